"""Removal of every long substring that occurs twice, by suffix sorting.

Which windows (substrings of ``length`` bytes) start in more than one place is
decided by suffix arrays, sorted by Lyndon grouping (``gsaca``). Three steps make
suffix sorting local:

1. Winnowing: every window has an anchor, the leftmost of its ``GRAM``-byte grams
   with the smallest hash. Equal windows have equal anchors, so a window can only
   recur where its anchor does. Blocks of texts report the hashes of their
   anchors and learn which of them occur twice anywhere.
2. The windows of such an anchor form one segment of text. A block merges equal
   segments, and the segments of equal anchors meet in a range.
3. A range trims each segment to what it has in common with any other one around
   the anchor and sorts the suffixes of the different strings that are left.
   Neighbours that agree on ``length`` bytes, and all windows of a string that
   came more than once, are repeats; their places go back to the blocks, which
   cut the bytes out.

No step depends on how often something occurs for its result; hash collisions
only make step 3 sort more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import blocks_for
from skein.llm.gsaca import suffix_array

LENGTH = 200
GRAM = 50
BLOCK_BYTES = 12_000_000
_BATCH = 1 << 20
_SORT_BATCH = 200_000

#: Multiplier of the rolling hash and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(factor: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        done = 1
        while done < n:  # doubling: the next part is the first times a power
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(factor, done, 1 << 64))
            done += more
        return out

    return table(_BASE), table(_INVERSE)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every ``gram`` bytes."""
    size = 1 << max(20, int(len(data)).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbouring keys."""
    done, out = 1, keys
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(data: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in a run of texts: hash, first and last window start and place of each.

    ``ends`` are the texts' ends in ``data``; no window crosses one. The starts of
    an anchor's windows are neighbours, because anchors never move backwards.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    array = np.frombuffer(data, dtype=np.uint8)
    h = _gram_hashes(array, gram)
    # Leading bits of the hash, then the place: the leftmost of equal hashes wins.
    bits = max(1, int(len(h)).bit_length())
    keys = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    chosen = (_sliding_min(keys, length - gram + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    inside = np.zeros(len(data) - length + 1, dtype=bool)
    begin = 0
    for end in ends.tolist():
        if end - begin >= length:
            inside[begin : end - length + 1] = True
        begin = end
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    chosen = chosen[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(starts) != 1)]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return h[chosen[new]], starts[new], starts[last], chosen[new]


def _texts(table: pa.Table) -> tuple[list[bytes], list[int], list[list[int]]]:
    """A block's distinct texts in the order of their digests, how often each occurs, and its rows."""
    rows: dict[bytes, list[int]] = {}
    for i, t in enumerate(table.column("text")):
        rows.setdefault(t.as_py() or b"", []).append(i)
    order = sorted(rows, key=lambda t: (hashlib.sha256(t).digest(), t))
    return order, [len(rows[t]) for t in order], [rows[t] for t in order]


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _BATCH):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _all_anchors(texts: list[bytes], length: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By batch: first text, data, offsets of its texts, and the anchors."""
    for at, end in _batches(texts):
        part = texts[at:end]
        data = b"".join(part)
        ends = np.cumsum([len(t) for t in part])
        yield at, data, np.concatenate([[0], ends]), *anchors(data, ends, length)


def _ask(table: pa.Table, ranges: int, length: int) -> pa.Table:
    """The block's anchor hashes by range, sorted, and which of them it has twice."""
    texts, times, _ = _texts(table)
    found, doubled = [], []
    for at, _, offsets, h, first, _, _ in _all_anchors(texts, length):
        found.append(h)
        copies = np.array(times[at : at + len(offsets) - 1])
        doubled.append(copies[np.searchsorted(offsets, first, side="right") - 1] > 1)
    hashes = np.concatenate([*found, np.zeros(0, np.uint64)])
    several = np.concatenate([*doubled, np.zeros(0, bool)])
    distinct, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[back[several]] = True
    home = (distinct % np.uint64(ranges)).astype(np.int64)
    names, asked, flags = [], [], []
    for r in np.unique(home).tolist():
        own = home == r
        names.append(r)
        asked.append(distinct[own].tobytes())
        flags.append(np.packbits(twice[own]).tobytes())
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(names), pa.int64()), "range": pa.array(names, pa.int64()), "hashes": pa.array(asked, pa.binary()), "twice": pa.array(flags, pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """For each block's hashes, whether they occur twice over all blocks."""
    asked = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("hashes")]
    twice = [np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=len(h)).astype(bool) for x, h in zip(table.column("twice"), asked)]
    distinct, back, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
    repeated = counts > 1
    repeated[back[np.concatenate(twice)]] = True
    said = repeated[back]
    out, at = [], 0
    for h in asked:
        out.append(h[said[at : at + len(h)]].tobytes())
        at += len(h)
    return pa.table({"block": table.column("block"), "repeated": pa.array(out, pa.binary())})


def _segments(rows: pa.Table, answers: pa.Table, spans: int, length: int) -> pa.Table:
    """The block's segments at repeated anchors, merged, with all their places (text, start)."""
    texts, times, _ = _texts(rows)
    repeated = np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x.as_py(), dtype=np.uint64) for x in answers.column("repeated")]]))
    found: dict[tuple[int, bytes, int], list[int]] = {}
    if len(repeated):
        for at, data, offsets, h, first, last, middle in _all_anchors(texts, length):
            place = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
            hit = repeated[place] == h
            own = np.searchsorted(offsets, first, side="right") - 1
            for anchor, s, e, m, t in zip(h[hit].tolist(), first[hit].tolist(), last[hit].tolist(), middle[hit].tolist(), own[hit].tolist()):
                found.setdefault((anchor, data[s : e + length], m - s), []).extend((at + t, s - int(offsets[t])))
    block = rows.column("block")[0].as_py() if rows.num_rows else 0
    n = [sum(times[t] for t in places[::2]) for places in found.values()]
    return pa.table({
        "block": pa.array([block] * len(found), pa.int64()),
        "range": pa.array([anchor % spans for anchor, _, _ in found], pa.int64()),
        "anchor": pa.array(np.array([anchor for anchor, _, _ in found], dtype=np.uint64).view(np.int64), pa.int64()),
        "segment": pa.array([s for _, s, _ in found], pa.binary()),
        "middle": pa.array([m for _, _, m in found], pa.int64()),
        "n": pa.array(n, pa.int64()),
        "places": pa.array([np.array(p, dtype="<i4").tobytes() for p in found.values()], pa.binary()),
    })


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some different segments, which of its windows occur in another place among them."""
    sizes = np.array([len(s) for s in segments])
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b"\0".join([*segments, b""]), dtype=np.uint8)
    text = data.astype(np.int64) + 2
    text[bounds[1:] - 1] = 1  # between segments
    order = np.array(suffix_array([*text.tolist(), 0]), dtype=np.int64)
    valid = np.zeros(len(data) + 1, dtype=bool)
    for begin, size in zip(bounds.tolist(), sizes.tolist()):
        valid[begin : begin + size - length + 1] = True
    order = order[valid[order]]
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    repeat = np.zeros(len(data), dtype=bool)
    for at in range(0, len(order) - 1, 20_000):
        a, b = order[at : at + 20_000], order[at + 1 : at + 20_001]
        a = a[: len(b)]
        near = np.flatnonzero((windows[a, :8] == windows[b, :8]).all(axis=1))
        a, b = a[near], b[near]
        same = (windows[a] == windows[b]).all(axis=1)
        repeat[a[same]] = True
        repeat[b[same]] = True
    return [repeat[begin : begin + size - length + 1] for begin, size in zip(bounds.tolist(), sizes.tolist())]


def _runs(mask: np.ndarray) -> np.ndarray:
    """Pairs (first, last) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return np.column_stack([edges[::2], edges[1::2] - 1])


def _common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


def _shared(parts: list[bytes]) -> list[int]:
    """For each string, its longest common prefix with any of the others."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _sort_range(table: pa.Table, length: int) -> pa.Table:
    """Find the repeated windows of a range's segments and their places."""
    columns = [table.column(c).to_pylist() for c in ("anchor", "segment", "middle", "n")]
    groups: dict[int, dict[tuple[bytes, int], int]] = {}
    for a, s, m, k in zip(*columns):
        own = groups.setdefault(a, {})
        own[s, m] = own.get((s, m), 0) + k
    whole = lambda s: np.array([[0, len(s) - length]])
    runs: dict[tuple[int, bytes], np.ndarray] = {}
    batch: list[bytes] = []
    owners: list[tuple[int, list[tuple[bytes, int]]]] = []
    size = 0

    def settle() -> None:
        for (a, users), mask in zip(owners, repeated_windows(batch, length) if batch else []):
            if mask.any():
                for s, begin in users:
                    runs.setdefault((a, s), _runs(mask) + begin)
        batch.clear()
        owners.clear()

    for a, own in groups.items():
        runs.update(((a, s), whole(s)) for (s, _), k in own.items() if k > 1)
        if len(own) == 1 or all(k > 1 for k in own.values()):
            continue
        rows = list(own)
        right = _shared([s[m:] for s, m in rows])
        left = _shared([s[:m][::-1] for s, m in rows])
        trimmed: dict[bytes, list[tuple[bytes, int]]] = {}
        times: dict[bytes, int] = {}
        for (s, m), r, b in zip(rows, right, left):
            if b + r >= length:
                part = s[m - b : m + r]
                trimmed.setdefault(part, []).append((s, m - b))
                times[part] = times.get(part, 0) + own[s, m]
        for part, users in trimmed.items():
            if times[part] > 1:
                for s, begin in users:
                    runs.setdefault((a, s), whole(part) + begin)
        if len(trimmed) > 1 and any((a, s) not in runs for users in trimmed.values() for s, _ in users):
            batch.extend(trimmed)
            owners.extend((a, users) for users in trimmed.values())
            size += sum(map(len, trimmed))
            if size >= _SORT_BATCH:
                settle()
                size = 0
    settle()
    blocks, places, spans = [], [], []
    for a, s, b, p in zip(columns[0], columns[1], table.column("block").to_pylist(), table.column("places")):
        if (a, s) in runs:
            blocks.append(b)
            places.append(p.as_py())
            spans.append(runs[a, s].astype("<i4").tobytes())
    return pa.table({"block": pa.array(blocks, pa.int64()), "places": pa.array(places, pa.binary()), "spans": pa.array(spans, pa.binary())})


def _cut(rows: pa.Table, found: pa.Table, length: int) -> pa.Table:
    """Each row of the block with the spans of bytes to remove."""
    texts, times, own = _texts(rows)
    begins: list[list[np.ndarray]] = [[] for _ in texts]
    lasts: list[list[np.ndarray]] = [[] for _ in texts]
    for p, s in zip(found.column("places"), found.column("spans")):
        runs = np.frombuffer(s.as_py(), dtype="<i4").reshape(-1, 2).astype(np.int64)
        for t, start in np.frombuffer(p.as_py(), dtype="<i4").reshape(-1, 2).tolist():
            begins[t].append(runs[:, 0] + start)
            lasts[t].append(runs[:, 1] + start)
    ids = rows.column("id").to_pylist()
    order: list[int] = []
    out: list[list] = [[] for _ in range(5)]
    for text, where, b, e in zip(texts, own, begins, lasts):
        spans: list[int] = []
        if b:
            change = np.zeros(len(text) + 1, dtype=np.int32)
            np.add.at(change, np.concatenate(b), 1)
            np.add.at(change, np.concatenate(e) + length, -1)
            runs = _runs(np.cumsum(change[:-1]) > 0)
            runs[:, 1] += 1
            spans = runs.reshape(-1).tolist()
        kept, at = [], 0
        for begin, end in zip(spans[::2], spans[1::2]):
            kept.append(text[at:begin])
            at = end
        kept.append(text[at:])
        rest = b"".join(kept)
        order += where
        for i in where:
            for column, value in zip(out, (ids[i], len(text), len(text) - len(rest), spans, rest)):
                column.append(value)
    if "carry" in rows.column_names:
        # A null text that loses nothing stays null.
        known = rows.column("text").take(pa.array(order, pa.int64())).is_valid().to_pylist()
        new = [b.decode("utf-8", "ignore") if k else None for b, k in zip(out[4], known)]
        return pa.table({"carry": rows.column("carry").take(pa.array(order, pa.int64())), "text": pa.array(new, pa.string())})
    return pa.table({"id": pa.array(out[0], pa.int64()), "n_bytes": pa.array(out[1], pa.int64()), "n_removed": pa.array(out[2], pa.int64()), "n_spans": pa.array([len(s) // 2 for s in out[3]], pa.int64()), "spans": pa.array(out[3], pa.list_(pa.int64())), "kept": pa.array(out[4], pa.binary())})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Cut every byte that lies in a ``length``-byte string which starts in two places.

    Texts are UTF-8 bytes (null: empty); strings do not cross texts, may overlap
    and are judged on the input. Returns id, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``spans`` (begin, end, begin, end, ... in bytes) and ``kept``,
    the remaining bytes. Copies of a text repeat it, so of ``length`` bytes or
    more nothing stays. Null ids and repeated rows stay; an empty table gives
    none; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return _cut_rows(rows, length, block_bytes).withColumnRenamed("id", id_col)


def substring_cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns and what ``substring_dedup`` keeps as the text.

    Where a cut goes through a character, the rest of that character goes too.
    """
    carry = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("carry")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), carry)
    cut = _cut_rows(rows, length, block_bytes)
    return cut.select([F.col("text").alias(c) if c == text_col else F.col("carry")[c].alias(c) for c in docs.columns])


def _cut_rows(rows: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """The cuts of rows with ``id`` and ``text``; with ``carry``, that and the new texts."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    blocks = blocks_for(rows, "text", block_bytes)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(blocks, "block")
    by_block = rows.groupBy("block")
    asked = by_block.applyInArrow(lambda t: _ask(t, blocks, length), "block long, range long, hashes binary, twice binary")
    answered = asked.groupBy("range").applyInArrow(_answer, "block long, repeated binary")
    segments = by_block.cogroup(answered.groupBy("block")).applyInArrow(
        lambda left, right: _segments(left, right, 8 * blocks, length), "block long, range long, anchor long, segment binary, middle long, n long, places binary"
    )
    found = segments.groupBy("range").applyInArrow(lambda t: _sort_range(t, length), "block long, places binary, spans binary")
    schema = T.StructType.fromDDL("id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")
    if "carry" in rows.columns:
        schema = T.StructType([rows.schema["carry"], T.StructField("text", T.StringType())])
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda left, right: _cut(left, right, length), schema)
