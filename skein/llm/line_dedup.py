"""Line deduplication by an exact set-similarity join.

Lines are sets of words. Words are ordered by rarity; two sets of Jaccard
similarity t or more share one of their rarest words (the prefix filter), have
sizes within t of each other (length), and the places of a shared prefix word
leave room for the overlap (position). 64 to 256 parities of each set bound the
difference once more. What is left is verified on the words of the texts.

A line goes if any earlier line is similar. All similar pairs are found; classes and
numbers of links come from them (``line_join``).

Equal sets are merged by 128 bits; prefix words are named by 32-bit hashes, which may
bring sets together but never link them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import line_join
from skein.llm.common import drop_path, materialise
from skein.llm.line_sets import Sets, Words, slices
from skein.plans.components import connected_components
from skein.plans.hot import hot_join

THRESHOLD = 0.8
COUNTERS = 1 << 20
COUNT_PARTS = 32
WANTED_BITS = 1 << 25
HOT = 4_096
ENTRIES_AT_ONCE = 400_000
MEETINGS_AT_ONCE = 40_000
SPREAD = 2654435761
_FIRST_ID = -(2**63)
_SKETCH = ["s0", "s1", "s2", "s3"]
_LINKS = "array<struct<number: long, class_id: long, class_number: long, n_links: long>>"
_BLOBS = "home int, n long, more long, columns binary, tokens binary, texts binary"
_NAMES = [x.split()[0] for x in _BLOBS.split(", ")]


def prefix_sizes(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of its rarest words a set of n shares one of with any similar set."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def similar(a: set, b: set, threshold: float) -> bool:
    both = len(a & b)
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def _summed(rows: DataFrame, size: int, kind: type, take: Callable[[np.ndarray, pa.RecordBatch], None], both: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A table of ``size`` numbers that each task fills and that parts of are put together in tasks."""
    width = -(-size // COUNT_PARTS)

    def packed(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([zstandard.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())], ["part", "found"])

    def unpacked(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        for part, found in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield part, np.frombuffer(zstandard.decompress(found.as_py()), kind)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * COUNT_PARTS, kind)
        for batch in batches:
            take(total, batch)
        yield packed({k: x for k, x in enumerate(total.reshape(COUNT_PARTS, width)) if x.any()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, found in unpacked(batch):
                total[part] = both(total[part], found) if part in total else found
        yield packed(total)

    schema = "part long, found binary"
    out = np.zeros((COUNT_PARTS, width), kind)
    for part, found in unpacked(rows.mapInArrow(fill, schema).repartition(COUNT_PARTS, "part").mapInArrow(merge, schema).toArrow()):
        out[part] = found
    return out.reshape(-1)[:size]


def tally(rows: DataFrame, classes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """How often each of ``size`` classes occurs: a bounded table."""

    def take(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for found in classes(batch):
            np.add.at(total, found, 1)

    return _summed(rows, size, np.int64, take, np.add)


def word_counts(rows: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """How often the words of each of ``counters`` hash classes occur, over all texts."""

    def words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, texts, _ in slices(batch.column("id"), batch.column("text"), batch.column("mark")):
            yield (Words.hashes_of(texts) % np.uint64(counters)).astype(np.int64)

    return np.minimum(tally(rows, words, counters), 2**31 - 1).astype(np.int32)


def bit_table(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bounded table of the numbers under ``bits`` (a power of two) that ``column`` holds, packed."""

    def take(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total[batch.column(0).to_numpy()] = True

    return np.packbits(_summed(rows.select(column), bits, np.bool_, take, np.logical_or))


def _position(ids: np.ndarray, numbers: np.ndarray, bits: int) -> np.ndarray:
    return (ids ^ (numbers * SPREAD >> 11)) & (bits - 1)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and each list's length."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _numbers(batch: pa.RecordBatch, *names: str) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy() for n in names}


def _deal_entries(batches: Iterator[pa.RecordBatch], hot: np.ndarray, threshold: float, ranges: int) -> Iterator[pa.RecordBatch]:
    """Each set's entries, dealt by group; a row for each range and some thousand sets."""
    for batch in batches:
        own = _numbers(batch, "sid", "size", *_SKETCH)
        tokens, counts = _flat(batch.column("prefix"))
        owner, group, place, second = line_join.entries(tokens.view(np.uint32), np.cumsum(counts) - counts, counts, prefix_sizes(own["size"], threshold), hot)
        home = line_join.homes(group, ranges=ranges)
        order = np.lexsort((group, home))
        owner, home = owner[order], home[order]
        columns = {k: x[owner] for k, x in own.items()} | {"group": group[order], "place": place[order], "second": second[order]}
        cuts = np.flatnonzero(np.diff(home, prepend=-1))
        ends = np.append(cuts[1:], len(home))
        blobs = [line_join.pack_columns({k: x[a:b] for k, x in columns.items()}, line_join.ENTRY) for a, b in zip(cuts, ends)]
        empty = pa.array([b""] * len(cuts), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(home[cuts], pa.int32()), pa.array(ends - cuts, pa.int64()), pa.array(np.zeros(len(cuts), np.int64)), pa.array(blobs, pa.binary()), empty, empty], _NAMES)


def _find_candidates(batches: Iterator[pa.RecordBatch], threshold: float, chunk: int) -> Iterator[pa.RecordBatch]:
    parts = [line_join.unpack_columns(blob.as_py(), n, line_join.ENTRY) for batch in batches for n, blob in zip(batch.column("n").to_pylist(), batch.column("columns"))]
    if parts:
        found = line_join.candidates({k: np.concatenate([p[k] for p in parts]) for k in line_join.ENTRY}, threshold, chunk)
        names = ["sid", "group", "place", "second", "m"]
        found["group"] = found["group"].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[n].astype(np.int64)) for n in names], names)


def _deal_meetings(batches: Iterator[pa.RecordBatch], kinds: dict[str, str], chunk: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Candidates, with their texts where ``kinds`` has these, dealt by group and pair of chunks."""
    with_texts = "bytes" in kinds
    for batch in batches:
        own = _numbers(batch, *(k for k in kinds if k not in ("tokens", "bytes")))
        tokens, counts = _flat(batch.column("prefix"))
        first = np.cumsum(counts) - counts
        meetings = batch.column("meetings")
        inner, times = meetings.flatten(), np.diff(meetings.offsets.to_numpy())
        m = dict(zip(("group", "place", "second", "m"), (inner.field(k).to_numpy(zero_copy_only=False) for k in range(4))))
        row = np.repeat(np.arange(len(times)), times)
        chunks = np.where(m["m"] > chunk, -(-m["m"] // chunk), 1)
        at = np.repeat(np.arange(len(row)), chunks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        chunk_of = line_join.homes(own["sid"][row], ranges=1 << 30) % chunks
        a, b = np.minimum(chunk_of[at], other), np.maximum(chunk_of[at], other)
        group = m["group"][at].view(np.uint64)
        home = line_join.homes(group, a, b, ranges=ranges)
        order = np.lexsort((row[at], home))
        texts = batch.column("line").to_pylist() if with_texts else []
        out: list[list] = [[] for _ in _NAMES]
        for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            if not len(part):
                continue
            rows, member = np.unique(row[at[part]], return_inverse=True)
            entry = {"group": group[part], "a": a[part], "b": b[part], "own": chunk_of[at[part]], "member": member} | {k: m[k][at[part]] for k in ("place", "second", "m")}
            lines = [texts[r] for r in rows.tolist()] if with_texts else []
            sets = {k: x[rows] for k, x in own.items()} | {"tokens": counts[rows], "bytes": np.array([len(x) for x in lines])}
            packed = line_join.pack_columns(entry, line_join.MEETING)
            kept = tokens[line_join.spans(first[rows], counts[rows])].astype("<i4").tobytes()
            row_of = (int(home[part[0]]), len(part), len(rows), len(packed).to_bytes(8, "little") + packed + line_join.pack_columns(sets, kinds), zstandard.compress(kept, 1), zstandard.compress(b"".join(lines), 1))
            for column, value in zip(out, row_of):
                column.append(value)
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], _NAMES)


def _meet(batches: Iterator[pa.RecordBatch], kinds: dict[str, str], threshold: float) -> Iterator[pa.RecordBatch]:
    """What the sets of one range find in their groups."""
    entries, members, tokens, texts = [], [], [], []
    seen: dict[int, int] = {}
    for batch in batches:
        for n, more, columns, words, lines in zip(batch.column("n").to_pylist(), batch.column("more").to_pylist(), *(batch.column(c) for c in _NAMES[3:])):
            columns = columns.as_py()
            cut = 8 + int.from_bytes(columns[:8], "little")
            e = line_join.unpack_columns(columns[8:cut], n, line_join.MEETING)
            own = line_join.unpack_columns(columns[cut:], more, kinds)
            # A set comes with each of its blobs and is taken once.
            before = len(seen)
            number = np.array([seen.setdefault(x, len(seen)) for x in own["sid"].tolist()])
            new = np.flatnonzero(number >= before)
            e["member"] = number[e["member"]]
            entries.append(e)
            if "bytes" in kinds:
                ends, data = np.cumsum(own["bytes"].astype(np.int64)), zstandard.decompress(lines.as_py())
                texts += [data[ends[k] - own["bytes"][k] : ends[k]] for k in new.tolist()]
            counts = own["tokens"].astype(np.int64)
            tokens.append(np.frombuffer(zstandard.decompress(words.as_py()), "<i4")[line_join.spans((np.cumsum(counts) - counts)[new], counts[new])])
            members.append({k: x[new] for k, x in own.items()})
    if entries:
        met, sets = ({k: np.concatenate([p[k] for p in parts]) for k in parts[0]} for parts in (entries, members))
        words = np.concatenate(tokens)
        found = line_join.Verifier(sets, words, texts, threshold) if "bytes" in kinds else line_join.Pruner(sets, words, threshold)
        found.run(met)
        yield found.found()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, counters: int = COUNTERS, wanted_bits: int = WANTED_BITS, hot: int = HOT, chunk: int = line_join.CHUNK) -> DataFrame:
    """Remove every line that is similar to an earlier one; one row for each document.

    Lines end at line feeds. A line is the set of its words (split at ASCII white
    space, A-Z lowered); lines without words always stay. Similar: Jaccard
    similarity of ``threshold`` or more. Earlier: by id (nulls first), line number,
    then a hash of the row or set; lines that go themselves count as earlier ones too.
    Returns id, ``n_lines``, ``n_removed``, ``removed`` (line numbers), ``kept`` (the
    other lines in UTF-8) and ``links``: each line that has an equal or similar one
    somewhere, with its class (lines that chains of such pairs join, named by id and
    number of its first line) and ``n_links``, how many different sets are similar to
    it. Null and empty texts have no lines; of rows repeated
    in full one keeps what stays; an empty table gives none; further columns are
    ignored.

    Rarity is counted over all texts, by hash class: ``counters`` numbers, a bounded
    table that is sent to the tasks; a class that occurs once joins nothing. The order
    of words only has to be the same everywhere for the result to be exact. Words of a
    class in over ``hot`` prefixes are joined in pairs; groups of over ``chunk`` sets
    are verified by pairs of chunks. ``wanted_bits`` (a power of two) sizes the tables
    that spare most unwanted lines a shuffle.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    own = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).cast("binary").alias("text"))
    rows = own.select(F.coalesce("own", F.lit(_FIRST_ID)).alias("id"), "text", F.xxhash64("own", "text").alias("mark"))
    counts = share(word_counts(rows, counters))

    def find_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, marks in slices(*(batch.column(n) for n in ("id", "text", "mark"))):
                found = Sets.of(texts, counts.value)
                if not len(found.starts):
                    continue
                key, key2 = found.names()
                row_id, mark = (np.array(x, dtype=np.int64)[found.rows] for x in (ids, marks))
                order = np.lexsort((mark, found.numbers, row_id, key2, key))
                k, k2 = key[order], key2[order]
                heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])]))
                by_line = np.argsort(order[heads])
                first = order[heads][by_line]
                place = np.arange(len(found.hashes)) - np.repeat(found.starts, found.sizes)
                # The prefix, and a word more for joining in pairs; a set's further lines in the slice have none.
                prefix = np.minimum(prefix_sizes(found.sizes, threshold) + 1, found.sizes)
                held = np.zeros(len(found.starts), dtype=bool)
                held[first] = True
                prefix[~held] = 0
                inside = place < np.repeat(prefix, found.sizes)
                h = found.hashes[inside]
                token = np.maximum(h & np.uint64(0xFFFFFFFF), np.uint64(1)).astype(np.uint32).view(np.int32)
                token = np.where(counts.value[(h % np.uint64(counters)).astype(np.int64)] > 1, token, 0).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)
                sketches = [np.where(held, x, 0) for x in found.sketches()]
                columns = [key, key2, row_id, found.numbers, mark, np.where(held, found.sizes, 0), *sketches]
                names = ["key", "key2", "id", "number", "mark", "size", *_SKETCH, "prefix"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(offsets), pa.array(token))], names)

    schema = "key long, key2 long, id long, number long, mark long, size long, s0 long, s1 long, s2 long, s3 long, prefix array<int>"
    all_lines, _ = materialise(rows.mapInArrow(find_sets, schema), "line-rows")
    one = F.min(F.when(F.col("size") > 0, F.struct("id", "number", "mark", "size", *_SKETCH, "prefix")))
    first = all_lines.groupBy("key", "key2").agg(one.alias("s"), F.count(F.lit(1)).alias("times"))
    # Numbers are written with the sets, so each set keeps its own.
    sets, _ = materialise(first.select(F.monotonically_increasing_id().alias("sid"), "key", "key2", "times", "s.*"), "line-sets")

    def prefix_words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield (_flat(batch.column(0))[0].view(np.uint32) % np.uint32(counters)).astype(np.int64)

    in_prefix = tally(sets.select("prefix"), prefix_words, counters)
    often = share(in_prefix > hot)
    ranges = max(1, -(-int(in_prefix.sum()) // ENTRIES_AT_ONCE))
    dealt = sets.select("sid", "size", *_SKETCH, "prefix").mapInArrow(lambda b: _deal_entries(b, often.value, threshold, ranges), _BLOBS)
    met = dealt.repartitionById(ranges, F.col("home")).mapInArrow(lambda b: _find_candidates(b, threshold, chunk), "sid long, group long, place long, second long, m long")
    met, met_path = materialise(met, "line-candidates")

    copies_of = F.when(F.col("m") > chunk, F.ceil(F.col("m") / chunk)).otherwise(1)

    def together(met: DataFrame, known: DataFrame, columns: list[str], what: str) -> tuple[DataFrame, str, int]:
        """The sets of some entries with all of these, and how many entries all chunks have."""
        n = met.agg(F.coalesce(F.sum(copies_of), F.lit(0)).alias("n")).first()["n"]
        by_set = met.groupBy("sid").agg(F.collect_list(F.struct("group", "place", "second", "m")).alias("meetings"))
        return *materialise(known.select("sid", *columns, "prefix").join(by_set, "sid"), what), max(1, -(-int(n) // MEETINGS_AT_ONCE))

    sketched, sketched_path, parts = together(met, sets, ["id", "number", "mark", "size", *_SKETCH], "line-sketched")
    dealt = sketched.mapInArrow(lambda b: _deal_meetings(b, line_join.SKETCHED, chunk, parts), _BLOBS)
    pruned = dealt.repartitionById(parts, F.col("home")).mapInArrow(lambda b: _meet(b, line_join.SKETCHED, threshold), "sid long, group long, place long, second long, m long")
    pruned, pruned_path = materialise(pruned.distinct(), "line-pruned")
    wanted, wanted_path, parts2 = together(pruned, sketched, ["id", "number", "mark"], "line-wanted")
    place = F.col("id").bitwiseXOR(F.shiftright(F.col("number") * SPREAD, 11)).bitwiseAND(F.lit(wanted_bits - 1))
    fetched = share(bit_table(wanted.select(place.alias("at")), "at", wanted_bits))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(fetched.value).view(bool)
        for batch in batches:
            for ids, texts, marks in slices(*(batch.column(n) for n in ("id", "text", "mark"))):
                lines = [t.split(b"\n") for t in texts]
                n = np.array([len(x) for x in lines])
                row = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                take = np.flatnonzero(bits[_position(np.array(ids, dtype=np.int64)[row], number, wanted_bits)])
                own = [lines[r][k] for r, k in zip(row[take].tolist(), number[take].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[row[take]]), pa.array(np.array(marks, np.int64)[row[take]]), pa.array(number[take]), pa.array(own, pa.binary())], ["id", "mark", "number", "line"])

    lines = rows.mapInArrow(fetch, "id long, mark long, number long, line binary").groupBy("id", "mark", "number").agg(F.first("line").alias("line"))
    dealt = wanted.join(lines, ["id", "mark", "number"]).mapInArrow(lambda b: _deal_meetings(b, line_join.TEXTS, chunk, parts2), _BLOBS)
    verified = dealt.repartitionById(parts2, F.col("home")).mapInArrow(lambda b: _meet(b, line_join.TEXTS, threshold), "sid long, links long, lost boolean, root long")
    verified, _ = materialise(verified, "line-links")
    for path in (met_path, sketched_path, pruned_path, wanted_path):
        drop_path(spark, path)
    degree = verified.groupBy("sid").agg(F.sum("links").alias("n_links"), F.max("lost").alias("lost"))
    linked, _ = materialise(sets.select("sid", "id", "number").join(degree, "sid").join(connected_components(verified, "sid", "root").withColumnRenamed("node", "sid"), "sid"), "line-linked")
    heads = linked.groupBy("component").agg(F.min(F.struct("id", "number")).alias("head"), F.count(F.lit(1)).alias("n"))
    label = hot_join(linked, heads, ["component"], "n", linked.count(), F.col("sid")).select("sid", "n_links", F.col("head.id").alias("class_id"), F.col("head.number").alias("class_number"))
    members = sets.select("sid", "key", "key2", "id", "number", "times").join(label, "sid", "left").where("times > 1 OR n_links > 0")
    own_class = [F.coalesce(F.col(f"class_{c}"), F.col(c)).alias(f"class_{c}") for c in ("id", "number")]
    members, _ = materialise(members.select("key", "key2", "times", *own_class, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "line-members")
    lines = all_lines.select("id", "mark", "number", "key", "key2")
    named = F.struct("number", F.when(F.col("class_id") != _FIRST_ID, F.col("class_id")).alias("class_id"), "class_number", "n_links")
    in_rows = hot_join(lines, members, ["key", "key2"], "times", all_lines.count(), F.hash("id", "mark")).groupBy("id", "mark").agg(F.sort_array(F.collect_set(named)).alias("links"))
    stays = sets.select("sid", "id", "number", "mark").join(linked.where("lost").select("sid"), "sid", "left_anti").groupBy("id", "mark").agg(F.collect_set("number").alias("stays"))
    copies = own.select("own", F.coalesce("own", F.lit(_FIRST_ID)).alias("id"), "text", F.xxhash64("own", "text").alias("mark"))
    copies = copies.withColumn("copy", F.expr("row_number() OVER (PARTITION BY id, mark ORDER BY mark)"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, copy, stays in zip(batch.column("text"), batch.column("copy").to_pylist(), batch.column("stays")):
                text = text.as_py() or b""
                lines = text.split(b"\n") if text else []
                keep = set(stays.as_py() or ()) if copy == 1 else set()
                drop = [k for k, x in enumerate(lines) if k not in keep and x and not x.isspace()]
                gone = set(drop)
                for column, value in zip(out, (len(lines), len(drop), drop, b"\n".join([x for k, x in enumerate(lines) if k not in gone]))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("links"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], ["own", "links", "n_lines", "n_removed", "removed", "kept"])

    told = copies.join(stays, ["id", "mark"], "left").join(in_rows, ["id", "mark"], "left").select("own", F.coalesce("links", F.array().cast(_LINKS)).alias("links"), "text", "copy", "stays")
    return told.mapInArrow(cut, f"own long, links {_LINKS}, n_lines long, n_removed long, removed array<long>, kept binary").withColumnRenamed("own", id_col)
