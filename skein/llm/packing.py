"""Packing examples into sequences by vector bin packing.

An example's demand is a vector (tokens, segments, loss-bearing tokens), a
sequence's capacity one as well. The dot-product heuristic fills one sequence at
a time: of the examples that still fit, it takes the one whose demand has the
largest dot product with what is left of the capacity. Where nothing fits any
more, the best example is cut to fit. Each task packs its own rows in windows,
so nothing is shuffled; what a window leaves over goes into the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.words import vocabulary_path, word_cache

MAX_TOKENS = 2048
MAX_SEGMENTS = 128
END_ID = 1
WINDOW_TOKENS = 4_000_000
WINDOW_DOCS = 8_192

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class _Pool:
    """Pieces of examples that wait: example, start, end; ``alive`` marks those left."""

    def __init__(self, items: list[tuple[int, int, int]], loss_from: dict[int, int]):
        self.loss_from = loss_from
        self.doc = np.array([x[0] for x in items], dtype=np.int64)
        self.start = np.array([x[1] for x in items], dtype=np.int64)
        self.end = np.array([x[2] for x in items], dtype=np.int64)
        self.bare = np.array([loss_from[x[0]] for x in items], dtype=np.int64)
        self.tokens = self.end - self.start
        self.loss = np.maximum(0, self.end - np.maximum(self.start, self.bare))

    def cut(self, at: int, take: int) -> tuple[int, int, int]:
        piece = (int(self.doc[at]), int(self.start[at]), int(self.start[at]) + take)
        self.start[at] += take
        self.tokens[at] -= take
        self.loss[at] = max(0, self.end[at] - max(self.start[at], self.bare[at]))
        return piece

    def give_back(self, piece: tuple[int, int, int], at: int) -> None:
        self.start[at] = piece[1]
        self.tokens[at] = self.end[at] - piece[1]
        self.loss[at] = max(0, self.end[at] - max(piece[1], self.bare[at]))

    def left(self) -> list[tuple[int, int, int]]:
        return [(int(d), int(s), int(e)) for d, s, e in zip(self.doc, self.start, self.end) if e > s]


def pack_window(items: list[tuple[int, int, int]], loss_from: dict[int, int], max_tokens: int, max_segments: int, max_loss: int, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Fill sequences from pieces (example, start, end); returns sequences and leftovers.

    A sequence ends at ``max_tokens``, or, where the segment or loss limit or the
    end of the data comes first, is cut back to the largest power of two, which
    needs no padding. Unless ``last``, packing stops when less than a sequence's
    tokens wait.
    """
    pool = _Pool(items, loss_from)
    waiting = int(pool.tokens.sum())
    out = []
    while waiting > 0 and (last or waiting >= max_tokens):
        room, seats, loss_room = max_tokens, max_segments, max_loss
        taken: list[tuple[tuple[int, int, int], int]] = []
        while room > 0 and seats > 0:
            live = pool.tokens > 0
            if not live.any():
                break
            score = pool.tokens * (room / max_tokens**2) + seats / max_segments**2 + pool.loss * (loss_room / max(1, max_loss) ** 2)
            fits = live & (pool.tokens <= room) & (pool.loss <= loss_room)
            if fits.any():
                at = int(np.argmax(np.where(fits, score, -1.0)))
                take = int(pool.tokens[at])
            else:
                # Up to its first loss-bearing token a piece costs no loss.
                longest = np.minimum(room, np.maximum(0, pool.bare - pool.start) + loss_room)
                at = int(np.argmax(np.where(live & (longest > 0), score, -1.0)))
                take = min(int(longest[at]), int(pool.tokens[at]))
                if take <= 0:
                    break
            piece = pool.cut(at, take)
            taken.append((piece, at))
            room, seats = room - take, seats - 1
            loss_room -= max(0, piece[2] - max(piece[1], int(pool.bare[at])))
        filled = max_tokens - room
        if filled == 0:
            raise ValueError("a sequence's limits leave no room for a single token")
        if room:
            surplus = filled - (1 << (filled.bit_length() - 1))
            while surplus > 0:
                (doc, start, end), at = taken.pop()
                if end - start > surplus:
                    taken.append(((doc, start, end - surplus), at))
                    start = end - surplus
                pool.give_back((doc, start, end), at)
                surplus -= end - start
        out.append([piece for piece, _ in taken])
        waiting = int(pool.tokens.sum())
    return out, pool.left()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut and place every row's tokens; one row for each piece.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    loss_tokens`` and, with ``with_ids``, the piece's ``ids``. A row's tokens are
    its ids and ``end_id``; those before ``loss_from_col`` (null: 0) bear no
    loss. A null text counts as empty and is one token long; null ids stay null;
    repeated rows are packed each; an empty table gives none; further columns
    are ignored. ``sequence_id`` is unique, not gapless.
    """
    path = vocabulary or vocabulary_path()
    loss = F.lit(0).cast("long") if loss_from_col is None else F.coalesce(F.col(loss_from_col).cast("long"), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), loss.alias("loss_from"))
    schema = _SCHEMA + (", ids array<long>" if with_ids else "")
    end_bytes = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path)
        base = TaskContext.get().partitionId() << 33
        number, count = 0, 0
        names: dict[int, int | None] = {}
        ids: dict[int, np.ndarray] = {}
        loss_from: dict[int, int] = {}
        items: list[tuple[int, int, int]] = []
        tokens = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, items, tokens
            full = []
            rest = []
            for doc, start, end in items:
                bare = loss_from[doc]
                while end - start >= max_tokens and max_loss >= max_tokens and max_segments >= 1:
                    full.append([(doc, start, start + max_tokens)])
                    start += max_tokens
                if end > start:
                    rest.append((doc, start, end))
            packed, items = pack_window(rest, loss_from, max_tokens, max_segments, max_loss, last)
            cols: list[list] = [[] for _ in range(9)]
            for sequence in full + packed:
                offset = 0
                for doc, start, end in sequence:
                    bare = loss_from[doc]
                    piece = ids[doc][start:end]
                    row = (names[doc], start, end - start, zlib.crc32(piece.tobytes()), len(ids[doc]), base + number, offset, max(0, end - max(start, bare)), piece)
                    for col, value in zip(cols, row):
                        col.append(value)
                    offset += end - start
                number += 1
            keep = {doc for doc, _, _ in items}
            for doc in [d for d in ids if d not in keep]:
                del ids[doc], names[doc], loss_from[doc]
            tokens = sum(end - start for _, start, end in items)
            if cols[0]:
                arrays = [pa.array(c, pa.int64()) for c in cols[:8]]
                fields = [x.split()[0] for x in _SCHEMA.split(", ")]
                if with_ids:
                    arrays.append(pa.array(cols[8], pa.list_(pa.int64())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, fields)

        for batch in batches:
            for name, text, bare in zip(batch.column("doc_id"), batch.column("text"), batch.column("loss_from")):
                found = np.frombuffer(cache.encode(text.as_py()) + end_bytes, dtype="<u4")
                names[count], ids[count], loss_from[count] = name.as_py(), found, bare.as_py()
                items.append((count, 0, len(found)))
                tokens += len(found)
                count += 1
                if tokens >= WINDOW_TOKENS or len(items) >= WINDOW_DOCS:
                    yield from flush(False)
        yield from flush(True)

    return rows.mapInArrow(run, schema)
