"""Periodic runs of words in texts, and the texts with the repetitions cut out.

Each text is a row of its own and settled within its task; texts never meet, so
nothing is shuffled. A task holds one text's words and the result rows of about
``BYTES_AT_ONCE`` bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.lyndon_runs import runs

BYTES_AT_ONCE = 8 << 20
LEAST = 12

_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words between blanks, tabs and line ends of ASCII."""
    return text.split()


def with_repeated_tail(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words; in every tenth document, by its id's checksum, those from some word on repeat a few of them.

    With h the checksum and g = h // 10, word i >= a becomes word a + (i - a) % p, where
    a = g % n and p = 1 + (n - a) // (3 + g % 8). A null id changes nothing.
    """
    words = text.split()
    n = len(words)
    if doc_id is None or not n:
        return words
    g, turn = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if turn:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % period] for k in range(n - a)]


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: each run's first period stays, unless another run drops it."""
    kept, at = [], 0
    for first, last in sorted((start + period, start + length) for start, length, period in found):
        if last > at:
            kept += words[at:first]
            at = last
    return kept + words[at:]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
    words: Callable[[int | None, bytes], list[bytes]] = words_of,
) -> DataFrame:
    """``id, n_words, runs, collapsed`` of every row.

    A run is a stretch of at least ``least`` words, and of at least two periods, in which
    words a period apart are equal, with no smaller period, and which no neighbouring word
    continues. ``runs`` has ``start, length, period`` of each (words count from 0), by start
    and then period. ``collapsed`` has the words that lie in no run behind its first
    period, joined by blanks. ``words`` makes the words of an id and a text in UTF-8.

    A null text is empty: no words, no runs, an empty result. Null ids and repeated rows
    are rows like others. An empty table gives an empty result; further columns, of
    whatever names, are ignored. Time is linear in a text's length, whatever it repeats.
    """
    id_type = docs.schema[id_col].dataType

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, lists, texts, held, first = batch.column(0), [], [], [], 0, 0
            for k, text in enumerate(batch.column(1)):
                own = words(ids[k].as_py(), text.as_py())
                found = runs(own, least)
                sizes.append(len(own))
                lists.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(kept_words(own, found)))
                held += len(texts[-1])
                if held >= BYTES_AT_ONCE or k + 1 == batch.num_rows:
                    columns = [ids.slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(lists, _RUN), pa.array(texts, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])
                    sizes, lists, texts, held, first = [], [], [], 0, k + 1

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(settle, f"id {id_type.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's number of runs, its longest one, and digests of all runs and of what is kept; of every tenth document with a repeated tail."""
    found = periodic_runs(docs, id_col, text_col, words=with_repeated_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    listed = found.select("*", longest.alias("_longest"))
    return listed.select(
        F.col(id_col),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.col2")).alias("start"),
        F.col("_longest.length").alias("length"),
        (-F.col("_longest.col3")).alias("period"),
        F.expr("_longest.length * 1000 div -_longest.col3").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
