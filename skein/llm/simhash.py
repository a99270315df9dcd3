"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a value in common that lies
within r/2 bits of either. So every distinct fingerprint emits all values within
half the radius (65 for radius 2); whatever meets on a value is linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import materialise
from skein.plans.components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 2
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text as an unsigned number.

    A-Z are lowered; words are runs of anything but ASCII white space, which is
    what ``bytes.split`` gives; shingles count as often as they occur. A text of
    fewer words is one shingle, a text of none has fingerprint 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, ``fp`` (the fingerprint's bits as a signed long) and ``text_sha256`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks.view(np.int64)), batch.column("text_sha256")], ["id", "fp", "text_sha256"])

    return rows.mapInArrow(run, "id long, fp long, text_sha256 string")


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that connect all distinct ``fp`` at most ``radius`` bits apart.

    All members of a ball (one value's group) are within the radius of each
    other, so a chain along the group connects what all its pairs would; a ball
    holds at most as many distinct fingerprints as it has values. Links are
    verified; a pair beyond the radius cannot come up for an even radius.
    """
    half = (radius + 1) // 2
    masks = [0] + [sum(1 << b for b in bits) for n in range(1, half + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    values = F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: F.col("fp").bitwiseXOR(m))
    balls = fps.select("fp").distinct().select("fp", F.explode(values).alias("value"))
    before = F.lag("fp").over(Window.partitionBy("value").orderBy("fp"))
    pairs = balls.select(F.col("fp").alias("a"), before.alias("b")).where("b is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """id, ``fp``, ``text_sha256`` and ``component_id`` of every row.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits. Rows with equal fingerprints are one node, so
    copies are never paired. Null and empty texts have fingerprint 0 and link
    like any other; null ids are never the smallest (a group of null ids only
    gets null). Repeated rows stay repeated; an empty table gives none; further
    columns are ignored.
    """
    marks, _ = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = marks.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(ball_links(nodes, radius), "a", "b")
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = placed.join(least, "root").select("fp", "component_id")
    return marks.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "text_sha256", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """id, ``fingerprint`` (16 lower-case hex digits) and ``component_id``."""
    found = simhash_groups(docs, id_col, text_col, radius, shingle)
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component stays: the smallest id, then the smallest digest.

    Rows repeated with the same id and text stay together (exact deduplication
    is the operator for those).
    """
    found = simhash_groups(docs, id_col, text_col, radius, shingle)
    keys = found.groupBy("component_id").agg(F.min(F.struct(F.col(id_col).alias("id"), "text_sha256")).alias("k")).select("k.id", "k.text_sha256")
    digest = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return docs.join(keys, docs[id_col].eqNullSafe(keys["id"]) & (digest == keys["text_sha256"]), "left_semi")
