"""Shard assignment by jump consistent hashing, with SQL functions only.

The jump function (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash
Algorithm") needs no ring table: a 64-bit linear congruential generator seeded
with the key tells at which shard counts the key moves. When a shard is
appended, a row either stays or goes to the new shard.

The generator works modulo 2^64. Spark's long arithmetic raises on overflow, so
a state is kept as two 32-bit halves and multiplied in parts that fit a long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published jump function.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

_LOW = MULTIPLIER & 0xFFFFFFFF
_HIGH = MULTIPLIER >> 32
_MASK32 = 0xFFFFFFFF
_MASK16 = 0xFFFF


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state; all intermediate values stay below 2^63."""
    low0, low1 = low.bitwiseAND(F.lit(_MASK16)), F.shiftright(low, 16)
    high0, high1 = high.bitwiseAND(F.lit(_MASK16)), F.shiftright(high, 16)
    upper = low1 * F.lit(_LOW)
    low_sum = low0 * F.lit(_LOW) + F.shiftleft(upper.bitwiseAND(F.lit(_MASK16)), 16) + F.lit(INCREMENT)
    cross = high0 * F.lit(_LOW) + F.shiftleft((high1 * F.lit(_LOW)).bitwiseAND(F.lit(_MASK16)), 16) + (low * F.lit(_HIGH)).bitwiseAND(F.lit(_MASK32))
    new_high = (F.shiftright(low_sum, 32) + F.shiftright(upper, 16) + cross).bitwiseAND(F.lit(_MASK32))
    return new_high, low_sum.bitwiseAND(F.lit(_MASK32))


def _halves(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_MASK32))


def scrambled(key: Column) -> Column:
    """The generator's first output for ``key``, as a signed long; one to one."""
    high, low = _step(*_halves(key))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _jumps(key: Column, shards: int) -> Column:
    """The last jump below ``shards`` (``at``) and the first one not below (``next``).

    The fold has as many rounds as there are shards, the most jumps that can
    happen; a key that is through passes the rest unchanged.
    """
    high, low = _halves(F.coalesce(key.cast("long"), F.lit(0).cast("long")))
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(long(-1).alias("at"), long(0).alias("next"), high.alias("high"), low.alias("low"))

    def jump(state: Column, _: Column) -> Column:
        new_high, new_low = _step(state["high"], state["low"])
        reach = (state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_high, 1) + 1).cast("double"))
        moved = F.struct(state["next"].alias("at"), F.floor(reach).cast("long").alias("next"), new_high.alias("high"), new_low.alias("low"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a long key. A null key counts as 0."""
    return _jumps(key, shards)["at"].cast("int")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 50_000) -> DataFrame:
    """Put every row into a shard by its key and number the rows of each shard.

    Returns id, ``size`` (UTF-8 bytes of the text, null: none, plus 8),
    ``text_crc32``, ``law`` ('key'), ``shard``, ``slot`` (gapless from 0 in the
    shard) and ``grown_shard`` (with one shard more).

    Slots follow the scrambled key, then size and checksum. A shard is not one
    task: the scrambled key is uniform, so its leading bits cut each shard into
    ``rows_per_task`` pieces, numbered apart and shifted by the sizes of the
    pieces before. Equal keys (null ones too, as key 0) share a shard; rows
    repeated in full get different slots in either order. An empty table gives an
    empty result; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = max(1, math.ceil(docs.count() / (shards * rows_per_task)))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _jumps(key, shards).alias("_jumps"),
        scrambled(key).alias("_order"),
    )
    # With one shard more, the next jump decides: it ends in the new shard or beyond.
    rows = rows.select(
        "*",
        F.col("_jumps.at").cast("int").alias("shard"),
        F.when(F.col("_jumps.next") == shards, F.lit(shards)).otherwise(F.col("_jumps.at")).cast("int").alias("grown_shard"),
    ).drop("_jumps").withColumn("_piece", F.shiftright(F.shiftrightunsigned("_order", 32) * F.lit(pieces).cast("long"), 32))
    # shards x pieces rows: about one for each rows_per_task input rows.
    counts = rows.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # _order as an unsigned number: negative longs are the upper half.
    inside = Window.partitionBy("shard", "_piece").orderBy(F.col("_order") < 0, "_order", "size", "text_crc32")
    numbered = rows.withColumn("_turn", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "_piece"]).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_start") + F.col("_turn") - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id") -> None:
    """Write all columns of ``docs`` under ``path``, one folder for each shard."""
    name = "shard" if "shard" not in {c.lower() for c in docs.columns} else "skein_shard"
    docs.withColumn(name, jump_hash(F.col(id_col), shards)).write.partitionBy(name).parquet(path)
