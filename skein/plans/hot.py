"""Equi-joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1_000
LEAST_ROWS = 64
SALTS = 64


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, spread: Column, how: str = "inner", hot_keys: int = HOT_KEYS, salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key), hot keys spread.

    ``weight`` is a column of ``table``: how many of ``total`` rows its key has. A
    key is hot if it has at least the ``hot_keys``-th part of them, so there are at
    most ``hot_keys`` hot keys whatever the size. Their names are broadcast; their
    rows are dealt by ``spread`` as well, over ``salts`` groups, and meet copies of
    the table's row there. Neither the weight nor a helper column is returned.
    """
    least = max(LEAST_ROWS, -(-total // hot_keys))
    hot = F.broadcast(table.where(F.col(weight) >= least).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col(weight) >= least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn("_salt", F.explode(copies)).drop(weight), [*keys, "_salt"], how).drop("_salt")
