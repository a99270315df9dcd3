"""Dense row numbers in a global order without a single sorting task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.plans.scratch import materialise

ROWS_IN_LOT, LEAST_ROWS = 500_000, 50_000


def lots_of(spark: SparkSession, rows: int) -> int:
    """Lots of at most ``ROWS_IN_LOT`` rows on average, and where there are rows enough, one for each core."""
    return max(1, -(-rows // ROWS_IN_LOT), min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS))


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order of the columns ``order``.

    Rows are sorted by range; ranges are numbered apart and shifted by the sizes
    of the ranges before. Rows equal in all of ``order`` get numbers in any order.
    """
    ranged, _ = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "dense")
    starts = _starts(ranged, F.count(F.lit(1)))
    turn = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_turn", turn).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_turn") - 1).drop("_range", "_turn", "_start")


def _starts(ranged: DataFrame, size) -> DataFrame:
    """``_range, _start``: a row for each range, as many as partitions, so the window is small."""
    sizes = ranged.groupBy("_range").agg(size.alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def _ranks(keys: int):
    """Number the different keys (the last columns but two, longs) of a sorted partition, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, rank, last = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[-2 - keys : -2]])
            new = np.ones(batch.num_rows, bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            new[0] = last is None or (key[:, 0] != last).any()
            turn = rank + np.cumsum(new)
            rank, last = int(turn[-1]), key[:, -1].copy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(turn), pa.array(np.full(batch.num_rows, lot))], names=batch.schema.names)

    return run


def shared_index(df: DataFrame, keys: list[str], name: str, lots: int) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order of ``keys`` (longs without nulls); rows equal in them share a number.

    Equal keys fall into one range, so the ranges number theirs as they are sorted, and
    no row meets another by a join. What comes back reads written tables.
    """
    rows = df.select(*[c for c in df.columns if c not in keys], *keys, F.lit(0).cast("long").alias("_turn"), F.lit(0).cast("long").alias("_range"))
    sorted_rows = rows.repartitionByRange(lots, *keys).sortWithinPartitions(*keys)
    ranged, _ = materialise(sorted_rows.mapInArrow(_ranks(len(keys)), rows.schema), "ranks")
    starts, _ = materialise(_starts(ranged, F.max("_turn") + 1), "starts")
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_turn")).drop("_range", "_turn", "_start")
