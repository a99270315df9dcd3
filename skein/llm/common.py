"""Helpers shared by the corpus operators: names, sizes, tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.scratch import drop_path, materialise, scratch_dir

__all__ = ["blocks_for", "drop_path", "free_name", "materialise", "new_path", "read_table", "scratch_dir"]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names match without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def blocks_for(df: DataFrame, text: str, bytes_per_block: int) -> int:
    """How many blocks of about ``bytes_per_block`` the text column fills."""
    total = df.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / bytes_per_block))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
