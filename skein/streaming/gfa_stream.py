"""A stream over a folder of GFA files: running counts per segment name.

Ids need all files, so the stream stays on names. It is meant for watching a
folder fill before the batch reader builds the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.gfa import GfaOptions, link_rows, segment_rows


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New files' lines as they come, in the shape of ``sources.gfa.read_lines``."""
    text = spark.readStream.text(folder).where("value <> ''")
    return text.select(F.regexp_replace("value", r"\r$", "").alias("line"), F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("row")).alias("place"))


def name_counts(lines: DataFrame, options: GfaOptions = GfaOptions()) -> DataFrame:
    """``name, segments, links, bases, mass`` so far: one update for each changed name."""
    segments = segment_rows(lines, options).select("name", F.lit(1).alias("s"), F.lit(0).alias("l"), "len", (F.col("len") * F.col("cov")).alias("m"))
    zero = F.lit(0).cast("long")
    links = link_rows(lines, options).select(F.explode(F.array("a", "b")).alias("name"), F.lit(0).alias("s"), F.lit(1).alias("l"), zero.alias("len"), zero.alias("m"))
    rows = segments.unionByName(links)
    return rows.groupBy("name").agg(F.sum("s").alias("segments"), F.sum("l").alias("links"), F.sum("len").alias("bases"), F.sum("m").alias("mass"))
