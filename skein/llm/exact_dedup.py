"""Exact deduplication by skew-safe combining, with SQL functions only.

Three levels, each of which compares the full content (the text itself is part
of every grouping key, the digest only routes rows):

1. each task merges its own equal texts (the map-side half of the first
   aggregation), so a group of copies leaves a task as one row;
2. rows meet in groups of (digest, salt, text): the salt comes from the id, so
   a group that holds a third of all rows is spread over ``salts`` groups;
3. the winners of the salts, at most ``salts`` rows for each text, are combined
   by (digest, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import drop_path, materialise
from skein.plans.hot import hot_join

SALTS = 16


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _salted(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")
    return docs.select(digest(text).alias("_digest"), salt.alias("_salt"), text.alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per distinct text: ``digest``, ``contents``, ``keep_id``, ``group_size``.

    ``contents`` counts the different texts behind the digest; with SHA-256 it is
    1, and the caller checks that. A null text counts as empty. A group whose
    ids are all null has a null ``keep_id``.
    """
    rows = _salted(docs.select(id_col, text_col), id_col, text_col, salts, digest)
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max(F.col("_row")[id_col]).alias("_id"), F.count(F.lit(1)).alias("_n"))
    contents = salted.repartition("_digest").groupBy("_digest", "_text").agg(F.max("_id").alias("_id"), F.sum("_n").alias("_n"))
    return contents.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("contents"),
        F.max("_id").alias("keep_id"),
        F.sum("_n").alias("group_size"),
    ).withColumnRenamed("_digest", "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """Every row's decision: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays (nulls rank lowest; a group
    of null ids only keeps one row). Of rows repeated with the same id and text
    exactly one is kept. A null text equals an empty one. An empty table gives an
    empty result; further columns are ignored here.

    The decisions are joined to the rows by digest, digests of very many rows by a
    salt from the id as well. This is exact as long as no
    digest stands for two texts, which level 3 has compared in full; should that
    ever happen, the join takes the text into its key.
    """
    groups, path = materialise(exact_groups(docs, id_col, text_col, salts, digest), "exact-groups")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256"), text.alias("_text"))
    seen = groups.agg(F.coalesce(F.max("contents"), F.lit(0)).alias("contents"), F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()
    if seen["contents"] <= 1:
        joined = hot_join(rows.drop("_text"), groups.drop("contents").withColumn("_n", F.col("group_size")), ["digest"], "_n", seen["n"], F.col("_id"))
    else:
        drop_path(docs.sparkSession, path)
        salted = _salted(docs.select(id_col, text_col), id_col, text_col, salts, digest)
        by_text = (
            salted.groupBy("_digest", "_salt", "_text").agg(F.max(F.col("_row")[id_col]).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .groupBy(F.col("_digest").alias("digest"), "_text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
        by_text = by_text.withColumn("_n", F.col("group_size"))
        joined = hot_join(rows, by_text, ["digest", "_text"], "_n", seen["n"], F.col("_id")).drop("digest").withColumn("digest", F.xxhash64("_text"))
    # Copies share a digest but differ in their ids: dealing by both keeps a hot digest apart.
    dealt = joined.repartition("text_sha256", "_id")
    turn = F.row_number().over(Window.partitionBy("text_sha256", "_id").orderBy("digest"))
    return dealt.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (turn == 1)).alias("kept"),
        "text_sha256",
    )


def exact_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """The kept rows only, with all their columns, by the same three levels.

    The winning row travels inside the aggregation, so nothing is joined back.
    """
    row_id = F.coalesce(F.col("_row")[id_col].cast("long"), F.lit(-(2**63)))
    # The text is in the key; of it, a row only carries whether it was null.
    rest = F.struct(F.col(f"`{text_col}`").isNull().alias("_null"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    salt = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(salts)).cast("int")
    rows = docs.select(digest(text).alias("_digest"), salt.alias("_salt"), text.alias("_text"), rest.alias("_row"))
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max_by("_row", row_id).alias("_row"))
    kept = salted.groupBy("_digest", "_text").agg(F.max_by("_row", row_id).alias("_row"))
    own = F.when(~F.col("_row")["_null"], F.col("_text")).alias(text_col)
    return kept.select([own if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
