"""A corpus pipeline over ``documents``: each stage's output is the next one's input.

Quality classifier, exact dedup, SimHash near-dedup, suffix-array dedup, packing.
All stages but the last return the columns of their input; each stage's result is
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import drop_path, materialise, read_table
from skein.llm.exact_dedup import exact_keep
from skein.llm.packing import pack
from skein.llm.quality import quality_keep
from skein.llm.simhash import simhash_keep
from skein.llm.suffix_dedup import substring_cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality_keep(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their SimHash, the one with the smallest id stays."""
    return simhash_keep(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 bytes that occur twice are cut out of the texts."""
    return substring_cut(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens, cut and placed into sequences of 2048."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("suffix-array dedup", substrings),
    ("packing", packing),
]

#: Classifier, fingerprints, suffix sorting and tokens are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last:
            drop_path(spark, last)
        last = path
    return docs
