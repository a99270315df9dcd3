import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from skein.llm.sharding import jump_hash, shard

M = 1 << 64


def brute(key, n):
    key, b, j = (key or 0) % M, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % M
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_loop(spark):
    keys = [0, 1, 2, 3, 7, 10, 1 << 40, (1 << 63) - 1, -1, -(1 << 63)] + list(range(100, 400))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 100):
        got = {r.k: r.s for r in df.select("k", jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: brute(k, n) for k in keys}


def test_shard_rows(spark):
    rows = [(i, "té" * (i % 7)) for i in range(300)] + [(5, "x"), (5, "x"), (None, None), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit(1))
    out = shard(df, 24, rows_per_task=3).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        assert r.law == "key" and r.shard == brute(r.doc_id, 24)
        assert r.grown_shard == brute(r.doc_id, 25) and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in out) == sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)


def test_shard_of_nothing(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
