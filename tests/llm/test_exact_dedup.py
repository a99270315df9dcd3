import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from skein.llm.exact_dedup import exact_dedup, exact_keep

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "A"), (7, "a "), (7, "a "), (None, "n"), (None, "n"), (9, "é" * 5000), (10, "é" * 5000)] + [(100 + i, "hot") for i in range(500)]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out, seen = [], set()
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        kept = i == keep and (t or "") not in seen
        if kept:
            seen.add(t or "")
        out.append((i, keep, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_decisions(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("KEPT", F.lit("clash"))
    assert sorted(map(tuple, exact_dedup(df).collect()), key=str) == brute(ROWS)


def test_digest_collisions_are_settled_by_content(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    weak = lambda text: F.length(text).cast("string")
    assert sorted(map(tuple, exact_dedup(df, digest=weak).collect()), key=str) == brute(ROWS)
    assert exact_keep(df, digest=weak).count() == len({t or "" for _, t in ROWS})


def test_keep_carries_all_columns(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("kept", F.map_from_arrays(F.array(F.lit("k")), F.array("doc_id")))
    out = exact_keep(df)
    assert out.columns == df.columns
    want = {r[0] for r in brute(ROWS) if r[3]}
    assert {r.doc_id for r in out.collect()} == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(empty).collect() == [] and exact_keep(empty).collect() == []
