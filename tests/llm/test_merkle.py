import hashlib
import random
import zlib

from pyspark.sql import functions as F

from skein.llm import merkle
from skein.llm.merkle import ARITY, folded, merkle_manifest, proof_report

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    """All levels of the tree over ``nodes``, the root's last."""
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][k : k + ARITY]) for k in range(0, len(found[-1]), ARITY)])
    return found


def steps(tree, place):
    for level in tree[:-1]:
        first = place // ARITY * ARITY
        yield level[first:place], level[place + 1 : first + ARITY]
        place //= ARITY


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted([r for r in rows if r[1] == s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in ordered[s]]) for s in sources}
    above = levels([trees[s][-1][0] for s in sources])
    out = []
    for rank, s in enumerate(sources):
        for place, r in enumerate(ordered[s]):
            path = [*steps(trees[s], place), *steps(above, rank)]
            later = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                later = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf(later)
            for left, right in path:
                node = sha(*left, node, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], above[-1][0], sha(*[x for step in path for side in step for x in side]), node, node == above[-1][0]))
    return out


def corpus(sizes, seed=2):
    rng = random.Random(seed)
    ids = list(range(10_000))
    rng.shuffle(ids)
    rows = []
    for source, n in sizes.items():
        rows += [(ids.pop(), source, rng.choice(["en", None]), rng.choice([None, -3, 12]), rng.choice([None, "", "Ä Text", "lower"]) and f"{rng.choice('ABc')}é{k}") for k in range(n)]
    return rows


def check(spark, rows, partitions=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = [tuple(r) for r in proof_report(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


def test_report_by_brute_force(spark):
    rows = corpus({None: 3, "": 1, "s": 16, "t": 17, "ü": 1, "big": 600, **{f"x{k}": 2 for k in range(20)}})
    rows += [(None, "t", None, None, None), (None, "t", None, 1, "A"), (7, "s", "en", 1, "A"), (7, "s", "en", 1, "A"), (7, "s", "en", 1, "B")]
    got = check(spark, rows)
    assert {r[6] for r in got} == {True, False}


def test_one_source_and_one_row(spark):
    check(spark, corpus({"only": 40}))
    got = check(spark, [(5, "a", None, None, "X")])
    assert got[0][1] == got[0][2] == got[0][3]


def test_frontiers_meet_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TASKS_JOINED", 0)
    monkeypatch.setattr(merkle, "LEVELS_JOINED", 1)
    seen = []
    real = merkle.materialise
    monkeypatch.setattr(merkle, "materialise", lambda df, what: seen.append(what) or real(df, what))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, corpus({"hot": 5000, "b": 300}), 7)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen.count("merkle-nodes") >= 4


def test_repeated_rows_fill_many_ranges(spark):
    rows = [(1, "s", "en", 1, "Same")] * 900 + [(2, "s", "en", 1, "Other")]
    check(spark, rows)


def test_manifest_keeps_clashing_names_apart(spark):
    rows = corpus({"a": 20, "b": 3})
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tree", "2 AS place", "3 AS leaf", "4 AS level", "5 AS digest", "6 AS path")
    out = merkle_manifest(df, also={"tree": F.col("tree")})
    assert out.columns == ["doc_id", "source", "leaf", "place", "subroot", "root", "path", "tree"]
    assert out.where(folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0 and out.count() == 23


def test_manifest_of_nothing(spark):
    assert proof_report(spark.createDataFrame([], SCHEMA)).collect() == []
