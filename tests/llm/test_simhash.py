import random

import xxhash
from pyspark.sql import functions as F

from skein.llm.simhash import ball_links, fingerprint, simhash_components, simhash_keep
from skein.plans.components import connected_components


def slow(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint_agrees_with_spark_and_a_slow_one(spark):
    texts = ["", " \t\n", "One", "One two", "a b c", "A B\x0bC d É x", "w " * 500]
    assert [fingerprint(t.encode()) for t in texts] == [slow(t) for t in texts]
    assert fingerprint(None) == 0
    [row] = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).collect()
    assert row.h % (1 << 64) == fingerprint(b"a b c")


def test_components_by_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    rows = []
    for i in range(120):
        words = [rng.choice(base) for _ in range(rng.choice([3, 5, 60, 200]))] if i % 3 == 0 or not rows else rows[-1][1].split()[:]
        if i % 3 and len(words) > 4:
            words[rng.randrange(len(words))] = rng.choice(base)
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (3, rows[3][1]), (600, "hot copy"), *[(601 + i, "HOT\tcopy") for i in range(50)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    want = components([slow(t) for _, t in rows], [i for i, _ in rows])
    got = sorted(map(tuple, simhash_components(df).collect()))
    assert got == sorted((i, f"{slow(t):016x}", c) for (i, t), c in zip(rows, want))
    kept = simhash_keep(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want)


def test_links_reach_exactly_the_radius(spark):
    fps = [0, 1, 3, 7, 1 << 63, (1 << 63) | 6, 0xFF00]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.node % (1 << 64): r.component for r in connected_components(ball_links(df), "a", "b").collect()}
    assert 0xFF00 not in got and len(set(got.values())) == 1 and len(got) == 6


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
