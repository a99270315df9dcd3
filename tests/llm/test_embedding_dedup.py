import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.embedding_dedup import Grid, embedding_dedup, multi_sequence


def brute(rows):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=float)
        return x / np.linalg.norm(x)

    us = [None if i is None or lab is None else unit(v) for i, v, lab in rows]
    linked = [[j for j in range(len(rows)) if j != i and us[i] is not None and us[j] is not None and rows[i][2] == rows[j][2] and len(us[i]) == len(us[j]) and us[i] @ us[j] >= 0.98] for i in range(len(rows))]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, js in enumerate(linked):
        for j in js:
            a, b = sorted((find(rows[i][0]), find(rows[j][0])))
            parent[b] = a
    return sorted(((r[0], len(js), find(r[0]), find(r[0]) == r[0]) for r, js in zip(rows, linked)), key=str)


def data():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        centre = rng.normal(size=32)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (centre + rng.normal(size=32) * rng.choice([0.02, 0.14, 0.2])).tolist(), int(c % 4)))
    hot = rng.normal(size=32)
    rows += [(1000 + i, (hot + rng.normal(size=32) * 0.01).tolist(), 1) for i in range(150)]
    rows += [(2000 + i, hot.tolist(), 2) for i in range(40)]
    rows += [(3000, None, 1), (3001, [0.0] * 32, 1), (3002, [float("nan")] * 32, 1), (3003, [None] + [1.0] * 31, 1), (3004, hot.tolist(), None), (3005, [1.0, 2.0], 1), (3006, [2.0, 4.0], 1), (3007, [], 1), (3008, [5.0], 1), (3009, [7.0], 1), (3010, [float("inf")] * 32, 1), (None, hot.tolist(), 2), (3011, [-0.0, 1.0], 3), (3012, [0.0, 1.0], 3)]
    return rows


def test_links_and_components_by_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("mark", F.lit("clash"))
    exact = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").collect()
    want = brute([tuple(r) for r in exact])
    for size in ({}, {"cell_rows": 4, "chunk": 16}):
        got = sorted(map(tuple, embedding_dedup(df, **size).collect()), key=str)
        assert len(got) == len(want)
        found, there = sum(r[1] for r in got), sum(r[1] for r in want)
        assert 0.995 * there <= found <= there
        assert got == want or sum(a == b for a, b in zip(got, want)) > 0.98 * len(want)
    assert embedding_dedup(df.limit(0)).collect() == []


def test_multi_sequence_is_in_order():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.random(rng.integers(1, 7)), rng.random(rng.integers(1, 7))
        sums = (a[:, None] + b[None]).reshape(-1)
        got = multi_sequence(a, b, 10)
        assert sums[got].tolist() == np.sort(sums)[:10].tolist() and len(set(got)) == len(got)


def test_recall_is_reached_on_unseen_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = Grid(x[:2000], 8, 0.98, 0.999)
    step = rng.normal(size=(2000, 32))
    step -= (step * x[2000:]).sum(axis=1, keepdims=True) * x[2000:]
    other = 0.98 * x[2000:] + np.sqrt(1 - 0.98**2) * step / np.linalg.norm(step, axis=1, keepdims=True)
    hit = [h[0] in v or w[0] in u for u, v, h, w in zip(grid.order(x[2000:], grid.visits), grid.order(other, grid.visits), grid.order(x[2000:], 1), grid.order(other, 1))]
    assert np.mean(hit) > 0.99 and grid.visits < grid.cells


@pytest.mark.parametrize("cell_rows", [16, 2])
def test_recall_on_planted_links(spark, cell_rows):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turned = rng.normal(size=base.shape)
    turned -= (turned * base).sum(axis=1, keepdims=True) * base
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    cosine = rng.uniform(0.975, 0.999, size=(300, 1))
    x = np.vstack([base, cosine * base + np.sqrt(1 - cosine**2) * turned])
    rows = [(i, int(i % 300 % 2), v.tolist()) for i, v in enumerate(x)]
    near = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.98
    label = np.array([r[1] for r in rows])
    near &= label[:, None] == label[None]
    want = near.sum(axis=1) - 1
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup(df, cell_rows=cell_rows).collect()}
    assert want.sum() > 300 and all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.99 * want.sum()
