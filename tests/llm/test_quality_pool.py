import random

import numpy as np
from pyspark.sql import functions as F

from skein.llm import quality
from skein.llm.quality import Logistic, _cut, _fit_over, _Pick, _Rows, train


def test_all_unlabelled_documents_take_part(spark, monkeypatch):
    rng = random.Random(6)
    n = 12_500
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "A!! B!!").otherwise("some plain words").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.col("id").alias("n_chars"))
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in rng.sample(range(n), 100)], "doc_id long, quality int")
    seen, over = [], quality._over

    def counted(pool):
        seen.append(pool.count())
        return over(pool)

    monkeypatch.setattr(quality, "_over", counted)
    assert train(df, labels) is not None
    assert seen == [n - 100]


def test_fit_over_parts_is_the_fit_of_all_rows():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(900, 3)) + 40, rng.normal(size=(900, 2))]
    y = (x[0][:, 0] + x[1][:, 0] > 40).astype(float)
    teachers = [Logistic.fit(v[:100], y[:100]) for v in x]
    picks = [[_Pick(teachers[1 - k], {1.0: (0, 1.0), 0.0: (0, 1.0)})] for k in (0, 1)]
    parts = [_Rows((x[0][a : a + 200], x[1][a : a + 200]), np.zeros(200)) for a in range(100, 900, 200)]
    found = _fit_over([v[:100] for v in x], y[:100], picks, lambda f: [f(p) for p in parts], 0.6)
    for k in (0, 1):
        z = teachers[1 - k].logit(x[1 - k][100:])
        sure = np.abs(z) >= np.log(0.6 / 0.4)
        want = Logistic.fit(np.vstack([x[k][:100], x[k][100:][sure]]), np.concatenate([y[:100], (z[sure] > 0).astype(float)]))
        assert 0 < sure.sum() < 800
        assert np.allclose(found[k].logit(x[k]), want.logit(x[k]), atol=1e-6)


def test_quota_ends_within_a_bin():
    assert _cut(np.array([5, 4, 0, 2]), 4) == (1, 0.5)
    assert _cut(np.array([5, 4, 0, 2]), 2) == (3, 1.0)
    assert _cut(np.array([1, 1]), 9) == (0, 1.0)


def test_sums_of_parts_are_the_same_in_groups_and_direct(spark, monkeypatch):
    rows = [(i, [float(i), 1.0], [2.0 * i], i / 40) for i in range(40)]
    pool = spark.createDataFrame(rows, "_id long, text_x array<float>, metadata_x array<float>, turn double").repartition(7)

    def sums(r):
        return len(r.turn), {"x": [r.views[0].sum(axis=0), r.views[1].sum(axis=0)]}

    for direct in (256, 2):
        monkeypatch.setattr(quality, "DIRECT_PARTS", direct)
        parts = quality._over(pool)(sums)
        assert len(parts) <= 7 if direct > 7 else len(parts) <= direct
        n, found = parts[0]
        for more in parts[1:]:
            n, found = quality._plus((n, found), more)
        assert n == 40 and found["x"][0].tolist() == [780.0, 40.0] and found["x"][1].tolist() == [1560.0]
    assert quality._over(pool.limit(0))(sums) == []
