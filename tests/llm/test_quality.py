import random

import numpy as np
from pyspark.sql import functions as F

from skein.llm.quality import Logistic, co_train, metadata_features, quality_keep, quality_scores, text_features

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=400):
    rng = random.Random(4)
    rows, good = [], {}
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 120))]
        ok = i % 4 != 0
        good[i] = int(ok)
        text = " ".join(words) if ok else (" ".join(w.upper() + "!!" for w in words) if i % 8 else " ".join(words[:2] * 60))
        rows.append((i, text, rng.choice(["en", "de"]), f"s{i % 3}" if ok else f"s{i % 4 + 7}", len(text)))
    return rows, good


def test_held_out_accuracy_and_odd_rows(spark):
    rows, good = corpus()
    odd = [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (None, "x", "en", None, 1), (5, rows[5][1], "en", "s1", 3), (1002, "w " * 100_000, "xx", "yy", -5)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, g, 0) for i, g in good.items() if i % 2 == 0] + [(2, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_scores(df, labels).collect()
    assert len(out) == len(rows) + len(odd)
    test = [r for r in out if r.doc_id in good and r.doc_id % 2]
    assert sum(r.kept == bool(good[r.doc_id]) for r in test) / len(test) > 0.97
    ordered = lambda found: sorted((r.doc_id or -1, round(r.score, 9)) for r in found)
    assert ordered(quality_scores(df, labels).collect()) == ordered(out)
    kept = quality_keep(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in out)


def test_without_labels_everything_stays(spark):
    df = spark.createDataFrame(corpus(10)[0], SCHEMA)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        assert [(r.score, r.kept) for r in quality_scores(df, known).collect()] == [(None, True)] * 10
    assert quality_scores(df.limit(0), labels).collect() == []


def test_the_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.5).astype(float)
    strong = np.column_stack([y * 6 + rng.normal(size=2000), rng.normal(size=2000)])
    weak = np.column_stack([y * 3 + rng.normal(size=2000), rng.normal(size=(2000, 5))])
    known = np.arange(2000) < 24
    held = np.arange(24) % 3 == 0
    alone = Logistic.fit(weak[:24][~held], y[:24][~held])
    both = co_train(strong[known], weak[known], y[known], strong[24:1000], weak[24:1000], held)
    right = lambda m: ((m.logit(weak[1000:]) > 0) == y[1000:]).mean()
    assert right(both.views[1]) > right(alone)
    assert ((both.scores(strong[1000:], weak[1000:])[:, 0] > 0.5) == y[1000:]).mean() > 0.97


def test_features_are_finite():
    assert all(np.isfinite(text_features(t)).all() for t in (None, b"", b" ", b"\n\n", bytes(range(256))))
    assert len({len(metadata_features(*x)) for x in ((None, None, None), ("en", "s", float("nan")), ("", "", 3.0))}) == 1
