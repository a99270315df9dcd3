import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.line_dedup import line_dedup, similar
from skein.llm.line_join import _passes
from skein.llm.line_sets import Sets


def brute(rows, threshold=0.8):
    """By (id, line number); equal rows share what stays."""
    lines = []
    for row, (i, t) in enumerate(rows):
        for number, line in enumerate(t.split("\n") if t else []):
            lines.append((-(2**63) if i is None else i, number, row, set(line.encode().lower().split())))
    lines.sort(key=lambda x: x[:3])
    removed = {row: [] for row in range(len(rows))}
    for k, (_, number, row, tokens) in enumerate(lines):
        if tokens and any(similar(tokens, other, threshold) for *_, other in lines[:k] if other):
            removed[row].append(number)
    return sorted((i, len(t.split("\n")) if t else 0, len(removed[row]), sorted(removed[row])) for row, (i, t) in enumerate(rows))


@pytest.mark.parametrize("hot, chunk", [(4_096, 2_048), (3, 4)])
def test_lines_by_brute_force(spark, hot, chunk):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(300)]
    pool = [[rng.choice(words[: rng.choice([5, 40, 300])]) for _ in range(rng.randint(1, 30))] for _ in range(40)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randrange(5)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w.upper() if rng.random() < 0.1 else w for w in line))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n \n"), (203, " ".join("x%d" % (k % 2000) for k in range(5000))), (204, " ".join("x%d" % k for k in range(1900)))]
    rows += [(300 + i, "a very common line here\nown%d line%d" % (i, i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = line_dedup(df, hot=hot, chunk=chunk, counters=1 << 12).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, sorted(r.removed)) for r in got) == brute(rows)
    texts = dict(rows)
    for r in got:
        lines = texts[r.doc_id].split("\n") if texts[r.doc_id] else []
        assert r.kept.decode() == "\n".join(x for k, x in enumerate(lines) if k not in set(r.removed))


def test_repeated_rows_keep_one_line(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in line_dedup(df).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert line_dedup(df.limit(0)).collect() == []


def test_sketches_never_exceed_the_difference():
    rng = random.Random(2)
    for size in (3, 30, 47, 60, 149, 160, 400):
        a = ["w%d" % rng.randrange(10**6) for _ in range(size)]
        b = a[: size * 9 // 10] + ["v%d" % rng.randrange(10**6) for _ in range(size // 8)]
        found = Sets.of([" ".join(a).encode(), " ".join(b).encode()])
        columns = {"size": found.sizes, "place": np.zeros(2, np.int64), **{f"s{k}": x.view(np.uint64) for k, x in enumerate(found.sketches())}}
        columns |= {"even": columns["s0"] ^ columns["s2"], "odd": columns["s1"] ^ columns["s3"]}
        columns["all"] = columns["even"] ^ columns["odd"]
        both = len(set(a) & set(b))
        exact = both / len(set(a) | set(b))
        i, _ = _passes(columns, np.array([1]), np.array([0]), exact)
        assert len(i) == 1
        assert similar(set(a), set(b), exact) and Sets.of([b"x y", b"y\tX  x"]).names()[0].tolist()[0] == Sets.of([b"y x"]).names()[0][0]
