import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.gsaca import lyndon_groups, suffix_array
from skein.llm.suffix_dedup import anchors, repeated_windows, substring_dedup


def brute(rows, length):
    starts = defaultdict(int)
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        for i in range(len(b) - length + 1):
            starts[b[i : i + length]] += 1
    out = []
    for (name, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((name, len(b), len(b) - len(kept), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array_by_sorting():
    rng = random.Random(1)
    for _ in range(400):
        text = [rng.randrange(1, rng.choice([2, 3, 5, 40])) for _ in range(rng.randrange(0, 60))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_groups_are_lyndon_prefixes():
    text = [*b"mississippi", 0]
    order = suffix_array(text)
    rank = {i: r for r, i in enumerate(order)}
    nss = lambda i: next((j for j in range(i + 1, len(text)) if rank[j] < rank[i]), len(text))
    groups, _, _ = lyndon_groups(text)
    prefixes = [{tuple(text[i : nss(i)]) for i in g} for g in groups]
    assert all(len(p) == 1 for p in prefixes) and [next(iter(p)) for p in prefixes] == sorted(next(iter(p)) for p in prefixes)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    text = bytes(rng.choice(b"ab") for _ in range(700)) + b"x" * 300
    data = text + b"other" + text[3:500]
    ends = np.array([len(text), len(text) + 5, len(data)])
    h, first, last, middle = anchors(data, ends, 200)
    seen = {}
    for a, f, e, m in zip(h.tolist(), first.tolist(), last.tolist(), middle.tolist()):
        for i in range(f, e + 1):
            assert i <= m <= i + 150
            seen.setdefault(data[i : i + 200], set()).add((a, m - i))
    assert all(len(v) == 1 for v in seen.values())
    covered = sum(int(e - f + 1) for f, e in zip(first, last))
    assert covered == (1000 - 199) + (497 - 199)


def test_repeated_windows_small():
    a, b = b"0123456789abcdef", b"xx3456789abcyy"
    [x, y] = repeated_windows([a, b], 8)
    assert np.flatnonzero(x).tolist() == [3, 4, 5] and np.flatnonzero(y).tolist() == [2, 3, 4]


@pytest.mark.parametrize("block_bytes", [50_000_000, 4_000])
def test_cuts_by_brute_force(spark, block_bytes):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (30, 40, 60, 80)]
    rows = []
    for i in range(70):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randrange(3), rng.choice(passages)[rng.randrange(20) :])
        rows.append((i, " ".join(parts)))
    for i in range(20):  # near copies
        words = rows[1][1].split()
        words[rng.randrange(len(words))] = word()
        rows.append((100 + i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "z" * 1000), (203, "\x00" * 450), (204, "ab" * 300), (5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1]), (205, rows[7][1]), (206, "q" * 199), (207, "q" * 199), (208, "r" * 200), (209, "r" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = substring_dedup(df, block_bytes=block_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, 200)


def test_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
