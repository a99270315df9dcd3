import hashlib
import random
import re
import zlib

import pytest
from skein.llm import periodic_runs
from skein.llm.lyndon_runs import runs, smaller_suffixes
from skein.llm.periodic_runs import kept_words, run_report, words_of


def brute(text, least=2):
    """Maximal stretches of equal symbols p apart, for each p; those of a smaller period go."""
    n, found = len(text), set()
    for p in range(1, n // 2 + 1):
        start = None
        for i in range(n - p + 1):
            same = i + p < n and text[i] == text[i + p]
            if same and start is None:
                start = i
            if not same and start is not None:
                length = i - start + p
                if length >= 2 * p and not any(all(text[k] == text[k + q] for k in range(start, start + length - q)) for q in range(1, p)):
                    found.add((start, length, p))
                start = None
    return sorted(r for r in found if r[1] >= least)


def repetitive(rng):
    text = [rng.randint(0, rng.choice([0, 1, 1, 2, 3])) for _ in range(rng.randint(0, 30))]
    unit = text[: rng.randint(1, 9)] or [7]
    return text[:5] + unit * rng.randint(0, 5) + unit[: rng.randint(0, len(unit))] + text[: rng.randint(0, 9)]


def test_runs_by_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        text = repetitive(rng)
        assert runs(text) == brute(text), text
        assert runs([str(x).encode() for x in text], 12) == brute(text, 12)


class Counted:
    """A symbol that counts how often it is compared."""

    seen = 0

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        Counted.seen += 1
        return isinstance(other, Counted) and self.value == other.value

    def __lt__(self, other):
        Counted.seen += 1
        return self.value < other.value if isinstance(other, Counted) else NotImplemented

    def __gt__(self, other):
        Counted.seen += 1
        return self.value > other.value if isinstance(other, Counted) else NotImplemented


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def nested(letters):
    text = "a"
    for c in letters:
        text = text + c + text
    return text


@pytest.mark.parametrize("text", [
    "a" * 9000, "ab" * 4500, ("a" * 50 + "b") * 170, fibonacci(9000), fibonacci(600) * 15, nested("bcdefghijklm"), nested("mlkjihgfedcb"),
    "".join(str(i.bit_count() & 1) for i in range(9000)), "".join("a" * k + "b" for k in range(130)), "".join("a" * (130 - k) + "b" for k in range(130)),
])
def test_comparisons_are_linear(text):
    Counted.seen = 0
    found = runs([Counted(c) for c in text])
    assert Counted.seen < 25 * len(text) and len(found) < len(text)


def test_smaller_suffixes():
    rng = random.Random(3)
    for _ in range(300):
        text = repetitive(rng)
        for up in (True, False):
            marked = [x if up else -x for x in text]
            smaller = {i: next((j for j in range(i + 1, len(text)) if marked[j:] < marked[i:]), None) for i in range(len(text))}
            want = {i: j for i, j in smaller.items() if j is not None and text[i] == text[j]}
            assert {i: j for i, j, _ in smaller_suffixes(text, up)} == want


def report(doc_id, text):
    """A row of the query, read off its definition."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words, 12)
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (
        doc_id, len(found), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4),
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def test_report_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BYTES_AT_ONCE", 200)
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(rng.choice("abcdé") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "   \v x"), (None, "a " * 40), (903, "a b " * 3000 + "c"), (3, rows[3][1]), (3, rows[3][1]), (904, "a b c d e f " * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "1 AS n_words", "2 AS collapsed", "3 AS id")
    got = sorted(map(tuple, run_report(df.repartition(3)).collect()), key=str)
    small = [r for r in rows if r[0] != 903]
    assert [r for r in got if r[0] != 903] == sorted((report(*r) for r in small), key=str)
    assert [r[1:5] for r in got if r[0] == 903] == [(1, 0, 6000, 2)]
    assert sum(1 for i in range(150) if zlib.crc32(str(i).encode()) % 10 == 0) > 5


def test_kept_words():
    assert kept_words(list(range(12)), [(0, 6, 1), (3, 9, 4)]) == [0, 6]
    assert kept_words(list(range(6)), []) == list(range(6)) and words_of(None, b" a\xc2\xa0b \x0bc") == [b"a\xc2\xa0b", b"c"]


def test_runs_of_nothing(spark):
    assert run_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
