import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import packing
from skein.llm.packing import pack, pack_window
from skein.llm.words import WordCache, tokenizer, vocabulary_path

TEXTS = ["", None, "Hello, World's  42 <|endoftext|>x\x0b\x0cok\r\n\ty", "é́    ΑΣ ΑΣ. İ ﬀ 漢字 \x85 \x1c z", "a" * 3000, "word " * 5000, "<|startoftext|> <|endoftext|>", "e ́x"]


def ids_of(text):
    return tokenizer(vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def test_words_encode_like_whole_texts():
    cache = WordCache(vocabulary_path(), limit=4)
    for t in TEXTS + TEXTS[::-1]:
        assert np.frombuffer(cache.encode((t or "").encode()), "<u4").tolist() == ids_of(t)


def test_odd_words_encode_like_the_library():
    rng = random.Random(5)
    pieces = ["a", "Zy", "the", "'s", "'", "''", "*", "&&&", "<|", "|>", ".", ",", "!?", "9", "é", "É", "_", "\\", "\"", "<|endoftext|>", "İ", "H\u0331", "\x1f", "\x00"]
    words = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    cache = WordCache(vocabulary_path())
    text = " ".join(words)
    assert np.frombuffer(cache.encode(text.encode()), "<u4").tolist() == ids_of(text)
    plain = " ".join(w for w in words if w.isascii() and "<|" not in w)
    assert np.frombuffer(cache.encode(plain.encode()), "<u4").tolist() == ids_of(plain)


def check(rows, out, max_segments=128):
    want = {i: [*ids_of(t), 1] for i, t in rows}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids)
    padding = 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048 and len(s) <= max_segments
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_pack(spark, monkeypatch):
    rng = random.Random(1)
    rows = list(enumerate(TEXTS + ["w%d " % rng.randrange(99) * rng.choice([1, 3, 100, 1500]) for _ in range(150)] + [""] * 300))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash"))
    assert check(rows, pack(df).collect()) == 0
    out = pack(df, max_segments=3, with_ids=True).collect()
    assert check(rows, out, 3) == 0
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    assert pack(df.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sum(r.length for r in pack(twice).collect()) == 7


@pytest.mark.parametrize("limits", [(64, 4, 64), (64, 64, 20), (64, 5, 7)])
def test_window_respects_all_limits(limits):
    rng = random.Random(2)
    lengths = [rng.randrange(1, 90) for _ in range(300)]
    loss_from = {i: rng.randrange(0, n) for i, n in enumerate(lengths)}
    sequences, left = pack_window([(i, 0, n) for i, n in enumerate(lengths)], loss_from, *limits, last=True)
    assert left == []
    seen = defaultdict(list)
    for s in sequences:
        n = sum(e - a for _, a, e in s)
        assert n <= limits[0] and len(s) <= limits[1] and n & (n - 1) == 0
        assert sum(max(0, e - max(a, loss_from[d])) for d, a, e in s) <= limits[2]
        for d, a, e in s:
            seen[d].append((a, e))
    for d, n in enumerate(lengths):
        spans = sorted(seen[d])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_windows_leave_little_over(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_DOCS", 7)
    rows = [(i, "x y z " * (i % 50)) for i in range(200)]
    assert check(rows, pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()) == 0
