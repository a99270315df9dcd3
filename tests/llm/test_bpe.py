import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from skein.llm.bpe import encode_decode
from skein.llm.words import tokenizer, vocabulary_path


def test_round_trip_matches_the_library(spark):
    rng = random.Random(3)
    texts = ["", None, " \n", "Hello, World's  42 <|endoftext|>x\x0b\x0cok\r\n\ty", "é́ ΑΣ. İ ﬀ 漢字 \x85 \x1c z \xa0", "a" * 3000, "Word " * 9000, "\x85"]
    texts += [" ".join(rng.choice(["The", "the", "don't", "x1y2", "!!", "naïve", "<|startoftext|>", "🙂👍🏽"]) + str(rng.randrange(50)) for _ in range(rng.randrange(60))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(None, "no id"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash"))
    tok = tokenizer(vocabulary_path())

    def want(i, t):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text

    for size in (10_000_000, 2_000):
        got = encode_decode(df, with_texts=True, block_bytes=size).collect()
        assert sorted(map(tuple, got), key=str) == sorted((want(i, t) for i, t in rows), key=str)
    assert encode_decode(df.limit(0)).collect() == []
    assert encode_decode(df).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
