"""The pipeline on a small corpus, each stage judged on its own input."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from skein.llm.simhash import fingerprint
from skein.llm.suffix_dedup import substring_cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for i in range(160):
        text = " ".join(word() for _ in range(rng.randint(40, 150)))
        junk = i % 5 == 0
        if junk:
            text = text.upper().replace(" ", "!! ")
        elif i % 5 == 1:
            text += " " + passage + " " + word()
        elif i % 5 == 2 and i > 10:
            text = rows[i - 5][1]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 2:
            labels.append((i, int(not junk), 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name != "packing":
            assert out.columns == COLUMNS
        seen[name] = (docs.collect(), out.collect())
        docs = spark.createDataFrame(seen[name][1], out.schema)
    before, after = seen["quality classifier"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {i for i in range(0, 160, 5)} - gone == set() and not {i for i in gone if i < 160 and i % 5}
    before, after = seen["exact dedup"]
    best = {}
    for r in before:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())
    before, after = seen["simhash near-dedup"]
    fps = [fingerprint((r.text or "").encode()) for r in after]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i]) and len(after) > 50
    before, after = seen["suffix-array dedup"]
    assert len(before) == len(after) and sum(len(r.text or "") for r in after) < sum(len(r.text or "") for r in before) - 60 * 100
    assert not any(a.text and b.text and a.text[i : i + 200] in b.text for a in after[:20] for b in after if a.doc_id != b.doc_id for i in range(0, max(0, len(a.text) - 200), 50))
    assert {r.doc_id for r in seen["packing"][1]} == {r.doc_id for r in after}
    again = corpus_pipeline.run(spark, corpus).collect()
    assert {(r.doc_id, r.doc_tokens) for r in again} == {(r.doc_id, r.doc_tokens) for r in seen["packing"][1]}
    assert sum(r.length for r in again) == sum(r.length for r in seen["packing"][1])


def test_cut_carries_columns_and_whole_characters(spark):
    text = "é" * 150 + "end"
    rows = [(1, text + "a"), (2, "b" + text), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.create_map(F.lit("k"), "doc_id")).select("kept", "text", "doc_id")
    out = {r.doc_id: r for r in substring_cut(df).collect()}
    assert substring_cut(df).columns == ["kept", "text", "doc_id"] and out[3].text is None and out[4].text == ""
    assert out[1].text == "a" and out[2].text == "b" and out[2].kept == {"k": 2}
