"""The corpus operators as registered queries, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.bpe import encode_decode
from skein.llm.common import read_table
from skein.llm.embedding_dedup import embedding_dedup
from skein.llm.exact_dedup import exact_dedup
from skein.llm.line_dedup import line_dedup
from skein.llm.merkle import proof_report
from skein.llm.packing import pack
from skein.llm.periodic_runs import run_report
from skein.llm.quality import quality_scores
from skein.llm.sharding import shard
from skein.llm.simhash import simhash_components
from skein.llm.suffix_dedup import substring_dedup
from skein.llm.url_filter import url_verdicts, verdict_sql
from skein.llm.warc import pages_through_warc


def op1_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"), shards=24)


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_through_warc(read_table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("kept", 256).alias("kept_sha256"), "links")


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_embedding_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))


def op9_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proof_report(read_table(spark, sf_dir, "documents"))


def op12_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe_words": op1_bpe_words,
    "op2_vector_packing": op2_vector_packing,
    "op3_jump_sharding": op3_jump_sharding,
    "op4_warc_transactions": op4_warc_transactions,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_set_similarity": op6_line_set_similarity,
    "op7_quality_cotraining": op7_quality_cotraining,
    "op8_embedding_multi_index": op8_embedding_multi_index,
    "op9_simhash_ball": op9_simhash_ball,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_url_language_models": op12_url_language_models,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op8_embedding_multi_index": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         coalesce(label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE usable
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach AS (
  SELECT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), c AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id,
       v.vec_id IS NOT DISTINCT FROM coalesce(c.component_id, v.vec_id) AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
""",
    "op10_exact_dedup": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size,
       (d.doc_id IS NOT DISTINCT FROM g.keep_id
        AND row_number() OVER (PARTITION BY d.t, d.doc_id) = 1) AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
""",
    "op11_merkle_manifest": """
WITH RECURSIVE low AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents
), f AS (
  SELECT doc_id, source, lowered,
         list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')) AS fields,
         list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, lowered], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')) AS later
  FROM low
), sums AS (
  SELECT doc_id, doc_id::VARCHAR AS rest, 4294967295 AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, rest[2:], list_reduce([xor(crc, ascii(rest))] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))
  FROM sums WHERE rest <> ''
), changed AS (
  SELECT doc_id FROM sums WHERE rest = '' AND xor(crc, 4294967295) % 5 = 0
), d AS (
  SELECT f.doc_id, source, sha256(array_to_string(fields, '')) AS leaf,
         sha256(array_to_string(CASE WHEN c.doc_id IS NULL THEN fields ELSE later END, '')) AS later,
         row_number() OVER (PARTITION BY source ORDER BY f.doc_id NULLS FIRST, sha256(array_to_string(fields, ''))) - 1 AS place
  FROM f LEFT JOIN changed c ON f.doc_id = c.doc_id
), lower_trees AS (
  SELECT source, 0 AS level, list(leaf ORDER BY place) AS nodes FROM d GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1 : i + 16], '')))
  FROM lower_trees WHERE len(nodes) > 1
), subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM lower_trees WHERE len(nodes) = 1
), upper_tree AS (
  SELECT 0 AS level, (SELECT list(subroot ORDER BY rank) FROM subroots) AS nodes
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1 : i + 16], '')))
  FROM upper_tree WHERE len(nodes) > 1
), steps AS (
  SELECT d.doc_id, d.source, d.place, d.leaf, d.later, s.subroot, t.level, (d.place >> (4 * t.level)) AS own, t.nodes
  FROM d JOIN lower_trees t ON d.source IS NOT DISTINCT FROM t.source JOIN subroots s ON d.source IS NOT DISTINCT FROM s.source
  WHERE len(t.nodes) > 1
  UNION ALL
  SELECT d.doc_id, d.source, d.place, d.leaf, d.later, s.subroot, 1000 + t.level, (s.rank >> (4 * t.level)), t.nodes
  FROM d JOIN subroots s ON d.source IS NOT DISTINCT FROM s.source, upper_tree t WHERE len(t.nodes) > 1
), sided AS (
  SELECT source, place, level,
         array_to_string(nodes[(own // 16) * 16 + 1 : own], '') AS l,
         array_to_string(nodes[own + 2 : (own // 16) * 16 + 16], '') AS r
  FROM steps
), paths AS (
  SELECT source, place, list({'l': l, 'r': r} ORDER BY level) AS path FROM sided GROUP BY source, place
), climb AS (
  SELECT d.source, d.place, d.later AS node, coalesce(p.path, []) AS path
  FROM d LEFT JOIN paths p ON d.source IS NOT DISTINCT FROM p.source AND d.place = p.place
  UNION ALL
  SELECT source, place, sha256(path[1].l || node || path[1].r), path[2:] FROM climb WHERE len(path) > 0
)
SELECT d.doc_id, d.leaf, s.subroot, u.nodes[1] AS root,
       sha256(array_to_string(list_transform(coalesce(p.path, []), lambda x: x.l || x.r), '')) AS proof_sha256,
       c.node AS folded_root, c.node = u.nodes[1] AS verified
FROM d
JOIN subroots s ON d.source IS NOT DISTINCT FROM s.source
JOIN upper_tree u ON len(u.nodes) = 1
LEFT JOIN paths p ON d.source IS NOT DISTINCT FROM p.source AND d.place = p.place
JOIN climb c ON d.source IS NOT DISTINCT FROM c.source AND d.place = c.place AND len(c.path) = 0
""",
    "op12_url_language_models": verdict_sql(),
}
