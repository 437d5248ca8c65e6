"""The contract queries: thin digests of the operators' results over the whole
tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import conversation_digests
from .common import text_of
from .exact_dedup import exact_dedup, normalised
from .html_extract import extract
from .mixing import mix
from .packing import pack
from .shards import uniform_shards
from .simhash import simhash_groups
from .substrings import substring_dedup
from .toxicity import fit_on, held_out, score
from .vectors import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_of("text")) + 16).cast("long").alias("size"),
        F.crc32(text_of("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return uniform_shards(docs, n_shards=40).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.coalesce(F.col("full_hash"), F.sha2(normalised(), 256))
    return out.select("doc_id", "keep_id", "group_size", "kept", digest.alias("text_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on(docs, _table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return conversation_digests(turns.unionByName(more))


QUERIES = {
    "op1_near_vectors": op1_near_vectors,
    "op2_packing": op2_packing,
    "op3_html": op3_html,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_substrings": op6_substrings,
    "op7_sharding": op7_sharding,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_chat": op10_chat,
}

ORACLE_SQL = {
    "op8_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM h""",
    "op1_near_vectors": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id""",
    "op6_substrings": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS pos, w FROM d WHERE len(w) >= 20
), k AS (
  SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 19), ' ') AS window_words FROM s
), f AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY window_words ORDER BY doc_id, pos) > 1 AS again FROM k
), g AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 19)) AS pos FROM f WHERE again
), p AS (
  SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM d
), o AS (
  SELECT p.doc_id, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN word END, ' ' ORDER BY p.pos) AS kept
  FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id""",
    "op10_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length('### ') + length(replace(regexp_replace(role, '(\\|###|</turn>|<\|)', '\\\1', 'g'), ':', '\:')) + length(': ')
    + length(regexp_replace(text, '(\\|###|</turn>|<\|)', '\\\1', 'g')) + length('</turn>') + 1 AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY 1""",
}
