"""The registered queries of the ten operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, exact_dedup, langid, language_model, licenses, line_dedup, packing, pii, prefix_trie, sharding, simhash, vector_search
from .common import documents
from .conversation_sql import OP11_SQL, OP12_SQL, OP13_SQL


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id", "component_size")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    every = F.sort_array(F.array_distinct(F.concat("base", "added")))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(every).alias("spans"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair(conversation_repair.damage(conversations), known=conversations)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
k AS (SELECT r, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.r, k.k, k.line, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY m.k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d JOIN m ON d.r = m.r GROUP BY d.r, d.doc_id
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
  replace(replace(replace(replace(replace(replace(coalesce(text, ''), chr(32), ''), chr(9), ''), chr(10), ''), chr(11), ''), chr(12), ''), chr(13), '') AS norm FROM documents),
b AS (SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(chars) OVER w AS top, count(*) OVER (PARTITION BY norm) AS n
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, n::BIGINT AS group_size, (chars = top AND doc_id IS NOT DISTINCT FROM keep_id) AS kept, sha256(norm) AS text_sha256 FROM b
"""


def queries() -> dict:
    import corpus_pipeline

    own = [op1_language_id, op2_simhash, op3_packing, op4_sharding, op5_decontamination, op6_lm_score, op7_line_dedup, op8_licenses, op9_pii, op10_exact_dedup, op11_conversation_repair, op12_top_k, op13_prefix_trie]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_top_k": OP12_SQL, "op13_prefix_trie": OP13_SQL}
