"""The corpus operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, fill_middle, minhash_dedup, packing, piece_lattice, quality_classifier, quality_rules, simhash_dedup, suffix_dedup, token_files, token_rollup, toxicity, whitening
from .common import shared_folder, written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, purge of short documents, a second tokenizer version, a compaction and a revision, some batches committed twice."""
    v1, v2 = token_rollup.whitespace_tokens(), token_rollup.piece_tokens()
    bars = F.when(F.col("text").contains("|"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D|]+")), F.lit(0))).otherwise(F.coalesce(v1, F.lit(0)))
    counts = written(documents(spark, sf_dir).select("source", "lang", F.coalesce(v1, F.lit(0)).alias("v1"), F.coalesce(v2, F.lit(0)).alias("v2"), bars.alias("revised")), "counts")
    left = counts.filter("v1 >= 50")
    ledger = token_rollup.Ledger(spark, f"{shared_folder(spark)}/condensery-ledger-{uuid.uuid4().hex}")
    ledger.commit("1-load", token_rollup.changes(counts, F.col("v1"), "words-v1"))
    purge = token_rollup.changes(counts.filter("v1 < 50"), F.col("v1"), "words-v1", -1)
    ledger.commit("2-purge", purge)
    ledger.commit("3-retokenise", token_rollup.changes(left, F.col("v2"), "pieces-v2"))
    ledger.commit("2-purge", purge)
    ledger.compact()
    ledger.commit("2-purge", purge)
    revised = token_rollup.revisions(left, F.col("v1"), F.col("revised"), "words-v1")
    ledger.commit("4-revise", revised)
    ledger.commit("4-revise", revised)
    return ledger.totals()


OP4_SQL = r"""
WITH counts AS (
  SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS v1,
    coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')), 0) AS v2,
    CASE WHEN contains(text, '|') THEN len(regexp_extract_all(text, '[^\x20\x09-\x0D|]+')) ELSE coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) END AS revised
  FROM documents)
SELECT source, lang, 'words-v1' AS tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(revised) AS BIGINT) AS tokens FROM counts WHERE v1 >= 50 GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-v2' AS tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(v2) AS BIGINT) AS tokens FROM counts WHERE v1 >= 50 GROUP BY source, lang
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.ordinal_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/condensery-tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path)


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.n_best_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(documents(spark, sf_dir))


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn),
cut AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n - b) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_dedup, op2_toxicity, op3_quality_rules, op4_token_rollup, op5_exact_dedup, op6_quality_classifier, op7_suffix_dedup, op8_packing, op9_token_files, op10_piece_lattice, op11_whitening, op12_fill_middle, op13_simhash_dedup)
}
ORACLE_SQL = {"op4_token_rollup": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op12_fill_middle": OP12_SQL}
