"""The registered queries of this subpackage: each applies one operator to its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chunk_codec, context_tree, decontaminate, language, packing, pii, quality, quotes, simhash, sketches, substring_dedup, whitening
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_codec.encode(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_language_id,
        op3_simhash,
        op4_fingerprints,
        op5_decontamination,
        op6_packing,
        op7_quotation_linking,
        op8_lm_score,
        op9_pii,
        op10_quality,
        op11_chunk_bpe,
        op12_whitening,
        op13_centroids,
    )
}
ORACLE: dict[str, str] = {
    "op13_centroids": centroids.oracle(),
    "op1_substring_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
s AS (SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS span FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY span) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM twice),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS kept_text FROM w ANTI JOIN gone USING (r, j) GROUP BY r),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)""",
}
