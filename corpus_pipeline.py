"""documents -> training sequences: filter, deduplicate, decontaminate, mask, pack.

Every stage takes what its predecessor kept. SQL cannot express the classifier, so there is no oracle;
the stages are tested on small fixtures against what each must keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, near_copies, packing, pii, quality
from driftline.llm.common import cut, fold, fresh, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labels, does not reject."""
    labels = table(spark, sf_dir, "labels").filter(~F.coalesce(fold(F.col("doc_id")) % 5 == 0, F.lit(False)))
    score = fresh(docs, "score")
    scored = quality.with_score(docs, quality.train(docs, labels), score)
    return scored.filter(F.col(score) >= quality.CUTOFF).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links of Jaccard similarity 0.8 or more over five-word shingles."""
    return near_copies.representatives(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in their texts (n_chars follows)."""
    out = pii.mask(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0))).cast(docs.schema["n_chars"].dataType))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near-duplicates", distinct),
    ("decontamination", uncontaminated),
    ("personal data", masked),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that STAGES make of ``documents``; each stage's result is written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
