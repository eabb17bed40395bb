"""Ids that many rows share: every row is dealt, and what is fitted does not depend on the order of rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("driftline.llm")

from driftline.llm import language, quality, sketches  # noqa: E402


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_edits_follow_the_order_of_ids_and_hashes(spark, partitions):
    rows = [(i if i % 3 else None, f"text {i % 41} of row {i} " * (i % 7)) for i in range(300)] + [(5, "same")] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r["text"] for r in docs.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()]
    want = []
    for own, following in zip(order, [*order[1:], order[0]], strict=True):
        tail = len(own) // 3
        want.append(hashlib.sha256((own[: len(own) - tail] + following[:tail]).encode()).hexdigest())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = [r["edited_sha256"] for r in sketches.fingerprint_edits(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(found) == sorted(want)


def test_a_third_of_all_rows_without_id_is_more_than_one_range(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("a b c d e f g "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        sizes = sketches.fingerprint_edits(docs).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["count"] for r in sizes) == 3000 and max(r["count"] for r in sizes) < 400


def test_fits_do_not_depend_on_the_order_of_repeated_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 60))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    for run in (language.identify, lambda d: quality.classify(d, labels)):
        one, other = (sorted(map(str, run(d).collect())) for d in (docs, docs.repartition(3, F.rand(5))))
        assert one == other
