"""Writes that are killed, resumed or run twice leave what one run leaves."""

import pytest
from pyspark.sql import functions as F

from driftline.sources import stores

SCHEMA = "k long, v long"


def rows(spark, n=200):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))


def content(df):
    return sorted(map(tuple, df.select("k", "v").collect()))


def test_a_killed_run_is_resumed(spark, tmp_path):
    path, want = str(tmp_path / "out"), content(rows(spark))
    assert stores.read_parts(spark, path, SCHEMA).count() == 0

    def break_off(k):
        raise RuntimeError("killed")

    stores.write_parts(rows(spark), path, "k", 6, at_once=2, most=2)
    half = content(stores.read_parts(spark, path, SCHEMA))
    assert 0 < len(half) < 200
    # the next part's files are there, half of them, but the run ends before its manifest
    part = min(set(range(6)) - stores.committed_parts(spark, path))
    own = rows(spark).withColumn("part", F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(6)).cast("int")).filter(F.col("part") == part)
    own.limit(3).write.mode("append").partitionBy("part").parquet(f"{path}/data")
    assert content(stores.read_parts(spark, path, SCHEMA)) == half
    # and one run fails within a task
    broken = rows(spark).withColumn("v", F.udf(break_off, "long")("k"))
    with pytest.raises(Exception, match="killed"):
        stores.write_parts(broken, path, "k", 6)
    assert content(stores.read_parts(spark, path, SCHEMA)) == half
    assert stores.write_parts(rows(spark), path, "k", 6, at_once=1) == 4
    assert content(stores.read_parts(spark, path, SCHEMA)) == want
    assert stores.write_parts(rows(spark), path, "k", 6) == 0
    assert content(stores.read_parts(spark, path, SCHEMA)) == want


def test_parts_in_one_transaction_and_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    assert stores.write_parts(rows(spark, 3), path, "k", 50) == 50
    assert content(stores.read_parts(spark, path, SCHEMA)) == content(rows(spark, 3))
    assert stores.write_parts(rows(spark, 0), str(tmp_path / "none"), "k", 2) == 2


def batch(spark, *values):
    return spark.createDataFrame(values, "day long, k long, at long, v string")


DAYS = "k long, at long, v string"


def state(spark, path, **more):
    return sorted((r["day"], r["k"], r["v"]) for r in stores.read_days(spark, path, DAYS, **more).collect())


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "days")
    first, second = batch(spark, (1, 1, 1, "a"), (1, 2, 1, "b"), (2, 1, 5, "c")), batch(spark, (1, 1, 2, "A"), (1, 3, 2, "d"), (1, 2, 0, "old"))
    stores.flush_days(first, 0, path, ["k"], ["at"])
    assert state(spark, path) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    for _ in range(2):
        stores.flush_days(second, 1, path, ["k"], ["at"])
        assert state(spark, path) == [(1, 1, "A"), (1, 2, "b"), (1, 3, "d"), (2, 1, "c")]
    assert state(spark, path, closed=True) == [(1, 1, "A"), (1, 2, "b"), (1, 3, "d")]  # day 2 may go on
    assert stores.remove_superseded(spark, path) == 1
    assert state(spark, path) == [(1, 1, "A"), (1, 2, "b"), (1, 3, "d"), (2, 1, "c")]


def test_a_flush_without_manifest_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "days")
    stores.flush_days(batch(spark, (1, 1, 1, "a")), 0, path, ["k"], ["at"])
    lost = batch(spark, (1, 9, 9, "z")).withColumn("batch", F.lit(1).cast("long"))
    lost.write.mode("append").partitionBy("day", "batch").parquet(f"{path}/data")
    assert state(spark, path) == [(1, 1, "a")]
    stores.flush_days(batch(spark, (1, 2, 1, "b")), 1, path, ["k"], ["at"])
    assert state(spark, path) == [(1, 1, "a"), (1, 2, "b")]
    stores.flush_days(batch(spark).limit(0), 2, path, ["k"], ["at"])
    assert state(spark, path) == [(1, 1, "a"), (1, 2, "b")]


def test_a_stream_flushes_through_the_sink(spark, tmp_path):
    from driftline.streaming import ingest

    for i, v in enumerate(([(1, 1, 1, "a")], [(1, 1, 2, "b"), (2, 4, 1, "c")], [(2, 5, 1, "d")])):
        batch(spark, *v).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema("day long, k long, at long, v string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        sink = lambda df, n: stores.flush_days(df, n, str(tmp_path / "out"), ["k"], ["at"])
        ingest.capture_with(stream, sink, str(tmp_path / "check")).awaitTermination()
    assert state(spark, str(tmp_path / "out")) == [(1, 1, "b"), (2, 4, "c"), (2, 5, "d")]
