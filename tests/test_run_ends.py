"""Queries against their SQL where a run ends with its aircraft, and where a silence is just as long as the limit."""

import os

from compare import connect, difference
from pyspark.sql import functions as F

from driftline.plans import catalog, registry  # noqa: F401
from driftline.streaming import ingest

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def with_events(folder, sql):
    """The smallest tables, with events taken from the larger ones."""
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", f"{folder}/{name}")
    con = connect(LARGE)
    con.sql(f"COPY ({sql}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def test_the_last_band_of_an_aircraft_on_the_boot_board(spark, tmp_path):
    sf = with_events(tmp_path, "SELECT * FROM events WHERE user_id = 1484 OR ts = (SELECT max(ts) FROM events)")  # two red fixes end its track
    assert difference(registry.QUERIES["cmp08_boot"](spark, sf), connect(sf), registry.ORACLE["cmp08_boot"]) is None


def test_a_silence_of_just_the_limit_splits_a_flight(spark, tmp_path):
    rows = [("a", s) for s in (0, 899, 1799, 2698)]
    df = spark.createDataFrame(rows, "hex string, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("alt", F.lit(1.0))
    assert sorted(r["n"] for r in ingest.flight_sessions(df).collect()) == [2, 2]
    at = "TIMESTAMP '2024-01-01' + to_seconds(CAST(s AS INT))"
    sf = with_events(tmp_path, f"SELECT event_id, CAST({at} AS TIMESTAMP) AS ts, user_id % 3 AS user_id, event_type, value, props FROM (SELECT *, event_id * 450 AS s FROM events WHERE event_id < 60) e")
    assert difference(registry.QUERIES["str10_sessions"](spark, sf), connect(sf), registry.ORACLE["str10_sessions"]) is None
