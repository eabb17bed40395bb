"""Ordered per-aircraft logic: segments, runs, excursions, phases, cycles, gaps and trailing state.

All operators take a DataFrame with ``hex``, ``t_ms`` and ``seq``, whose order within an aircraft is
(t_ms, seq). They share one partitioning by ``hex``: chained windows shuffle once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

ORDER = ["t_ms", "seq"]


def by():
    """An aircraft's rows in order."""
    return Window.partitionBy("hex").orderBy(*ORDER)


def every():
    """All of an aircraft's rows, in order."""
    return by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def place() -> Column:
    """What orders an aircraft's rows."""
    return F.struct(*ORDER)


def segments(fixes: DataFrame) -> DataFrame:
    """One row per pair of neighbouring fixes (seq is the later one's): len_ft, dt and the previous values."""
    prev = {f"p_{c}": F.lag(c).over(by()) for c in ("lat", "lon", "alt", "t_ms", *(["sev"] if "sev" in fixes.columns else []))}
    rows = fixes.withColumns(prev).filter("p_t_ms is not null")
    out = rows.withColumn("len_ft", geo.planar_ft(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).withColumn("dt", F.col("t_ms") - F.col("p_t_ms"))
    return out.withColumn("seg_sev", F.greatest("sev", "p_sev")) if "sev" in fixes.columns else out


def islands(rows: DataFrame, change: Column, name: str = "run") -> DataFrame:
    """rows with a run number that grows where ``change`` holds; an aircraft's first row begins run 1."""
    first = F.row_number().over(by()) == 1
    return rows.withColumn("_new", (first | F.coalesce(change, F.lit(False))).cast("int")).withColumn(name, F.sum("_new").over(by()).cast("long")).drop("_new")


def changed(*columns: str) -> Column:
    """Whether any of the columns differs from the previous row's, nulls being equal."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(c).eqNullSafe(F.lag(c).over(by()))
    return out


def bands(fixes: DataFrame, *keys: str, bridge: bool = True, points: bool = False) -> DataFrame:
    """Runs of equal ``keys`` (default sev): first and last time, number of points, and their places.

    With ``bridge`` a run also receives the first point of the next one, so drawn bands touch.
    """
    keys = keys or ("sev",)
    nxt = F.lead(place()).over(by())
    runs = islands(fixes, changed(*keys)).withColumn("next_place", nxt)
    extra = F.max_by("next_place", place()) if bridge else F.lit(None).cast("struct<t_ms:bigint,seq:bigint>")
    agg = [F.min("t_ms").alias("t_from"), F.max("t_ms").alias("t_to"), F.count("*").alias("n"), F.min_by("seq", place()).alias("first_seq"), F.max_by("seq", place()).alias("last_seq"), extra.alias("bridge")]
    if points:
        agg.append(F.array_sort(F.collect_list(F.struct(*ORDER, "lat", "lon", "alt"))).alias("points"))
    out = runs.groupBy("hex", "run", *keys).agg(*agg)
    return out.withColumn("n_points", F.col("n") + F.col("bridge").isNotNull().cast("long")).withColumn("bridge_seq", F.col("bridge.seq")).drop("bridge")


def excursions(classed: DataFrame) -> DataFrame:
    """Maximal runs of a class other than clean: worst severity, altitude and zone where it is first reached,
    lowest altitude within the worst and overall, path length and whether the run is the aircraft's last."""
    rows = classed.withColumn("len_ft", F.coalesce(geo.planar_ft(F.lag("lat").over(by()), F.lag("lon").over(by()), F.col("lat"), F.col("lon")), F.lit(0.0)))
    rows = islands(rows.withColumn("out", F.col("sev") > 0), changed("out")).withColumn("is_last", F.lead("seq").over(by()).isNull()).filter("out")
    rows = rows.withColumn("run_start", F.row_number().over(Window.partitionBy("hex", "run").orderBy(*ORDER)) == 1)
    first_worst = F.struct(F.col("sev"), -F.col("t_ms"), -F.col("seq"))
    top = F.max("sev").over(Window.partitionBy("hex", "run"))
    rows = rows.withColumn("top", top)
    extra = [F.max_by("zone", first_worst).alias("zone")] if "zone" in classed.columns else []
    return rows.groupBy("hex", "run").agg(
        F.min("t_ms").alias("t_from"),
        F.max("t_ms").alias("t_to"),
        F.count("*").alias("n"),
        F.max("sev").alias("worst"),
        F.max_by("alt", first_worst).alias("alt_at_worst"),
        F.min(F.when(F.col("sev") == F.col("top"), F.col("alt"))).alias("lowest_in_worst"),
        F.min("alt").alias("lowest"),
        F.sum(F.when(F.col("run_start"), 0.0).otherwise(F.col("len_ft"))).alias("path_ft"),
        F.bool_or("is_last").alias("ongoing"),
        *extra,
    )


def air_islands(fixes: DataFrame, ground_ft: float) -> DataFrame:
    """fixes in runs of ground and air (``air``); a null altitude extends the run it falls into."""
    state = F.last(F.col("alt") > ground_ft, ignorenulls=True).over(by())
    rows = fixes.withColumn("air", F.coalesce(state, F.lit(False)))
    return islands(rows, changed("air"), "island")


def phases(fixes: DataFrame, ground_ft: float, taxi_nm: float = 0.02) -> DataFrame:
    """Phases of flight in order: taxiing or on_ground, and climb and descent about each airborne peak.

    The first highest fix splits an airborne run and belongs to both parts, unless it is at an end.
    """
    rows = air_islands(fixes, ground_ft)
    of = Window.partitionBy("hex", "island").orderBy(*ORDER)
    whole = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "moved": geo.planar_nm(F.first("lat").over(of), F.first("lon").over(of), F.col("lat"), F.col("lon")),
            "idx": F.row_number().over(of),
            "size": F.count("*").over(whole),
        }
    )
    rows = rows.withColumn("peak", F.max(F.struct("alt", -F.col("idx"))).over(whole)["col2"] * -1)
    ground = rows.filter(~F.col("air")).withColumn("type", F.when(F.max("moved").over(Window.partitionBy("hex", "island")) > taxi_nm, "taxiing").otherwise("on_ground"))
    single = F.when(F.col("peak") == 1, "descent").when(F.col("peak") == F.col("size"), "climb")
    parts = F.when(single.isNotNull(), F.array(single)).when(F.col("idx") < F.col("peak"), F.array(F.lit("climb"))).when(F.col("idx") > F.col("peak"), F.array(F.lit("descent")))
    air = rows.filter("air").withColumn("type", F.explode(parts.otherwise(F.array(F.lit("climb"), F.lit("descent")))))
    return (
        ground.unionByName(air)
        .groupBy("hex", "island", "type")
        .agg(
            F.min("t_ms").alias("start_ts"),
            F.max("t_ms").alias("end_ts"),
            F.min_by("alt", place()).alias("alt_start"),
            F.max_by("alt", place()).alias("alt_end"),
            F.count("*").alias("n"),
        )
    )


def cycles(fixes: DataFrame, ground_ft: float) -> DataFrame:
    """Flights: each airborne run that climbs. takeoff is its first fix, release its first highest one, landing
    its last one if ground follows (else the flight is in progress).
    """
    rows = air_islands(fixes, ground_ft)
    peak = F.struct(F.col("alt"), -F.col("t_ms"), -F.col("seq"))
    runs = rows.groupBy("hex", "island", "air").agg(
        F.min("t_ms").alias("takeoff_ts"),
        F.min(place()).alias("first"),
        F.max("t_ms").alias("last_ts"),
        F.max_by(F.struct("t_ms", "seq", "alt"), peak).alias("top"),
        F.min_by("alt", place()).alias("alt_start"),
    )
    follows = F.lead("island").over(Window.partitionBy("hex").orderBy("island")).isNotNull()
    flights = runs.withColumn("landed", follows).filter(F.col("air") & (F.col("top.seq") != F.col("first.seq")))
    minutes = (F.col("top.t_ms") - F.col("takeoff_ts")) / 60.0
    return flights.select(
        F.concat_ws("-", "hex", "takeoff_ts").alias("flight_id"),
        "hex",
        "island",
        "takeoff_ts",
        F.col("top.t_ms").alias("release_ts"),
        F.when(F.col("landed"), F.col("last_ts")).alias("landing_ts"),
        F.col("top.alt").alias("release_alt_ft"),
        F.when(minutes > 0, (F.col("top.alt") - F.col("alt_start")) / F.nullif(minutes, F.lit(0.0))).alias("climb_rate_fpm"),
        F.when(F.col("landed"), (F.col("last_ts") - F.col("takeoff_ts")) / 60.0).alias("cycle_time_min"),
    )


def merge_cycles(flights: DataFrame, gap: float) -> DataFrame:
    """Flights of an aircraft whose ground time is under ``gap`` become one, with the last one's landing."""
    legs = Window.partitionBy("hex").orderBy("takeoff_ts", "island")
    apart = F.col("takeoff_ts") - F.lag("landing_ts").over(legs) >= gap
    rows = flights.withColumn("trip", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(legs))
    return rows.groupBy("hex", "trip").agg(
        F.min("takeoff_ts").alias("takeoff_ts"),
        F.max_by("landing_ts", F.struct("takeoff_ts", "island")).alias("landing_ts"),
        F.count("*").alias("legs"),
        F.max("release_alt_ft").alias("top_ft"),
    )


def sessions(fixes: DataFrame, gap: float) -> DataFrame:
    """fixes with a flight number that grows where the time since the last fix exceeds ``gap``."""
    return islands(fixes, F.col("t_ms") - F.lag("t_ms").over(by()) > gap, "flight")


def last_fixes(fixes: DataFrame, n: int) -> DataFrame:
    """Each aircraft's last n fixes with ``back`` = 1 for the latest."""
    back = Window.partitionBy("hex").orderBy(F.desc("t_ms"), F.desc("seq"))
    return fixes.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= n)


def trailing(fixes: DataFrame, condition: Column) -> DataFrame:
    """The fixes at an aircraft's end for which, and for all later ones, ``condition`` holds."""
    later = Window.partitionBy("hex").orderBy(F.desc("t_ms"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return fixes.withColumn("_all", F.bool_and(F.coalesce(condition, F.lit(False))).over(later)).filter("_all").drop("_all")


def resample(fixes: DataFrame, step_ft: float) -> DataFrame:
    """Points at every whole multiple of ``step_ft`` along each path, interpolated linearly."""
    seg = segments(fixes)
    total = F.sum("len_ft").over(by())
    seg = seg.withColumn("to_ft", total).withColumn("from_ft", F.col("to_ft") - F.col("len_ft")).filter("len_ft > 0")
    low, high = F.ceil(F.col("from_ft") / step_ft).cast("long"), (F.ceil(F.col("to_ft") / step_ft) - 1).cast("long")
    rows = seg.filter(low <= high).withColumn("mark", F.explode(F.sequence(low, high)))
    share = (F.col("mark") * step_ft - F.col("from_ft")) / F.col("len_ft")
    mixed = lambda c: (F.col(f"p_{c}") + share * (F.col(c) - F.col(f"p_{c}"))).alias(c)
    return rows.select("hex", "mark", mixed("lat"), mixed("lon"), mixed("alt"))
