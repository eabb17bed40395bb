"""Queries of the ordered per-aircraft operators (WIN) and the aggregates that stand on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import sequences as seqs
from ..sources import analog
from ..sources.analog import FIELD_FT, LAT0, LON0
from .registry import query
from .scalars import _FT, _NM, CLASSED, FX, classified, nearest_zone

GROUND = 5438.0
W = "(PARTITION BY hex ORDER BY t_ms, seq)"
LAGS = ", ".join(f"lag({c}) OVER {W} AS p_{c}" for c in ("lat", "lon", "alt", "t_ms"))
SEG = f"seg AS (SELECT *, {_FT('p_lat', 'p_lon', 'lat', 'lon')} AS len_ft, t_ms - p_t_ms AS dt FROM (SELECT *, {LAGS} FROM fixes) WHERE p_t_ms IS NOT NULL)"
CSEG = f"cseg AS (SELECT *, {_FT('p_lat', 'p_lon', 'lat', 'lon')} AS len_ft, t_ms - p_t_ms AS dt, greatest(sev, p_sev) AS seg_sev FROM (SELECT *, lag(sev) OVER {W} AS p_sev, {LAGS} FROM classed) WHERE p_t_ms IS NOT NULL)"


def runs_sql(source: str, change: str, name: str = "run", out: str = "runs") -> str:
    """A CTE that numbers the runs of source's rows, a new one wherever ``change`` holds."""
    return f"{out} AS (SELECT *, sum(CASE WHEN first_row OR coalesce({change}, false) THEN 1 ELSE 0 END) OVER {W} AS {name} FROM (SELECT *, row_number() OVER {W} = 1 AS first_row FROM {source}))"


def prior(spark, sf_dir):
    return seqs.segments(classified(spark, sf_dir))


@query("win01_segments", f"{FX}, {SEG} SELECT seq, round(len_ft, 3) AS len_ft, dt FROM seg")
def win01(spark, sf_dir):
    return seqs.segments(analog.fixes(spark, sf_dir)).select("seq", F.round("len_ft", 3).alias("len_ft"), "dt")


@query("sca14_segment_class", f"{CLASSED}, {CSEG} SELECT seq, seg_sev FROM cseg")
def sca14(spark, sf_dir):
    return prior(spark, sf_dir).select("seq", "seg_sev")


_CHANGED = lambda c, src="classed": f"(SELECT *, {c} IS DISTINCT FROM lag({c}) OVER {W} AS ch, lead(seq) OVER {W} AS nxt FROM {src})"


@query("win02_bands", f"{CLASSED}, {runs_sql(_CHANGED('sev'), 'ch')} SELECT hex, run, sev, min(t_ms) AS t_from, max(t_ms) AS t_to, count(*) + CASE WHEN arg_max(coalesce(nxt, -1), t_ms * 1000000 + seq) < 0 THEN 0 ELSE 1 END AS n_points, arg_min(seq, t_ms * 1000000 + seq) AS first_seq, nullif(arg_max(coalesce(nxt, -1), t_ms * 1000000 + seq), -1) AS bridge_seq FROM runs GROUP BY ALL")
def win02(spark, sf_dir):
    return seqs.bands(classified(spark, sf_dir)).select("hex", "run", "sev", "t_from", "t_to", "n_points", "first_seq", "bridge_seq")


@query("win03_bands_no_bridge", f"{CLASSED}, {runs_sql(_CHANGED('sev'), 'ch')} SELECT hex, run, sev, count(*) AS n_points FROM runs GROUP BY ALL")
def win03(spark, sf_dir):
    return seqs.bands(classified(spark, sf_dir), bridge=False).select("hex", "run", "sev", "n_points")


@query("win04_bands_mean_altitude", f"{CLASSED}, {runs_sql(_CHANGED('sev'), 'ch')} SELECT hex, run, sev, round(avg(alt), 4) AS mean_alt, count(nxt) AS n_segments FROM runs GROUP BY ALL")
def win04(spark, sf_dir):
    rows = seqs.islands(classified(spark, sf_dir).withColumn("nxt", F.lead("seq").over(seqs.by())), seqs.changed("sev"))
    return rows.groupBy("hex", "run", "sev").agg(F.round(F.avg("alt"), 4).alias("mean_alt"), F.count("nxt").alias("n_segments"))


@query("win05_bands_by_zone", f"{CLASSED}, {runs_sql(f'(SELECT *, sev IS DISTINCT FROM lag(sev) OVER {W} OR zone IS DISTINCT FROM lag(zone) OVER {W} AS ch FROM classed)', 'ch')} SELECT hex, run, sev, zone, count(*) AS n FROM runs GROUP BY ALL")
def win05(spark, sf_dir):
    c = classified(spark, sf_dir).withColumn("zone", nearest_zone(F.col("lat"), F.col("lon")))
    return seqs.bands(c, "sev", "zone", bridge=False).select("hex", "run", "sev", "zone", "n")


@query("win06_run_times", f"{CLASSED}, {runs_sql(_CHANGED('sev'), 'ch')} SELECT hex, run, min(t_ms) AS t_from, max(t_ms) AS t_to FROM runs GROUP BY ALL")
def win06(spark, sf_dir):
    return seqs.bands(classified(spark, sf_dir), bridge=False).select("hex", "run", "t_from", "t_to")


EXC = f"""{CLASSED}, x AS (SELECT *, sev > 0 AS o, lag(sev > 0) OVER {W} AS po, lead(seq) OVER {W} IS NULL AS is_last, {_FT(f'lag(lat) OVER {W}', f'lag(lon) OVER {W}', 'lat', 'lon')} AS len_ft FROM classed),
{runs_sql('x', 'o IS DISTINCT FROM po')}, y AS (SELECT *, max(sev) OVER (PARTITION BY hex, run) AS top, row_number() OVER (PARTITION BY hex, run ORDER BY t_ms, seq) AS i FROM runs WHERE o),
exc AS (SELECT hex, run, min(t_ms) AS t_from, max(t_ms) AS t_to, count(*) AS n, max(sev) AS worst, arg_min(alt, t_ms * 1000000 + seq) FILTER (sev = top) AS alt_at_worst, arg_min(zone, t_ms * 1000000 + seq) FILTER (sev = top) AS zone,
  min(alt) FILTER (sev = top) AS lowest_in_worst, min(alt) AS lowest, sum(CASE WHEN i = 1 THEN 0.0 ELSE len_ft END) AS path_ft, bool_or(is_last) AS ongoing FROM y GROUP BY hex, run)"""


def _excursions(spark, sf_dir):
    return seqs.excursions(classified(spark, sf_dir).withColumn("zone", nearest_zone(F.col("lat"), F.col("lon"))))


@query("win07_excursions", f"{EXC} SELECT hex, run, t_from, t_to, n, worst, alt_at_worst, zone FROM exc")
def win07(spark, sf_dir):
    return _excursions(spark, sf_dir).select("hex", "run", "t_from", "t_to", "n", "worst", "alt_at_worst", "zone")


@query("win08_live_excursions", f"{EXC} SELECT hex, run, worst, lowest_in_worst, round(path_ft, 3) AS path_ft, ongoing FROM exc")
def win08(spark, sf_dir):
    return _excursions(spark, sf_dir).select("hex", "run", "worst", "lowest_in_worst", F.round("path_ft", 3).alias("path_ft"), "ongoing")


@query("win09_notice_excursions", f"{EXC} SELECT hex, run, worst, lowest FROM exc")
def win09(spark, sf_dir):
    return _excursions(spark, sf_dir).select("hex", "run", "worst", "lowest")


AIR = f"""a0 AS (SELECT *, coalesce(last_value(CASE WHEN alt IS NOT NULL THEN alt > {GROUND} END IGNORE NULLS) OVER {W}, false) AS air FROM fixes),
{runs_sql(f'(SELECT *, air IS DISTINCT FROM lag(air) OVER {W} AS ch FROM a0)', 'ch', 'island', 'isl')}"""
_IW = "(PARTITION BY hex, island ORDER BY t_ms, seq)"
PHASES = f"""{AIR},
ix AS (SELECT *, row_number() OVER {_IW} AS idx, count(*) OVER (PARTITION BY hex, island) AS size, {_NM(f'first_value(lat) OVER {_IW}', f'first_value(lon) OVER {_IW}', 'lat', 'lon')} AS moved FROM isl),
pk AS (SELECT hex, island, arg_max(idx, alt * 100000 - idx) AS peak, max(moved) AS far FROM ix GROUP BY 1, 2),
ph AS (
  SELECT ix.*, peak, CASE WHEN far > 0.02 THEN 'taxiing' ELSE 'on_ground' END AS type FROM ix JOIN pk USING (hex, island) WHERE NOT air
  UNION ALL SELECT ix.*, peak, 'climb' FROM ix JOIN pk USING (hex, island) WHERE air AND peak > 1 AND idx <= peak
  UNION ALL SELECT ix.*, peak, 'descent' FROM ix JOIN pk USING (hex, island) WHERE air AND (peak = 1 OR (idx >= peak AND peak < size)))"""


@query("win10_phases", f"{FX}, {PHASES} SELECT hex, island, type, min(t_ms) AS start_ts, max(t_ms) AS end_ts, arg_min(alt, t_ms * 1000000 + seq) AS alt_start, arg_max(alt, t_ms * 1000000 + seq) AS alt_end, count(*) AS n FROM ph GROUP BY 1, 2, 3")
def win10(spark, sf_dir):
    return seqs.phases(analog.fixes(spark, sf_dir), GROUND)


CYCLES = f"""{AIR},
rn AS (SELECT hex, island, air, min(t_ms) AS takeoff_ts, arg_min(seq, t_ms * 1000000 + seq) AS s0, max(t_ms) AS last_ts, arg_max(struct_pack(t := t_ms, s := seq, a := alt), alt * 1e9 - rank_no) AS top, arg_min(alt, t_ms * 1000000 + seq) AS alt_start
  FROM (SELECT *, row_number() OVER {_IW} AS rank_no FROM isl) GROUP BY 1, 2, 3),
cyc AS (SELECT concat_ws('-', hex, takeoff_ts) AS flight_id, hex, island, takeoff_ts, top.t AS release_ts, CASE WHEN landed THEN last_ts END AS landing_ts, top.a AS release_alt_ft,
    CASE WHEN top.t > takeoff_ts THEN (top.a - alt_start) / ((top.t - takeoff_ts) / 60.0) END AS climb_rate_fpm, CASE WHEN landed THEN (last_ts - takeoff_ts) / 60.0 END AS cycle_time_min
  FROM (SELECT *, lead(island) OVER (PARTITION BY hex ORDER BY island) IS NOT NULL AS landed FROM rn) WHERE air AND top.s <> s0)"""


def flights(spark, sf_dir):
    return seqs.cycles(analog.fixes(spark, sf_dir), GROUND)


@query("win11_cycles", f"{FX}, {CYCLES} SELECT flight_id, hex, takeoff_ts, release_ts, landing_ts, release_alt_ft, round(climb_rate_fpm, 4) AS climb_rate_fpm, round(cycle_time_min, 6) AS cycle_time_min FROM cyc")
def win11(spark, sf_dir):
    return flights(spark, sf_dir).select("flight_id", "hex", "takeoff_ts", "release_ts", "landing_ts", "release_alt_ft", F.round("climb_rate_fpm", 4).alias("climb_rate_fpm"), F.round("cycle_time_min", 6).alias("cycle_time_min"))


MERGED = f"""{CYCLES}, trips AS (SELECT *, sum(CASE WHEN takeoff_ts - pl >= 120 THEN 1 ELSE 0 END) OVER (PARTITION BY hex ORDER BY takeoff_ts, island) AS trip FROM (SELECT *, lag(landing_ts) OVER (PARTITION BY hex ORDER BY takeoff_ts, island) AS pl FROM cyc)),
merged AS (SELECT hex, trip, min(takeoff_ts) AS takeoff_ts, last(landing_ts ORDER BY takeoff_ts, island) AS landing_ts, count(*) AS legs, max(release_alt_ft) AS top_ft FROM trips GROUP BY 1, 2)"""


@query("win12_touch_and_go_merge", f"{FX}, {MERGED} SELECT * FROM merged")
def win12(spark, sf_dir):
    return seqs.merge_cycles(flights(spark, sf_dir), 120)


@query("win13_flight_split", f"{FX}, {runs_sql(f'(SELECT *, t_ms - lag(t_ms) OVER {W} > 60 AS ch FROM fixes)', 'ch', 'flight')} SELECT hex, flight, min(t_ms) AS t_from, max(t_ms) AS t_to, count(*) AS n FROM runs GROUP BY 1, 2")
def win13(spark, sf_dir):
    rows = seqs.sessions(analog.fixes(spark, sf_dir), 60)
    return rows.groupBy("hex", "flight").agg(F.min("t_ms").alias("t_from"), F.max("t_ms").alias("t_to"), F.count("*").alias("n"))


@query("win16_descents", f"{FX} SELECT hex, count(*) FILTER (ph AND NOT h) AS descents, count(*) FILTER (NOT ph AND h) AS climbs FROM (SELECT hex, alt > 5588 AS h, lag(alt > 5588) OVER {W} AS ph FROM fixes) GROUP BY hex")
def win16(spark, sf_dir):
    f = analog.fixes(spark, sf_dir).withColumn("h", F.col("alt") > 5588)
    f = f.withColumn("ph", F.lag("h").over(seqs.by()))
    return f.groupBy("hex").agg(F.count_if(F.col("ph") & ~F.col("h")).alias("descents"), F.count_if(~F.col("ph") & F.col("h")).alias("climbs"))


LAST = lambda n: f"lastn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY t_ms DESC, seq DESC) AS back FROM fixes) WHERE back <= {n})"


@query("win17_current_climb", f"{FX}, {LAST(5)} SELECT hex, count(*) AS n, CASE WHEN count(*) >= 3 AND max(t_ms) > min(t_ms) THEN round((arg_min(alt, back) - arg_max(alt, back)) / ((max(t_ms) - min(t_ms)) / 60.0), 4) END AS climb_fpm FROM lastn GROUP BY hex")
def win17(spark, sf_dir):
    span = (F.max("t_ms") - F.min("t_ms")) / 60.0
    rate = (F.min_by("alt", "back") - F.max_by("alt", "back")) / F.nullif(span, F.lit(0.0))
    return seqs.last_fixes(analog.fixes(spark, sf_dir), 5).groupBy("hex").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(rate, 4)).alias("climb_fpm"))


@query("win18_latest_position", f"{FX}, {SEG} SELECT hex, arg_max(seq, t_ms * 1000000 + seq) AS seq, arg_max(lat, t_ms * 1000000 + seq) AS lat, arg_max(CASE WHEN dt > 0 THEN round(len_ft / 6076.12 / (dt / 3600.0), 3) ELSE -1 END, t_ms * 1000000 + seq) AS knots, arg_max(CASE WHEN dt > 0 THEN round((alt - p_alt) / (dt / 60.0), 3) ELSE 0 END, t_ms * 1000000 + seq) AS fpm FROM seg GROUP BY hex")
def win18(spark, sf_dir):
    s = seqs.segments(analog.fixes(spark, sf_dir))
    dt = F.nullif(F.col("dt"), F.lit(0).cast("long"))
    s = s.withColumn("knots", F.coalesce(F.round(F.col("len_ft") / 6076.12 / (dt / 3600.0), 3), F.lit(-1.0))).withColumn("fpm", F.coalesce(F.round((F.col("alt") - F.col("p_alt")) / (dt / 60.0), 3), F.lit(0.0)))
    return s.groupBy("hex").agg(*(F.max_by(c, seqs.place()).alias(c) for c in ("seq", "lat", "knots", "fpm")))


@query("win21_eta", f"{FX}, {LAST(1)} SELECT hex, round(CASE WHEN alt - {FIELD_FT} < 2000 THEN (2000 - (alt - {FIELD_FT})) / 500 * 60 + 180 ELSE (alt - {FIELD_FT}) / 800 * 60 + 60 END, 4) AS eta_s FROM lastn")
def win21(spark, sf_dir):
    agl = F.col("alt") - FIELD_FT
    eta = F.when(agl < 2000, (2000 - agl) / 500 * 60 + 180).otherwise(agl / 800 * 60 + 60)
    return seqs.last_fixes(analog.fixes(spark, sf_dir), 1).select("hex", F.round(eta, 4).alias("eta_s"))


def _trail_sql(cond: str) -> str:
    return f"tr AS (SELECT * FROM (SELECT *, bool_and({cond}) OVER (PARTITION BY hex ORDER BY t_ms DESC, seq DESC) AS ok FROM fixes) WHERE ok)"


@query("win22_ground_dwell", f"{FX}, {_trail_sql('alt <= 6500')} SELECT hex, count(*) AS n, max(t_ms) - min(t_ms) AS dwell, max(t_ms) - min(t_ms) >= 60 AS landed FROM tr GROUP BY hex")
def win22(spark, sf_dir):
    t = seqs.trailing(analog.fixes(spark, sf_dir), F.col("alt") <= 6500)
    dwell = F.max("t_ms") - F.min("t_ms")
    return t.groupBy("hex").agg(F.count("*").alias("n"), dwell.alias("dwell"), (dwell >= 60).alias("landed"))


@query("win23_stationary", f"{FX}, l AS (SELECT hex, last(lat ORDER BY t_ms, seq) AS la, last(lon ORDER BY t_ms, seq) AS lo FROM fixes GROUP BY hex), st AS (SELECT * FROM (SELECT f.*, bool_and({_FT('la', 'lo', 'lat', 'lon')} <= 20000) OVER (PARTITION BY hex ORDER BY t_ms DESC, seq DESC) AS ok FROM fixes f JOIN l USING (hex)) WHERE ok) SELECT hex, count(*) AS n, max(t_ms) - min(t_ms) AS dwell FROM st GROUP BY hex")
def win23(spark, sf_dir):
    f = analog.fixes(spark, sf_dir)
    near = geo.planar_ft(F.last("lat").over(seqs.every()), F.last("lon").over(seqs.every()), F.col("lat"), F.col("lon")) <= 20000
    t = seqs.trailing(f.withColumn("near", near), F.col("near"))
    return t.groupBy("hex").agg(F.count("*").alias("n"), (F.max("t_ms") - F.min("t_ms")).alias("dwell"))


@query("win24_live_runs", f"{CLASSED}, {runs_sql(f'(SELECT *, t_ms - lag(t_ms) OVER {W} > 40 OR sev IS DISTINCT FROM lag(sev) OVER {W} AS ch FROM classed WHERE alt IS NOT NULL)', 'ch')} SELECT hex, run, sev, count(*) AS n FROM runs GROUP BY ALL")
def win24(spark, sf_dir):
    c = classified(spark, sf_dir).filter("alt is not null")
    rows = seqs.islands(c, (F.col("t_ms") - F.lag("t_ms").over(seqs.by()) > 40) | seqs.changed("sev"))
    return rows.groupBy("hex", "run", "sev").agg(F.count("*").alias("n"))


@query("win25_gap_split", f"{FX}, {runs_sql(f'(SELECT *, sqrt(pow({_FT(f"lag(lat) OVER {W}", f"lag(lon) OVER {W}", "lat", "lon")}, 2) + pow(alt - lag(alt) OVER {W}, 2)) > 40000 AS ch FROM fixes)', 'ch', 'leg')} SELECT hex, leg, count(*) AS n FROM runs GROUP BY 1, 2 HAVING count(*) >= 2")
def win25(spark, sf_dir):
    step = geo.spatial_ft(F.lag("lat").over(seqs.by()), F.lag("lon").over(seqs.by()), F.lag("alt").over(seqs.by()), F.col("lat"), F.col("lon"), F.col("alt"))
    rows = seqs.islands(analog.fixes(spark, sf_dir), step > 40000, "leg")
    return rows.groupBy("hex", "leg").agg(F.count("*").alias("n")).filter("n >= 2")


_F5 = "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING"


@query("win26_moving_average", f"{FX} SELECT seq, round(avg(lat) OVER (PARTITION BY hex ORDER BY t_ms, seq {_F5}), 8) AS lat, round(avg(lon) OVER (PARTITION BY hex ORDER BY t_ms, seq {_F5}), 8) AS lon FROM fixes")
def win26(spark, sf_dir):
    w = seqs.by().rowsBetween(-2, 2)
    return analog.fixes(spark, sf_dir).select("seq", F.round(F.avg("lat").over(w), 8).alias("lat"), F.round(F.avg("lon").over(w), 8).alias("lon"))


@query("win28_best_climb", f"{FX} SELECT hex, max(c) AS best_ft FROM (SELECT hex, alt - lag(alt, 12) OVER {W} AS c FROM fixes) GROUP BY hex")
def win28(spark, sf_dir):
    return analog.fixes(spark, sf_dir).withColumn("c", F.col("alt") - F.lag("alt", 12).over(seqs.by())).groupBy("hex").agg(F.max("c").alias("best_ft"))


def nearest_index(rows, column: str, **places: float):
    """rows with, for each name, the aircraft's value at place min(floor(n p), n - 1) of its sorted values (nulls aside).

    A row number and a count over one partitioning; no list of an aircraft's values is made.
    """
    w = Window.partitionBy("hex")
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy(F.asc_nulls_last(column))) - 1, "_n": F.count(column).over(w)})
    at = lambda p: F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * p), F.col("_n") - 1), F.col(column))).over(w)
    return rows.withColumns({name: at(p) for name, p in places.items()}).drop("_i", "_n")


@query("win30_mean_heading", f"{FX}, {SEG}, h AS (SELECT *, degrees(atan2((lon - p_lon) * cos(radians((lat + p_lat) / 2)), lat - p_lat)) AS b FROM seg) SELECT seq, round(degrees(atan2(avg(sin(radians(b))) OVER v, avg(cos(radians(b))) OVER v)), 5) AS heading FROM h WINDOW v AS (PARTITION BY hex ORDER BY t_ms, seq {_F5})")
def win30(spark, sf_dir):
    s = seqs.segments(analog.fixes(spark, sf_dir))
    b = F.radians(geo.planar_bearing(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")))
    w = seqs.by().rowsBetween(-2, 2)
    return s.withColumn("b", b).select("seq", F.round(F.degrees(F.atan2(F.avg(F.sin("b")).over(w), F.avg(F.cos("b")).over(w))), 5).alias("heading"))


@query(
    "win32_resample",
    f"""{FX}, {SEG}, c AS (SELECT *, sum(len_ft) OVER {W} AS b FROM seg), d AS (SELECT *, b - len_ft AS a FROM c WHERE len_ft > 0),
e AS (SELECT *, unnest(range(CAST(ceil(a / 50003.7) AS BIGINT), CAST(ceil(b / 50003.7) AS BIGINT))) AS mark FROM d)
SELECT hex, mark, round(p_lat + (mark * 50003.7::DOUBLE - a) / len_ft * (lat - p_lat), 7) AS lat, round(p_lon + (mark * 50003.7::DOUBLE - a) / len_ft * (lon - p_lon), 7) AS lon FROM e WHERE mark > 0""",
)
def win32(spark, sf_dir):
    r = seqs.resample(analog.fixes(spark, sf_dir), 50003.7).filter("mark > 0")
    return r.select("hex", "mark", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("win33_heat_runs", f"{FX}, m AS (SELECT *, CAST(floor(least(alt / max(alt) OVER (PARTITION BY hex), 0.999) * 10) AS INT) AS bucket FROM fixes), {runs_sql(f'(SELECT *, bucket IS DISTINCT FROM lag(bucket) OVER {W} AS ch FROM m)', 'ch')} SELECT hex, run, bucket, count(*) AS n FROM runs GROUP BY ALL")
def win33(spark, sf_dir):
    top = F.max("alt").over(Window.partitionBy("hex"))
    f = analog.fixes(spark, sf_dir).withColumn("bucket", F.floor(F.least(F.col("alt") / top, F.lit(0.999)) * 10).cast("int"))
    return seqs.bands(f, "bucket", bridge=False).select("hex", "run", "bucket", "n")


@query("win35_clip_around_nearest", f"{FX}, d AS (SELECT *, {_NM('lat', 'lon', LAT0, LON0)} AS nm FROM fixes), {runs_sql(f'(SELECT *, (nm <= 4) IS DISTINCT FROM lag(nm <= 4) OVER {W} AS ch FROM d)', 'ch')}, b AS (SELECT hex, arg_min(run, nm * 1e6 + seq * 1e-9) AS run FROM runs WHERE nm <= 4 GROUP BY hex) SELECT hex, seq FROM runs JOIN b USING (hex, run)")
def win35(spark, sf_dir):
    f = analog.fixes(spark, sf_dir).withColumn("nm", geo.planar_nm(F.col("lat"), F.col("lon"), LAT0, LON0)).withColumn("near", F.col("nm") <= 4)
    runs = seqs.islands(f, seqs.changed("near")).filter("near")
    best = F.min_by("run", F.struct("nm", "seq")).over(Window.partitionBy("hex"))
    return runs.withColumn("best", best).filter(F.col("run") == F.col("best")).select("hex", "seq")


SUMS = lambda c: ", ".join(f"round(coalesce(sum(len_ft) FILTER (seg_sev = {i}), 0), 2) AS {n}_ft" for i, n in ((1, "yellow"), (2, "orange"), (3, "red")))


def track_stats(classed, cap: float | None):
    """One row per aircraft: segments and length by class (of fixes below ``cap``), worst class, total length."""
    whole = seqs.segments(classed).groupBy("hex").agg(F.round(F.sum("len_ft"), 2).alias("len_total_ft"))
    low = seqs.segments(classed if cap is None else classed.filter(F.col("alt") < cap))
    names = ((1, "yellow"), (2, "orange"), (3, "red"))
    agg = [F.count_if(F.col("seg_sev") == i).alias(f"seg_{n}") for i, n in names] + [F.round(F.sum(F.when(F.col("seg_sev") == i, F.col("len_ft")).otherwise(0.0)), 2).alias(f"{n}_ft") for i, n in names]
    return whole.join(low.groupBy("hex").agg(F.max("seg_sev").alias("worst"), *agg), "hex", "left")


_STATS = ", ".join(f"count(*) FILTER (seg_sev = {i}) AS seg_{n}" for i, n in ((1, "yellow"), (2, "orange"), (3, "red")))
LOWSEG = CSEG.replace("cseg AS", "lseg AS").replace("FROM classed)", "FROM classed WHERE alt < 7500)")


@query("agg19_track_stats", f"{CLASSED}, {CSEG}, {LOWSEG}, w AS (SELECT hex, round(sum(len_ft), 2) AS len_total_ft FROM cseg GROUP BY hex) SELECT w.*, worst, seg_yellow, seg_orange, seg_red, yellow_ft, orange_ft, red_ft FROM w LEFT JOIN (SELECT hex, max(seg_sev) AS worst, {_STATS}, {SUMS(0)} FROM lseg GROUP BY hex) USING (hex)")
def agg19(spark, sf_dir):
    return track_stats(classified(spark, sf_dir), 7500.0)


@query("agg20_live_track_stats", f"{CLASSED}, {CSEG} SELECT hex, round(sum(len_ft), 2) AS len_total_ft, max(seg_sev) AS worst, {_STATS}, {SUMS(0)} FROM cseg GROUP BY hex")
def agg20(spark, sf_dir):
    return track_stats(classified(spark, sf_dir), None)


@query("agg21_track_length", f"{CLASSED}, {CSEG} SELECT hex, round(sum(len_ft), 2) AS total_ft, round(coalesce(sum(len_ft) FILTER (seg_sev > 0), 0), 2) AS in_zone_ft, round(coalesce(sum(len_ft) FILTER (seg_sev > 1), 0), 2) AS in_red_ft FROM cseg GROUP BY hex")
def agg21(spark, sf_dir):
    over = lambda s: F.round(F.sum(F.when(F.col("seg_sev") > s, F.col("len_ft")).otherwise(0.0)), 2)
    return prior(spark, sf_dir).groupBy("hex").agg(F.round(F.sum("len_ft"), 2).alias("total_ft"), over(0).alias("in_zone_ft"), over(1).alias("in_red_ft"))


@query("agg22_seconds_by_class", f"{CLASSED}, {CSEG} SELECT hex, sev, sum(greatest(dt, 0)) AS seconds FROM cseg WHERE sev > 0 GROUP BY 1, 2")
def agg22(spark, sf_dir):
    return prior(spark, sf_dir).filter("sev > 0").groupBy("hex", "sev").agg(F.sum(F.greatest("dt", F.lit(0).cast("long"))).alias("seconds"))


@query("agg14_active_points", f"{CLASSED} SELECT hex, max(sev) AS worst, count(*) FILTER (sev = 3) AS red, count(*) FILTER (sev = 2) AS orange, count(*) FILTER (sev = 1) AS yellow, count(*) FILTER (sev > 0) AS hit, count(*) AS n, max(t_ms) AS last_seen FROM classed GROUP BY hex")
def agg14(spark, sf_dir):
    names = ((3, "red"), (2, "orange"), (1, "yellow"))
    c = classified(spark, sf_dir).groupBy("hex")
    return c.agg(F.max("sev").alias("worst"), *(F.count_if(F.col("sev") == i).alias(n) for i, n in names), F.count_if(F.col("sev") > 0).alias("hit"), F.count("*").alias("n"), F.max("t_ms").alias("last_seen")).orderBy(F.desc("worst"), F.desc("hit"), "hex")


@query("agg15_live_band_merge", f"{CLASSED}, {runs_sql(_CHANGED('sev'), 'ch')}, r AS (SELECT hex, run, sev, count(*) AS n FROM runs GROUP BY ALL) SELECT hex, sev, count(*) AS runs, sum(n) AS points, max(n) AS longest FROM r GROUP BY 1, 2")
def agg15(spark, sf_dir):
    b = seqs.bands(classified(spark, sf_dir), bridge=False)
    return b.groupBy("hex", "sev").agg(F.count("*").alias("runs"), F.sum("n").alias("points"), F.max("n").alias("longest"))


@query("agg10_merge_per_hex", f"{FX}, {SEG} SELECT hex, count(*) AS n, round(sum(len_ft), 2) AS len_ft FROM seg GROUP BY hex")
def agg10(spark, sf_dir):
    return seqs.segments(analog.fixes(spark, sf_dir)).groupBy("hex").agg(F.count("*").alias("n"), F.round(F.sum("len_ft"), 2).alias("len_ft"))


@query("agg33_track_quality", f"{FX}, {SEG}, m AS (SELECT hex, list_sort(list(len_ft))[CAST(floor(count(*) / 2.0) AS BIGINT) + 1] AS med FROM seg WHERE len_ft > 0 GROUP BY hex) SELECT seq, CASE WHEN len_ft / med < 2 THEN 'excellent' WHEN len_ft / med < 5 THEN 'good' ELSE 'poor' END AS quality FROM seg JOIN m USING (hex)")
def agg33(spark, sf_dir):
    s = seqs.segments(analog.fixes(spark, sf_dir))
    s = s.withColumn("pos", F.when(F.col("len_ft") > 0, F.col("len_ft")))
    ratio = F.col("len_ft") / F.col("med")
    return nearest_index(s, "pos", med=0.5).select("seq", F.when(ratio < 2, "excellent").when(ratio < 5, "good").otherwise("poor").alias("quality"))


@query("agg34_altitude_stats", f"{FX}, {SEG} SELECT hex, round(min(alt - {FIELD_FT}), 3) AS low, round(max(alt - {FIELD_FT}), 3) AS high, count(*) FILTER (alt - p_alt > 50) AS climbs, count(*) FILTER (alt - p_alt < -50) AS descents, count(*) FILTER (abs(alt - p_alt) <= 50) AS level FROM seg GROUP BY hex")
def agg34(spark, sf_dir):
    s = seqs.segments(analog.fixes(spark, sf_dir)).withColumn("d", F.col("alt") - F.col("p_alt"))
    agl = F.col("alt") - FIELD_FT
    return s.groupBy("hex").agg(F.round(F.min(agl), 3).alias("low"), F.round(F.max(agl), 3).alias("high"), F.count_if(F.col("d") > 50).alias("climbs"), F.count_if(F.col("d") < -50).alias("descents"), F.count_if(F.abs("d") <= 50).alias("level"))


@query("agg31_nearest_flagged", f"{CLASSED} SELECT hex, round(min({_NM('lat', 'lon', LAT0, LON0)}), 6) AS nm FROM classed WHERE sev > 0 GROUP BY hex")
def agg31(spark, sf_dir):
    return classified(spark, sf_dir).filter("sev > 0").groupBy("hex").agg(F.round(F.min(geo.planar_nm(F.col("lat"), F.col("lon"), LAT0, LON0)), 6).alias("nm"))


@query("agg32_ring_totals", f"{CLASSED} SELECT sev, count(*) AS n, count(DISTINCT hex) AS aircraft FROM classed WHERE {_NM('lat', 'lon', LAT0, LON0)} <= 4 GROUP BY sev")
def agg32(spark, sf_dir):
    c = classified(spark, sf_dir).filter(geo.planar_nm(F.col("lat"), F.col("lon"), LAT0, LON0) <= 4)
    return c.groupBy("sev").agg(F.count("*").alias("n"), F.countDistinct("hex").alias("aircraft"))


@query("flt10_band_trim", f"{FX}, n AS (SELECT *, lead(t_ms) OVER {W} AS nt FROM fixes) SELECT seq FROM n WHERE coalesce(nt, t_ms) >= 1000000")
def flt10(spark, sf_dir):
    f = analog.fixes(spark, sf_dir).withColumn("nt", F.lead("t_ms").over(seqs.by()))
    return f.filter(F.coalesce("nt", "t_ms") >= 1000000).select("seq")


@query("flt16_stride", f"{FX}, n AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY hex) AS c FROM fixes) SELECT seq FROM n WHERE (i - 1) % CAST(greatest(1, ceil(c / 20.0)) AS BIGINT) = 0 OR i = c")
def flt16(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy("hex"))
    f = analog.fixes(spark, sf_dir).withColumns({"i": F.row_number().over(seqs.by()), "c": n})
    step = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("c") / 20.0))
    return f.filter(((F.col("i") - 1) % step == 0) | (F.col("i") == F.col("c"))).select("seq")


@query("flt17_repeat_suppression", f"{FX} SELECT seq FROM (SELECT seq, lat, lon, lag(lat) OVER {W} AS a, lag(lon) OVER {W} AS b FROM fixes) WHERE a IS NULL OR a <> lat OR b <> lon")
def flt17(spark, sf_dir):
    f = analog.fixes(spark, sf_dir).withColumns({"a": F.lag("lat").over(seqs.by()), "b": F.lag("lon").over(seqs.by())})
    return f.filter(F.col("a").isNull() | (F.col("a") != F.col("lat")) | (F.col("b") != F.col("lon"))).select("seq")
