"""Boards of flights and aircraft: scores, landings, detectors, intent, tows, spectra (WIN-14/15/19/20/31, AGG-11/16/35, CMP-01/02/03/05/06)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..operators import detect, joins, lookup, noise
from ..operators import sequences as seqs
from ..sources import analog
from ..sources.analog import FIELD_FT, LAT0, LON0, with_sql
from ..streaming import ingest
from .rasters import _CLS_TAIL
from .registry import query
from .scalars import _FT, _NM, CELL_SQL, GRADE_SQL, TIER_SQL, classified, with_density
from .stores import timed
from .trajectories import CYCLES, GROUND, PHASES, SEG, W, flights

FX = with_sql("fixes")
#: fixes of one aircraft are hours apart here; the limits in time grow with that
_GAP, _MINUTE, _STALE = 60_000, 36_000.0, 200_000
RUNWAYS = {"08": 80.0, "26": 260.0}

# --- low passes and phases ------------------------------------------------------------------------------------


def _passes_sql(source: str, elev: str) -> str:
    """A CTE ``tg`` of the low passes of source (hex, t_ms, seq, lat, lon, alt), with crossings counted from the back."""
    low, high = f"alt < {elev} + 250", f"alt > {elev} + 800"
    return f"""i0 AS (SELECT *, row_number() OVER {W} - 1 AS idx, count(*) OVER (PARTITION BY hex) AS size, lead(alt) OVER {W} AS a1, lead(alt, 2) OVER {W} AS a2 FROM {source}),
ends AS (SELECT hex, idx AS end_idx, max(idx) FILTER ({high}) OVER (PARTITION BY hex ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_before, {high} AS hi FROM i0),
starts AS (SELECT e.hex, end_idx, min(i.idx) AS start_idx FROM ends e JOIN i0 i ON i.hex = e.hex AND i.idx < end_idx AND i.idx > coalesce(high_before, -1) AND i.{low} WHERE hi GROUP BY 1, 2),
bottoms AS (SELECT s.hex, start_idx, end_idx, arg_min(i.idx, i.alt * 1e6 + i.idx) AS bottom_idx FROM starts s JOIN i0 i ON i.hex = s.hex AND i.idx >= start_idx AND i.idx < end_idx GROUP BY 1, 2, 3),
climbs AS (SELECT b.hex, start_idx, min(i.idx) AS ascent_idx FROM bottoms b JOIN i0 i ON i.hex = b.hex AND i.idx >= bottom_idx AND i.idx < least(end_idx + 5, i.size - 3) AND a1 > alt AND a2 > a1 GROUP BY 1, 2),
tg AS (SELECT b.hex, start_idx, bottom_idx, end_idx, ascent_idx, a.t_ms - i.t_ms AS gap_s, i.alt - {elev.replace('elev', 'i.elev')} AS bottom_agl, i.t_ms AS bottom_ts, i.lat, i.lon
  FROM bottoms b LEFT JOIN climbs USING (hex, start_idx) JOIN i0 i ON i.hex = b.hex AND i.idx = bottom_idx LEFT JOIN i0 a ON a.hex = b.hex AND a.idx = ascent_idx)"""


_LOCAL = "floor((bottom_ts + 61200) % 86400 / 3600.0)"


@query("win14_touch_and_go", f"{FX}, {_passes_sql('fixes', str(FIELD_FT))} SELECT hex, start_idx, end_idx, round(bottom_agl, 4) AS bottom_agl, gap_s FROM tg WHERE gap_s <= {_GAP} AND ({_LOCAL} >= 17 OR {_LOCAL} < 5) AND {_NM('lat', 'lon', LAT0, LON0)} <= 4")
def win14(spark, sf_dir):
    """Touch-and-goes near the field whose lowest fix is in the quiet hours."""
    t = detect.touch_and_goes(detect.low_passes(analog.fixes(spark, sf_dir), F.lit(FIELD_FT)), _GAP)
    hour = scoring.local_hour(F.col("bottom_ts"))
    near = geo.planar_nm(F.col("lat"), F.col("lon"), LAT0, LON0) <= 4
    return t.filter(near & ((hour >= 17) | (hour < 5))).select("hex", "start_idx", "end_idx", F.round("bottom_agl", 4).alias("bottom_agl"), "gap_s")


def fielded(spark, sf_dir):
    """fixes with the elevation and code of the site nearest to their aircraft's lowest one."""
    f = analog.fixes(spark, sf_dir)
    lowest = f.groupBy("hex").agg(F.min(F.struct("alt", "t_ms", "seq", "lat", "lon")).alias("l"))
    sites = analog.airports(spark, sf_dir).select("code", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "elev")
    near = lowest.crossJoin(joins.small(sites))  # one row an aircraft, times 25 sites at most
    nm = geo.planar_nm(F.col("l.lat"), F.col("l.lon"), F.col("s_lat"), F.col("s_lon"))
    best = near.groupBy("hex").agg(F.min_by(F.struct("code", "elev"), F.struct(nm, "code")).alias("s")).select("hex", F.col("s.code").alias("site"), F.col("s.elev").alias("elev"))
    return f.join(best, "hex")


_FIELDED = f"""{with_sql('fixes', 'airports')}, lo AS (SELECT hex, arg_min(struct_pack(lat := lat, lon := lon), struct_pack(a := alt, t := t_ms, s := seq)) AS l FROM fixes GROUP BY hex),
st AS (SELECT hex, arg_min(struct_pack(code := code, elev := elev), struct_pack(d := {_NM('l.lat', 'l.lon', 'a.lat', 'a.lon')}, c := code)) AS s FROM lo CROSS JOIN airports a GROUP BY hex),
fe AS (SELECT f.*, s.code AS site, s.elev AS elev FROM fixes f JOIN st USING (hex))"""


@query("win15_touch_and_go_detector", f"{_FIELDED}, {_passes_sql('fe', 'elev')} SELECT hex, start_idx, bottom_idx, ascent_idx, end_idx, gap_s, round(bottom_agl, 4) AS bottom_agl FROM tg WHERE gap_s <= {_GAP}")
def win15(spark, sf_dir):
    t = detect.touch_and_goes(detect.low_passes(fielded(spark, sf_dir), F.col("elev")), _GAP)
    return t.select("hex", "start_idx", "bottom_idx", "ascent_idx", "end_idx", "gap_s", F.round("bottom_agl", 4).alias("bottom_agl"))


_PHASE = f"""{_FIELDED}, ev AS (SELECT *, CASE WHEN alt - elev < 250 THEN -1 WHEN alt - elev > 800 THEN 1 END AS e, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY hex) AS n FROM fe),
ce AS (SELECT hex, e, lag(e) OVER (PARTITION BY hex ORDER BY i) AS pe FROM ev WHERE e IS NOT NULL),
cr AS (SELECT hex, count(*) FILTER (pe = 1 AND e = -1) AS descents, count(*) FILTER (pe = -1 AND e = 1) AS ascents FROM ce GROUP BY hex),
ag AS (SELECT hex, max(n) AS n, any_value(site) AS site, round(min(alt - elev), 4) AS agl_min, round(max(alt - elev), 4) AS agl_max, bool_or(i = 1 AND alt - elev < 250) AS f, bool_or(i = n AND alt - elev < 250) AS l FROM ev GROUP BY hex)"""


@query("win15b_track_phase", f"{_PHASE} SELECT hex, site, n, agl_min, agl_max, coalesce(descents, 0) AS descents, coalesce(ascents, 0) AS ascents, CASE WHEN f AND NOT l THEN 'departure' WHEN NOT f AND l THEN 'arrival' WHEN NOT f AND NOT l THEN 'overflight' ELSE 'pattern' END AS phase FROM ag LEFT JOIN cr USING (hex) WHERE n >= 5")
def win15b(spark, sf_dir):
    f = fielded(spark, sf_dir)
    p = detect.track_phases(f, F.col("elev")).join(f.groupBy("hex").agg(F.first("site").alias("site")), "hex")
    return p.select("hex", "site", "n", F.round("agl_min", 4).alias("agl_min"), F.round("agl_max", 4).alias("agl_max"), "descents", "ascents", "phase")


# --- intent ---------------------------------------------------------------------------------------------------

_PURPOSE = "CASE WHEN type = 'GLID' THEN 'glider' WHEN purpose = 'survey' THEN 'tow_plane' WHEN type = 'C560' THEN 'airline' ELSE 'other' END"
_WRAP = lambda x: f"({x} - 360 * floor(({x} + 180) / 360))"
_OFFS = "[" + ", ".join(f"abs({_WRAP(f'(hdg - {h})')})" for h in RUNWAYS.values()) + "]"
_TURNS = "[" + ", ".join(_WRAP(f"(hdg - {h})") for h in RUNWAYS.values()) + "]"
INTENT = f"""{with_sql('fixes', 'aircraft')}, l90 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY t_ms DESC, seq DESC) AS back FROM fixes) WHERE back <= 90),
lg AS (SELECT *, lag(lat) OVER {W} AS la, lag(lon) OVER {W} AS lo FROM l90),
hd AS (SELECT *, CASE WHEN abs(lat - la) >= 1e-7 OR abs((lon - lo) * cos(radians((lat + la) / 2))) >= 1e-7 THEN degrees(atan2((lon - lo) * cos(radians((lat + la) / 2)), lat - la)) END AS h,
  {_NM('la', 'lo', 'lat', 'lon')} AS step, degrees(atan2((lon - lo) * cos(radians(lat)), lat - la)) AS eh, {_NM('lat', 'lon', LAT0, LON0)} AS nm FROM lg),
tn AS (SELECT *, abs({_WRAP(f'(h - lag(h) OVER {W})')}) AS turn FROM hd),
fe AS (SELECT hex, count(*) AS n, (arg_min(t_ms, back) - arg_max(t_ms, back)) / {_MINUTE}::DOUBLE AS mins, (arg_min(t_ms, back) - max(t_ms) FILTER (back = 3)) / {_MINUTE}::DOUBLE AS m3, arg_max(lat, back) AS lat0, arg_max(lon, back) AS lon0, arg_max(alt, back) AS alt0, arg_max(nm, back) AS nm0,
  arg_min(lat, back) AS lat1, arg_min(lon, back) AS lon1, arg_min(alt, back) AS alt1, arg_min(nm, back) AS nm1, max(lat) FILTER (back = 3) AS lat3, max(lon) FILTER (back = 3) AS lon3, coalesce(sum(turn), 0) AS turned, coalesce(sum(step), 0) AS path, stddev_pop(alt) AS alt_sd,
  coalesce(max(eh) FILTER (back = 1), 0) AS hdg FROM tn GROUP BY hex),
kn AS (SELECT *, CASE WHEN n >= 3 THEN {_NM('lat3', 'lon3', 'lat1', 'lon1')} * 60 / CASE WHEN m3 <> 0 THEN m3 ELSE 1 END ELSE 0 END AS knots, CASE WHEN mins > 0 THEN (nm0 - nm1) / mins ELSE 0 END AS closure, CASE WHEN mins > 0 THEN turned / mins ELSE 0 END AS rate, CASE WHEN mins > 0 THEN (alt1 - alt0) / mins ELSE 0 END AS climb_fpm FROM fe),
ft AS (SELECT hex, n, closure, CASE WHEN knots > 10 THEN closure * 60 / knots * 100 ELSE 0 END AS closure_pct, CASE WHEN mins > 0 AND knots * mins / 60 > 0.01 THEN turned / (knots * mins / 60) WHEN mins > 0 THEN 0 ELSE turned / 0.1 END AS turn_per_nm, climb_fpm, alt_sd, abs(alt1 - {FIELD_FT + 1000}) < 200 AS at_pattern_alt,
  CASE WHEN rate > 10 THEN knots / 60 / radians(rate) ELSE 99 END AS orbit_nm, CASE WHEN path > 0.01 THEN {_NM('lat0', 'lon0', 'lat1', 'lon1')} / path ELSE 1 END AS directness, list_min({_OFFS}) AS runway_off, ({_TURNS})[list_position({_OFFS}, list_min({_OFFS}))] AS runway_turn, nm1 AS dist_nm, alt1 - {FIELD_FT} AS agl FROM kn),
ru AS (SELECT ft.*, {_PURPOSE} AS use FROM ft JOIN aircraft ON tail = hex),
ri AS (SELECT *, CASE WHEN use = 'tow_plane' AND turn_per_nm > 200 THEN 'towing/0.9' WHEN use = 'glider' AND dist_nm > 3 THEN 'soaring/0.8' WHEN use = 'glider' THEN 'local_soaring/0.7' WHEN dist_nm < 3 AND turn_per_nm > 150 AND at_pattern_alt THEN 'pattern/0.85' WHEN dist_nm < 3 AND turn_per_nm > 100 THEN 'pattern/0.7'
  WHEN closure_pct > 60 AND dist_nm < 12 AND climb_fpm < 0 THEN 'inbound/0.8' WHEN closure_pct > 40 AND dist_nm < 15 THEN 'inbound/0.6' WHEN closure_pct < -60 AND dist_nm < 5 THEN 'outbound/0.8' WHEN closure_pct < -30 AND dist_nm < 8 AND climb_fpm > 200 THEN 'outbound/0.7'
  WHEN dist_nm > 5 AND directness < 0.4 AND alt_sd > 100 THEN 'practicing/0.75' WHEN dist_nm > 5 AND closure_pct > 20 THEN 'returning/0.6' WHEN dist_nm > 5 AND closure_pct < -20 THEN 'to_practice/0.6' WHEN use = 'airline' AND climb_fpm > 100 THEN 'outbound/0.6' WHEN use = 'airline' THEN 'inbound/0.6' ELSE 'transit/0.4' END AS ic FROM ru),
board AS (SELECT *, split_part(ic, '/', 1) AS intent, CAST(split_part(ic, '/', 2) AS DOUBLE) AS confidence, CASE WHEN NOT ic LIKE 'pattern%' THEN NULL WHEN agl < 50 THEN 'on_runway' WHEN agl < 200 AND abs(runway_turn) < 30 AND closure > 0 THEN 'short_final' WHEN abs(runway_turn) < 30 AND climb_fpm < -200 THEN 'final'
  WHEN abs({_WRAP('(runway_turn - 90)')}) < 40 AND climb_fpm < -100 THEN 'base' WHEN abs(runway_turn - 180) < 40 OR abs(runway_turn + 180) < 40 THEN 'downwind' WHEN abs({_WRAP('(runway_turn - 90)')}) < 40 AND climb_fpm > 100 THEN 'crosswind' WHEN abs(runway_turn) < 30 AND climb_fpm > 100 THEN 'upwind'
  WHEN closure > 0 AND dist_nm > 1.5 THEN 'entering' ELSE 'maneuvering' END AS leg FROM ri)"""


def intent_board(spark, sf_dir):
    """Features of each known aircraft's last 90 fixes, its intent, how sure that is, and the leg of a pattern."""
    use = F.when(F.col("type") == "GLID", "glider").when(F.col("purpose") == "survey", "tow_plane").when(F.col("type") == "C560", "airline").otherwise("other")
    known = analog.aircraft(spark, sf_dir).select(F.col("tail").alias("hex"), use.alias("purpose"))
    features = detect.intent_features(analog.fixes(spark, sf_dir), LAT0, LON0, FIELD_FT, RUNWAYS, 90, _MINUTE)
    return detect.intent(features.join(known, "hex"))


_FEATURES = ("closure_pct", "turn_per_nm", "climb_fpm", "alt_sd", "orbit_nm", "directness", "runway_off")


@query("win19_intent_features", f"{INTENT} SELECT hex, n, at_pattern_alt, {', '.join(f'round({c}, 5) AS {c}' for c in _FEATURES)} FROM board")
def win19(spark, sf_dir):
    return intent_board(spark, sf_dir).select("hex", "n", "at_pattern_alt", *(F.round(c, 5).alias(c) for c in _FEATURES))


@query("win20_intent_rules", f"{INTENT} SELECT hex, intent, confidence, leg FROM board")
def win20(spark, sf_dir):
    return intent_board(spark, sf_dir).select("hex", "intent", "confidence", "leg")


@query("agg16_intent_groups", f"{INTENT} SELECT intent, count(*) AS n FROM board GROUP BY 1")
def agg16(spark, sf_dir):
    return intent_board(spark, sf_dir).groupBy("intent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "intent")


@query("cmp05_intent_board", f"{INTENT} SELECT hex, intent, leg, confidence, round(dist_nm, 1) AS dist_nm, CAST(floor(agl + 0.5) AS BIGINT) AS agl, count(*) OVER (PARTITION BY intent) AS of_intent FROM board WHERE round(dist_nm, 1) <= 6")
def cmp05(spark, sf_dir):
    """Aircraft within six miles with intent and leg, and how many share it."""
    b = intent_board(spark, sf_dir).withColumn("dist_nm", F.round("dist_nm", 1)).filter("dist_nm <= 6")
    groups = b.groupBy("intent").agg(F.count("*").alias("of_intent"))
    return b.join(F.broadcast(groups), "intent").select("hex", "intent", "leg", "confidence", "dist_nm", F.floor(F.col("agl") + 0.5).alias("agl"), "of_intent")  # a row for each rule


# --- statistics of flights ----------------------------------------------------------------------------------------

_ROUND1 = lambda x: f"floor(round({x}, 9) * 10 + 0.5) / 10"
_BANDED = "CASE WHEN release_alt_ft < 6000 THEN '<6000' WHEN release_alt_ft < 7000 THEN '6000-7000' WHEN release_alt_ft < 8000 THEN '7000-8000' WHEN release_alt_ft < 9000 THEN '8000-9000' ELSE '9000+' END"
_RANK = lambda p: f"round(list_sort(list(cycle_time_min) FILTER (cycle_time_min <> 0))[CAST(least(floor(count(*) FILTER (cycle_time_min <> 0) * {p}::DOUBLE), count(*) FILTER (cycle_time_min <> 0) - 1) AS BIGINT) + 1], 6)"


@query(
    "agg11_flight_stats",
    f"""{with_sql('fixes', 'aircraft')}, {CYCLES}, c2 AS (SELECT *, unnest([struct_pack(by_ := 'hour', k := printf('%02d:00', CAST(takeoff_ts // 3600 % 24 AS INT))), struct_pack(by_ := 'glider', k := coalesce(school, 'unknown')), struct_pack(by_ := 'da_band', k := {_BANDED}), struct_pack(by_ := 'all', k := 'all')]) AS g
FROM cyc LEFT JOIN aircraft ON tail = hex WHERE cycle_time_min IS NOT NULL)
SELECT g.by_ AS grouping, g.k AS key, count(*) AS n, {_ROUND1('avg(cycle_time_min) FILTER (cycle_time_min <> 0)')} AS avg_cycle_min, CAST(nullif(floor({_ROUND1('avg(climb_rate_fpm) FILTER (climb_rate_fpm <> 0)')} + 0.5), 0) AS BIGINT) AS avg_climb_fpm, {_RANK(0.1)} AS p10, {_RANK(0.5)} AS p50, {_RANK(0.9)} AS p90 FROM c2 GROUP BY 1, 2""",
)
def agg11(spark, sf_dir):
    """Completed flights by hour, paired glider (the school stands in), altitude band and all together: means and exact ranks."""
    a = analog.aircraft(spark, sf_dir).select(F.col("tail").alias("hex"), "school")
    f = flights(spark, sf_dir).filter("cycle_time_min is not null").join(a, "hex", "left")
    alt = F.col("release_alt_ft")
    band = F.when(alt < 6000, "<6000").when(alt < 7000, "6000-7000").when(alt < 8000, "7000-8000").when(alt < 9000, "8000-9000").otherwise("9000+")
    keys = {"hour": scoring.hour_bucket(F.col("takeoff_ts") * 1000), "glider": F.coalesce("school", F.lit("unknown")), "da_band": band, "all": F.lit("all")}
    f = f.withColumn("g", F.explode(F.array(*(F.struct(F.lit(n).alias("grouping"), k.alias("key")) for n, k in keys.items())))).select("g.*", F.nullif("cycle_time_min", F.lit(0.0)).alias("cycle"), F.nullif("climb_rate_fpm", F.lit(0.0)).alias("climb"))
    mean = lambda c: scoring.js_round(F.round(F.avg(c), 9), 1)
    sums = f.groupBy("grouping", "key").agg(F.count("*").alias("n"), mean("cycle").alias("avg_cycle_min"), F.nullif(F.floor(mean("climb") + 0.5), F.lit(0)).cast("long").alias("avg_climb_fpm"))
    ranks = lookup.nearest_ranks(f, ["grouping", "key"], "cycle", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return sums.join(ranks, ["grouping", "key"], "left").select("grouping", "key", "n", "avg_cycle_min", "avg_climb_fpm", *(F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")))


@query("win31_cumulative_length", f"{FX}, {SEG} SELECT seq, round(sum(len_ft) OVER {W}, 2) AS so_far_ft FROM seg")
def win31(spark, sf_dir):
    return seqs.segments(analog.fixes(spark, sf_dir)).select("seq", F.round(F.sum("len_ft").over(seqs.by()), 2).alias("so_far_ft"))


_MARKS = 12


@query(
    "win31b_position_at_distance",
    f"""{FX}, pc AS (SELECT *, sum(coalesce({_FT('la', 'lo', 'lat', 'lon')}, 0)) OVER {W} AS ft, row_number() OVER {W} AS i, la, lo FROM (SELECT *, lag(lat) OVER {W} AS la, lag(lon) OVER {W} AS lo FROM fixes)),
mk AS (SELECT hex, max(ft) AS total, unnest(range(0, {_MARKS + 2})) AS k FROM pc GROUP BY hex),
pa AS (SELECT mk.hex, k, k / {_MARKS}.0::DOUBLE * total AS far, total, max(i) AS a FROM mk JOIN pc ON pc.hex = mk.hex AND ft <= k / {_MARKS}.0::DOUBLE * total GROUP BY 1, 2, 3, 4)
SELECT pa.hex, k, round(coalesce(p.lat + (n.lat - p.lat) * (far - p.ft) / nullif(n.ft - p.ft, 0), p.lat), 7) AS lat, round(coalesce(p.lon + (n.lon - p.lon) * (far - p.ft) / nullif(n.ft - p.ft, 0), p.lon), 7) AS lon
FROM pa JOIN pc p ON p.hex = pa.hex AND p.i = a LEFT JOIN pc n ON n.hex = pa.hex AND n.i = a + 1 AND far < total""",
)
def win31b(spark, sf_dir):
    """Positions at twelfths of every path, and beyond its end."""
    f = analog.fixes(spark, sf_dir)
    total = seqs.segments(f).groupBy("hex").agg(F.sum("len_ft").alias("total"))
    marks = f.select("hex").distinct().join(total, "hex", "left").select("hex", F.coalesce("total", F.lit(0.0)).alias("total"), F.explode(F.sequence(F.lit(0), F.lit(_MARKS + 1))).alias("k"))
    marks = marks.withColumn("ft", F.col("k") / float(_MARKS) * F.col("total"))
    found = lookup.positions_at(f, marks.select("hex", "ft").distinct())
    return marks.join(found, ["hex", "ft"]).select("hex", F.col("k").cast("long").alias("k"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


# --- tows ---------------------------------------------------------------------------------------------------------

_NEAR_NM, _NEAR_FT = 1.5, 1500.0


@query(
    "cmp06_active_tow",
    f"""{with_sql('fixes', 'aircraft')}, {PHASES}, p1 AS (SELECT hex, island, type, min(t_ms) AS t0, max(t_ms) AS t1 FROM ph GROUP BY 1, 2, 3),
lp AS (SELECT hex, arg_max(type, struct_pack(i := island, d := type = 'descent')) AS phase, max(t1) FILTER (type IN ('on_ground', 'taxiing')) AS cycle_start FROM p1 GROUP BY hex),
l5 AS (SELECT hex, count(*) AS n, arg_min(lat, back) AS lat, arg_min(lon, back) AS lon, arg_min(alt, back) AS alt, max(t_ms) AS t, CASE WHEN count(*) >= 3 AND max(t_ms) > min(t_ms) THEN floor((arg_min(alt, back) - arg_max(alt, back)) / ((max(t_ms) - min(t_ms)) / {_MINUTE}::DOUBLE) + 0.5) END AS fpm
  FROM (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY t_ms DESC, seq DESC) AS back FROM fixes) WHERE back <= 5 GROUP BY hex),
sn AS (SELECT l5.*, coalesce(purpose = 'survey', false) AS tow FROM l5 JOIN aircraft ON tail = hex),
up AS (SELECT * FROM sn WHERE alt > {FIELD_FT + 150} AND t >= (SELECT max(t_ms) FROM fixes) - {_STALE}),
pr AS (SELECT a.hex, arg_min(b.hex, struct_pack(d := {_NM('a.lat', 'a.lon', 'b.lat', 'b.lon')}, h := b.hex)) AS glider FROM up a JOIN up b ON a.tow AND NOT b.tow AND {_NM('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {_NEAR_NM} AND abs(a.alt - b.alt) <= {_NEAR_FT} GROUP BY 1)
SELECT hex, phase, alt, CAST(fpm AS BIGINT) AS fpm, cycle_start, glider,
  CAST(CASE WHEN phase = 'climb' AND fpm > 0 THEN CASE WHEN alt - {FIELD_FT} >= 2000 THEN 0 ELSE floor((2000 - (alt - {FIELD_FT})) / fpm * 60 + 0.5) END END AS BIGINT) AS release_s,
  CAST(CASE WHEN phase = 'climb' AND fpm > 0 THEN CASE WHEN alt - {FIELD_FT} >= 2000 THEN 120 ELSE floor((2000 - (alt - {FIELD_FT})) / fpm * 60 + 180.5) END WHEN phase = 'descent' THEN floor(greatest(alt - {FIELD_FT}, 0) / 800 * 60 + 60.5) END AS BIGINT) AS available_s
FROM sn JOIN lp USING (hex) LEFT JOIN pr USING (hex) WHERE tow""",
)
def cmp06(spark, sf_dir):
    """Tow aircraft with phase, climb, forecast release and return, and the glider that is nearest while both are up.

    Latest positions meet by grid cell; the reach of a cell covers the limit, so no pair is missed or formed beyond the neighbours.
    """
    f = analog.fixes(spark, sf_dir)
    p = seqs.phases(f, GROUND).withColumn("late", F.struct("island", F.col("type") == "descent"))
    state = p.groupBy("hex").agg(F.max_by("type", "late").alias("phase"), F.max(F.when(F.col("type").isin("on_ground", "taxiing"), F.col("end_ts"))).alias("cycle_start"))
    span = (F.max("t_ms") - F.min("t_ms")) / _MINUTE
    rate = F.floor((F.min_by("alt", "back") - F.max_by("alt", "back")) / F.nullif(span, F.lit(0.0)) + 0.5)
    last = seqs.last_fixes(f, 5).groupBy("hex").agg(*(F.min_by(c, "back").alias(c) for c in ("lat", "lon", "alt")), F.max("t_ms").alias("t"), F.when(F.count("*") >= 3, rate).cast("long").alias("fpm"))
    roles = analog.aircraft(spark, sf_dir).select(F.col("tail").alias("hex"), F.coalesce(F.col("purpose") == "survey", F.lit(False)).alias("tow"))
    snap = last.join(roles, "hex")
    now = f.agg(F.max("t_ms").alias("now"))
    up = snap.crossJoin(F.broadcast(now)).filter((F.col("alt") > FIELD_FT + 150) & (F.col("t") >= F.col("now") - _STALE))  # one row
    cell = _NEAR_NM / geo.NM_PER_DEG * 1.5
    placed = up.withColumns({"cy": F.floor(F.col("lat") / cell), "cx": F.floor(F.col("lon") / cell)})
    around = placed.filter("tow").withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))).withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)))
    others = placed.filter("not tow").select("cy", "cx", *(F.col(c).alias(f"o_{c}") for c in ("hex", "lat", "lon", "alt")))
    nm = geo.planar_nm(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    pairs = around.join(others, ["cy", "cx"]).withColumn("nm", nm).filter((F.col("nm") <= _NEAR_NM) & (F.abs(F.col("alt") - F.col("o_alt")) <= _NEAR_FT))
    best = pairs.groupBy("hex").agg(F.min(F.struct("nm", "o_hex"))["o_hex"].alias("glider"))
    agl = F.col("alt") - FIELD_FT
    tows = snap.filter("tow").join(state, "hex").join(best, "hex", "left")
    climbing = (F.col("phase") == "climb") & (F.col("fpm") > 0)
    left = (2000 - agl) / F.col("fpm") * 60
    release = F.when(climbing, F.when(agl >= 2000, 0).otherwise(F.floor(left + 0.5)))
    back = F.when(climbing, F.when(agl >= 2000, 120).otherwise(F.floor(left + 180.5))).when(F.col("phase") == "descent", F.floor(F.greatest(agl, F.lit(0.0)) / 800 * 60 + 60.5))
    return tows.select("hex", "phase", "alt", "fpm", "cycle_start", "glider", release.cast("long").alias("release_s"), back.cast("long").alias("available_s"))


# --- flights and their scores ---------------------------------------------------------------------------------------

_CELL_M, _SCALE = 2000.0, 1e9
_K = {"quiet_skies": 1.5, "neighbor_harmony": 3.0, "altitude_generosity": 2.0, "score": 2.0}
_HP = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in scoring.POWER.items()) + f" ELSE {scoring.DEFAULT_POWER}::DOUBLE END"
_WEIGHT = "CASE klass WHEN 'orange' THEN 2 WHEN 'red' THEN 3 ELSE 1 END"
_TO_SCORE = lambda x, k: f"CAST(floor(100 * exp(-greatest(0.0, {x}) / {k}) + 0.5) AS INT)"
_PRAISE = [
    ("silent", "No engine was heard below"),
    ("quiet_skies >= 85", "Peaceful skies over the neighbours"),
    ("altitude_generosity >= 90", "High above every quiet zone"),
    ("altitude_generosity < 90 AND zone_s = 0", "Clear of the quiet zones all the way"),
    ("voices = 0", "Nobody had a word to say"),
    ("trip_min >= 8 AND score >= 80", "A long and considerate flight"),
]
_SCORED = f"""{with_sql('fixes', 'zone_edges', 'pop_grid', 'aircraft', 'complaints', 'airports')}, {_CLS_TAIL}, {CYCLES},
fp AS (SELECT c.flight_id, c.hex, i.t_ms, i.seq, i.lat, i.lon, i.alt, k.sev, row_number() OVER (PARTITION BY c.flight_id ORDER BY i.t_ms, i.seq) AS i, {_HP} AS hp FROM cyc c JOIN isl i USING (hex, island) JOIN classed k ON k.seq = i.seq LEFT JOIN aircraft ON tail = c.hex WHERE landing_ts IS NOT NULL),
{noise.flight_cells_sql('fp', cell_m=_CELL_M, field_ft=FIELD_FT)},
ex AS (SELECT flight_id, sum(energy * coalesce(density, 0.0) * {(_CELL_M / 1000) ** 2}::DOUBLE) AS exposure, max(energy) AS peak FROM fcell LEFT JOIN pop_grid ON pop_grid.row = {CELL_SQL[False][0]} AND pop_grid.col = {CELL_SQL[False][1]} GROUP BY 1),
zs AS (SELECT flight_id, coalesce(sum(dt * s), 0) AS weighted, coalesce(sum(dt) FILTER (s > 0), 0) AS zone_s FROM (SELECT flight_id, greatest(0, t_ms - lag(t_ms) OVER v) AS dt, greatest(sev, lag(sev) OVER v) AS s FROM fp WINDOW v AS (PARTITION BY flight_id ORDER BY i)) GROUP BY 1),
vo AS (SELECT flight_id, count(*) AS voices, sum({_WEIGHT}) AS weight FROM cyc JOIN complaints ON tail = hex AND coalesce(ended, started) >= takeoff_ts - 600 AND started <= landing_ts + 600 WHERE landing_ts IS NOT NULL GROUP BY 1),
ld AS (SELECT c.flight_id, c.hex, landing_ts, cycle_time_min AS trip_min, coalesce(voices, 0) AS voices, zone_s, exposure, exposure IS NULL AND {_HP} <= 0 AS silent, CASE WHEN peak > 0 THEN round(10 * log10(peak), 1) END AS peak_db,
    log10(1 + coalesce(exposure, 0) / {_SCALE}) / greatest(cycle_time_min, 1) AS noise_load, 2.0::DOUBLE * coalesce(weight, 0) / greatest(cycle_time_min, 1) AS voice_load, weighted / 60.0 / greatest(cycle_time_min, 1) AS zone_load
  FROM cyc c LEFT JOIN ex USING (flight_id) LEFT JOIN vo USING (flight_id) JOIN zs USING (flight_id) LEFT JOIN aircraft ON tail = c.hex WHERE landing_ts IS NOT NULL),
sc AS (SELECT *, {_TO_SCORE('noise_load', 1.5)} AS quiet_skies, {_TO_SCORE('voice_load', 3.0)} AS neighbor_harmony, {_TO_SCORE('zone_load', 2.0)} AS altitude_generosity, {_TO_SCORE('(noise_load + voice_load + zone_load)', 2.0)} AS score FROM ld),
scored AS (SELECT *, {TIER_SQL('score')} AS tier, coalesce(nullif(concat_ws('; ', {', '.join(f"CASE WHEN {when} THEN '{what}' END" for when, what in _PRAISE)}), ''), 'Thank you for flying') AS highlights FROM sc)"""


def scored_flights(spark, sf_dir):
    """Completed flights with loads by the minute as scores from 0 to 100 (higher is gentler), their tier and highlights.

    Noise is what the flight's energy brings to the people of each cell, voices are complaints about the aircraft that overlap the flight,
    padded by ten minutes, zones the seconds spent in classes, weighted by severity.
    """
    f = flights(spark, sf_dir).filter("landing_ts is not null")
    kinds = analog.aircraft(spark, sf_dir).select(F.col("tail").alias("hex"), "type")
    c = classified(spark, sf_dir)
    isl = seqs.air_islands(c, GROUND).select("hex", "island", "t_ms", "seq", "lat", "lon", "alt", "sev")
    points = isl.join(f.select("hex", "island", "flight_id"), ["hex", "island"])
    flight = Window.partitionBy("flight_id").orderBy("t_ms", "seq")
    points = points.withColumn("i", F.row_number().over(flight))
    powered = points.join(kinds, "hex", "left")
    cells = noise.flight_cells(powered, scoring.horsepower(F.col("type")), cell_m=_CELL_M, field_ft=FIELD_FT)
    people = with_density(cells, analog.pop_grid(spark, sf_dir), False)
    exposure = people.groupBy("flight_id").agg(F.sum(F.col("energy") * F.col("density") * (_CELL_M / 1000) ** 2).alias("exposure"), F.max("energy").alias("peak"))
    pairs = points.withColumns({"dt": F.greatest(F.lit(0), F.col("t_ms") - F.lag("t_ms").over(flight)), "s": F.greatest("sev", F.lag("sev").over(flight))})
    zones = pairs.withColumn("dt", F.when(F.col("i") > 1, F.col("dt"))).groupBy("flight_id").agg(F.coalesce(F.sum(F.col("dt") * F.col("s")), F.lit(0)).alias("weighted"), F.coalesce(F.sum(F.when(F.col("s") > 0, F.col("dt"))), F.lit(0)).alias("zone_s"))
    weight = F.when(F.col("klass") == "orange", 2).when(F.col("klass") == "red", 3).otherwise(1)
    heard = joins.overlapping(analog.complaints(spark, sf_dir).withColumnRenamed("tail", "hex"), f, "hex", 600)
    voices = heard.groupBy("flight_id").agg(F.count("*").alias("voices"), F.sum(weight).alias("weight"))
    rows = f.join(exposure, "flight_id", "left").join(voices, "flight_id", "left").join(zones, "flight_id").join(kinds, "hex", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    minutes = F.greatest("cycle_time_min", F.lit(1.0))
    rows = rows.select(
        "flight_id",
        "hex",
        "landing_ts",
        F.col("cycle_time_min").alias("trip_min"),
        zero("voices").alias("voices"),
        "zone_s",
        "exposure",
        (F.col("exposure").isNull() & (scoring.horsepower(F.col("type")) <= 0)).alias("silent"),
        F.when(F.col("peak") > 0, F.round(10 * F.log10("peak"), 1)).alias("peak_db"),
        (F.log10(1 + zero("exposure") / _SCALE) / minutes).alias("noise_load"),
        (2.0 * zero("weight") / minutes).alias("voice_load"),
        (F.col("weighted") / 60.0 / minutes).alias("zone_load"),
    )
    loads = {"quiet_skies": F.col("noise_load"), "neighbor_harmony": F.col("voice_load"), "altitude_generosity": F.col("zone_load"), "score": F.col("noise_load") + F.col("voice_load") + F.col("zone_load")}
    rows = rows.withColumns({name: scoring.load_score(load, _K[name]) for name, load in loads.items()})
    praise = F.concat_ws("; ", *(F.when(F.expr(when), what) for when, what in _PRAISE))
    return rows.withColumn("tier", scoring.tier(F.col("score"))).withColumn("highlights", F.coalesce(F.nullif(praise, F.lit("")), F.lit("Thank you for flying")))


_SHOWN = ("flight_id", "hex", "voices", "zone_s", "peak_db", "quiet_skies", "neighbor_harmony", "altitude_generosity", "score", "tier", "highlights")


@query("cmp01_flight_score", f"{_SCORED} SELECT {', '.join(_SHOWN)}, round(log10(1 + coalesce(exposure, 0)), 5) AS exposure FROM scored")
def cmp01(spark, sf_dir):
    return scored_flights(spark, sf_dir).select(*_SHOWN, F.round(F.log10(1 + F.coalesce("exposure", F.lit(0.0))), 5).alias("exposure"))


_AT = f"""lf AS (SELECT flight_id, arg_max(struct_pack(lat := lat, lon := lon), i) AS p FROM fp GROUP BY 1),
ls AS (SELECT flight_id, arg_min(code, struct_pack(d := {_NM('p.lat', 'p.lon', 'a.lat', 'a.lon')}, c := code)) AS site FROM lf CROSS JOIN airports a WHERE {_NM('p.lat', 'p.lon', 'a.lat', 'a.lon')} <= 5 GROUP BY 1)"""
_RECENT = 1_500_000


@query(
    "cmp02_recent_landings",
    f"""{_SCORED}, {_AT}, hm AS (SELECT s.*, site, school IS NOT NULL OR count(*) OVER (PARTITION BY hex, site) >= 2 AS home FROM scored s JOIN ls USING (flight_id) LEFT JOIN aircraft ON tail = hex)
SELECT flight_id, hex, site, home, score, tier, CASE WHEN home THEN 'Welcome home, ' || hex ELSE 'Welcome, ' || hex || ', good to see you at ' || site END AS greeting FROM hm WHERE landing_ts >= (SELECT max(t_ms) FROM fixes) - {_RECENT} ORDER BY landing_ts DESC""",
)
def cmp02(spark, sf_dir):
    """Landings of the last while at the site nearest to them, scored; at home are aircraft of the fleet, and those that land there twice."""
    f = flights(spark, sf_dir).filter("landing_ts is not null").select("hex", "island", "flight_id")
    isl = seqs.air_islands(analog.fixes(spark, sf_dir), GROUND)
    ends = isl.groupBy("hex", "island").agg(F.max_by(F.struct("lat", "lon", "seq"), seqs.place()).alias("p")).join(f, ["hex", "island"])
    at = joins.nearest_site(ends.select("flight_id", "p.lat", "p.lon", "p.seq"), analog.airports(spark, sf_dir), 5.0).filter("site is not null").select("flight_id", "site")
    fleet = analog.aircraft(spark, sf_dir).filter("school is not null").select(F.col("tail").alias("hex"), F.lit(True).alias("known"))
    rows = scored_flights(spark, sf_dir).join(at, "flight_id").join(fleet, "hex", "left")
    home = F.coalesce("known", F.lit(False)) | (F.count("*").over(Window.partitionBy("hex", "site")) >= 2)
    now = analog.fixes(spark, sf_dir).agg(F.max("t_ms").alias("now"))
    rows = rows.withColumn("home", home).crossJoin(F.broadcast(now)).filter(F.col("landing_ts") >= F.col("now") - _RECENT)
    tail = F.col("hex").cast("string")
    greeting = F.when(F.col("home"), F.concat(F.lit("Welcome home, "), tail)).otherwise(F.concat(F.lit("Welcome, "), tail, F.lit(", good to see you at "), F.col("site").cast("string")))
    return rows.orderBy(F.desc("landing_ts")).select("flight_id", "hex", "site", "home", "score", "tier", greeting.alias("greeting"))


# --- landings at one site ---------------------------------------------------------------------------------------------

_CODE, _POP_SCALE, _NEAR_SITE = 12, 2500.0, 4.0
_HERE = f"{_NM('lat', 'lon', 'a_lat', 'a_lon')} <= {_NEAR_SITE}"


@query(
    "cmp03_landings_at_airport",
    f"""{with_sql('fixes', 'aircraft', 'airports', 'pop_grid')}, {CYCLES}, ap AS (SELECT lat AS a_lat, lon AS a_lon, elev FROM airports WHERE code = {_CODE}),
big AS (SELECT hex FROM fixes GROUP BY hex HAVING count(*) >= 5),
en AS (SELECT flight_id, any_value(c.hex) AS hex, any_value(takeoff_ts) AS takeoff_ts, any_value(landing_ts) AS landing_ts, arg_max(lat, struct_pack(t := t_ms, s := seq)) AS lat, arg_max(lon, struct_pack(t := t_ms, s := seq)) AS lon FROM cyc c JOIN big USING (hex) JOIN fixes f ON f.hex = c.hex AND f.t_ms <= landing_ts GROUP BY 1),
he AS (SELECT hex, takeoff_ts, landing_ts FROM en, ap WHERE {_HERE}),
gp AS (SELECT *, sum(CASE WHEN takeoff_ts - pl < {_GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY hex ORDER BY takeoff_ts, landing_ts) AS g FROM (SELECT *, lag(landing_ts) OVER (PARTITION BY hex ORDER BY takeoff_ts, landing_ts) AS pl FROM he)),
mg AS (SELECT hex, min(takeoff_ts) AS t0, max(landing_ts) AS t1, false AS inferred FROM gp GROUP BY hex, g),
la AS (SELECT hex, arg_max(lat, o) AS lat, arg_max(lon, o) AS lon, arg_max(alt, o) AS alt, max(t_ms) AS t1, min(t_ms) AS first_t, min(t_ms) FILTER (alt > elev + 200) AS air_t FROM (SELECT *, struct_pack(t := t_ms, s := seq) AS o FROM fixes), ap WHERE hex IN (SELECT hex FROM big) GROUP BY hex),
fb AS (SELECT hex, coalesce(air_t, first_t) AS t0, t1, true AS inferred FROM la, ap WHERE hex NOT IN (SELECT hex FROM mg) AND alt <= elev + 1500 AND {_HERE}),
lg AS (SELECT * FROM mg UNION ALL SELECT * FROM fb),
pt AS (SELECT l.hex, l.t0, l.t1, inferred, f.t_ms, f.seq, f.lat, f.lon, f.alt, lag(f.lat) OVER v AS pla, lag(f.lon) OVER v AS plo, lag(f.alt) OVER v AS pal, count(*) OVER (PARTITION BY l.hex, l.t0) AS n FROM lg l JOIN fixes f ON f.hex = l.hex AND f.t_ms BETWEEN l.t0 AND l.t1 WINDOW v AS (PARTITION BY l.hex, l.t0 ORDER BY f.t_ms, f.seq)),
sg AS (SELECT hex, t0, {_FT('pla', 'plo', 'lat', 'lon')} AS len, (alt + pal) / 2 AS a, (lat + pla) / 2 AS lat, (lon + plo) / 2 AS lon FROM pt WHERE n >= 3 AND pla IS NOT NULL),
ix AS (SELECT hex, t0, sum(coalesce(density, 0) * len * pow(1000 / greatest(300.0, a - 5300), 2)) / nullif(sum(len), 0) / {_POP_SCALE} AS idx FROM sg LEFT JOIN pop_grid ON pop_grid.row = {CELL_SQL[False][0]} AND pop_grid.col = {CELL_SQL[False][1]} GROUP BY 1, 2),
s0 AS (SELECT hex, t0, any_value(t1) AS t1, bool_or(inferred) AS inferred, arg_min(lat, struct_pack(t := t_ms, s := seq)) AS lat, arg_min(lon, struct_pack(t := t_ms, s := seq)) AS lon FROM pt WHERE n >= 3 GROUP BY 1, 2),
og AS (SELECT hex, t0, arg_min(code, struct_pack(d := {_NM('s.lat', 's.lon', 'a.lat', 'a.lon')}, c := code)) AS origin FROM s0 s CROSS JOIN airports a WHERE {_NM('s.lat', 's.lon', 'a.lat', 'a.lon')} <= 3 GROUP BY 1, 2),
pu AS (SELECT s0.*, round(coalesce(idx, 0), 3) AS impact_index, round(coalesce(idx, 0) * CASE WHEN school IS NOT NULL THEN 2 ELSE 1 END, 3) AS impact_score, og.origin AS origin FROM s0 LEFT JOIN ix USING (hex, t0) LEFT JOIN og USING (hex, t0) LEFT JOIN aircraft ON tail = hex)
SELECT hex, t0 AS takeoff_ts, t1 AS landing_ts, inferred, origin, round(greatest(0, t1 - t0) / 60.0, 1) AS airborne_min, impact_index, impact_score, {GRADE_SQL('impact_score')} AS grade FROM pu""",
)
def cmp03(spark, sf_dir):
    """Landings at one site with a grade by population impact, twice for training; touch-and-goes there are one flight.

    Aircraft without a flight that ends there get one landing inferred if their last fix is low and near.
    """
    f = analog.fixes(spark, sf_dir).withColumn("size", F.count("*").over(Window.partitionBy("hex"))).filter("size >= 5").drop("size")
    site = F.broadcast(analog.airports(spark, sf_dir).filter(F.col("code") == _CODE).select(F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("elev").alias("a_elev")))  # one row
    here = geo.planar_nm(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon")) <= _NEAR_SITE
    done = seqs.cycles(f, GROUND).filter("landing_ts is not null").select("hex", "takeoff_ts", "landing_ts")
    ends = joins.as_of(done, f, "hex", "landing_ts", "t_ms", ["seq", "lat", "lon"]).withColumnsRenamed({"r_lat": "lat", "r_lon": "lon"})
    legs = ends.crossJoin(site).filter(here).select("hex", "takeoff_ts", "landing_ts")
    w = Window.partitionBy("hex").orderBy("takeoff_ts", "landing_ts")
    near = F.coalesce(F.col("takeoff_ts") - F.lag("landing_ts").over(w) < _GAP, F.lit(False))
    legs = legs.withColumn("g", F.sum((~near).cast("int")).over(w))
    merged = legs.groupBy("hex", "g").agg(F.min("takeoff_ts").alias("t0"), F.max("landing_ts").alias("t1")).select("hex", "t0", "t1", F.lit(False).alias("inferred"))
    place = seqs.place()
    last = f.crossJoin(site).groupBy("hex", "a_lat", "a_lon", "a_elev").agg(*(F.max_by(c, place).alias(c) for c in ("lat", "lon", "alt")), F.max("t_ms").alias("t1"), F.min("t_ms").alias("first"), F.min(F.when(F.col("alt") > F.col("a_elev") + 200, F.col("t_ms"))).alias("air"))
    inferred = last.filter(here & (F.col("alt") <= F.col("a_elev") + 1500)).join(merged.select("hex"), "hex", "left_anti").select("hex", F.coalesce("air", "first").alias("t0"), "t1", F.lit(True).alias("inferred"))
    landed = merged.unionByName(inferred)
    own = f.join(landed, "hex").filter((F.col("t_ms") >= F.col("t0")) & (F.col("t_ms") <= F.col("t1")))
    v = Window.partitionBy("hex", "t0").orderBy("t_ms", "seq")
    own = own.withColumn("n", F.count("*").over(Window.partitionBy("hex", "t0"))).filter("n >= 3").withColumns({f"p_{c}": F.lag(c).over(v) for c in ("lat", "lon", "alt")})
    first = own.groupBy("hex", "t0").agg(F.max("t1").alias("t1"), F.bool_or("inferred").alias("inferred"), F.min_by(F.struct("lat", "lon", "seq"), place).alias("p"))
    middle = own.filter("p_lat is not null").select("hex", "t0", geo.planar_ft(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")).alias("len"), *(((F.col(c) + F.col(f"p_{c}")) / 2).alias(c) for c in ("lat", "lon", "alt")))
    dense = with_density(middle, analog.pop_grid(spark, sf_dir), False)
    impact = F.col("density") * F.col("len") * F.pow(1000 / F.greatest(F.lit(300.0), F.col("alt") - 5300), F.lit(2))
    index = dense.groupBy("hex", "t0").agg((F.sum(impact) / F.nullif(F.sum("len"), F.lit(0.0)) / _POP_SCALE).alias("idx"))
    origin = joins.nearest_site(first.select("hex", "t0", "p.lat", "p.lon", "p.seq"), analog.airports(spark, sf_dir), 3.0).select("hex", "t0", F.col("site").alias("origin"))
    schools = analog.aircraft(spark, sf_dir).select(F.col("tail").alias("hex"), "school")
    rows = first.join(index, ["hex", "t0"], "left").join(origin, ["hex", "t0"], "left").join(schools, "hex", "left")
    idx = F.coalesce("idx", F.lit(0.0))
    rows = rows.withColumns({"impact_index": F.round(idx, 3), "impact_score": F.round(idx * F.when(F.col("school").isNotNull(), 2).otherwise(1), 3)})
    return rows.select("hex", F.col("t0").alias("takeoff_ts"), F.col("t1").alias("landing_ts"), "inferred", "origin", F.round(F.greatest(F.lit(0), F.col("t1") - F.col("t0")) / 60.0, 1).alias("airborne_min"), "impact_index", "impact_score", scoring.impact_grade(F.col("impact_score")).alias("grade"))


# --- spectra ------------------------------------------------------------------------------------------------------------

_BINS, _HZ = 64, 200.0


def _weights() -> list[float]:
    """Decibels by which the ear discounts each bin, to a tenth."""
    out = [-50.0]
    for i in range(1, _BINS):
        f2 = (i * _HZ) ** 2
        out.append(round(20 * math.log10(12194.0**2 * f2 * f2 / ((f2 + 20.6**2) * math.sqrt((f2 + 107.7**2) * (f2 + 737.9**2)) * (f2 + 12194.0**2))) + 2.0, 1))
    return out


_AW = "[" + ", ".join(f"{w}::DOUBLE" for w in _weights()) + "]"
_SPAN = noise.band_bins(_BINS, _HZ)
_LVL = lambda p: f"CASE WHEN {p} > 1e-12 THEN 10 * log10({p}) ELSE -100.0 END"
_V = "(PARTITION BY source ORDER BY t, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_OUT35 = [*(f"mean{b}" for b in range(5)), *(f"dba{b}" for b in range(5)), *(f"sustained{b}" for b in range(5)), *(f"sustained_dba{b}" for b in range(5)), "dba", "sustained", "sustained_dba"]


@query(
    "agg35_spectral_bands",
    f"""{FX}, sp AS (SELECT hex AS source, t_ms AS t, seq, list_transform(range({_BINS}), lambda i: -90 + (seq * (i + 3) * 7919 % 600) / 10.0::DOUBLE) AS db FROM fixes),
pw AS (SELECT *, list_transform(range({_BINS}), lambda i: pow(10.0::DOUBLE, (db[i + 1] + ({_AW})[i + 1]) / 10)) AS p FROM sp),
b1 AS (SELECT source, t, seq, {', '.join(f'list_sum(db[{lo + 1}:{hi + 1}]) / {hi - lo + 1} AS mean{b}, {_LVL(f"list_sum(p[{lo + 1}:{hi + 1}])")} AS dba{b}' for b, (lo, hi) in enumerate(_SPAN))}, {_LVL(f"list_sum(p[2:{_BINS}])")} AS dba, (list_position(p[2:{_BINS}], list_max(p[2:{_BINS}]))) * {_HZ} AS hz FROM pw),
b2 AS (SELECT *, {', '.join(f'min(mean{b}) OVER {_V} AS sustained{b}, min(dba{b}) OVER {_V} AS sustained_dba{b}' for b in range(5))}, min(dba) OVER {_V} AS sustained_dba, list_sort(list(hz) OVER {_V}) AS hs FROM b1)
SELECT seq, {', '.join(f'round({c}, 6) AS {c}' for c in _OUT35 if c != 'sustained')}, round(greatest(sustained0, sustained1, sustained2, sustained3, sustained4), 6) AS sustained, CAST(hz AS DOUBLE) AS hz, CAST(hs[CAST(floor(len(hs) / 2.0) AS BIGINT) + 1] AS DOUBLE) AS median_hz FROM b2""",
)
def agg35(spark, sf_dir):
    """Spectra (made of each fix's number) as band means, A-weighted band levels, what lasts over 20 samples, and the dominant frequency."""
    level = lambda i: -90 + ((F.col("seq") * (i + 3) * 7919) % 600) / 10.0
    samples = analog.fixes(spark, sf_dir).select(F.col("hex").alias("source"), F.col("t_ms").alias("t"), "seq", F.array(*(level(i) for i in range(_BINS))).alias("db"))
    rows = noise.spectral_levels(samples, _BINS, _HZ, _weights())
    return rows.select("seq", *(F.round(c, 6).alias(c) for c in _OUT35), "hz", "median_hz")


@query(
    "str08_rolling_low",
    f"{FX}, wn AS (SELECT hex AS source, unnest(range(t_ms - 4, t_ms + 1)) AS start_s, alt / 100 AS db FROM fixes) SELECT source, start_s, count(*) AS n, min(db) AS sustained, list_sort(list(db))[CAST(floor(count(*) / 2.0) AS BIGINT) + 1] AS median FROM wn GROUP BY 1, 2",
)
def str08(spark, sf_dir):
    """Least and (upper) median level of every five seconds, each second."""
    levels = timed(spark, sf_dir).select("ts", F.col("hex").alias("source"), (F.col("alt") / 100).alias("db"))
    return ingest.rolling_low(levels).select("source", F.unix_timestamp("window.start").alias("start_s"), "n", "sustained", "median")
