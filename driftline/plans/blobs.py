"""Engine power and the rasters that it makes (WIN-27, WIN-29, RAS-05, RAS-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import power
from ..sources import analog
from ..sources.analog import with_sql
from .boards import _HP
from .registry import query
from .scalars import _FT
from .trajectories import W

#: seconds between samples that fit the analog tracks' steps of some thirty thousand feet
_PERIOD, _GROUND = 180.0, 5300.0
_SHORT, _LONG, _CLIMB = power.spans(_PERIOD)
_PER_NM, _MOST, _PX = 2.0, 4000, 64
_HOURS, _ZONE_S = (6, 22), -25_200
_TIMES, _GAP_FT = 4, 40_000.0


def _mean(a: int, b: int) -> str:
    side = lambda n: f"{-n} PRECEDING" if n < 0 else "CURRENT ROW"
    return f"coalesce(avg(CASE WHEN idx > 0 THEN knots END) OVER (PARTITION BY hex ORDER BY t_ms, seq ROWS BETWEEN {side(a)} AND {side(b)}), 0)"


_NI = lambda c, p: f"list_sort(list({c}) FILTER ({c} IS NOT NULL))[greatest(0, CAST(least(floor(count({c}) * {p}::DOUBLE), count({c}) - 1) AS BIGINT)) + 1]"
POWER = f"""{with_sql('fixes', 'aircraft')}, k0 AS (SELECT *, row_number() OVER {W} - 1 AS idx, count(*) OVER (PARTITION BY hex) AS size, coalesce({_FT('la', 'lo', 'lat', 'lon')} / {_PERIOD} / {power.FPS_PER_KT}::DOUBLE, 0) AS knots FROM (SELECT *, lag(lat) OVER {W} AS la, lag(lon) OVER {W} AS lo FROM fixes)),
k1 AS (SELECT *, {_mean(1 - _SHORT, 0)} - {_mean(1 - 2 * _SHORT, -_SHORT)} AS speed_delta, {_mean(1 - _LONG, 0)} AS mean_knots, CASE WHEN idx > 0 THEN (alt - coalesce(lag(alt, {_LONG}) OVER {W}, first_value(alt) OVER {W})) / (least(idx, {_LONG}) * {_PERIOD} / 60) ELSE 0 END AS mean_fpm FROM k0),
k2 AS (SELECT *, min(alt) OVER (PARTITION BY hex) AS low, knots - lag(knots) OVER {W} AS dv, alt - lag(alt, {_CLIMB}) OVER {W} AS gained, avg(knots) OVER (PARTITION BY hex ORDER BY t_ms, seq ROWS BETWEEN {_CLIMB - 1} PRECEDING AND CURRENT ROW) AS ck FROM k1 WHERE size >= 3),
k3 AS (SELECT *, CASE WHEN idx > 0 AND alt - low > 300 AND knots < 600 THEN knots END AS air, CASE WHEN idx > 0 AND alt - low < 50 AND dv > 0 THEN dv END AS faster, CASE WHEN idx > 0 AND alt - low < 50 AND dv < 0 THEN dv END AS slower, idx >= {_CLIMB} AND idx < size - 1 AND gained > 0 AS counts FROM k2),
li AS (SELECT hex, min(low) AS low, coalesce(max(gained) FILTER (counts), 0) AS fpm, coalesce(arg_max(ck, struct_pack(g := gained, i := -idx)) FILTER (counts), 70) AS kt, {_NI('air', 0.95)} AS top, {_NI('faster', 0.9)} AS accel, {_NI('slower', 0.1)} AS decel FROM k3 GROUP BY hex),
lm AS (SELECT hex, low, CASE WHEN fpm < 100 THEN 600 ELSE fpm END AS max_fpm, greatest(CASE WHEN kt < 30 THEN 70 ELSE kt END * 1.3::DOUBLE, coalesce(top, 0)) AS max_knots, coalesce(accel, 2) AS accel, coalesce(decel, -2) AS decel FROM li),
wk AS (SELECT k1.*, lm.low, accel, decel, greatest(greatest(0, mean_fpm / greatest(1, max_fpm)), pow(greatest(0, mean_knots) / greatest(1, max_knots), 2)) AS work, least(1, -mean_fpm / 600) AS idle FROM k1 JOIN lm USING (hex)),
pw AS (SELECT *, CASE WHEN alt - low < 50 THEN CASE WHEN accel > 0 AND speed_delta > 0.25 * accel THEN 0.5 + 0.5 * least(1, speed_delta / greatest(0.001, accel)) WHEN decel < 0 AND speed_delta < 0.25 * decel THEN 0.1 ELSE 0.15 + 0.1 * least(1, abs(speed_delta) / 2) END
  ELSE greatest(0.05, least(1, CASE WHEN mean_fpm < 0 THEN work * (1 - 0.7 * idle) + 0.1 * idle ELSE work END)) END::DOUBLE AS power FROM wk)"""
_BRG = lambda a, b, c, d: f"degrees(atan2(({d} - {b}) * cos(radians(({a} + {c}) / 2)), {c} - {a}))"
BLOBS = f"""{POWER}, b0 AS (SELECT pw.*, greatest(0.0::DOUBLE, alt - {_GROUND}) AS agl, {_HP} AS rated, coalesce(lag(lat) OVER {W}, lat) AS a1, coalesce(lag(lon) OVER {W}, lon) AS o1, coalesce(lead(lat) OVER {W}, lat) AS a2, coalesce(lead(lon) OVER {W}, lon) AS o2 FROM pw LEFT JOIN aircraft ON tail = hex),
bl AS (SELECT hex, t_ms, seq, lat, lon, greatest(1, greatest(50, agl) * 0.3048::DOUBLE * 3) AS radius_m, CASE WHEN agl < 50 THEN 0 ELSE power * rated END AS hp, {_BRG('a1', 'o1', 'a2', 'o2')} AS heading FROM b0)"""


def _raster_sql(source: str) -> str:
    d = lambda x: f"{x}::DOUBLE"
    pad = f"radius_m * {d(power.SIDE)} * 1.05::DOUBLE"
    return f"""bx AS (SELECT *, (lon_max - lon_min) * cos(radians((lat_min + lat_max) / 2)) / (lat_max - lat_min) AS aspect FROM (SELECT min(lat - {pad} / {power.M_PER_DEG}) AS lat_min, max(lat + {pad} / {power.M_PER_DEG}) AS lat_max, min(lon - {pad} / ({power.M_PER_DEG} * cos(radians(lat)))) AS lon_min, max(lon + {pad} / ({power.M_PER_DEG} * cos(radians(lat)))) AS lon_max FROM {source})),
bw AS (SELECT *, CASE WHEN aspect >= 1 THEN {_PX} ELSE greatest(16, floor({_PX} * aspect + 0.5)) END AS w, CASE WHEN aspect >= 1 THEN greatest(16, floor({_PX} / aspect + 0.5)) ELSE {_PX} END AS h FROM bx),
bp AS (SELECT *, (lat_max - lat_min) * {power.M_PER_DEG} / h AS my, (lon_max - lon_min) * {power.M_PER_DEG} * cos(radians((lat_min + lat_max) / 2)) / w AS mx, (lon - lon_min) / (lon_max - lon_min) * w AS x, (lat_max - lat) / (lat_max - lat_min) * h AS y FROM {source}, bw WHERE hp > 0),
br AS (SELECT *, greatest(radius_m * {d(power.SIDE)} / mx, radius_m * {d(power.SIDE)} / my) + 1 AS reach FROM bp),
bc AS (SELECT r, c, hp, radius_m, radians(heading) AS a, -(r + 0.5 - y) * my AS north, (c + 0.5 - x) * mx AS east FROM br JOIN range(64) rr(r) ON r < h AND r >= floor(y - reach) AND r <= ceil(y + reach) JOIN range(64) cc(c) ON c < w AND c >= floor(x - reach) AND c <= ceil(x + reach)),
bd AS (SELECT *, pow((north * cos(a) + east * sin(a)) / greatest(0.1, radius_m * {d(power.FORE_AFT)} * {d(power.SIDE)}), 2) + pow((-north * sin(a) + east * cos(a)) / greatest(0.1, radius_m * {d(power.SIDE)}), 2) AS d2 FROM bc),
ra AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, sum(hp / (pi() * radius_m * radius_m) * (1 - d2)) AS value FROM bd WHERE d2 < 1 GROUP BY 1, 2)"""


@query("win27_windowed_deltas", f"{POWER} SELECT seq, round(knots, 5) AS knots, round(speed_delta, 5) AS speed_delta, round(mean_knots, 5) AS mean_knots, round(mean_fpm, 5) AS mean_fpm FROM k1")
def win27(spark, sf_dir):
    s = power.speeds(analog.fixes(spark, sf_dir), _PERIOD)
    return s.select("seq", *(F.round(c, 5).alias(c) for c in ("knots", "speed_delta", "mean_knots", "mean_fpm")))


@query("win29_engine_power", f"{POWER} SELECT seq, round(power, 6) AS power FROM pw")
def win29(spark, sf_dir):
    return power.power(analog.fixes(spark, sf_dir), _PERIOD).select("seq", F.round("power", 6).alias("power"))


def track_blobs(spark, sf_dir):
    kinds = analog.aircraft(spark, sf_dir).select(F.col("tail").alias("hex"), "type")
    powered = power.power(analog.fixes(spark, sf_dir), _PERIOD).join(kinds, "hex", "left")
    return power.blobs(powered, scoring.horsepower(F.col("type")), _GROUND)


_LOCAL = f"floor((t_ms + 86400 + {_ZONE_S}) % 86400 / 3600.0)"
_STEP = 1 / _PER_NM


@query(
    "ras05_blob_pipeline",
    f"""{BLOBS}, hf AS (SELECT *, {_LOCAL} AS hour FROM bl), tf AS (SELECT *, lag(lat) OVER {W} AS pa, lag(lon) OVER {W} AS po FROM hf WHERE hour >= {_HOURS[0]} AND hour < {_HOURS[1]}),
kp AS (SELECT *, lag(lat) OVER {W} AS p_lat, lag(lon) OVER {W} AS p_lon, lag(radius_m) OVER {W} AS p_r, lag(hp) OVER {W} AS p_hp FROM tf WHERE pa IS NULL OR pa <> lat OR po <> lon),
sg AS (SELECT *, 2 * 3440.065::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(lat - p_lat) / 2), 2) + cos(radians(p_lat)) * cos(radians(lat)) * pow(sin(radians(lon - p_lon) / 2), 2)))) AS nm FROM kp WHERE p_lat IS NOT NULL),
cu AS (SELECT *, sum(nm) OVER {W} AS to_, sum(nm) OVER (PARTITION BY hex) AS total, row_number() OVER {W} = 1 AS first FROM sg), cf AS (SELECT *, to_ - nm AS from_ FROM cu),
mk AS (SELECT *, unnest(range(CASE WHEN first THEN 0 ELSE CAST(floor(from_ / {_STEP}) AS BIGINT) + 1 END, CAST(floor(to_ / {_STEP}) AS BIGINT) + 1)) AS mark FROM cf WHERE total >= {_STEP}),
ev AS (SELECT hex, mark, p_lat + s * (lat - p_lat) AS lat, p_lon + s * (lon - p_lon) AS lon, greatest({_STEP * 1852 * 0.6}::DOUBLE, p_r + s * (radius_m - p_r)) AS radius_m, p_hp + s * (hp - p_hp) AS hp, {_BRG('p_lat', 'p_lon', 'lat', 'lon')} AS heading FROM (SELECT *, (mark * {_STEP}::DOUBLE - from_) / nm AS s FROM mk)
  UNION ALL SELECT hex, row_number() OVER {W} - 1, lat, lon, radius_m, hp, heading FROM tf WHERE hex IN (SELECT hex FROM cf WHERE first AND total < {_STEP})),
nu AS (SELECT *, row_number() OVER (ORDER BY hex, mark) - 1 AS i, greatest(1, CAST(ceil(count(*) OVER () / {_MOST}.0) AS BIGINT)) AS k FROM ev),
dc AS (SELECT lat, lon, radius_m, hp * k AS hp, heading FROM nu WHERE i % k = 0), {_raster_sql('dc')}
SELECT row, col, round(value * 1e6, 4) AS value FROM ra""",
)
def ras05(spark, sf_dir):
    """Power to blobs, by hours, evenly spaced, within a budget that keeps the energy, on a grid about them."""
    b = track_blobs(spark, sf_dir)
    b = b.filter(scoring.in_hours(scoring.local_hour(F.col("t_ms"), _ZONE_S // 3600), *_HOURS))
    b = power.spaced_within(b, _PER_NM, _MOST)
    b = b.agg(F.collect_list(F.struct(*b.columns)).alias("b")).select(F.inline("b"))  # _MOST at most, made once for the box and the grid
    return power.rasterised(b, power.bounds(b, _PX)).select("row", "col", F.round(F.col("value") * 1e6, 4).alias("value"))


@query(
    "ras13_calibrated_raster",
    f"""{BLOBS}, ld AS (SELECT *, lead(lat) OVER {W} AS n_lat, lead(lon) OVER {W} AS n_lon, lead(radius_m) OVER {W} AS n_r, lead(hp) OVER {W} AS n_hp, lead(heading) OVER {W} AS n_h FROM bl),
gp AS (SELECT *, sqrt(pow((n_lat - lat) * {power.M_PER_DEG}, 2) + pow((n_lon - lon) * {power.M_PER_DEG} * cos(radians((lat + n_lat) / 2)), 2)) * 3.281::DOUBLE <= {_GAP_FT} AS near FROM ld),
ks AS (SELECT *, unnest(CASE WHEN coalesce(near, false) THEN range({_TIMES}) ELSE [0] END) AS k FROM gp),
rf AS (SELECT CASE WHEN k = 0 THEN lat ELSE lat + (n_lat - lat) * k / {_TIMES}::DOUBLE END AS lat, CASE WHEN k = 0 THEN lon ELSE lon + (n_lon - lon) * k / {_TIMES}::DOUBLE END AS lon, CASE WHEN k = 0 THEN radius_m ELSE radius_m + (n_r - radius_m) * k / {_TIMES}::DOUBLE END AS radius_m, CASE WHEN k = 0 THEN hp ELSE hp + (n_hp - hp) * k / {_TIMES}::DOUBLE END / {_TIMES} AS hp,
  CASE WHEN k = 0 THEN heading ELSE degrees(atan2(sin(radians(heading)) + (sin(radians(n_h)) - sin(radians(heading))) * k / {_TIMES}::DOUBLE, cos(radians(heading)) + (cos(radians(n_h)) - cos(radians(heading))) * k / {_TIMES}::DOUBLE)) END AS heading FROM ks), {_raster_sql('rf')},
qs AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM ra WHERE value > 0), lh AS (SELECT ln(greatest(1e-12, v[CAST(floor(n * 0.01::DOUBLE) AS BIGINT) + 1])) AS lo, ln(greatest(1e-12, v[CAST(floor(n * 0.99::DOUBLE) AS BIGINT) + 1])) AS hi FROM qs)
SELECT row, col, round(value * 1e6, 4) AS value, CAST(floor(greatest(0, least(1, (ln(value) - lo) / greatest(0.01, hi - lo))) * 255 + 1e-9) AS INT) AS shade FROM ra, lh WHERE value > 0""".replace(" + 1e-9", ""),
)
def ras13(spark, sf_dir):
    """Blobs refined between samples but not across gaps, on a grid about them, shaded between two places of its own values."""
    b = power.refined(track_blobs(spark, sf_dir), _TIMES, _GAP_FT)
    r = power.calibrated(power.rasterised(b, power.bounds(b, _PX)))
    return r.select("row", "col", F.round(F.col("value") * 1e6, 4).alias("value"), "shade")
