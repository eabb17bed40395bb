"""Sound on the ground: what a flight exposes people to, and spectra summed by bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the emission and propagation model: source level in dB at 100 hp and 100 knots, spreading, ground and air.
SOURCE_DB, SPREAD, GROUND, AIR = 95.0, 25.0, 0.65, 0.0016
FT_PER_M, M_PER_DEG, LEAST_SLANT_FT, FLOOR_DB = 3.28084, 111320.0, 50.0, -100.0
#: bands of a meter, in hertz
BANDS = [(50, 200), (200, 500), (500, 1500), (1500, 4000), (4000, 8000)]


def flight_cells(points: DataFrame, horsepower: Column, half_km: float = 10.0, cell_m: float = 250.0, reach_km: float = 4.0, field_ft: float = 5288.0, most: int = 400) -> DataFrame:
    """(flight_id, c_lat, c_lon, energy): the loudest energy that each flight brings to each cell of a grid about its own middle.

    points has flight_id, i (its order), lat, lon and alt. Long flights are read at ``most`` points or so. A cell is made only where a
    segment's reach covers it, and only the loudest of a flight and cell passes the shuffle.
    """
    flight = Window.partitionBy("flight_id")
    order = flight.orderBy("i")
    p = points.withColumns({"_hp": horsepower, "_k": F.row_number().over(order) - 1, "_n": F.count("*").over(flight)}).filter(F.col("_hp") > 0)
    step = F.when(F.col("_n") > most, F.ceil(F.col("_n") / most)).otherwise(F.lit(1).cast("long"))
    p = p.filter((F.col("_k") % step == 0) | (F.col("_k") == F.col("_n") - 1))
    p = p.withColumns({"lat0": F.avg("lat").over(flight), "lon0": F.avg("lon").over(flight)})
    m_lon = M_PER_DEG * F.cos(F.radians("lat0"))
    p = p.withColumns({"x": (F.col("lon") - F.col("lon0")) * m_lon, "y": (F.col("lat") - F.col("lat0")) * M_PER_DEG})
    s = p.withColumns({f"{c}a": F.lag(c).over(order) for c in ("x", "y", "alt")}).filter("xa is not null")
    n = max(16, int(2 * half_km * 1000 / cell_m + 0.5))
    half, reach = (n - 1) / 2, reach_km * 1000
    s = s.withColumns({"dx": F.col("x") - F.col("xa"), "dy": F.col("y") - F.col("ya"), "dz": F.col("alt") - F.col("alta")})
    s = s.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).withColumn("d", F.sqrt("d2"))
    state = F.when(F.col("dz") > 50, 0.0).when(F.col("dz") < -50, -6.0).otherwise(-3.0)
    knots = F.greatest(F.lit(30.0), F.col("d") * 1.94384)
    s = s.withColumn("src", SOURCE_DB + 10 * F.log10(F.col("_hp") / 100) + state + 10 * F.log10(100 / knots))
    low = lambda a, b: F.greatest(F.lit(0).cast("long"), F.floor((F.least(a, b) - reach) / cell_m + half))
    high = lambda a, b: F.least(F.lit(n).cast("long"), F.ceil((F.greatest(a, b) + reach) / cell_m + half) + 1) - 1
    s = s.withColumns({"c0": low("xa", "x"), "c1": high("xa", "x"), "r0": low("ya", "y"), "r1": high("ya", "y")}).filter("c0 <= c1 and r0 <= r1")
    s = s.select("flight_id", "lat0", "lon0", "xa", "ya", "alta", "dx", "dy", "dz", "d2", "d", "src", "r0", "r1", F.explode(F.sequence("c0", "c1")).alias("col")).withColumn("row", F.explode(F.sequence("r0", "r1")))
    s = s.withColumns({"cx": (F.col("col") - half) * cell_m, "cy": (F.col("row") - half) * cell_m})
    along = ((F.col("cx") - F.col("xa")) * F.col("dx") + (F.col("cy") - F.col("ya")) * F.col("dy")) / F.col("d2")
    s = s.withColumn("t", F.when(F.col("d2") > 1e-6, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))).otherwise(0.0))
    s = s.withColumns({"sx": F.col("cx") - (F.col("xa") + F.col("dx") * F.col("t")), "sy": F.col("cy") - (F.col("ya") + F.col("dy") * F.col("t")), "agl": F.greatest(F.col("alta") + F.col("dz") * F.col("t") - field_ft, F.lit(0.0))})
    s = s.withColumn("h2", F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")).filter(F.col("h2") <= reach * reach)
    s = s.withColumn("hft", F.sqrt("h2") * FT_PER_M)
    s = s.withColumns({"slant": F.greatest(F.hypot("agl", "hft"), F.lit(LEAST_SLANT_FT)), "theta": F.atan2(F.col("agl"), F.greatest(F.col("hft"), F.lit(1e-6))), "aglm": F.col("agl") / FT_PER_M})
    vx, vy = F.when(F.col("d") < 1e-3, 1.0).otherwise(F.col("dx") / F.col("d")), F.when(F.col("d") < 1e-3, 0.0).otherwise(F.col("dy") / F.col("d"))
    cos = (F.col("sx") * vx + F.col("sy") * vy) / (F.sqrt(F.col("h2") + F.col("aglm") * F.col("aglm")) + 1e-6)
    sideways = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cos * cos))
    db = F.col("src") - SPREAD * F.log10(F.col("slant") / 100) - GROUND * (10 - 8 * F.sin("theta")) - GROUND * 9.5 * F.pow(F.cos("theta"), F.lit(2.5)) - AIR * F.col("slant") + 10 * F.log10(sideways + 0.05)
    cells = s.withColumn("energy", F.pow(F.lit(10.0), db / 10)).groupBy("flight_id", "row", "col").agg(F.max("energy").alias("energy"), F.first("lat0").alias("lat0"), F.first("lon0").alias("lon0"))
    lat = F.col("lat0") + (F.col("row") - half) * cell_m / M_PER_DEG
    lon = F.col("lon0") + (F.col("col") - half) * cell_m / m_lon
    return cells.select("flight_id", lat.alias("lat"), lon.alias("lon"), "energy")


def flight_cells_sql(points: str, half_km: float = 10.0, cell_m: float = 250.0, reach_km: float = 4.0, field_ft: float = 5288.0, most: int = 400) -> str:
    """CTEs from ``points`` (flight_id, i, lat, lon, alt, hp) to fcell (flight_id, lat, lon, energy)."""
    n = max(16, int(2 * half_km * 1000 / cell_m + 0.5))
    half, reach = (n - 1) / 2, reach_km * 1000
    d = lambda x: f"{x}::DOUBLE"
    return f"""f0 AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY flight_id) AS n FROM {points} WHERE hp > 0),
f1 AS (SELECT *, avg(lat) OVER (PARTITION BY flight_id) AS lat0, avg(lon) OVER (PARTITION BY flight_id) AS lon0 FROM f0 WHERE k % CAST(CASE WHEN n > {most} THEN ceil(n / {d(most)}) ELSE 1 END AS BIGINT) = 0 OR k = n - 1),
f2 AS (SELECT *, (lon - lon0) * {d(M_PER_DEG)} * cos(radians(lat0)) AS x, (lat - lat0) * {d(M_PER_DEG)} AS y FROM f1),
f3 AS (SELECT * FROM (SELECT *, lag(x) OVER v AS xa, lag(y) OVER v AS ya, lag(alt) OVER v AS alta FROM f2 WINDOW v AS (PARTITION BY flight_id ORDER BY i)) WHERE xa IS NOT NULL),
f4 AS (SELECT *, x - xa AS dx, y - ya AS dy, alt - alta AS dz, pow(x - xa, 2) + pow(y - ya, 2) AS d2 FROM f3),
f5 AS (SELECT *, sqrt(d2) AS d, {d(SOURCE_DB)} + 10 * log10(hp / 100) + CASE WHEN dz > 50 THEN 0.0 WHEN dz < -50 THEN -6.0 ELSE -3.0 END::DOUBLE + 10 * log10(100.0::DOUBLE / greatest(30.0::DOUBLE, sqrt(d2) * {d(1.94384)})) AS src FROM f4),
f6 AS (SELECT f5.*, c, r, (c - {d(half)}) * {d(cell_m)} AS cx, (r - {d(half)}) * {d(cell_m)} AS cy FROM f5 JOIN range({n}) a(c) ON c >= floor((least(xa, x) - {reach}) / {cell_m} + {half}) AND c <= ceil((greatest(xa, x) + {reach}) / {cell_m} + {half})
  JOIN range({n}) b(r) ON r >= floor((least(ya, y) - {reach}) / {cell_m} + {half}) AND r <= ceil((greatest(ya, y) + {reach}) / {cell_m} + {half})),
f7 AS (SELECT *, CASE WHEN d2 > 1e-6 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((cx - xa) * dx + (cy - ya) * dy) / d2)) ELSE 0.0::DOUBLE END AS t FROM f6),
f8 AS (SELECT *, cx - (xa + dx * t) AS sx, cy - (ya + dy * t) AS sy, greatest(alta + dz * t - {field_ft}, 0.0::DOUBLE) AS agl FROM f7),
f9 AS (SELECT *, sx * sx + sy * sy AS h2, sqrt(sx * sx + sy * sy) * {d(FT_PER_M)} AS hft FROM f8 WHERE sx * sx + sy * sy <= {reach * reach}),
fa AS (SELECT *, greatest(sqrt(agl * agl + hft * hft), {LEAST_SLANT_FT}) AS slant, atan2(agl, greatest(hft, 1e-6)) AS theta, (sx * CASE WHEN d < 1e-3 THEN 1.0 ELSE dx / d END + sy * CASE WHEN d < 1e-3 THEN 0.0 ELSE dy / d END) / (sqrt(h2 + pow(agl / {d(FT_PER_M)}, 2)) + 1e-6) AS cosine FROM f9),
fcell AS (SELECT flight_id, any_value(lat0) + (r - {d(half)}) * {d(cell_m)} / {d(M_PER_DEG)} AS lat, any_value(lon0) + (c - {d(half)}) * {d(cell_m)} / ({d(M_PER_DEG)} * cos(radians(any_value(lat0)))) AS lon,
  max(pow(10.0::DOUBLE, (src - {d(SPREAD)} * log10(slant / 100) - {d(GROUND)} * (10 - 8 * sin(theta)) - {d(GROUND)} * 9.5::DOUBLE * pow(cos(theta), 2.5::DOUBLE) - {d(AIR)} * slant + 10 * log10(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - cosine * cosine)) + 0.05::DOUBLE)) / 10)) AS energy FROM fa GROUP BY flight_id, r, c)"""


def band_bins(bins: int, bin_hz: float) -> list[tuple[int, int]]:
    """First and last bin of each band; bin 0 is never one."""
    return [(max(1, int(lo // bin_hz)), min(bins - 1, -int(-hi // bin_hz))) for lo, hi in BANDS]


def spectral_levels(samples: DataFrame, bins: int, bin_hz: float, weights: list[float], keep: int = 20) -> DataFrame:
    """samples (source, t, seq, db: an array of ``bins`` levels) with, for each: mean level and A-weighted power level of each band, the
    weighted level and dominant frequency of all, and over the last ``keep`` samples of a source the least of each band's levels, the
    greatest of these, the least level of all, and the upper median of the dominant frequency.
    """
    weight = F.array(*(F.lit(float(w)) for w in weights))
    power = F.transform(F.col("db"), lambda x, i: F.pow(F.lit(10.0), (x + F.element_at(weight, i + 1)) / 10))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    level = lambda p: F.when(p > 1e-12, 10 * F.log10(p)).otherwise(FLOOR_DB)
    part = lambda c, lo, hi: F.slice(c, lo + 1, max(0, hi - lo + 1))
    rows = samples.withColumn("_p", power)
    spans = band_bins(bins, bin_hz)
    loudest = F.array_max(F.transform(part("_p", 1, bins - 1), lambda x, i: F.struct(x.alias("p"), (-(i + 1)).alias("bin"))))
    rows = rows.withColumns(
        {f"mean{b}": total(part("db", lo, hi)) / (hi - lo + 1) if hi >= lo else F.lit(FLOOR_DB) for b, (lo, hi) in enumerate(spans)}
        | {f"dba{b}": level(total(part("_p", lo, hi))) for b, (lo, hi) in enumerate(spans)}
        | {"dba": level(total(part("_p", 1, bins - 1))), "hz": -loudest["bin"] * bin_hz}
    )
    w = Window.partitionBy("source").orderBy("t", "seq").rowsBetween(-(keep - 1), 0)
    lows = {f"sustained{b}": F.min(f"mean{b}").over(w) for b in range(len(spans))} | {f"sustained_dba{b}": F.min(f"dba{b}").over(w) for b in range(len(spans))}
    recent = F.sort_array(F.collect_list("hz").over(w))
    rows = rows.withColumns(lows | {"sustained_dba": F.min("dba").over(w), "median_hz": F.element_at(recent, (F.floor(F.size(recent) / 2) + 1).cast("int"))})
    return rows.withColumn("sustained", F.greatest(*(F.col(f"sustained{b}") for b in range(len(spans))))).drop("_p")
