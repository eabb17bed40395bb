"""Joins of moving objects: nearest site, spatial neighbours, interval overlap, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

#: rows that a dimension may have to be sent to all tasks
SMALL = 100_000


def small(dim: DataFrame, limit: int = SMALL) -> DataFrame:
    """dim, marked for broadcast if it has at most ``limit`` rows; otherwise as it is, for Spark to shuffle."""
    return F.broadcast(dim) if dim.limit(limit + 1).count() <= limit else dim


def nearest_site(fixes: DataFrame, sites: DataFrame, max_nm: float, cell_deg: float | None = None) -> DataFrame:
    """fixes with the code and distance of the nearest site within ``max_nm`` (null if none).

    Sites are spread over the grid cells that their radius reaches and each cell holds a list of its own, so a fix
    meets one row, whatever the number of sites, and takes the nearest of that list; no pairs are formed or dealt.
    """
    cell = cell_deg or max_nm / geo.NM_PER_DEG * 1.5
    reach_lat, reach_lon = max_nm / geo.NM_PER_DEG, max_nm / (geo.NM_PER_DEG * 0.5)
    span = lambda c, reach: F.sequence(F.floor((F.col(c) - reach) / cell), F.floor((F.col(c) + reach) / cell))
    spread = sites.select("code", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.explode(span("lat", reach_lat)).alias("_cy"), span("lon", reach_lon).alias("xs"))
    spread = spread.withColumn("_cx", F.explode("xs")).groupBy("_cy", "_cx").agg(F.collect_list(F.struct("code", "s_lat", "s_lon")).alias("_sites"))
    placed = fixes.withColumns({"_cy": F.floor(F.col("lat") / cell), "_cx": F.floor(F.col("lon") / cell)})
    far = lambda s: F.struct(geo.planar_nm(F.col("lat"), F.col("lon"), s["s_lat"], s["s_lon"]).alias("nm"), s["code"].alias("code"))
    best = placed.join(small(spread), ["_cy", "_cx"], "left").withColumn("_best", F.array_min(F.transform("_sites", far)))
    own = lambda c: F.when(F.col("_best.nm") <= max_nm, F.col(f"_best.{c}"))
    return best.select(*fixes.columns, own("code").alias("site"), own("nm").alias("site_nm"))


def overlapping(events: DataFrame, flights: DataFrame, key: str, pad: float) -> DataFrame:
    """Pairs of equal ``key`` where an event (started, ended or null) overlaps a flight padded on both sides."""
    end = F.coalesce("ended", "started")
    hit = (end >= F.col("takeoff_ts") - pad) & (F.col("started") <= F.coalesce("landing_ts", "takeoff_ts") + pad)
    return events.join(flights, key).filter(hit)


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with right's ``values`` at its latest time not after left's: one shuffle, no pairs.

    Both sides are stacked and each left row takes the last right row before it in time; right rows of one
    time are ordered by their values, and come before left rows of that time.
    """
    l_rows = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))
    r_rows = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l_rows.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = l_rows.unionByName(r_rows).withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select("_left.*", *(F.col(f"_hit.{v}").alias(f"r_{v}") for v in values))


def neighbours(left: DataFrame, right: DataFrame, max_nm: float, max_ft: float, max_age: float) -> DataFrame:
    """The nearest right row of each left row within lateral, vertical and time limits, by cells of space and time; of
    distances that are equal but for rounding, the one of the lesser seq.

    Cells are two and a half times as long as the limits, and a left row is dealt to those only that its limits reach, some six
    of them, with no more than the test needs. The best is kept while pairs are formed, so that pairs are never written or sorted.
    """
    size, t_size, reach = max_nm / geo.NM_PER_DEG * 2.5, max(max_age, 1.0) * 2.5, max_nm / geo.NM_PER_DEG
    at = lambda c, d, n: F.floor((F.col(c) + d) / n)
    around = lambda c, d, n: F.explode(F.sequence(at(c, -d, n), at(c, d, n)))
    # where a degree of longitude is shortest within reach
    lon_reach = F.lit(reach) / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(90.0)))), F.lit(reach / 360))
    spread = left.select("seq", "hex", "lat", "lon", "alt", "t_ms", around("lat", reach * (1 + 1e-9), size).alias("cy"))
    spread = spread.withColumn("cx", around("lon", lon_reach * (1 + 1e-9), size)).withColumn("ct", around("t_ms", max_age, t_size))
    cell = F.xxhash64("cy", "cx", "ct").alias("cell")  # cells that share one only form pairs that fail the test
    spread = spread.select("seq", "hex", "lat", "lon", "alt", "t_ms", cell)
    other = right.withColumns({"cy": at("lat", 0, size), "cx": at("lon", 0, size), "ct": at("t_ms", 0, t_size)})
    other = other.select(cell, *(F.col(c).alias(f"o_{c}") for c in ("hex", "seq", "lat", "lon", "alt", "t_ms")))
    pairs = spread.join(other, "cell").filter((F.col("hex") != F.col("o_hex")) & (F.abs(F.col("alt") - F.col("o_alt")) <= max_ft) & (F.abs(F.col("t_ms") - F.col("o_t_ms")) <= max_age))
    nm = geo.planar_nm(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    pairs = pairs.withColumn("nm", nm).filter(F.col("nm") <= max_nm)
    return pairs.groupBy("seq").agg(F.min_by("o_seq", F.col("nm") + F.col("o_seq") * 1e-13).alias("other"), F.min("nm").alias("nm"))


def latest_non_null(rows: DataFrame, key: str, columns: list[str], order: list[str | Column]) -> DataFrame:
    """Per key, each column's last value that is not null, independently; ``order`` must be total."""
    place = F.struct(*order)
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns))
