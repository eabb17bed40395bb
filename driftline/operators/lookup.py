"""Look-ups along ordered values: positions at given distances, and exact ranks by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import sequences as seqs


def positions_at(fixes: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (hex, ft) with the position at ``ft`` along the aircraft's path: lat, lon and alt, interpolated, and the heading.

    Before the path's start and behind its end its ends hold, with heading 0 and that of the last step. Fixes and marks are stacked in order of their distance, so all marks
    of all paths are found in one pass; nothing is paired. Where fixes share a distance, the first one's place is taken.
    """
    step = F.coalesce(geo.planar_ft(F.lag("lat").over(seqs.by()), F.lag("lon").over(seqs.by()), F.col("lat"), F.col("lon")), F.lit(0.0))
    path = fixes.withColumn("_step", step).withColumn("_ft", F.sum("_step").over(seqs.by()))
    path = path.withColumn("_bearing", geo.planar_bearing(F.lag("lat").over(seqs.by()), F.lag("lon").over(seqs.by()), F.col("lat"), F.col("lon")))
    at = F.struct(F.col("_ft").alias("ft"), "lat", "lon", "alt", F.col("_bearing").alias("bearing"))
    first = Window.partitionBy("hex", "_ft").orderBy("t_ms", "seq")
    rows = path.withColumn("_i", F.row_number().over(first)).filter("_i = 1").select("hex", F.col("_ft").alias("ft"), F.lit(0).alias("side"), at.alias("at"))
    asked = marks.select("hex", "ft", F.lit(1).alias("side"), F.lit(None).cast(rows.schema["at"].dataType).alias("at"))
    w = Window.partitionBy("hex").orderBy("ft", "side")
    before = F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("at", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = rows.unionByName(asked).withColumns({"a": before, "b": after}).filter("side = 1")
    found = found.withColumns({"a": F.coalesce("a", "b"), "b": F.coalesce("b", "a")}).filter("a is not null")
    share = F.when(F.col("b.ft") > F.col("a.ft"), (F.col("ft") - F.col("a.ft")) / (F.col("b.ft") - F.col("a.ft"))).otherwise(0.0)
    mixed = lambda c: (F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c)
    heading = F.when(F.col("ft") > 0, F.coalesce("b.bearing", F.lit(0.0))).otherwise(0.0)
    return found.select("hex", "ft", mixed("lat"), mixed("lon"), mixed("alt"), heading.alias("heading"))


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float = 1.0) -> DataFrame:
    """Per keys, the values at places min(floor(n p), n - 1) of the sorted values, exact, as columns named by ``shares``.

    Values are counted by ranges of ``width``; a place is looked up in the ranges' running counts, and then only among
    the distinct values of its range, so no key's values are sorted in one task.
    """
    rows = rows.filter(F.col(value).isNotNull()).withColumn("_range", F.floor(F.col(value) / width))
    w = Window.partitionBy(*keys).orderBy("_range")
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    counts = counts.withColumns({"_to": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("_n") * p), F.col("_n") - 1).alias("place")) for name, p in shares.items()))
    places = counts.withColumn("_w", F.explode(wanted)).filter((F.col("_w.place") >= F.col("_to") - F.col("_c")) & (F.col("_w.place") < F.col("_to")))
    places = places.select(*keys, "_range", F.col("_w.name").alias("_name"), (F.col("_w.place") - (F.col("_to") - F.col("_c"))).alias("_rest"))
    values = rows.groupBy(*keys, "_range", value).agg(F.count("*").alias("_c"))
    inner = Window.partitionBy(*keys, "_name").orderBy(value)
    hits = values.join(places, [*keys, "_range"]).withColumn("_to", F.sum("_c").over(inner))
    hits = hits.filter((F.col("_rest") >= F.col("_to") - F.col("_c")) & (F.col("_rest") < F.col("_to")))
    return hits.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in shares))
