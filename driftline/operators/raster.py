"""Raster kernels: segments, blobs and points spread over the cells they reach, and filters over sparse grids.

A raster is a sparse DataFrame of (row, col, value). Cells are made only within each item's influence
box, and summed with map-side partial aggregates; no grid is materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def box(items: DataFrame, row: Column, col: Column, reach: int, rows: int, cols: int) -> DataFrame:
    """items times the cells within ``reach`` of (row, col) and inside the grid."""
    span = lambda c, n: F.sequence(F.greatest(F.lit(0), c - reach), F.least(F.lit(n - 1), c + reach))
    inside = (row >= -reach) & (row < rows + reach) & (col >= -reach) & (col < cols + reach)
    return items.filter(inside).withColumn("row", F.explode(span(row, rows))).withColumn("col", F.explode(span(col, cols)))


def splat(items: DataFrame, row: Column, col: Column, weight: Column, sigma: float, rows: int, cols: int) -> DataFrame:
    """Weighted Gaussian splat within three sigmas (in cells); row and col of items are fractional."""
    reach = int(3 * sigma + 1)
    at = items.withColumns({"_y": row, "_x": col, "_w": weight})
    cells = box(at, F.floor("_y").cast("int"), F.floor("_x").cast("int"), reach, rows, cols)
    d2 = F.pow(F.col("row") - F.col("_y"), 2) + F.pow(F.col("col") - F.col("_x"), 2)
    near = cells.withColumn("_d2", d2).filter(F.col("_d2") <= (3 * sigma) ** 2)
    return near.groupBy("row", "col").agg(F.sum(F.col("_w") * F.exp(-F.col("_d2") / (2 * sigma * sigma))).alias("value"))


def blobs(items: DataFrame, row: Column, col: Column, power: Column, radius: Column, heading: Column, stretch: float, reach: int, rows: int, cols: int) -> DataFrame:
    """Oriented ellipses: power / (pi r^2) * (1 - d^2) inside, d being 1 on the ellipse's edge; sums per cell."""
    at = items.withColumns({"_y": row, "_x": col, "_p": power, "_r": radius, "_h": F.radians(heading)})
    cells = box(at, F.floor("_y").cast("int"), F.floor("_x").cast("int"), reach, rows, cols)
    dy, dx = F.col("row") - F.col("_y"), F.col("col") - F.col("_x")
    along = dx * F.sin("_h") - dy * F.cos("_h")
    across = dx * F.cos("_h") + dy * F.sin("_h")
    d2 = F.pow(along / (F.col("_r") * stretch), 2) + F.pow(across / F.col("_r"), 2)
    near = cells.withColumn("_d2", d2).filter("_d2 < 1")
    return near.groupBy("row", "col").agg(F.sum(F.col("_p") / (3.141592653589793 * F.col("_r") * F.col("_r")) * (1 - F.col("_d2"))).alias("value"))


def exposure(segments: DataFrame, source_db: Column, spread: float, lat: Column, lon: Column, ground_ft: float, how: str) -> DataFrame:
    """Sound level per cell from segments already spread over cells whose centres are (lat, lon).

    The level is taken where a segment is closest to the cell; ``how`` adds energies up ("sum") or keeps the
    loudest ("max"). Result: row, col, db.
    """
    lateral = geo.segment_ft(lat, lon, F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    height = F.greatest(F.lit(1.0), (F.col("alt") + F.col("p_alt")) / 2 - ground_ft)
    slant = F.greatest(F.lit(100.0), F.hypot(lateral, height))
    energy = F.pow(F.lit(10.0), (source_db - spread * F.log10(slant / 100)) / 10)
    total = (F.sum if how == "sum" else F.max)(energy)
    return segments.groupBy("row", "col").agg((10 * F.log10(total)).alias("db"))


def box_blur(grid: DataFrame, radius: int, rows: int, cols: int) -> DataFrame:
    """Mean over a window that shrinks at the grid's edges, by rows and then by columns; missing cells are 0."""
    out = grid
    for along, n in (("col", cols), ("row", rows)):
        spread = out.withColumn("_t", F.explode(F.sequence(F.greatest(F.lit(0), F.col(along) - radius), F.least(F.lit(n - 1), F.col(along) + radius))))
        size = F.least(F.lit(n - 1), F.col(along) + radius) - F.greatest(F.lit(0), F.col(along) - radius) + 1
        other = "row" if along == "col" else "col"
        out = spread.groupBy(F.col(other), F.col("_t").alias(along)).agg(F.sum("value").alias("value")).withColumn("value", F.col("value") / size)
    return out.select("row", "col", "value")


def mean_blur(grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """3 x 3 mean with zeros beyond the edge."""
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = grid.withColumn("_o", F.explode(near)).select((F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), "value")
    return spread.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).groupBy("row", "col").agg((F.sum("value") / 9).alias("value"))


def coarsen(grid: DataFrame, factor: int) -> DataFrame:
    """Block means, missing cells being 0."""
    return grid.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg((F.sum("value") / (factor * factor)).alias("value"))


def marching_squares(grid: DataFrame, level: float) -> DataFrame:
    """Contour segments of ``level``: one row per segment with the two cell sides it joins.

    Corners come from the next column and the next row by windows along the grid; a saddle is settled by
    the mean of its corners. Sides are n, e, s, w.
    """
    right = Window.partitionBy("row").orderBy("col")
    pairs = grid.withColumns({"tr": F.lead("value").over(right), "_c": F.lead("col").over(right)}).filter("_c = col + 1").withColumnRenamed("value", "tl")
    down = Window.partitionBy("col").orderBy("row")
    quads = pairs.withColumns({"bl": F.lead("tl").over(down), "br": F.lead("tr").over(down), "_r": F.lead("row").over(down)}).filter("_r = row + 1")
    bit = lambda c, b: F.when(F.col(c) >= level, b).otherwise(0)
    quads = quads.withColumn("case", bit("tl", 8) + bit("tr", 4) + bit("br", 2) + bit("bl", 1))
    high = (F.col("tl") + F.col("tr") + F.col("bl") + F.col("br")) / 4 >= level
    sides = {1: "ws", 2: "se", 3: "we", 4: "ne", 6: "ns", 7: "nw", 8: "nw", 9: "ns", 11: "ne", 12: "we", 13: "se", 14: "ws"}
    parts = F.array()
    for case, pair in sides.items():
        parts = F.when(F.col("case") == case, F.array(F.lit(pair))).otherwise(parts)
    parts = F.when(F.col("case") == 5, F.when(high, F.array(F.lit("nw"), F.lit("se"))).otherwise(F.array(F.lit("ne"), F.lit("ws")))).when(F.col("case") == 10, F.when(high, F.array(F.lit("ne"), F.lit("ws"))).otherwise(F.array(F.lit("nw"), F.lit("se")))).otherwise(parts)
    return quads.withColumn("sides", F.explode(parts)).select("row", "col", "sides")
