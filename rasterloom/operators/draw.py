"""Drawing as pixels: shapes become ``(by, y, x)`` rows that overlay a raster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import raster


def box_outline(boxes: DataFrame, by: Sequence[str], thickness: int = 1) -> DataFrame:
    """``by, y, x``: cells of rectangle borders at truncated coordinates."""
    b = F.col("box")
    x1, y1, x2, y2 = (b[c].cast("int") for c in ("x1", "y1", "x2", "y2"))
    rows = boxes.select(*by, "box", F.explode(F.sequence(y1, F.greatest(y1, y2))).alias("y"))
    inner = (F.col("y") >= y1 + thickness) & (F.col("y") <= y2 - thickness)
    sides = F.concat(F.sequence(x1, F.least(x1 + thickness - 1, x2)), F.sequence(F.greatest(x2 - thickness + 1, x1), x2))
    xs = F.when(inner, F.array_distinct(sides)).otherwise(F.sequence(x1, F.greatest(x1, x2)))
    return rows.select(*by, "y", F.explode(xs).alias("x")).distinct()


def line_cells(lines: DataFrame, by: Sequence[str], x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> DataFrame:
    """``by, y, x`` of segments: one cell per step along the longer axis, rounded half even."""
    ax, ay, bx, by_ = (F.rint(F.col(c)) for c in (x1, y1, x2, y2))
    n = F.greatest(F.abs(bx - ax), F.abs(by_ - ay)).cast("int")
    steps = lines.select(*by, ax.alias("_ax"), ay.alias("_ay"), bx.alias("_bx"), by_.alias("_by"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n)).alias("_t"))
    at = lambda a, b: F.rint(F.col(a) + F.coalesce(F.try_divide((F.col(b) - F.col(a)) * F.col("_t"), F.col("_n")), F.lit(0.0))).cast("int")
    return steps.select(*by, at("_ay", "_by").alias("y"), at("_ax", "_bx").alias("x")).distinct()


def polyline(rings: DataFrame, by: Sequence[str], ring: str = "ring", close: bool = True) -> DataFrame:
    from ..functions.polygon import edges

    e = rings.select(*by, F.posexplode(edges(F.col(ring))).alias("_k", "e"), F.size(ring).alias("_m"))
    if not close:
        e = e.where(F.col("_k") < F.col("_m") - 1)
    return line_cells(e.select(*by, F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2")), by)


def disks(points: DataFrame, by: Sequence[str], radius: int, x: str = "x", y: str = "y") -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius])
    spread = points.select(*by, F.rint(x).cast("int").alias("_x"), F.rint(y).cast("int").alias("_y"), F.explode(cells).alias("o"))
    return spread.select(*by, (F.col("_y") + F.col("o.dy")).alias("y"), (F.col("_x") + F.col("o.dx")).alias("x")).distinct()


def soft_points(points: DataFrame, by: Sequence[str], radius: float = 5.0, x: str = "x", y: str = "y") -> DataFrame:
    """``by, y, x, v``: the greatest of Gaussian blobs with covariance ``radius`` around points, within three deviations."""
    reach = int(3 * radius ** 0.5) + 1
    near = F.sequence(F.lit(-reach), F.lit(reach))
    spread = points.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(near).alias("_i")).select("*", F.explode(near).alias("_j"))
    cell = spread.select(*by, (F.rint("_y") + F.col("_i")).cast("int").alias("y"), (F.rint("_x") + F.col("_j")).cast("int").alias("x"), "_x", "_y")
    d = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))
    return cell.groupBy(*by, "y", "x").agg(F.max(F.exp(-d / (2 * radius))).alias("v"))


def fill_polygons(polys: DataFrame, by: Sequence[str], height: int, width: int, poly: str = "poly") -> DataFrame:
    """``by, y, start, stop``: runs of cells whose centre lines lie inside, even-odd over all rings.

    Every edge meets the scan lines between its ends (the lower one included, the upper not);
    crossings of a line are sorted and paired.  Work is one row per edge and line, and the
    pairing window spans one line of one polygon.
    """
    from ..functions.polygon import edges

    e = polys.select(*by, F.explode(F.flatten(F.transform(poly, edges))).alias("e"))
    e = e.select(*by, F.col("e.p.x").alias("ax"), F.col("e.p.y").alias("ay"), F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by_")).where("ay <> by_")
    lo, hi = F.greatest(F.ceil(F.least("ay", "by_")), F.lit(0)).cast("int"), F.least(F.ceil(F.greatest("ay", "by_")) - 1, F.lit(height - 1)).cast("int")
    lines = e.withColumn("y", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    cross = lines.select(*by, "y", (F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by_") - F.col("ay"))).alias("cx"))
    at = W.partitionBy(*by, "y").orderBy("cx")
    paired = cross.withColumns({"_k": F.row_number().over(at), "ex": F.lead("cx").over(at)}).where("_k % 2 = 1 and ex is not null")
    runs = paired.select(*by, "y", F.greatest(F.ceil("cx"), F.lit(0)).cast("int").alias("start"), (F.least(F.floor("ex"), F.lit(width - 1)) + 1).cast("int").alias("stop"))
    return runs.where("start < stop")


def run_cells(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    return runs.select(*by, "y", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("x")).distinct()


def to_masks(polys: DataFrame, by: Sequence[str], height: int, width: int, poly: str = "poly") -> DataFrame:
    """Row-major run-length masks of polygons."""
    from . import runlength

    runs = fill_polygons(polys, by, height, width, poly).select(*by, (F.col("y") * width + F.col("start")).cast("bigint").alias("start"), (F.col("y") * width + F.col("stop")).cast("bigint").alias("stop"))
    merged = runlength.merge_runs(runs, by).withColumns({"_h": F.lit(height), "_w": F.lit(width)})
    return runlength.runs_to_masks(merged, by, "_h", "_w", "C")


def draw_on(pixels: DataFrame, cells: DataFrame, by: Sequence[str], value: float, alpha: float = 1.0) -> DataFrame:
    """Blends ``value`` over the given cells; cells outside the raster are ignored."""
    marks = cells.select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(True).alias("_m")).distinct()
    own = pixels.withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")})
    v = F.when(F.col("_m"), F.col("v") * (1 - alpha) + value * alpha).otherwise(F.col("v"))
    return own.join(marks, [*by, "y", "x"], "left").withColumn("v", v).drop("_m")


def heatmask(pixels: DataFrame, low: tuple, high: tuple, with_alpha: float = 1.0) -> DataFrame:
    """Adds ``r, g, b, a``: a two-colour ramp over probabilities, alpha in proportion."""
    mix: dict[str, Column] = {c: F.lit(float(a)) * (1 - F.col("v")) + F.lit(float(b)) * F.col("v") for c, a, b in zip("rgb", low, high, strict=True)}
    return pixels.withColumns(mix | {"a": F.col("v") * with_alpha})


def vector_field(field: DataFrame, by: Sequence[str], stride: int, thresh: float = 0.0, scale: float = 1.0) -> DataFrame:
    """``by, x1, y1, x2, y2`` arrows of a field ``dx, dy`` sampled every ``stride`` cells where longer than ``thresh``."""
    kept = field.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0) & (F.hypot("dx", "dy") > thresh))
    return kept.select(*by, F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), (F.col("x") + F.col("dx") * scale).alias("x2"), (F.col("y") + F.col("dy") * scale).alias("y2"))


def checkered_nodata(pixels: DataFrame, square: int = 8, on: float = 1.0, off: float = 0.0) -> DataFrame:
    return pixels.withColumn("v", raster.fill_checkers(F.col("v"), F.col("y"), F.col("x"), square, on, off))
