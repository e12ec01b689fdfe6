"""Heatmaps ``(heatmap_id, y, x, probs, ...)``: to detections, from detections, and combined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import box as B
from ..functions import matrix as M
from . import raster


def detect(pixels: DataFrame, by: Sequence[str], prob: str = "v", min_score: float = 0.01, num_min: int = 10, diameter: tuple | None = None,
           offset: tuple | None = None, max_dims: tuple | None = None, min_dims: tuple | None = None) -> DataFrame:
    """Boxes around pixels above ``min_score``, or around the ``num_min`` best where fewer are.

    ``diameter`` and ``offset`` name the (height, width) and (dy, dx) columns; by default
    boxes have sides 1 and lie on their pixels.  Sizes outside the given (height, width)
    bounds are dropped.  Ties are broken by position.
    """
    whole = W.partitionBy(*by)
    enough = F.count_if(F.col(prob) > min_score).over(whole)
    rank = F.row_number().over(whole.orderBy(F.desc(prob), "y", "x"))
    picked = pixels.withColumns({"_n": enough, "_r": rank}).where((F.col(prob) > min_score) | ((F.col("_n") < num_min) & (F.col("_r") <= num_min)))
    h, w = (F.col(c) for c in diameter) if diameter else (F.lit(1.0), F.lit(1.0))
    dy, dx = (F.col(c) for c in offset) if offset else (F.lit(0.0), F.lit(0.0))
    if max_dims:
        picked = picked.where((h <= max_dims[0]) & (w <= max_dims[1]))
    if min_dims:
        picked = picked.where((h >= min_dims[0]) & (w >= min_dims[1]))
    return picked.select(*by, "y", "x", B.from_format("cxywh", F.col("x") + dx, F.col("y") + dy, w, h).alias("box"), F.col(prob).alias("score"))


def combine(maps: DataFrame, by: Sequence[str], prob: str = "v", means: Sequence[str] = ()) -> DataFrame:
    """Several aligned heatmaps as one: geometric mean of probabilities, arithmetic mean of ``means``."""
    gmean = F.when(F.min(prob) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(prob))))
    return maps.groupBy(*by, "y", "x").agg(gmean.alias(prob), *[F.avg(c).alias(c) for c in means])


def rasterize(dets: DataFrame, by: Sequence[str], height: int, width: int, background: int, shape: str = "ellipse") -> DataFrame:
    """``by, y, x, class_idx, score, dy, dx, h, w``: each pixel shows the smallest detection over it.

    Footprints are boxes or the ellipses inside them; pixels are whole coordinates.  Cells
    without a detection hold ``background``.
    """
    b = F.col("box")
    lo = lambda v, n: F.greatest(F.ceil(v), F.lit(0)).cast("int")
    hi = lambda v, n: F.least(F.floor(v), F.lit(n - 1)).cast("int")
    span = lambda a, z, n: F.when(lo(a, n) <= hi(z, n), F.sequence(lo(a, n), hi(z, n))).otherwise(F.array().cast("array<int>"))
    rows = dets.select("*", F.explode(span(b["y1"], b["y2"], height)).alias("y"))
    cells = rows.select("*", F.explode(span(b["x1"], b["x2"], width)).alias("x"))
    rx, ry = B.width(b) / 2, B.height(b) / 2
    ux, uy = F.try_divide(F.col("x") - B.center_x(b), rx), F.try_divide(F.col("y") - B.center_y(b), ry)
    if shape == "ellipse":
        cells = cells.where(F.coalesce(ux * ux, F.lit(0.0)) + F.coalesce(uy * uy, F.lit(0.0)) <= 1)
    entry = F.struct("class_idx", "score", (B.center_y(b) - F.col("y")).alias("dy"), (B.center_x(b) - F.col("x")).alias("dx"), B.height(b).alias("h"), B.width(b).alias("w"))
    top = cells.groupBy(*by, "y", "x").agg(F.min_by(entry, F.struct(B.area(b), -F.col("score"), "det_id")).alias("e"))
    grid = dets.select(*by).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(height * width - 1)))).select(
        *by, F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).cast("int").alias("x"))
    return grid.join(top, [*by, "y", "x"], "left").select(*by, "y", "x", F.coalesce("e.class_idx", F.lit(background)).alias("class_idx"), *[F.col(f"e.{c}").alias(c) for c in ("score", "dy", "dx", "h", "w")])


def smooth_probs(pixels: DataFrame, by: Sequence[str], kernel: int = 3) -> DataFrame:
    """Blur, then stretch back to the least and greatest value before."""
    before = pixels.groupBy(*by).agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    blurred = raster.gaussian_blur(pixels, by, kernel)
    after = raster.normalize(blurred, by).select(*by, "y", "x", F.col("norm").alias("_u"))
    return after.join(before, [*by]).select(*by, "y", "x", (F.col("_a") + F.col("_u") * (F.col("_b") - F.col("_a"))).alias("v"))


def warp(pixels: DataFrame, by: Sequence[str], matrix, height: int, width: int) -> DataFrame:
    return raster.warp_nearest(pixels, by, matrix, height, width)


def align(maps: DataFrame, frames: DataFrame, by: Sequence[str], prob: str = "v") -> DataFrame:
    """``by, y, x, prob`` of heatmaps on grids of their own choice, linear between their pixels and 0 beyond them.

    ``frames`` holds a row a heatmap: ``to_img``, the matrix from its pixels to the image,
    ``target``, the one from the new grid's pixels to the image (null, for
    both: the image's own pixels), ``height`` and ``width`` of the new grid.  Heatmaps brought to one grid can be
    combined.  Those without a frame have no row; missing pixels count as 0; a matrix without
    an inverse, a null size, or a grid pixel on the horizon gives 0 throughout or there.

    Each new pixel asks for the four around its place, so work follows the new grids and
    no heatmap is held whole.
    """
    back = M.matmul(M.inv(F.col("to_img")), F.col("target"))
    sized = frames.select(*by, "height", "width", back.alias("_m"))
    cells = sized.where("height > 0 and width > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height").cast("bigint") * F.col("width") - 1)))
    grid = cells.select(*by, F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"), (F.col("_i") % F.col("width")).cast("int").alias("x"), "_m")
    u, v, w = (F.col(f"_m.a{i}1") * F.col("x") + F.col(f"_m.a{i}2") * F.col("y") + F.col(f"_m.a{i}3") for i in (1, 2, 3))
    placed = grid.select(*by, "y", "x", F.try_divide(u, w).alias("_sx"), F.try_divide(v, w).alias("_sy"))
    taps = F.array(*[F.struct(
        (F.floor("_sy") + dy).alias("sy"), (F.floor("_sx") + dx).alias("sx"), ((1 - F.abs(F.col("_sy") - F.floor("_sy") - dy)) * (1 - F.abs(F.col("_sx") - F.floor("_sx") - dx))).alias("w"))
        for dy in (0, 1) for dx in (0, 1)])
    asked = placed.select(*by, "y", "x", F.inline(taps))
    held = maps.select(*by, F.col("y").cast("bigint").alias("sy"), F.col("x").cast("bigint").alias("sx"), F.col(prob).cast("double").alias("_p"))
    summed = F.coalesce(F.sum(F.col("w") * F.col("_p")), F.lit(0.0))
    return asked.join(held, [*by, "sy", "sx"], "left").groupBy(*by, "y", "x").agg(summed.alias(prob))


def upscale(maps: DataFrame, frames: DataFrame, by: Sequence[str], prob: str = "v") -> DataFrame:
    """Heatmaps on the pixels of their images; ``frames`` as for :func:`align`, without ``target``."""
    return align(maps, frames.withColumn("target", M.eye()), by, prob)


def colorize(pixels: DataFrame, palette: DataFrame, class_col: str = "class_idx") -> DataFrame:
    """Adds ``r, g, b`` by class; classes without a colour, and negative ones, are gray.  ``palette`` has a row per class and is broadcast only if small by Spark's own threshold."""
    joined = pixels.join(palette, class_col, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.5)) for c in ("r", "g", "b")})
