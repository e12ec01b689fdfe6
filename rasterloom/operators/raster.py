"""Raster operations on the pixel relation ``(image_id..., y, x[, c], v)``.

Null ``v`` is masked; NaN is a value.  ``by`` names the columns that identify an image
(and channel, where channels are treated apart).  Neighbourhoods scatter each pixel to the
cells it contributes to and aggregate there, so partial sums combine before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def checkerboard(spark, width: int, height: int, square: int, on: float = 1.0, off: float = 0.0) -> DataFrame:
    """``y, x, v`` of a checkerboard whose top left square is off."""
    n = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    odd = (F.floor(F.col("y") / square) + F.floor(F.col("x") / square)) % 2 == 1
    return n.withColumn("v", F.when(odd, F.lit(on)).otherwise(F.lit(off)))


def next_power_of_two(x: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(x))).cast("bigint")


def next_multiple_of(x: Column, m: int) -> Column:
    return F.ceil(x / m) * m


def sizes(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*by).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def ensure_float01(v: Column) -> Column:
    """Whole numbers in [0, 255] over 255; others raise."""
    return F.when((v >= 0) & (v <= 255), v / 255.0).when(v.isNull(), F.lit(None).cast("double")).otherwise(
        F.raise_error(F.lit("image values are not between 0 and 255")).cast("double"))


def ensure_uint255(v: Column) -> Column:
    """Numbers in [0, 1] (with a tolerance of 1e-3) times 255, truncated; others raise."""
    inside = (v >= -1e-3) & (v <= 1 + 1e-3)
    return F.when(inside, F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")).when(v.isNull(), F.lit(None).cast("int")).otherwise(
        F.raise_error(F.lit("image values are not between 0 and 1")).cast("int"))


def mask_nodata(v: Column, nodata: float, method: str = "ma") -> Column:
    """Nodata values become null (``ma``) or NaN (``nan``)."""
    return F.when(v == nodata, F.lit(None).cast("double") if method == "ma" else F.lit(float("nan"))).otherwise(v.cast("double"))


def fill_checkers(v: Column, y: Column, x: Column, square: int = 8, on: float = 1.0, off: float = 0.0) -> Column:
    """Checkers where the value is null or NaN."""
    odd = (F.floor(y / square) + F.floor(x / square)) % 2 == 1
    return F.when(v.isNull() | F.isnan(v), F.when(odd, F.lit(on)).otherwise(F.lit(off))).otherwise(v)


def atleast_3channels(pixels: DataFrame) -> DataFrame:
    """Gray pixels ``v`` tiled over channels 0 to 2."""
    return pixels.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))


def crop(pixels: DataFrame, by: Sequence[str], y0: int, x0: int, height: int, width: int, fill: float | None = 0.0) -> DataFrame:
    """Window of every image at (y0, x0); cells outside the image get ``fill``, or no row if that is None."""
    inside = pixels.where(F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1))
    moved = inside.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})
    if fill is None:
        return moved
    full = pixels.select(*by).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(height * width - 1)))).select(
        *by, F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).cast("int").alias("x"))
    had = moved.select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v", F.lit(True).alias("_had"))
    return full.join(had, [*by, "y", "x"], "left").select(*by, "y", "x", F.when(F.col("_had"), F.col("v")).otherwise(F.lit(fill)).alias("v"))


def crop_border(pixels: DataFrame, by: Sequence[str], fill: float = 255.0, thresh: float = 0.0) -> DataFrame:
    """Images without the rows and columns at their edges that differ from ``fill`` by at most ``thresh`` throughout."""
    odd = F.abs(F.col("v") - fill) > thresh
    box = pixels.where(odd).groupBy(*by).agg(*[f(c).alias(f"_{n}{c}") for c in ("y", "x") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    kept = pixels.join(box, [*by]).where(F.col("y").between(F.col("_loy"), F.col("_hiy")) & F.col("x").between(F.col("_lox"), F.col("_hix")))
    return kept.withColumns({"y": F.col("y") - F.col("_loy"), "x": F.col("x") - F.col("_lox")}).drop("_loy", "_hiy", "_lox", "_hix")


def normalize(pixels: DataFrame, by: Sequence[str], mode: str = "linear", alpha: float | None = None, beta: float | None = None) -> DataFrame:
    """Adds ``norm``: values stretched over [0, 1] by their least and greatest, linearly or by a sigmoid."""
    stats = pixels.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*by).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    joined = pixels.join(stats, [*by], "left")
    unit = F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    if mode == "sigmoid":
        b = F.lit(beta) if beta is not None else (F.col("_hi") - F.col("_lo")) / 2
        a = F.lit(alpha) if alpha is not None else F.lit(10.0)
        s = lambda t: 1 / (1 + F.exp(-F.try_divide(a * (t - b), F.col("_hi") - F.col("_lo"))))
        lo, hi = s(F.lit(0.0)), s(F.col("_hi") - F.col("_lo"))
        unit = F.try_divide(s(F.col("v") - F.col("_lo")) - lo, hi - lo)
    return joined.withColumn("norm", F.coalesce(unit, F.when(F.col("v").isNotNull(), F.lit(0.0)))).drop("_lo", "_hi")


def robust_normalizers(pixels: DataFrame, by: Sequence[str], low: float = 0.01, mid: float = 0.5, high: float = 0.9) -> DataFrame:
    """Exact quantiles ``lo, mid, hi`` of the unmasked values of every image."""
    q = F.percentile("v", F.array(F.lit(low), F.lit(mid), F.lit(high)))
    return pixels.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*by).agg(q.alias("_q")).select(
        *by, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("mid"), F.col("_q")[2].alias("hi"))


def normalize_intensity(pixels: DataFrame, by: Sequence[str], low: float = 0.01, mid: float = 0.5, high: float = 0.9) -> DataFrame:
    """Adds ``norm``: contrast stretch between robust quantiles, clamped to [0, 1]."""
    joined = pixels.join(robust_normalizers(pixels, by, low, mid, high), [*by], "left")
    unit = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))
    return joined.withColumn("norm", F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0))).drop("lo", "mid", "hi")


def alpha_over(c1: Column, a1: Column, c2: Column, a2: Column) -> tuple[Column, Column]:
    """Colour and alpha of layer 1 over layer 2; where nothing shows the colour is 0."""
    a3 = a1 + a2 * (1 - a1)
    return F.coalesce(F.try_divide(c1 * a1 + c2 * a2 * (1 - a1), a3), F.lit(0.0)), a3


def overlay_layers(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """One layer of many: rows ``by, layer, y, x, v, alpha``; the smallest layer lies on top."""
    grouped = pixels.groupBy(*by, "y", "x").agg(F.sort_array(F.collect_list(F.struct("layer", "v", "alpha"))).alias("_l"))

    def under(acc, e):
        c, a = alpha_over(acc["v"], acc["alpha"], e["v"].cast("double"), e["alpha"].cast("double"))
        return F.struct(c.alias("v"), a.alias("alpha"))

    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("alpha"))
    return grouped.withColumn("_o", F.aggregate("_l", start, under)).select(*by, "y", "x", F.col("_o.v").alias("v"), F.col("_o.alpha").alias("alpha"))


# neighbourhoods ----------------------------------------------------------------------


def gaussian_kernel(k: int, sigma: float | None = None) -> np.ndarray:
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8 if sigma is None or sigma <= 0 else sigma
    x = np.arange(k) - (k - 1) / 2
    g = np.exp(-(x * x) / (2 * sigma * sigma))
    return g / g.sum()


def gaussian_patch(height: int, width: int, sigma: float | tuple | None = None) -> np.ndarray:
    sy, sx = sigma if isinstance(sigma, tuple) else (sigma, sigma)
    return np.outer(gaussian_kernel(height, sy), gaussian_kernel(width, sx))


def structuring_element(k: int, element: str = "rect") -> np.ndarray:
    """``rect``, ``cross`` or ``ellipse`` of odd size."""
    y, x = np.mgrid[:k, :k] - (k - 1) // 2
    r = (k - 1) // 2
    if element == "cross":
        return (y == 0) | (x == 0)
    if element == "ellipse":
        return np.abs(x) <= np.rint(np.sqrt(np.maximum(0, r * r - y * y)))
    return np.ones((k, k), dtype=bool)


def _offsets(weights: np.ndarray) -> Column:
    h, w = weights.shape
    cy, cx = (h - 1) // 2, (w - 1) // 2
    return F.array(*[F.struct(F.lit(int(i - cy)).alias("dy"), F.lit(int(j - cx)).alias("dx"), F.lit(float(weights[i, j])).alias("w")) for i in range(h) for j in range(w) if weights[i, j]])


def _scatter(pixels: DataFrame, by: Sequence[str], weights: np.ndarray) -> DataFrame:
    """``by, y, x, v, w``: each pixel sent to every cell whose window holds it, cells inside the image only."""
    spread = pixels.select(*by, "y", "x", "v", F.explode(_offsets(weights)).alias("o"))
    return spread.select(*by, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "v", F.col("o.w").alias("w"))


def convolve(pixels: DataFrame, by: Sequence[str], weights: np.ndarray, border: str = "reflect101") -> DataFrame:
    """Correlation with ``weights``; beyond the border pixels reflect without repeating the edge, or count as 0 (``constant``)."""
    size = sizes(pixels, by)
    if border == "constant":
        out = _scatter(pixels, by, weights).groupBy(*by, "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        return out.join(size, [*by]).where("y >= 0 and x >= 0 and y < height and x < width").select(*by, "y", "x", "v")
    h, w = weights.shape
    cy, cx = (h - 1) // 2, (w - 1) // 2
    own = pixels.join(size, [*by])

    def mirrored(c: str, n: str, r: int) -> Column:
        """Positions, inside and out, that reflect onto this one within reach ``r``."""
        at, last = F.col(c).cast("bigint"), F.col(n).cast("bigint") - 1
        if r == 0:
            return F.array(at)
        once = F.array_compact(F.array(at, F.when((at > 0) & (at <= r), -at), F.when((at < last) & (last - at <= r), 2 * last - at)))
        # images no larger than the reach reflect more than once; their reach is at most three times the kernel's
        reach = F.sequence(F.lit(-r).cast("bigint"), last + r)
        fold = lambda i: F.when(last == 0, F.lit(0)).otherwise(last - F.abs(F.pmod(i, F.greatest(2 * last, F.lit(1))) - last))
        return F.when(last >= r, once).otherwise(F.filter(reach, lambda i: fold(i) == at))

    copies = own.select(*by, "height", "width", "v", F.explode(mirrored("y", "height", cy)).alias("y"), F.col("x").alias("_x0")).withColumnRenamed("_x0", "x")
    copies = copies.select(*by, "height", "width", "v", "y", F.explode(mirrored("x", "width", cx)).alias("x"))
    spread = copies.select(*by, "height", "width", "v", "y", "x", F.explode(_offsets(weights)).alias("o")).select(
        *by, "height", "width", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), (F.col("v") * F.col("o.w")).alias("t"))
    inside = spread.where("y >= 0 and x >= 0 and y < height and x < width")
    return inside.groupBy(*by, "y", "x").agg(F.sum("t").alias("v"))


def gaussian_blur(pixels: DataFrame, by: Sequence[str], kernel: int = 3, sigma: float | None = None) -> DataFrame:
    """Separable blur: rows, then columns."""
    k = gaussian_kernel(kernel, sigma)
    return convolve(convolve(pixels, by, k[None, :]), by, k[:, None])


def pyr_down(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blur by 1 4 6 4 1 along both axes, then every second pixel."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    out = convolve(convolve(pixels, by, k[None, :]), by, k[:, None])
    return out.where("y % 2 = 0 and x % 2 = 0").withColumns({"y": (F.col("y") / 2).cast("int"), "x": (F.col("x") / 2).cast("int")})


def morphology(pixels: DataFrame, by: Sequence[str], mode: str, kernel: int = 3, element: str = "rect") -> DataFrame:
    """``dilate erode open close gradient tophat blackhat``; outside the image counts as 0."""
    m = structuring_element(kernel, element)
    if mode in ("dilate", "erode"):
        size = sizes(pixels, by)
        moved = _scatter(pixels, by, m.astype(float))
        g = moved.groupBy(*by, "y", "x").agg((F.max if mode == "dilate" else F.min)("v").alias("v"), F.count(F.lit(1)).alias("_n"))
        g = g.join(size, [*by]).where("y >= 0 and x >= 0 and y < height and x < width")
        zero = F.lit(0).cast(dict(pixels.dtypes)["v"])
        bound = F.greatest("v", zero) if mode == "dilate" else F.least("v", zero)
        return g.select(*by, "y", "x", F.when(F.col("_n") < int(m.sum()), bound).otherwise(F.col("v")).alias("v"))
    run = lambda p, s: morphology(p, by, s, kernel, element)
    if mode == "open":
        return run(run(pixels, "erode"), "dilate")
    if mode == "close":
        return run(run(pixels, "dilate"), "erode")
    pair = {"gradient": (run(pixels, "dilate"), run(pixels, "erode")), "tophat": (pixels, run(pixels, "open")), "blackhat": (run(pixels, "close"), pixels)}
    a, b = pair[mode]
    a = a.select(*by, "y", "x", F.col("v").alias("_a"))
    return a.join(b.select(*by, "y", "x", F.col("v").alias("_b")), [*by, "y", "x"]).select(*by, "y", "x", (F.col("_a") - F.col("_b")).alias("v"))


# resampling --------------------------------------------------------------------------


def resize_nearest(pixels: DataFrame, by: Sequence[str], height: int, width: int) -> DataFrame:
    """Each target cell takes the source pixel at floor(i * scale); sources scatter to their targets, so no grid is joined."""
    own = pixels.join(sizes(pixels, by), [*by])

    def targets(c: str, n: str, m: int) -> Column:
        lo, hi = F.ceil(F.col(c) * m / F.col(n)), F.ceil((F.col(c) + 1) * m / F.col(n)) - 1
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    rows = own.select(*by, "x", "width", "v", F.explode(targets("y", "height", height)).alias("y"))
    return rows.select(*by, "y", "v", F.explode(targets("x", "width", width)).alias("_x")).select(*by, "y", F.col("_x").alias("x"), "v")


def resize_area(pixels: DataFrame, by: Sequence[str], factor: int) -> DataFrame:
    """Mean over whole ``factor`` x ``factor`` cells."""
    cell = lambda c: F.floor(F.col(c) / factor).alias(c)
    return pixels.groupBy(*by, cell("y"), cell("x")).agg(F.avg("v").alias("v"))


def overviews(pixels: DataFrame, by: Sequence[str], levels: int) -> DataFrame:
    """Pyramid ``by, level, y, x, v`` by nearest sampling at powers of two, ``level`` 0 being the image."""
    at = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    p = pixels.select(*by, "y", "x", "v", at)
    step = F.shiftleft(F.lit(1), F.col("level"))
    return p.where((F.col("y") % step == 0) & (F.col("x") % step == 0)).select(*by, "level", F.floor(F.col("y") / step).alias("y"), F.floor(F.col("x") / step).alias("x"), "v")


def warp_nearest(pixels: DataFrame, by: Sequence[str], matrix: np.ndarray, height: int, width: int) -> DataFrame:
    """Target grid by the inverse transform, nearest source pixel; cells without a source are 0."""
    inv = np.linalg.inv(np.asarray(matrix, dtype=float))
    grid = pixels.select(*by).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))))
    ty, tx = F.floor(F.col("_i") / width), F.col("_i") % width
    u, v, w = (inv[i, 0] * tx + inv[i, 1] * ty + inv[i, 2] for i in range(3))
    at = grid.select(*by, ty.alias("ty"), tx.cast("bigint").alias("tx"), F.rint(F.try_divide(v, w)).cast("bigint").alias("y"), F.rint(F.try_divide(u, w)).cast("bigint").alias("x"))
    src = pixels.select(*by, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "v")
    return at.join(src, [*by, "y", "x"], "left").select(*by, F.col("ty").alias("y"), F.col("tx").alias("x"), F.coalesce("v", F.lit(0.0)).alias("v"))


def sample_bilinear(points: DataFrame, pixels: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """``by, key, v``: bilinear values at ``px, py``; neighbours are clipped to the image and keep their weights."""
    p = points.join(sizes(pixels, by), [*by])
    fx, fy = F.floor("px"), F.floor("py")
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.col(n) - 1).cast("bigint")
    dx, dy = F.col("px") - fx, F.col("py") - fy
    corner = lambda ox, oy, w: F.struct(clamp(fy + oy, "height").alias("y"), clamp(fx + ox, "width").alias("x"), w.alias("w"))
    near = F.array(corner(0, 0, (1 - dx) * (1 - dy)), corner(1, 0, dx * (1 - dy)), corner(0, 1, (1 - dx) * dy), corner(1, 1, dx * dy))
    asked = p.select(*by, *key, F.explode(near).alias("n")).select(*by, *key, F.col("n.y").alias("y"), F.col("n.x").alias("x"), F.col("n.w").alias("w"))
    src = pixels.select(*by, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "v")
    return asked.join(src, [*by, "y", "x"]).groupBy(*by, *key).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def translate_bilinear(pixels: DataFrame, by: Sequence[str], dy: float, dx: float) -> DataFrame:
    """Sub-pixel shift: every pixel adds to the up to four cells it falls between; cells outside are lost."""
    fy, fx = math.floor(dy), math.floor(dx)
    ay, ax = dy - fy, dx - fx
    parts = [(fy + i, fx + j, (ay if i else 1 - ay) * (ax if j else 1 - ax)) for i in (0, 1) for j in (0, 1)]
    moves = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(w).alias("w")) for a, b, w in parts if w])
    size = sizes(pixels, by)
    spread = pixels.select(*by, "y", "x", "v", F.explode(moves).alias("m")).select(*by, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), (F.col("v") * F.col("m.w")).alias("t"))
    out = spread.groupBy(*by, "y", "x").agg(F.sum("t").alias("v")).join(size, [*by])
    return out.where("y >= 0 and x >= 0 and y < height and x < width").select(*by, "y", "x", "v")


def accumulate(dst: DataFrame, src: DataFrame, by: Sequence[str], how: str = "sum") -> DataFrame:
    """Pixels of two tables by position: ``sum``, ``max``, ``min``, or ``set`` (src wins)."""
    both = dst.select(*by, "y", "x", "v", F.lit(0).alias("_s")).unionByName(src.select(*by, "y", "x", "v", F.lit(1).alias("_s")))
    agg = {"sum": F.sum("v"), "max": F.max("v"), "min": F.min("v"), "set": F.max_by("v", "_s")}[how]
    return both.groupBy(*by, "y", "x").agg(agg.alias("v"))


def stack_offsets(images: DataFrame, by: Sequence[str], order: str, axis: int = 0, overlap: int = 0, pad: int = 0) -> DataFrame:
    """Adds ``y0, x0``: where each image goes when all are stacked along ``axis`` (0 down, 1 across)."""
    side, zero = ("height", "x0") if axis == 0 else ("width", "y0")
    at = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.col(side) - overlap + pad).over(at), F.lit(0))
    return images.withColumns({("y0" if axis == 0 else "x0"): moved, zero: F.lit(0).cast("bigint")})


def stack_grid_offsets(images: DataFrame, by: Sequence[str], order: str, chunk: int | None = None) -> DataFrame:
    """Adds ``row, col, y0, x0`` of a grid of ``chunk`` images a row (the root of their number by default)."""
    whole = W.partitionBy(*by)
    n = F.lit(chunk) if chunk else F.greatest(F.floor(F.sqrt(F.count(F.lit(1)).over(whole))), F.lit(1))
    i = F.row_number().over(whole.orderBy(order)) - 1
    placed = images.withColumns({"_n": n, "_i": i})
    placed = placed.withColumns({"row": F.floor(F.col("_i") / F.col("_n")), "col": F.col("_i") % F.col("_n")})
    across = W.partitionBy(*by, "row").orderBy("col").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("x0", F.coalesce(F.sum("width").over(across), F.lit(0)))
    tall = placed.groupBy(*by, "row").agg(F.max("height").alias("_h"))
    above = W.partitionBy(*by).orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    tall = tall.select(*by, "row", F.coalesce(F.sum("_h").over(above), F.lit(0)).alias("y0"))
    return placed.join(tall, [*by, "row"]).drop("_n", "_i")


def connected_components(pixels: DataFrame, by: Sequence[str], connectivity: int = 8) -> DataFrame:
    """``by, label, left, top, width, height, area, cx, cy`` of the blobs of non-zero pixels.

    Each image is labelled in one task over its runs; labels count from 1 in the order of
    each blob's first pixel.
    """
    kinds = dict(pixels.dtypes)
    reach = 1 if connectivity == 8 else 0

    def run(f):
        import pandas as pd

        f = f[f["v"] != 0].sort_values(["y", "x"])
        if f.empty:
            return pd.DataFrame(columns=[*by, "label", "left", "top", "width", "height", "area", "cx", "cy"])
        y, x = f["y"].to_numpy(), f["x"].to_numpy()
        new = np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)])
        run_of = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        ry, lo, hi = y[head], x[head], x[np.append(head[1:], len(x)) - 1]
        parent = list(range(len(head)))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        first = {int(v): int(i) for i, v in reversed(list(enumerate(ry)))}
        j_of: dict[int, int] = dict(first)
        for i in range(len(head)):
            j = j_of.get(int(ry[i]) - 1)
            while j is not None and j < len(head) and ry[j] == ry[i] - 1 and lo[j] <= hi[i] + reach:
                if hi[j] >= lo[i] - reach:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
                j += 1
            if j is not None:
                j_of[int(ry[i]) - 1] = max(first[int(ry[i]) - 1], j - 1)
        root = np.array([find(i) for i in range(len(head))])
        label = np.unique(root, return_inverse=True)[1][run_of] + 1
        g = pd.DataFrame({"label": label, "y": y, "x": x}).groupby("label").agg(left=("x", "min"), top=("y", "min"), r=("x", "max"), b=("y", "max"), area=("x", "size"), cx=("x", "mean"), cy=("y", "mean")).reset_index()
        g["width"], g["height"] = g["r"] - g["left"] + 1, g["b"] - g["top"] + 1
        for c in by:
            g[c] = f[c].iloc[0]
        return g[[*by, "label", "left", "top", "width", "height", "area", "cx", "cy"]]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "label long, left long, top long, width long, height long, area long, cx double, cy double"])
    return pixels.select(*by, "y", "x", "v").groupBy(*by).applyInPandas(run, schema)
