"""Warps and resizes of images of any size, tile by tile.

An image is rows of square tiles.  A tile of the result is mapped back to find which tiles
of the source it reads, halo included; a join brings these together, and NumPy takes the
samples of one tile of the result.  No task holds an image.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import _edge, _weights
from .raster import sizes

#: How far, in pixels, a sample reads from its place.
REACH = {"nearest": 0, "linear": 1, "cubic": 2, "lanczos": 4}
#: Source pixels that are sampled at once.
AT_ONCE = 1 << 20
BORDERS = ("constant", "replicate", "reflect", "reflect101", "wrap")


def tiled(pixels: DataFrame, by: Sequence[str], tile: int) -> DataFrame:
    """Tiles ``(by, height, width, ty, tx, values)`` of a pixel relation; ``values`` are ``tile * tile`` numbers by row, missing ones NaN.

    Null pixels are missing ones; of pixels given twice the greater counts.
    """
    at = (F.col("y") % tile) * tile + F.col("x") % tile
    cell = lambda c: F.floor(F.col(c) / tile)
    held = pixels.where("v is not null").groupBy(*by, cell("y").alias("ty"), cell("x").alias("tx")).agg(
        F.map_from_entries(F.collect_set(F.struct(at.cast("int").alias("i"), F.col("v").cast("double").alias("v")))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(float("nan"))))
    return held.join(sizes(pixels, by), list(by)).select(*by, "height", "width", "ty", "tx", values.alias("values"))


def untiled(tiles: DataFrame, by: Sequence[str], tile: int) -> DataFrame:
    """Pixels ``(by, y, x, v)`` of tiles, those inside the image."""
    flat = tiles.select(*by, "height", "width", "ty", "tx", F.posexplode("values").alias("_i", "v"))
    placed = flat.select(*by, "height", "width", (F.col("ty") * tile + F.floor(F.col("_i") / tile)).alias("y"), (F.col("tx") * tile + F.col("_i") % tile).alias("x"), "v")
    return placed.where("y < height and x < width").select(*by, "y", "x", "v")


def folded(i: Column, n: Column, border: str) -> Column:
    """Index of a row or column as the border mode reads it; beyond the image null if constant."""
    if border == "replicate":
        return F.least(F.greatest(i, F.lit(0)), n - 1)
    if border == "wrap":
        return F.pmod(i, n)
    if border == "constant":
        return F.when((i >= 0) & (i < n), i)
    period = 2 * n if border == "reflect" else F.greatest(2 * (n - 1), F.lit(1))
    j = F.pmod(i, period)
    return F.when(j < n, j).otherwise((2 * n - 1 - j) if border == "reflect" else period - j)


def read_tiles(lo: Column, hi: Column, n: Column, tile: int, border: str) -> Column:
    """Tiles along an axis that hold the indices from ``lo`` to ``hi``."""
    if border in ("constant", "replicate"):
        inside = (F.least(F.greatest(v, F.lit(0)), n - 1) for v in (lo, hi))
        first, last = (F.floor(v / tile) for v in inside)
        none = F.array().cast("array<bigint>")
        return F.when((hi < 0) | (lo >= n), none).otherwise(F.sequence(first, last)) if border == "constant" else F.sequence(first, last)
    # beyond a whole period every index is read
    return F.array_distinct(F.transform(F.sequence(lo, F.least(hi, lo + 2 * n)), lambda i: F.floor(folded(i, n, border) / tile)))


def warp(
    tiles: DataFrame, by: Sequence[str], matrix: np.ndarray, height: int, width: int, tile: int,
    interpolation: str = "linear", border: str = "constant", value: float = 0.0,
) -> DataFrame:
    """Tiles of the images of ``height`` and ``width`` that an affine or projective ``matrix`` makes of tiles of :func:`tiled`.

    Pixel centres are at whole coordinates.  Samples are ``nearest``, ``linear``, ``cubic``
    (a = -0.75) or ``lanczos`` (four lobes, weights scaled to 1); beyond the image the
    border is ``constant`` (``value``), ``replicate``, ``reflect``, ``reflect101`` or
    ``wrap``.  A missing pixel makes every sample missing that reads it with a weight.  A
    tile of the result reads as much of the source as it covers, so reduce images that
    shrink much first.  Without images, or with a size of 0, there are no tiles.
    """
    reach, inv = REACH[interpolation], np.linalg.inv(np.asarray(matrix, dtype=float))
    if border not in BORDERS:
        raise ValueError(f"no border {border!r}")
    count = lambda n: -(-n // tile)
    if not height or not width:
        return tiles.limit(0)
    images = tiles.select(*by, "height", "width").distinct()
    targets = images.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(count(height) * count(width) - 1)))).select(
        *by, F.col("height").alias("_n"), F.col("width").alias("_m"), F.floor(F.col("_t") / count(width)).alias("_ty"), (F.col("_t") % count(width)).cast("bigint").alias("_tx"))
    ys = [F.col("_ty") * tile, F.least((F.col("_ty") + 1) * tile, F.lit(height)) - 1]
    xs = [F.col("_tx") * tile, F.least((F.col("_tx") + 1) * tile, F.lit(width)) - 1]
    corners = [[float(inv[i, 0]) * x + float(inv[i, 1]) * y + float(inv[i, 2]) for i in range(3)] for y in ys for x in xs]
    # where the plane goes through infinity within a tile, the whole image is read
    sound = F.lit(True)
    for _, _, w in corners:
        sound = sound & (w > 0)

    def span(axis: int, n: str) -> tuple[Column, Column]:
        at = F.array(*[F.try_divide(c[axis], c[2]) for c in corners])
        bound = lambda v: F.least(F.greatest(v, F.lit(-2.0**40)), F.lit(2.0**40)).cast("bigint")
        return (F.when(sound, bound(F.floor(F.array_min(at)) - reach)).otherwise(F.lit(0)), F.when(sound, bound(F.ceil(F.array_max(at)) + reach)).otherwise(F.col(n) - 1))

    rows, cols = read_tiles(*span(1, "_n"), F.col("_n"), tile, border), read_tiles(*span(0, "_m"), F.col("_m"), tile, border)
    asked = targets.withColumns({"_r": rows, "_c": cols}).withColumn("ty", F.explode_outer("_r")).withColumn("tx", F.explode_outer("_c"))
    met = asked.join(tiles.drop("height", "width"), [*by, "ty", "tx"], "left").select(*by, "_n", "_m", "_ty", "_tx", "ty", "tx", "values")
    kinds = dict(tiles.dtypes)

    def sample(n: int, m: int, oy: int, ox: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Tile ``oy, ox`` of images of one size that read the same tiles ``at`` of their sources; ``values`` are these, image by image."""
        ranks = [{t: k for k, t in enumerate(sorted(set(at[:, axis].tolist())))} for axis in (0, 1)]
        block = np.full((len(values), max(1, len(ranks[0])) * tile, max(1, len(ranks[1])) * tile), np.nan)
        for k, (y, x) in enumerate(at.tolist()):
            r, c = ranks[0][y] * tile, ranks[1][x] * tile
            block[:, r:r + tile, c:c + tile] = values[:, k]
        slot = [np.zeros(-(-size // tile), dtype=np.int64) for size in (n, m)]
        for axis in (0, 1):
            for t, k in ranks[axis].items():
                slot[axis][t] = k
        yy, xx = np.mgrid[oy * tile:min((oy + 1) * tile, height), ox * tile:min((ox + 1) * tile, width)].astype(float)
        u, v, w = (inv[i, 0] * xx + inv[i, 1] * yy + inv[i, 2] for i in range(3))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = take(block, slot, tile, n, m, v / w, u / w)
        full = np.full((len(values), tile, tile), np.nan)
        full[:, :out.shape[1], :out.shape[2]] = out
        return full

    def run(batches):
        for batch in batches:
            held = batch.column("_t")
            ends = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
            read = held.flatten()
            at = np.stack([read.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ty", "tx")], axis=1)
            values = read.field("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, tile, tile)
            where = [batch.column(c).to_pylist() for c in ("_n", "_m", "_ty", "_tx")]
            alike: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(*where, strict=True)):
                alike.setdefault((*key, at[ends[k]:ends[k + 1]].tobytes()), []).append(k)
            made = np.empty((batch.num_rows, tile, tile))
            for (n, m, oy, ox, _), rows in alike.items():
                count = int(ends[rows[0] + 1] - ends[rows[0]])
                many = max(1, AT_ONCE // (max(1, count) * tile * tile))
                for lo in range(0, len(rows), many):
                    some = np.array(rows[lo:lo + many])
                    made[some] = sample(n, m, oy, ox, at[ends[some[0]]:ends[some[0] + 1]], values[ends[some][:, None] + np.arange(count)])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tile * tile, pa.int32()), pa.array(made.ravel()))
            sides = [pa.array(np.full(batch.num_rows, side), pa.int32()) for side in (height, width)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in by), *sides, batch.column("_ty"), batch.column("_tx"), flat], names=[*by, "height", "width", "ty", "tx", "values"])

    def take(block, slot, tile, n, m, y, x) -> np.ndarray:
        """Samples of each image at places of the source of which ``block`` has the tiles; ``slot`` says where."""
        def tap(iy, ix):
            (jy, oky), (jx, okx) = _edge(iy, n, border), _edge(ix, m, border)
            got = block[:, slot[0][jy // tile] * tile + jy % tile, slot[1][jx // tile] * tile + jx % tile]
            return np.where(oky & okx, got, value)

        whole = np.isfinite(y) & np.isfinite(x)
        y, x = np.where(whole, y, -1e9), np.where(whole, x, -1e9)
        if interpolation == "nearest":
            return tap(np.rint(y).astype(np.int64), np.rint(x).astype(np.int64))
        r, weight = _weights(interpolation)
        fy, fx = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        out, total = np.zeros((len(block), *y.shape)), np.zeros(y.shape)
        for i in range(1 - r, r + 1):
            for j in range(1 - r, r + 1):
                ww = weight(y - fy - i) * weight(x - fx - j)
                out += np.where(ww == 0, 0.0, ww * tap(fy + i, fx + j))
                total += ww
        return out / np.where(total == 0, 1, total)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", height int, width int, ty long, tx long, values array<double>"
    # images of one size that read the same tiles are sampled together
    held = F.when(F.col("values").isNotNull(), F.struct("ty", "tx", "values"))
    return met.groupBy(*by, "_n", "_m", "_ty", "_tx").agg(F.sort_array(F.collect_list(held)).alias("_t")).mapInArrow(run, schema)


def resize(tiles: DataFrame, by: Sequence[str], source: tuple[int, int], height: int, width: int, tile: int, interpolation: str = "linear") -> DataFrame:
    """Tiles of images of size ``source`` (height, width) brought to another, corners of the outer pixels aligned, borders replicated."""
    sy, sx = height / source[0], width / source[1]
    return warp(tiles, by, np.array([[sx, 0, sx / 2 - 0.5], [0, sy, sy / 2 - 0.5], [0, 0, 1]]), height, width, tile, interpolation, "replicate")
