"""Masks to polygons, from their runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draw import fill_polygons
from .runlength import one_runs
from .unions import union_rings, unary_union


def line_runs(masks: DataFrame, by: Sequence[str], mask: str = "mask") -> DataFrame:
    """``by, line, start, stop`` of the ones of each row of a mask (each column, if it is column-major); nothing is decoded."""
    long = F.when(F.col(mask)["order"] == "F", F.col(mask)["height"]).otherwise(F.col(mask)["width"])
    shape = masks.select(*by, long.cast("bigint").alias("_long"), (F.col(mask)["order"] == "F").alias("by_column"))
    runs = one_runs(masks, by, mask).join(shape, list(by))
    lines = runs.withColumn("line", F.explode(F.sequence(F.floor(F.col("start") / F.col("_long")), F.floor((F.col("stop") - 1) / F.col("_long")))))
    first = F.greatest(F.col("start") - F.col("line") * F.col("_long"), F.lit(0))
    last = F.least(F.col("stop") - F.col("line") * F.col("_long"), F.col("_long"))
    return lines.select(*by, "by_column", "line", first.alias("start"), last.alias("stop"))


def run_rectangles(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, poly``: each run as the rectangle of its pixels, the first pixel from (0, 0) to (1, 1)."""
    across, along = (F.col("line"), F.col("line") + 1), (F.col("start"), F.col("stop"))
    pick = lambda a, b: F.when(F.col("by_column"), a).otherwise(b).cast("double")
    x1, x2, y1, y2 = pick(across[0], along[0]), pick(across[1], along[1]), pick(along[0], across[0]), pick(along[1], across[1])
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return runs.select(*by, F.array(F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))).alias("poly"))


def mask_rings(masks: DataFrame, by: Sequence[str], mask: str = "mask", tile: float = 256.0) -> DataFrame:
    """Rings ``(ring, area, points)`` around the ones of each mask, exteriors counter-clockwise, holes clockwise with negative area.

    Pixels that touch at a corner only are parts of different rings.  The runs' rectangles
    are united in tiles and rings are stitched over tile borders, so a mask of any size is
    spread over tasks.  ``by`` must be unique; a mask without ones has no rings.
    """
    return union_rings(run_rectangles(line_runs(masks, by, mask), by), by, F.col("poly"), tile)


def mask_polygons(masks: DataFrame, by: Sequence[str], mask: str = "mask", tile: float = 256.0) -> DataFrame:
    """``polygons`` around the ones of each mask, in one row a mask; see :func:`mask_rings`."""
    return unary_union(run_rectangles(line_runs(masks, by, mask), by), by, F.col("poly"), tile)


def polygon_runs(polys: DataFrame, by: Sequence[str], height: int, width: int, polygons: Column) -> DataFrame:
    """``by, y, start, stop``: runs of the pixels whose middles lie in any of an array of polygons, as :func:`mask_polygons` gives them."""
    rings = F.transform(F.flatten(polygons), lambda r: F.transform(r, lambda p: F.struct((p["x"] - 0.5).alias("x"), (p["y"] - 0.5).alias("y"))))
    return fill_polygons(polys.select(*by, rings.alias("poly")), by, height, width)
