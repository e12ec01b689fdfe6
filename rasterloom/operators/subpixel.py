"""Patches put into images, and read from them, at places between pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMBINERS = ("add", "set", "max", "min")


def _share(name: str, at: Column, more: int) -> list[Column]:
    """Cell and weight of one of the two cells along an axis that a place lies between."""
    cell = F.floor(at) + more
    return [cell.cast("bigint").alias(name), (1 - F.abs(at - cell)).alias(f"_w{name}")]


def _taps(y: Column, x: Column) -> Column:
    """The up to four cells around a place, those of weight 0 as well."""
    return F.array(*[F.struct(*_share("cy", y, a), *_share("cx", x, b)) for a in (0, 1) for b in (0, 1)])


def splat(images: DataFrame, patches: DataFrame, by: Sequence[str], patch: str = "patch", how: str = "add") -> DataFrame:
    """``by, y, x, v`` of images after every patch was put in.

    ``patches`` holds ``by, patch, oy, ox, y, x, v``: a pixel lies at ``(oy + y, ox + x)`` and
    is shared linearly among the cells around it.  ``how`` says what a cell does with what a
    patch brings: add it, become it (of several patches the one of the greatest name counts)
    or keep the greater or smaller one.  What falls beyond an image is lost; cells that no
    patch reaches stay.  Null cells of images stay null; null pixels of patches bring nothing.
    Patches of unknown images are ignored.

    All patches of an image go in at once: shares are summed before they are shuffled, and no
    image or patch is held whole.
    """
    if how not in COMBINERS:
        raise ValueError(f"unknown combiner {how!r}; known are {', '.join(COMBINERS)}")
    at = patches.where("v is not null").select(*by, F.col(patch).alias("_k"), F.col("v").cast("double").alias("_v"), F.inline(_taps(F.col("oy") + F.col("y"), F.col("ox") + F.col("x"))))
    brought = at.where("_wcy > 0 and _wcx > 0").select(*by, "_k", F.col("cy").alias("y"), F.col("cx").alias("x"), (F.col("_v") * F.col("_wcy") * F.col("_wcx")).alias("_s"))
    if how != "add":
        brought = brought.groupBy(*by, "_k", "y", "x").agg(F.sum("_s").alias("_s"))
    own = images.select(*by, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("v").cast("double").alias("_v"), F.lit(True).alias("_there"))
    cells = own.unionByName(brought, allowMissingColumns=True).groupBy(*by, "y", "x")
    new = {"add": F.sum("_s"), "set": F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_k"))), "max": F.max("_s"), "min": F.min("_s")}[how]
    merged = cells.agg(F.max("_there").alias("_there"), F.max("_v").alias("_v"), new.alias("_s")).where("_there")
    value = {"add": F.col("_v") + F.col("_s"), "set": F.when(F.col("_v").isNotNull(), F.col("_s")), "max": F.greatest("_v", "_s"), "min": F.least("_v", "_s")}[how]
    return merged.select(*by, "y", "x", F.when(F.col("_s").isNull() | F.col("_v").isNull(), F.col("_v")).otherwise(value).alias("v"))


def slices(images: DataFrame, windows: DataFrame, by: Sequence[str], patch: str = "patch") -> DataFrame:
    """``by, patch, y, x, v`` of windows ``by, patch, y0, y1, x0, x1`` of images, whose sides may lie between pixels.

    The pixel ``(y, x)`` of a patch is the image, linear between its pixels and 0 beyond them,
    at ``(y0 + y, x0 + x)``; a side that isn't whole is rounded up.  Null and missing pixels
    count as 0; empty windows have no rows.
    """
    side = lambda a, b: F.greatest(F.ceil(F.col(b) - F.col(a)), F.lit(0)).cast("bigint")
    sized = windows.select(*by, patch, "y0", "x0", side("y0", "y1").alias("_h"), side("x0", "x1").alias("_w")).where("_h > 0 and _w > 0")
    cells = sized.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_h") * F.col("_w") - 1)))
    grid = cells.select(*by, patch, "y0", "x0", F.floor(F.col("_i") / F.col("_w")).alias("y"), (F.col("_i") % F.col("_w")).alias("x"))
    asked = grid.select(*by, patch, "y", "x", F.inline(_taps(F.col("y0") + F.col("y"), F.col("x0") + F.col("x"))))
    held = images.select(*by, F.col("y").cast("bigint").alias("cy"), F.col("x").cast("bigint").alias("cx"), F.col("v").cast("double").alias("_v"))
    summed = F.coalesce(F.sum(F.col("_v") * F.col("_wcy") * F.col("_wcx")), F.lit(0.0))
    return asked.join(held, [*by, "cy", "cx"], "left").groupBy(*by, patch, "y", "x").agg(summed.alias("v"))
