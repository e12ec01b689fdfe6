"""Spatial joins of boxes and points by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import box as B


#: Each grid level has cells ``STEP`` times as wide as the one below; boxes beyond level ``TOP`` are clamped to its cell.
STEP, TOP = 8, 15


def level(b: Column, size: float) -> Column:
    """The finest grid whose cells are at least as wide as the box, so that it touches at most four of them."""
    side = F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"], F.lit(size))
    return F.least(F.ceil(F.log2(side / size) / math.log2(STEP)), F.lit(TOP)).cast("int")


def at(v: Column, level: Column, size: float) -> Column:
    """Number of the cell of a level that holds a coordinate."""
    far = size * STEP ** TOP
    return F.floor(F.greatest(F.least(v, F.lit(far)), F.lit(-far)) / (F.pow(F.lit(float(STEP)), level) * size))


def cells(b: Column, levels: Column, size: float) -> Column:
    """Cells that a box touches on each of the levels, as ``array<struct<level,cx,cy>>``; boxes with NaN sides touch none."""
    def on_level(n: Column) -> Column:
        span = lambda lo, hi: F.sequence(at(b[lo], n, size), F.greatest(at(b[lo], n, size), at(b[hi], n, size)))
        return F.flatten(F.transform(span("x1", "x2"), lambda cx: F.transform(
            span("y1", "y2"), lambda cy: F.struct(n.alias("level"), cx.alias("cx"), cy.alias("cy")))))

    return F.when(whole(b), F.flatten(F.transform(levels, on_level))).otherwise(F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>"))


def whole(b: Column) -> Column:
    return ~(F.isnan(b["x1"]) | F.isnan(b["y1"]) | F.isnan(b["x2"]) | F.isnan(b["y2"]))


def levels_of(df: DataFrame, box: str, size: float) -> list[int]:
    """Levels that a table's boxes have, at most ``TOP + 1``."""
    found = df.where(whole(F.col(box))).select(level(F.col(box), size).alias("n")).distinct().collect()
    return sorted(r["n"] for r in found if r["n"] is not None)


def dealt(df: DataFrame, box: str, others: list[int], size: float, role: int) -> DataFrame:
    """``df`` once for each cell that its box touches, as the larger box of a pair on its own level, and as the smaller on the levels of ``others``.

    ``_role`` says which side has the larger box, 0 or 1; of boxes of one level it is side
    0.  So boxes meet on a level only with those whose own level it is.
    """
    b, own = F.col(box), level(F.col(box), size)
    known = F.array(*[F.lit(n) for n in others]).cast("array<int>")
    larger = F.filter(F.array(own), lambda n: F.exists(known, lambda m: m < n if role else m <= n))
    smaller = F.filter(known, lambda m: m >= own if role else m > own)
    ways = F.concat(
        F.transform(cells(b, larger, size), lambda c: F.struct(F.lit(role).alias("role"), c.alias("cell"))),
        F.transform(cells(b, smaller, size), lambda c: F.struct(F.lit(1 - role).alias("role"), c.alias("cell"))))
    return df.withColumn("_way", F.explode(ways)).select(*df.columns, F.col("_way.role").alias("_role"), F.col("_way.cell").alias("cell"))


def overlapping_pairs(left: DataFrame, right: DataFrame, on: list[str], size: float = 64.0, left_box: str = "box", right_box: str = "box") -> DataFrame:
    """Pairs of rows with equal ``on`` whose boxes overlap; columns of the sides are prefixed ``l_`` and ``r_``.

    Both sides are dealt over nested grids, the finest with cells of ``size``: a box of any
    size touches a few cells of its own level, and a pair meets on the level of its larger
    box, which is that box's own: small boxes that share a large cell don't meet there.  A
    pair that shares several cells is kept only in the cell that holds the top left of its
    intersection, so no distinct is needed.  The join is an equi-join on ``on``, the side of
    the larger box and the cell, which adaptive execution can split where it is skewed.

    The levels that occur, at most ``TOP + 1`` numbers a side, are read first.
    """
    right_levels = levels_of(right, right_box, size)
    left_levels = right_levels if left is right and left_box == right_box else levels_of(left, left_box, size)
    l = left.select(*on, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in on])
    r = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on])
    a, b = F.col(f"l_{left_box}"), F.col(f"r_{right_box}")
    joined = dealt(l, f"l_{left_box}", right_levels, size, 0).join(dealt(r, f"r_{right_box}", left_levels, size, 1), [*on, "_role", "cell"])
    n = F.col("cell.level")
    first = (F.col("cell.cx") == at(F.greatest(a["x1"], b["x1"]), n, size)) & (F.col("cell.cy") == at(F.greatest(a["y1"], b["y1"]), n, size))
    meets = (F.greatest(a["x1"], b["x1"]) <= F.least(a["x2"], b["x2"])) & (F.greatest(a["y1"], b["y1"]) <= F.least(a["y2"], b["y2"]))
    return joined.where(meets & first).drop("cell", "_role")


def ious(left: DataFrame, right: DataFrame, on: list[str], bias: float = 0.0, size: float = 64.0) -> DataFrame:
    """Overlapping pairs with ``isect``, ``iou`` and ``iooa``; pairs that are absent have all three 0."""
    pad = bias or 0.0
    grown = lambda d: d.withColumn("box", B.pad(F.col("box"), 0, 0, pad, pad)) if pad else d
    pairs = overlapping_pairs(grown(left), grown(right), on, size)
    a, b = F.col("l_box"), F.col("r_box")
    out = pairs.withColumns({"isect": B.isect_area(a, b), "iou": B.iou(a, b), "iooa": B.iooa(a, b)})
    if pad:
        out = out.withColumns({"l_box": B.pad(a, 0, 0, -pad, -pad), "r_box": B.pad(b, 0, 0, -pad, -pad)})
    return out


def all_ious(left: DataFrame, right: DataFrame, on: list[str], bias: float = 0.0) -> DataFrame:
    """Every pair of rows with equal ``on`` (an image, say), zeros included; the result itself is that large."""
    a = left.select(*on, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in on])
    b = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on])
    return a.join(b, on).withColumn("iou", B.iou(F.col("l_box"), F.col("r_box"), bias))


def points_in_boxes(points: DataFrame, boxes: DataFrame, on: list[str], x: str = "x", y: str = "y", size: float = 64.0) -> DataFrame:
    """Pairs of a point and a box that holds it, borders included."""
    own = boxes.withColumn("_level", level(F.col("box"), size))
    b = own.withColumn("cell", F.explode(cells(F.col("box"), F.array("_level"), size))).drop("_level")
    # a point is looked up on every level that has boxes, at most TOP + 1
    levels = own.agg(F.collect_set("_level")).scalar()
    p = points.withColumn("_levels", levels).withColumn("_level", F.explode("_levels"))
    p = p.withColumn("cell", F.struct(F.col("_level").alias("level"), at(F.col(x), F.col("_level"), size).alias("cx"), at(F.col(y), F.col("_level"), size).alias("cy")))
    return p.drop("_levels", "_level").join(b, [*on, "cell"]).where(B.contains(F.col("box"), F.col(x), F.col(y))).drop("cell")


def zipped(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Row by row intersection and hull of two box tables with the same key."""
    a = left.select(*key, F.col("box").alias("_a"))
    b = right.select(*key, F.col("box").alias("_b"))
    return a.join(b, key).select(*key, B.intersection(F.col("_a"), F.col("_b")).alias("intersection"), B.union_hull(F.col("_a"), F.col("_b")).alias("hull"))
