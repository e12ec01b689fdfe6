"""Warps, scales and patches of masks from their runs, without decoding them.

A run of one line of a mask is a thin rectangle.  Each line of the result meets its image
in one stretch, whose ends solve linear inequalities; stretches of a line are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contours import line_runs
from .runlength import merge_runs, runs_to_masks

#: Slack, in pixels, of the solved ends before they are tried exactly.
SLACK = 1e-6


def reframed(frame: DataFrame, stretches: DataFrame, by: Sequence[str], mask: str) -> DataFrame:
    """Masks of ``frame`` (``by, _o, _h, _w``) with ones on ``stretches`` (``by, line, start, stop``); those without any are zeros."""
    long = F.when(F.col("_o") == "F", F.col("_h")).otherwise(F.col("_w")).cast("bigint")
    placed = stretches.join(frame, [*by]).select(*by, "_o", "_h", "_w", (F.col("line") * long + F.col("start")).alias("start"), (F.col("line") * long + F.col("stop")).alias("stop"))
    made = runs_to_masks(merge_runs(placed, [*by, "_o", "_h", "_w"]), [*by, "_o"], "_h", "_w").select(*by, F.col("mask.counts").alias("_c"))
    empty = F.array((F.col("_h") * F.col("_w")).cast("int"))
    return frame.join(made, [*by], "left").select(
        *by, F.struct(F.col("_h").alias("height"), F.col("_w").alias("width"), F.col("_o").alias("order"), F.coalesce("_c", empty).alias("counts")).alias(mask))


def _frame(masks: DataFrame, by: Sequence[str], mask: str, height: Column, width: Column) -> DataFrame:
    """``by, _o, _h, _w``: order and new size of every mask that isn't null."""
    known = masks.where(F.col(mask).isNotNull())
    return known.select(*by, F.col(mask)["order"].alias("_o"), height.cast("int").alias("_h"), width.cast("int").alias("_w"))


def warp_masks(masks: DataFrame, by: Sequence[str], matrix: np.ndarray, height: int | Column | None = None, width: int | Column | None = None, mask: str = "mask") -> DataFrame:
    """``by, mask`` of masks taken through a 3x3 ``matrix`` into a frame of ``height`` by ``width`` (as before, if unset).

    A pixel of the result is that of the mask nearest to the place it came from, halves to
    the even one; beyond the mask it is 0.  ``by`` is unique and not null; masks keep their
    order, null ones have no row, those that vanish are one run of zeros.  Projective
    matrices must keep the frame on one side of their horizon; others are refused, and
    so are singular ones.

    A run meets as many lines as its image crosses, so work follows the runs, not the
    pixels; runs of a large mask are spread over tasks.
    """
    there = np.asarray(matrix, dtype=float)
    if there.shape != (3, 3) or not np.isfinite(there).all() or np.linalg.matrix_rank(there) < 3:
        raise ValueError("a 3x3 matrix with an inverse is needed")
    back = np.linalg.inv(there)
    size = lambda given, name: F.col(mask)[name] if given is None else given if isinstance(given, Column) else F.lit(given)
    frame = _frame(masks, by, mask, size(height, "height"), size(width, "width"))
    corners = [float(back[2, 2]) + float(back[2, 0]) * x + float(back[2, 1]) * y for x in (F.lit(0), F.col("_w") - 1) for y in (F.lit(0), F.col("_h") - 1)]
    side = F.when(F.least(*corners) > 0, 1).when(F.greatest(*corners) < 0, -1).otherwise(F.raise_error(F.lit("the frame crosses the horizon of the matrix")).cast("int"))
    # coefficients of (along, line, 1): as given for lines that are rows, with axes exchanged for columns
    swap = (1, 0, 2)
    sides = {"_side": side, "_long": F.when(F.col("_o") == "F", F.col("_h")).otherwise(F.col("_w")), "_last": F.when(F.col("_o") == "F", F.col("_w")).otherwise(F.col("_h")) - 1}
    for letter, m in (("m", there), ("r", back)):
        for i in range(3):
            for j in range(3):
                sides[f"_{letter}{i}{j}"] = F.when(F.col("_o") == "F", F.lit(float(m[swap[i], swap[j]]))).otherwise(F.lit(float(m[i, j])))
    runs = line_runs(masks, by, mask).join(frame.withColumns(sides).drop("_o", "_h", "_w"), [*by])
    forth = lambda i, j: F.col(f"_m{i}{j}")
    source = lambda i, j: F.col(f"_r{i}{j}")

    # lines that the image of a run may cross
    at = [[forth(i, 0) * s + forth(i, 1) * t + forth(i, 2) for i in (1, 2)]
          for s in (F.col("start") - 0.5, F.col("stop") - 0.5) for t in (F.col("line") - 0.5, F.col("line") + 0.5)]
    depths = [d for _, d in at]
    whole = F.least(*depths) * F.greatest(*depths) <= 0
    crossed = [n / F.when(d != 0, d) for n, d in at]
    low = F.when(whole, F.lit(0)).otherwise(F.greatest(F.floor(F.least(*crossed)) - 1, F.lit(0)))
    high = F.when(whole, F.col("_last")).otherwise(F.least(F.ceil(F.greatest(*crossed)) + 1, F.col("_last")))
    # a generated row keeps an expression from being written out again wherever it is used
    given = lambda d, **columns: d.select("*", F.inline(F.array(F.struct(*[c.cast("bigint").alias(n) for n, c in columns.items()]))))
    spread = given(runs, _lo=low, _hi=high).where("_lo <= _hi").withColumn("_l", F.explode(F.sequence("_lo", "_hi")))

    def side_of(i: int, edge: Column) -> tuple[Column, Column]:
        """``a, b``: the place along axis ``i`` of the source is at or beyond ``edge`` where ``a * along + b >= 0``."""
        a = source(i, 0) - edge * source(2, 0)
        b = (source(i, 1) - edge * source(2, 1)) * F.col("_l") + (source(i, 2) - edge * source(2, 2))
        return a * F.col("_side"), b * F.col("_side")

    lows, highs = [F.lit(0)], [F.col("_long") - 1]
    for i, first, end in ((0, F.col("start") - 0.5, F.col("stop") - 0.5), (1, F.col("line") - 0.5, F.col("line") + 0.5)):
        for sign, edge in ((1, first), (-1, end)):
            a, b = (c * sign for c in side_of(i, edge))
            root = -b / F.when(a != 0, a)
            lows.append(F.when(a > 0, F.ceil(root - SLACK)))
            highs.append(F.when(a < 0, F.floor(root + SLACK)))
    solved = given(spread, _a=F.greatest(*lows), _b=F.least(*highs)).where("_a <= _b")

    def inside(x: Column) -> Column:
        s, t, d = (source(i, 0) * x + source(i, 1) * F.col("_l") + source(i, 2) for i in range(3))
        s, t = F.rint(s / d), F.rint(t / d)
        return (t == F.col("line")) & (s >= F.col("start")) & (s < F.col("stop"))

    a, b = F.col("_a"), F.col("_b")
    ends = given(
        solved, _from=F.when(inside(a), a).when(inside(a + 1), a + 1).when(inside(a + 2), a + 2), _to=F.when(inside(b), b).when(inside(b - 1), b - 1).when(inside(b - 2), b - 2))
    stretches = ends.where("_from <= _to").select(*by, F.col("_l").alias("line"), F.col("_from").alias("start"), (F.col("_to") + 1).alias("stop"))
    return reframed(frame, stretches, by, mask)


def scale_masks(masks: DataFrame, by: Sequence[str], factor: float | tuple[float, float], height: int | None = None, width: int | None = None, mask: str = "mask") -> DataFrame:
    """Masks scaled by ``factor`` or ``(x, y)`` factors; the frame is scaled with them and cut to whole pixels unless given."""
    sx, sy = factor if isinstance(factor, Sequence) else (factor, factor)
    grown = lambda name, s: (F.col(mask)[name] * F.lit(float(s))).cast("int")
    return warp_masks(masks, by, np.diag([sx, sy, 1.0]), grown("height", sy) if height is None else height, grown("width", sx) if width is None else width, mask)


def mask_patches(masks: DataFrame, by: Sequence[str], mask: str = "mask") -> DataFrame:
    """``by, x, y, mask``: the least part of each mask that holds its ones, and where it lay; masks without ones have no row."""
    runs = line_runs(masks, by, mask)
    box = runs.groupBy(*by, "by_column").agg(F.min("line").alias("_l0"), F.max("line").alias("_l1"), F.min("start").alias("_s0"), F.max("stop").alias("_s1"))
    lines, along = F.col("_l1") - F.col("_l0") + 1, F.col("_s1") - F.col("_s0")
    pick = lambda f, c: F.when(F.col("by_column"), f).otherwise(c)
    frame = box.select(*by, pick(F.lit("F"), F.lit("C")).alias("_o"), pick(along, lines).cast("int").alias("_h"), pick(lines, along).cast("int").alias("_w"))
    moved = runs.join(box.drop("by_column"), [*by]).select(*by, (F.col("line") - F.col("_l0")).alias("line"), (F.col("start") - F.col("_s0")).alias("start"), (F.col("stop") - F.col("_s0")).alias("stop"))
    corner = box.select(*by, pick(F.col("_l0"), F.col("_s0")).alias("x"), pick(F.col("_s0"), F.col("_l0")).alias("y"))
    return corner.join(reframed(frame, moved, by, mask), [*by])
