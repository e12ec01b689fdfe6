"""Overlay of polygons of any shape: arrangements of their edges, and how often each side covers what lies beside an edge.

Edges are rows.  A range join on grid cells finds where edges of one key meet, edges are
split there, and a join on bands of y counts which edges lie to the right of each part.
What lies left and right of a part is then known, and so is whether the part borders a
result.  No polygon is held by a task before its result is put together.

Where polygons are small, callers ask for ``within_tasks``: a row's arrangement is then
made by :mod:`.arrangement` where the row is, without joins, to the same results.

Coordinates are put on a grid of :data:`GRID` first, so that crossings computed from
different pairs of edges agree; results are right to within that.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygon as G
from . import arrangement as A
from . import rings as R
from .arrangement import GRID
from .durable import durable

#: Cells of a key's grid along one axis at most; edges are dealt over the cells they pass.
MAX_CELLS = 1024

#: When a place that sides 0 and 1 cover or not is in the result.
RULES = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "symmetric_difference": lambda a, b: a != b,
}

ENDS = ["lx", "ly", "hx", "hy"]


def snap(v: Column) -> Column:
    # adding 0 turns -0.0 to 0.0
    return F.rint(v / GRID) * GRID + F.lit(0.0)


def odd(winding: Column) -> Column:
    """Even-odd: right for valid polygons whatever way their rings turn, and the usual reading of invalid ones."""
    return F.pmod(winding, F.lit(2)) == 1


def nonzero(winding: Column) -> Column:
    """Covered by at least one of several polygons whose exteriors turn the same way."""
    return winding != 0


def directed(df: DataFrame, on: Sequence[str], rings: Column, side: int = 0) -> DataFrame:
    """Directed edges ``(x1, y1, x2, y2, side)`` of an array of rings, holes among them; null rings have none."""
    rows = df.select(*on, F.explode(rings).alias("_ring")).select(*on, F.explode(G.edges(F.col("_ring"))).alias("_e"))
    e = F.col("_e")
    return rows.select(*on, *[snap(e[p][c]).alias(f"{c}{i}") for p, i in (("p", 1), ("q", 2)) for c in "xy"], F.lit(side).alias("side"))


def canonical(edges: DataFrame, on: Sequence[str]) -> DataFrame:
    """Edges from their lower end (the left one if level) to the higher, once each, with the net number of passes ``d0``, ``d1`` of either side.

    Edges without length, with a coordinate that is null or not finite, and those that
    cancel are left out.
    """
    up = (F.col("y1") < F.col("y2")) | ((F.col("y1") == F.col("y2")) & (F.col("x1") < F.col("x2")))
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    finite = (F.abs(F.col("x1") + F.col("x2") + F.col("y1") + F.col("y2")) < float("inf")) & ~F.isnan(F.col("x1") + F.col("x2") + F.col("y1") + F.col("y2"))
    passes = F.when(up, 1).otherwise(-1) * (F.col("n") if "n" in edges.columns else F.lit(1))
    flat = edges.where(finite & ((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))).select(
        *on, pick("x1", "x2").alias("lx"), pick("y1", "y2").alias("ly"), pick("x2", "x1").alias("hx"), pick("y2", "y1").alias("hy"),
        *[F.when(F.col("side") == s, passes).otherwise(0).alias(f"d{s}") for s in (0, 1)])
    return flat.groupBy(*on, *ENDS).agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1")).where("d0 <> 0 or d1 <> 0")


def measured(edges: DataFrame, on: Sequence[str]) -> DataFrame:
    """Edges with their key's corner ``_x0``, ``_y0``, mean extent ``_w``, mean height ``_h`` and number ``_n``."""
    each = edges.groupBy(*on).agg(
        F.min(F.least("lx", "hx")).alias("_x0"), F.min("ly").alias("_y0"), F.max(F.greatest("lx", "hx")).alias("_x1"), F.max("hy").alias("_y1"),
        F.avg(F.greatest(F.abs(F.col("hx") - F.col("lx")), F.col("hy") - F.col("ly"))).alias("_w"), F.avg(F.col("hy") - F.col("ly")).alias("_h"), F.count(F.lit(1)).alias("_n"))
    return edges.join(each, list(on))


def passed_cells() -> Column:
    """Cells ``struct<cx,cy>`` of the key's grid that an edge passes, column by column."""
    size = F.greatest(2 * F.col("_w"), F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")) / MAX_CELLS, F.lit(GRID))
    cell = lambda v, zero: F.floor((v - F.col(zero)) / size)
    left, right = F.least("lx", "hx"), F.greatest("lx", "hx")

    def rows(cx: Column) -> Column:
        # the edge's part within the column, a little widened; a steep edge's whole height where it has no width
        a, b = F.greatest(left, F.col("_x0") + cx * size), F.least(right, F.col("_x0") + (cx + 1) * size)
        at = lambda x: F.col("ly") + (F.col("hy") - F.col("ly")) * (x - F.col("lx")) / (F.col("hx") - F.col("lx"))
        level = F.col("hx") == F.col("lx")
        lo = F.when(level, F.col("ly")).otherwise(F.greatest(F.col("ly"), F.least(at(a), at(b)) - 2 * GRID))
        hi = F.when(level, F.col("hy")).otherwise(F.least(F.col("hy"), F.greatest(at(a), at(b)) + 2 * GRID))
        return F.transform(F.sequence(cell(lo, "_y0"), F.greatest(cell(lo, "_y0"), cell(hi, "_y0"))), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    x, y = cell(left, "_x0"), cell(F.col("ly"), "_y0")
    single = F.array(F.struct(x.alias("cx"), y.alias("cy")))
    return F.when((x == cell(right, "_x0")) & (y == cell(F.col("hy"), "_y0")), single).otherwise(F.flatten(F.transform(F.sequence(x, cell(right, "_x0")), rows)))


def cross(ax, ay, bx, by, px, py) -> Column:
    """Twice the area of a, b, p: positive where p lies left of the way from a to b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def meetings(edges: DataFrame, on: Sequence[str], carried: Sequence[str] = ("d0", "d1")) -> DataFrame:
    """Pairs of edges ``e_*``, ``f_*`` of a key that pass a common cell and whose boxes meet, in both orders; an edge meets itself.

    A pair that shares several cells is there as often; ``carried`` columns go along.
    What is dealt is written first, as the join reads it twice.
    """
    dealt = durable(measured(edges, on).select(*on, *ENDS, *carried, F.inline(passed_cells())))
    e = dealt.select(*on, "cx", "cy", *[F.col(c).alias(f"e_{c}") for c in [*ENDS, *carried]])
    f = dealt.select(*on, "cx", "cy", *[F.col(c).alias(f"f_{c}") for c in [*ENDS, *carried]])
    c = F.col
    boxes = (
        (F.greatest(F.least(c("e_lx"), c("e_hx")), F.least(c("f_lx"), c("f_hx"))) <= F.least(F.greatest(c("e_lx"), c("e_hx")), F.greatest(c("f_lx"), c("f_hx"))) + GRID)
        & (F.greatest(c("e_ly"), c("f_ly")) <= F.least(c("e_hy"), c("f_hy")) + GRID))
    return e.join(f, [*on, "cx", "cy"]).where(boxes)


def same_edge() -> Column:
    c = F.col
    return (c("e_lx") == c("f_lx")) & (c("e_ly") == c("f_ly")) & (c("e_hx") == c("f_hx")) & (c("e_hy") == c("f_hy"))


def sides() -> tuple[Column, ...]:
    """How far, as a distance, the ends of f lie from the line of e, and those of e from the line of f."""
    e, f = ([F.col(f"{s}_{c}") for c in ENDS] for s in "ef")
    length = lambda s: F.hypot(s[2] - s[0], s[3] - s[1])
    return (cross(*e, *f[:2]) / length(e), cross(*e, *f[2:]) / length(e), cross(*f, *e[:2]) / length(f), cross(*f, *e[2:]) / length(f))


def crossing() -> tuple[Column, Column]:
    """Whether e and f cross inside both, and ``struct<x,y>`` of where, the same in both orders."""
    lo, hi, own_lo, own_hi = sides()
    off = lambda d: F.abs(d) > GRID
    proper = off(lo) & off(hi) & off(own_lo) & off(own_hi) & (F.signum(lo) != F.signum(hi)) & (F.signum(own_lo) != F.signum(own_hi))
    e, f = (F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ENDS]) for s in "ef")
    a, b = F.least(e, f), F.greatest(e, f)
    dax, day, dbx, dby = a["hx"] - a["lx"], a["hy"] - a["ly"], b["hx"] - b["lx"], b["hy"] - b["ly"]
    t = ((b["lx"] - a["lx"]) * dby - (b["ly"] - a["ly"]) * dbx) / (dax * dby - day * dbx)
    return proper, F.struct(snap(a["lx"] + t * dax).alias("x"), snap(a["ly"] + t * day).alias("y"))


def along(x: Column, y: Column) -> Column:
    """Place of a point along e, 0 at its lower end and 1 at its higher."""
    dx, dy = F.col("e_hx") - F.col("e_lx"), F.col("e_hy") - F.col("e_ly")
    return ((x - F.col("e_lx")) * dx + (y - F.col("e_ly")) * dy) / (dx * dx + dy * dy)


def arrange(edges: DataFrame, on: Sequence[str]) -> DataFrame:
    """Canonical edges split wherever they meet, so that two of a key share ends at most."""
    met = meetings(edges, on)
    lo, hi, _, _ = sides()
    proper, where = crossing()
    # an end of f on e; the ends of e itself are no cuts
    touch = lambda d, x, y: (F.abs(d) <= GRID) & (along(F.col(x), F.col(y)) > 0) & (along(F.col(x), F.col(y)) < 1)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    itself = same_edge()
    keys = [f"e_{c}" for c in [*ENDS, "d0", "d1"]]
    cuts = {
        "_p1": F.when(proper, where), "_p2": F.when(touch(lo, "f_lx", "f_ly"), point("f_lx", "f_ly")), "_p3": F.when(touch(hi, "f_hx", "f_hy"), point("f_hx", "f_hy"))}
    cut = met.select(*on, *keys, itself.alias("_self"), *[F.when(~itself, c).alias(n) for n, c in cuts.items()]).where(
        "_self or _p1 is not null or _p2 is not null or _p3 is not null")
    sets = cut.groupBy(*on, *keys).agg(*[F.collect_set(n).alias(n) for n in cuts])
    split = sets.select(*on, *keys, F.array_union(F.array_union("_p1", "_p2"), "_p3").alias("_cuts"))
    ends = F.array(point("e_lx", "e_ly"), point("e_hx", "e_hy"))
    placed = F.array_sort(F.transform(F.array_union(F.col("_cuts"), ends), lambda p: F.struct(along(p["x"], p["y"]).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    parts = split.select(*on, "e_d0", "e_d1", placed.alias("_p")).select(
        *on, "e_d0", "e_d1", F.explode(F.zip_with(F.slice("_p", F.lit(1), F.size("_p") - 1), F.slice("_p", F.lit(2), F.size("_p") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("_e"))
    e = F.col("_e")
    again = parts.select(*on, *[e[p][c].alias(f"{c}{i}") for p, i in (("p", 1), ("q", 2)) for c in "xy"], F.array("e_d0", "e_d1").alias("_d")).select(
        "*", F.posexplode("_d").alias("side", "n")).where("n <> 0").drop("_d")
    return canonical(again, on)


def covered(parts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Parts with the windings ``r0``, ``r1`` of either side to their right and ``l0``, ``l1`` to their left.

    A ray to the right, bent down by less than any distance, starts at a part's middle;
    the passes of the parts that it meets add up to the winding where it starts.  Parts
    meet in bands of y about twice as high as the key's parts are on average.  The parts are
    written first, as the join reads them twice.
    """
    height = F.greatest(2 * F.col("_h"), (F.col("_y1") - F.col("_y0")) / F.col("_n"), F.lit(GRID))
    band = lambda y: F.floor((y - F.col("_y0")) / height)
    known = measured(durable(parts), on)
    mid = (F.col("ly") + F.col("hy")) / 2
    e = known.select(*on, band(mid).alias("_band"), *[F.col(c).alias(f"e_{c}") for c in [*ENDS, "d0", "d1"]])
    f = known.withColumn("_band", F.explode(F.sequence(band(F.col("ly")), band(F.col("hy"))))).select(*on, "_band", *[F.col(c).alias(f"f_{c}") for c in [*ENDS, "d0", "d1"]])
    mx, my = (F.col("e_lx") + F.col("e_hx")) / 2, (F.col("e_ly") + F.col("e_hy")) / 2
    below = (F.col("f_ly") < my) | ((F.col("f_ly") == my) & (F.col("f_lx") < mx))
    above = (F.col("f_hy") > my) | ((F.col("f_hy") == my) & (F.col("f_hx") > mx))
    hit = below & above & (cross(*[F.col(f"f_{c}") for c in ENDS], mx, my) > 0)
    itself = same_edge()
    met = e.join(f, [*on, "_band"]).where(itself | hit)
    passes = lambda s: F.sum(F.when(itself, 0).otherwise(F.col(f"f_d{s}")))
    out = met.groupBy(*on, *[f"e_{c}" for c in [*ENDS, "d0", "d1"]]).agg(passes(0).alias("r0"), passes(1).alias("r1"))
    return out.select(
        *on, *[F.col(f"e_{c}").alias(c) for c in [*ENDS, "d0", "d1"]], "r0", "r1", (F.col("r0") + F.col("e_d0")).alias("l0"), (F.col("r1") + F.col("e_d1")).alias("l1"))


def edge_areas(edges: DataFrame, on: Sequence[str], out: str = "area") -> DataFrame:
    """Area of the region on the left of each key's directed edges."""
    return edges.groupBy(*on).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias(out))


def border(known: DataFrame, on: Sequence[str], inside) -> DataFrame:
    """Directed edges ``(x1, y1, x2, y2)`` of the region where ``inside(winding 0, winding 1)`` holds, the region on their left."""
    left, right = inside(F.col("l0"), F.col("l1")), inside(F.col("r0"), F.col("r1"))
    pick = lambda a, b: F.when(left, F.col(a)).otherwise(F.col(b))
    return known.where(left != right).select(*on, pick("lx", "hx").alias("x1"), pick("ly", "hy").alias("y1"), pick("hx", "lx").alias("x2"), pick("hy", "ly").alias("y2"))


def windings(df: DataFrame, on: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Arrangement of the edges of two polygons a row, ``a`` as side 0 and ``b`` as side 1; each an array of rings.  ``on`` tells rows apart."""
    both = directed(df, on, a, 0).unionByName(directed(df, on, b, 1))
    return covered(arrange(canonical(both, on), on), on)


def overlay_areas(df: DataFrame, on: Sequence[str], a: Column, b: Column, within_tasks: bool = False) -> DataFrame:
    """Areas ``area_a``, ``area_b``, ``union``, ``intersection``, ``difference``, ``symmetric_difference``, with ``iou`` and ``iooa`` (of b), for each row of ``df``.

    Polygons may be concave, have holes, touch, nest or cross themselves (even-odd).  A
    null or empty polygon covers nothing; ratios of areas 0 are null.  ``on`` must be
    unique and not null, unless polygons are overlaid ``within_tasks``.
    """
    names = {"area_a": lambda p, q: p, "area_b": lambda p, q: q, **RULES}
    ratios = {"iou": F.try_divide("intersection", "union"), "iooa": F.try_divide("intersection", "area_b")}
    if within_tasks:
        def made(rows: int, **shapes: pa.Array) -> dict[str, pa.Array]:
            known = A.windings(shapes["_a"], shapes["_b"], rows)
            l0, l1, r0, r1 = (v % 2 == 1 for v in (known.l0, known.l1, known.r0, known.r1))
            part = known.lx * known.hy - known.hx * known.ly
            sums = lambda rule: np.bincount(known.row, weights=part * (rule(l0, l1).astype(int) - rule(r0, r1)), minlength=rows) / 2
            return {n: pa.array(sums(rule)) for n, rule in names.items()}

        return A.by_row(df, on, {"_a": a, "_b": b}, made, ", ".join(f"`{n}` double" for n in names)).withColumns(ratios)
    known = windings(df, on, a, b)
    part = F.col("lx") * F.col("hy") - F.col("hx") * F.col("ly")

    def area(rule) -> Column:
        left, right = (rule(odd(F.col(f"{s}0")), odd(F.col(f"{s}1"))) for s in "lr")
        return F.sum(F.when(left & ~right, part).when(right & ~left, -part).otherwise(0.0)) / 2

    sums = known.groupBy(*on).agg(*[area(rule).alias(n) for n, rule in names.items()])
    out = df.select(*on).join(sums, list(on), "left").select(*on, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    return out.withColumns(ratios)


def overlay(df: DataFrame, on: Sequence[str], a: Column, b: Column, how: str, within_tasks: bool = False) -> DataFrame:
    """``polygons``, an array of polygons that do not overlap, of the union, intersection, difference or symmetric difference of each row.

    Exteriors turn counter-clockwise, holes clockwise; each hole is in the least exterior
    around it.  Nothing left is an empty array.  See :func:`overlay_areas` on odd input.
    """
    rule = RULES[how]
    if within_tasks:
        def made(rows: int, **shapes: pa.Array) -> dict[str, pa.Array]:
            known = A.windings(shapes["_a"], shapes["_b"], rows)
            l0, l1, r0, r1 = (v % 2 == 1 for v in (known.l0, known.l1, known.r0, known.r1))
            return {"polygons": A.traced(A.border(known, rule(l0, l1), rule(r0, r1)), rows)}

        return A.by_row(df, on, {"_a": a, "_b": b}, made, f"polygons {R.POLYGONS}")
    edges = border(windings(df, on, a, b), on, lambda p, q: rule(odd(p), odd(q)))
    return R.with_polygons(df.select(*on), edges, on)
