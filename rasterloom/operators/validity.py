"""Whether polygons are valid, why not, and repair."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygon as G
from . import arrangement as A
from . import rings as R
from .durable import durable
from .overlay import ENDS, GRID, along, border, crossing, meetings, odd, sides, snap, windings

#: What can be wrong, the first found in this order counts.
REASONS = [
    "Invalid Coordinate", "Too few points in geometry component", "Self-intersection", "Ring Self-intersection", "Hole lies outside shell",
    "Holes are nested", "Interior is disconnected",
]


def _ring_edges(df: DataFrame, on: Sequence[str], poly: Column) -> DataFrame:
    """Edges with length, from the lower end to the higher, with their ``ring``, place ``pos`` in it and the number ``n`` of its edges."""
    put = lambda p: F.struct(snap(p["x"]).alias("x"), snap(p["y"]).alias("y"))
    rows = df.select(*on, F.posexplode(poly).alias("ring", "_r")).select(*on, "ring", G.edges(F.transform("_r", put)).alias("_e"))
    kept = F.filter("_e", lambda e: (e["p"]["x"] != e["q"]["x"]) | (e["p"]["y"] != e["q"]["y"]))
    rows = rows.select(*on, "ring", F.posexplode(kept).alias("pos", "_e"), F.size(kept).alias("n"))
    p, q = F.col("_e")["p"], F.col("_e")["q"]
    up = (p["y"] < q["y"]) | ((p["y"] == q["y"]) & (p["x"] < q["x"]))
    pick = lambda a, b: F.when(up, a).otherwise(b)
    return rows.select(
        *on, "ring", "pos", "n", pick(p["x"], q["x"]).alias("lx"), pick(p["y"], q["y"]).alias("ly"), pick(q["x"], p["x"]).alias("hx"), pick(q["y"], p["y"]).alias("hy"))


def _finding(rows: DataFrame, on: Sequence[str], reason: str, x: Column, y: Column) -> DataFrame:
    return rows.select(*on, F.struct(F.lit(REASONS.index(reason)).alias("k"), x.cast("double").alias("x"), y.cast("double").alias("y")).alias("_f"))


def _meetings(df: DataFrame, on: Sequence[str], poly: Column) -> DataFrame:
    """Where edges cross, lie on each other, or a ring meets itself."""
    edges = _ring_edges(df, on, poly)
    c = F.col
    pairs = meetings(edges, on, ["ring", "pos", "n"]).where((c("e_ring") < c("f_ring")) | ((c("e_ring") == c("f_ring")) & (c("e_pos") < c("f_pos"))))
    lo, hi, own_lo, own_hi = sides()
    proper, where = crossing()
    near = lambda d: F.abs(d) <= GRID
    t_lo, t_hi = along(c("f_lx"), c("f_ly")), along(c("f_hx"), c("f_hy"))
    first = F.greatest(F.least(t_lo, t_hi), F.lit(0.0))
    overlap = near(lo) & near(hi) & (first < F.least(F.greatest(t_lo, t_hi), F.lit(1.0)))
    held = lambda d, t: near(d) & (t >= 0) & (t <= 1)
    # places of e's ends along f
    dx, dy = c("f_hx") - c("f_lx"), c("f_hy") - c("f_ly")
    on_f = lambda x, y: ((c(x) - c("f_lx")) * dx + (c(y) - c("f_ly")) * dy) / (dx * dx + dy * dy)
    point = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    meets = F.coalesce(
        F.when(held(lo, t_lo), point("f_lx", "f_ly")), F.when(held(hi, t_hi), point("f_hx", "f_hy")),
        F.when(held(own_lo, on_f("e_lx", "e_ly")), point("e_lx", "e_ly")), F.when(held(own_hi, on_f("e_hx", "e_hy")), point("e_hx", "e_hy")))
    apart = c("f_pos") - c("e_pos")
    itself = (c("e_ring") == c("f_ring")) & (apart > 1) & (apart < c("e_n") - 1)
    start = F.struct((c("e_lx") + first * (c("e_hx") - c("e_lx"))).alias("x"), (c("e_ly") + first * (c("e_hy") - c("e_ly"))).alias("y"))
    found = pairs.select(*on, F.when(proper, where).when(overlap, start).alias("_cross"), F.when(itself, meets).alias("_touch"))
    crossed = _finding(found.where("_cross is not null"), on, "Self-intersection", F.col("_cross.x"), F.col("_cross.y"))
    return crossed.unionByName(_finding(found.where("_cross is null and _touch is not null"), on, "Ring Self-intersection", F.col("_touch.x"), F.col("_touch.y")))


def _holes(df: DataFrame, on: Sequence[str], poly: Column) -> DataFrame:
    """Holes that lie outside the shell or in another hole, by what lies beside each part of their borders; and shells cut in two."""
    known = windings(df, on, F.slice(G.oriented(poly), 1, 1), F.slice(G.oriented(poly), 2, F.greatest(F.size(poly) - 1, F.lit(0))))
    known = durable(known)
    x, y = (F.col("lx") + F.col("hx")) / 2, (F.col("ly") + F.col("hy")) / 2
    outside = F.col("d1").cast("boolean") & (((F.col("l1") != 0) & ~odd(F.col("l0"))) | ((F.col("r1") != 0) & ~odd(F.col("r0"))))
    nested = (F.abs(F.col("l1")) > 1) | (F.abs(F.col("r1")) > 1)
    found = _finding(known.where(outside), on, "Hole lies outside shell", x, y).unionByName(_finding(known.where(nested), on, "Holes are nested", x, y))
    kinds = dict(df.dtypes)

    def parts(table: pa.Table) -> pa.Table:
        edges = R.edge_list(table)
        closed, _ = R.walks(edges)
        shells = [w for w in ([edges[i][0] for i in walk] for walk in closed) if R.area(w) > 0]
        x, y = min(shells[-1]) if shells else (0.0, 0.0)
        return pa.table({**{k: table[k][:1] for k in on}, "_n": pa.array([len(shells)], pa.int32()), "_x": pa.array([x], pa.float64()), "_y": pa.array([y], pa.float64())})

    inner = border(known, on, lambda a, b: odd(a) & (b == 0))
    counted = inner.groupBy(*on).applyInArrow(parts, ", ".join(f"`{k}` {kinds[k]}" for k in on) + ", _n int, _x double, _y double")
    return found.unionByName(_finding(counted.where("_n > 1"), on, "Interior is disconnected", F.col("_x"), F.col("_y")))


def _few(p: A.Rings, rows: int) -> np.ndarray:
    """For each row the first point of its first ring of fewer than three points that differ, else -1."""
    out = np.full(rows, -1)
    if not len(p.row):
        return out
    new = np.ones(len(p.row), dtype=bool)
    new[1:] = (p.row[1:] != p.row[:-1]) | (p.ring[1:] != p.ring[:-1])
    first, of, none = np.flatnonzero(new), np.cumsum(new) - 1, len(p.row)
    differs = lambda at: (p.x != p.x[at][of]) | (p.y != p.y[at][of])
    once = differs(first)
    second = np.minimum.reduceat(np.where(once, np.arange(none), none), first)
    third = once & differs(np.where(second < none, second, first))
    few = first[~np.logical_or.reduceat(third, first)][::-1]
    out[p.row[few]] = few
    return out


def _least(row: np.ndarray, k: int, x: np.ndarray, y: np.ndarray, found: list[np.ndarray]) -> None:
    """Puts a finding of kind ``k``, the least by place, where a row has none yet."""
    order = np.lexsort((y, x, row))
    first = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
    first = first[found[0][row[first]] < 0]
    for held, v in zip(found, (k, x[first], y[first]), strict=True):
        held[row[first]] = v


def _faults(polygons: pa.Array, rows: int) -> list[np.ndarray]:
    """Kind (-1 for none) and place of each row's first fault."""
    found = [np.full(rows, -1), np.full(rows, np.nan), np.full(rows, np.nan)]
    p = A.points_of(polygons)
    sound = np.ones(rows, dtype=bool)
    sound[p.row[~(np.isfinite(p.x) & np.isfinite(p.y))]] = False
    of, _ = A.spread(polygons.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    holed = np.zeros(rows, dtype=bool)
    # a row with a null ring has no finding
    holed[of[polygons.flatten().is_null().to_numpy(zero_copy_only=False)]] = True
    found[0][~sound & ~holed] = 0
    sound &= ~holed
    few = _few(p, rows)
    at = np.flatnonzero(sound & (few >= 0))
    found[0][at], found[1][at], found[2][at] = 1, p.x[few[at]], p.y[few[at]]

    # edges in the order of their rings
    x, y = A.snap(p.x), A.snap(p.y)
    kept = np.flatnonzero(sound[p.row] & ((x != x[p.after]) | (y != y[p.after])))
    row, ring, x1, y1, x2, y2 = p.row[kept], p.ring[kept], x[kept], y[kept], x[p.after[kept]], y[p.after[kept]]
    up = (y1 < y2) | ((y1 == y2) & (x1 < x2))
    ends = [np.where(up, x1, x2), np.where(up, y1, y2), np.where(up, x2, x1), np.where(up, y2, y1)]
    new = np.ones(len(kept), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (ring[1:] != ring[:-1])
    sizes = np.diff(np.append(np.flatnonzero(new), len(kept)))
    which, pos = A.spread(sizes)
    i, j = A.meetings(row, rows, *ends)
    e, f = [v[i] for v in ends], [v[j] for v in ends]
    m = A.met(e, f)
    near = lambda d: np.abs(d) <= GRID
    first = np.maximum(np.minimum(m.t_lo, m.t_hi), 0.0)
    overlap = ~m.proper & near(m.lo) & near(m.hi) & (first < np.minimum(np.maximum(m.t_lo, m.t_hi), 1.0))
    crossed = m.proper | overlap
    _least(
        row[i][crossed], 2, np.where(m.proper, m.x, e[0] + first * (e[2] - e[0]))[crossed], np.where(m.proper, m.y, e[1] + first * (e[3] - e[1]))[crossed], found)
    held = lambda d, t: near(d) & (t >= 0) & (t <= 1)
    on = [held(m.lo, m.t_lo), held(m.hi, m.t_hi), held(m.own_lo, m.own_t_lo), held(m.own_hi, m.own_t_hi)]
    apart = pos[j] - pos[i]
    touch = ~crossed & (which[i] == which[j]) & (apart > 1) & (apart < sizes[which[i]] - 1) & np.logical_or.reduce(on)
    _least(row[i][touch], 3, np.select(on, [f[0], f[2], e[0], e[2]])[touch], np.select(on, [f[1], f[3], e[1], e[3]])[touch], found)

    # what lies beside the parts of shells and holes
    o = A.oriented(polygons)
    open_ = (sound & (found[0] < 0))[o.row]
    shell, holes = (tuple(A.snapped(*(v[open_ & side] for v in (o.row, o.x1, o.y1, o.x2, o.y2)))) for side in (o.ring == 0, o.ring > 0))
    known = A.windings(shell, holes, rows)
    odd0, odd1 = known.l0 % 2 == 1, known.r0 % 2 == 1
    x, y = (known.lx + known.hx) / 2, (known.ly + known.hy) / 2
    outside = (known.d1 != 0) & (((known.l1 != 0) & ~odd0) | ((known.r1 != 0) & ~odd1))
    nested = (np.abs(known.l1) > 1) | (np.abs(known.r1) > 1)
    for k, at in ((4, outside), (5, nested)):
        _least(known.row[at], k, x[at], y[at], found)
    inner = A.border(known, odd0 & (known.l1 == 0), odd1 & (known.r1 == 0))
    inner = tuple(v[found[0][inner[0]] < 0] for v in inner)
    for r in A.several(inner, rows).tolist():
        edges = sorted(((a, b), (c, d)) for a, b, c, d in zip(*(v[inner[0] == r].tolist() for v in inner[1:]), strict=True))
        walks, _ = R.walks(edges)
        shells = [w for w in ([edges[i][0] for i in walk] for walk in walks) if R.area(w) > 0]
        if len(shells) > 1:
            found[0][r], (found[1][r], found[2][r]) = 6, min(shells[-1])
    return found


def explain_validity(df: DataFrame, on: Sequence[str], poly: Column, within_tasks: bool = False) -> DataFrame:
    """``is_invalid``, ``reason``, a place ``x``, ``y`` and ``explanation`` (``reason[x y]``) for each row; the last four null where a polygon is valid.

    Of several faults the first of :data:`REASONS` counts, and of its places the least.
    Rings may touch each other in points, but not themselves; a point given twice in a row
    is no fault.  Null and empty polygons are valid.  ``on`` must be unique and not null,
    unless polygons are looked at ``within_tasks``.
    """
    number = lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    reason = F.when(F.col("_f").isNotNull(), F.element_at(F.array(*map(F.lit, REASONS)), F.col("_f.k") + 1))
    x, y = F.col("_f.x"), F.col("_f.y")
    told = [
        *on, F.col("_f").isNotNull().alias("is_invalid"), reason.alias("reason"), x.alias("x"), y.alias("y"),
        F.when(x.isNull(), reason).otherwise(F.concat(reason, F.lit("["), number(x), F.lit(" "), number(y), F.lit("]"))).alias("explanation")]
    if within_tasks:
        def made(rows: int, _p: pa.Array) -> dict[str, pa.Array]:
            k, *place = _faults(_p, rows)
            kind = pa.array(np.maximum(k, 0), pa.int32())
            return {"_f": pa.StructArray.from_arrays([kind, *[pa.array(v, mask=~np.isfinite(v)) for v in place]], names=["k", "x", "y"], mask=pa.array(k < 0))}

        return A.by_row(df, on, {"_p": poly}, made, "_f struct<k:int,x:double,y:double>").select(*told)
    rows = df.select(*on, poly.alias("_p"))
    points = F.flatten("_p")
    odd_place = F.filter(points, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
    bad = rows.where(F.size(odd_place) > 0)
    sound = rows.where(F.coalesce(F.size(odd_place) == 0, F.lit(False)))
    few = sound.withColumn("_few", F.filter("_p", lambda r: (F.size(F.array_distinct(r)) < 3) & (F.size(r) > 0))).where(F.size("_few") > 0)
    nowhere = F.lit(None)
    found = _finding(bad, on, "Invalid Coordinate", nowhere, nowhere).unionByName(
        _finding(few, on, "Too few points in geometry component", F.col("_few")[0][0]["x"], F.col("_few")[0][0]["y"]))
    found = found.unionByName(_meetings(sound, on, F.col("_p"))).unionByName(_holes(sound.where(F.size("_p") > 0), on, F.col("_p")))
    first = found.groupBy(*on).agg(F.min("_f").alias("_f"))
    return df.select(*on).join(first, list(on), "left").select(*told)


def fix(df: DataFrame, on: Sequence[str], poly: Column, within_tasks: bool = False) -> DataFrame:
    """``polygons``: valid polygons that cover what ``poly`` covers read even-odd; edges that bound nothing are gone.

    Valid polygons come back as they are, but for points inside straight lines and the
    point that a ring starts with.  Null, empty and degenerate polygons give an empty array.
    ``on`` must be unique, unless polygons are repaired ``within_tasks``.
    """
    if within_tasks:
        def made(rows: int, _p: pa.Array) -> dict[str, pa.Array]:
            known = A.windings(_p, None, rows)
            return {"polygons": A.traced(A.border(known, known.l0 % 2 == 1, known.r0 % 2 == 1), rows)}

        return A.by_row(df, on, {"_p": poly}, made, f"polygons {R.POLYGONS}")
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return R.with_polygons(df.select(*on), border(windings(df, on, poly, none), on, lambda a, _: odd(a)), on)
