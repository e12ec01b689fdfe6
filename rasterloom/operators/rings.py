"""Rings and polygons from directed edges that have a region on their left."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]

POLYGONS = "array<array<array<struct<x:double,y:double>>>>"
_TYPE = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def following(ways: Sequence[Sequence[Point]]) -> list[int | None]:
    """For each way (an edge, or a chain of edges) the one that goes on around the same part of the region: the first way out clockwise from the way back."""
    out = defaultdict(list)
    for i, w in enumerate(ways):
        out[w[0]].append((math.atan2(w[1][1] - w[0][1], w[1][0] - w[0][0]), i))
    found: list[int | None] = []
    for w in ways:
        on = out.get(w[-1], ())
        if len(on) < 2:
            found.append(on[0][1] if on else None)
            continue
        back = math.atan2(w[-2][1] - w[-1][1], w[-2][0] - w[-1][0])
        found.append(min(on, key=lambda o: ((back - o[0]) % (2 * math.pi) or 2 * math.pi, o[1]))[1])
    return found


def walks(ways: Sequence[Sequence[Point]]) -> tuple[list[list[int]], list[list[int]]]:
    """Numbers of the ways of each closed walk, and of each open one."""
    nxt = following(ways)
    led = {x for x in nxt if x is not None}
    closed, open_, seen = [], [], set()
    for start in [*(i for i in range(len(ways)) if i not in led), *range(len(ways))]:
        if start in seen:
            continue
        walk, i = [], start
        while i is not None and i not in seen:
            seen.add(i)
            walk.append(i)
            i = nxt[i]
        (closed if i == start else open_).append(walk)
    return closed, open_


def simple(points: list[Point]) -> list[list[Point]]:
    """Rings without a point twice that a closed walk is made of."""
    done, walk, at = [], [], {}
    for p in points:
        if p in at:
            lo = at[p]
            loop = walk[lo:]
            for q in loop:
                del at[q]
            del walk[lo:]
            done.append(loop)
        at[p] = len(walk)
        walk.append(p)
    done.append(walk)
    return [straight(r) for r in done if len(r) > 2]


def straight(ring: list[Point]) -> list[Point]:
    """The ring without points inside straight lines, from its lowest point."""
    xy = np.array(ring)
    before, after = np.roll(xy, 1, axis=0), np.roll(xy, -1, axis=0)
    bend = (xy[:, 0] - before[:, 0]) * (after[:, 1] - xy[:, 1]) - (xy[:, 1] - before[:, 1]) * (after[:, 0] - xy[:, 0])
    kept = [p for p, b in zip(ring, bend.tolist(), strict=True) if b] or ring
    first = min(range(len(kept)), key=lambda i: (kept[i][1], kept[i][0]))
    return kept[first:] + kept[:first]


def area(ring: list[Point]) -> float:
    xy = np.array(ring)
    nxt = np.roll(xy, -1, axis=0)
    return float((xy[:, 0] * nxt[:, 1] - nxt[:, 0] * xy[:, 1]).sum()) / 2


def holds(ring: list[Point], p: Point) -> bool:
    """Whether a point lies inside a ring; false on its border is not promised."""
    xy = np.array(ring)
    nxt = np.roll(xy, -1, axis=0)
    spans = (xy[:, 1] > p[1]) != (nxt[:, 1] > p[1])
    a, b = xy[spans], nxt[spans]
    return bool(((a[:, 0] + (p[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])) > p[0]).sum() % 2)


def inside(hole: list[Point], ring: list[Point]) -> bool:
    """Whether a ring that does not cross another lies in it: by the middle of an edge that both do not share."""
    border = {frozenset(e) for e in zip(ring, [*ring[1:], ring[0]], strict=True)}
    for p, q in zip(hole, [*hole[1:], hole[0]], strict=True):
        if frozenset((p, q)) not in border:
            return holds(ring, ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2))
    return False


def polygons(rings: Sequence[list[Point]], least: float = 0.0) -> list[list[list[Point]]]:
    """Polygons of counter-clockwise exteriors and the clockwise holes that lie in them; rings of at most ``least`` area are left out."""
    sized = [(area(r), r) for r in rings]
    shells = sorted(((a, r) for a, r in sized if a > least), key=lambda s: (s[0], s[1]))
    boxes = [(min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)) for _, r in shells]
    out = [[r] for _, r in shells]
    for a, hole in sorted((s for s in sized if s[0] < -least), key=lambda s: s[1]):
        x, y = hole[0]
        for k, (size, shell) in enumerate(shells):
            lo_x, lo_y, hi_x, hi_y = boxes[k]
            if size >= -a and lo_x <= x <= hi_x and lo_y <= y <= hi_y and inside(hole, shell):
                out[k].append(hole)
                break
    return sorted(out)


def from_edges(edges: Sequence[tuple[Point, Point]], least: float = 0.0) -> list[list[list[Point]]]:
    edges = sorted(edges)
    closed, _ = walks(edges)
    return polygons([r for walk in closed for r in simple([edges[i][0] for i in walk])], least)


def edge_list(table: pa.Table) -> list[tuple[Point, Point]]:
    x1, y1, x2, y2 = (table[c].to_pylist() for c in ("x1", "y1", "x2", "y2"))
    return sorted(zip(zip(x1, y1, strict=True), zip(x2, y2, strict=True), strict=True))


def as_value(found: Sequence[Sequence[Sequence[Point]]]) -> pa.Array:
    return pa.array([[[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in found]], _TYPE)


def with_polygons(rows: DataFrame, edges: DataFrame, on: Sequence[str], out: str = "polygons") -> DataFrame:
    """``rows`` with the polygons that their directed edges ``(x1, y1, x2, y2)`` bound; a task holds the edges of one result."""
    kinds = dict(edges.dtypes)

    def trace(table: pa.Table) -> pa.Table:
        return pa.table({**{k: table[k][:1] for k in on}, out: as_value(from_edges(edge_list(table)))})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in on) + f", {out} {POLYGONS}"
    traced = edges.groupBy(*on).applyInArrow(trace, schema)
    return rows.join(traced, list(on), "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(POLYGONS)))
