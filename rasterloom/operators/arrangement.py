"""The arrangement of :mod:`.overlay` of each row by itself, as NumPy over the rows of an Arrow batch.

A row's polygons are a value that its task holds anyway, so where rows are small no edge
has to leave the task.  Pairs of edges are tried in blocks of :data:`BLOCK`, so memory
stays within a row's edges and meetings however large a row is; time grows with the
square of a row's edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from . import rings as R

#: Step of the coordinate grid, a power of two, exact for coordinates below 2**22.
GRID = 2.0 ** -30

#: Pairs that are tried at once, and points of the rows that are arranged at once.
BLOCK, POINTS = 1 << 18, 40_000


class Known(NamedTuple):
    """Parts of all rows, with passes and windings as in :func:`.overlay.covered`; sorted by ``row``."""

    row: np.ndarray
    lx: np.ndarray
    ly: np.ndarray
    hx: np.ndarray
    hy: np.ndarray
    d0: np.ndarray
    d1: np.ndarray
    r0: np.ndarray
    r1: np.ndarray

    @property
    def l0(self) -> np.ndarray:
        return self.r0 + self.d0

    @property
    def l1(self) -> np.ndarray:
        return self.r1 + self.d1


def snap(v: np.ndarray) -> np.ndarray:
    return np.rint(v / GRID) * GRID + 0.0


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``counts`` entries that follow each other, each entry's group and place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - (np.cumsum(counts) - counts)[group]


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


class Rings(NamedTuple):
    """Points of rings one after another: ``row`` and ``ring`` (its number in the row) of each, and ``after``, the next of its ring."""

    row: np.ndarray
    ring: np.ndarray
    x: np.ndarray
    y: np.ndarray
    after: np.ndarray


def points_of(polygons: pa.Array) -> Rings:
    """Points of an array of polygons (lists of rings, which are lists of ``struct<x,y>``), missing coordinates NaN."""
    row, ring = spread(_lengths(polygons))
    rings = polygons.flatten()
    sizes = _lengths(rings)
    points = rings.flatten()
    x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in points.flatten())
    of, place = spread(sizes)
    first = np.arange(len(of)) - place
    after = np.where(place + 1 < sizes[of], np.arange(len(of)) + 1, first)
    return Rings(row[of], ring[of], x, y, after)


def directed(polygons: pa.Array) -> tuple[np.ndarray, ...]:
    """Directed edges ``(row, x1, y1, x2, y2)``."""
    p = points_of(polygons)
    x, y = snap(p.x), snap(p.y)
    return p.row, x, y, x[p.after], y[p.after]


def _mixed(*values: np.ndarray) -> np.ndarray:
    h = np.zeros(len(values[0]), dtype=np.uint64)
    for v in values:
        h = (h ^ v.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _by_row(row: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by row that brings equal values together, and where another value begins."""
    values = tuple(np.ascontiguousarray(v) for v in values)
    key = (row.astype(np.uint64) << np.uint64(40)) | (_mixed(*values) >> np.uint64(24))
    order = np.argsort(key, kind="stable")
    key = key[order]
    other = np.ones(len(order), dtype=bool)
    other[1:] = row[order][1:] != row[order][:-1]
    for v in values:
        w = v[order]
        other[1:] |= w[1:] != w[:-1]
    if (other[1:] & (key[1:] == key[:-1])).any():  # two values of one hash
        order = np.lexsort((*values, row))
        other = np.ones(len(order), dtype=bool)
        other[1:] = row[order][1:] != row[order][:-1]
        for v in values:
            w = v[order]
            other[1:] |= w[1:] != w[:-1]
    return order, other


def canonical(row, x1, y1, x2, y2, d0, d1) -> tuple[np.ndarray, ...]:
    """See :func:`.overlay.canonical`: ``(row, lx, ly, hx, hy, d0, d1)``, sorted by row."""
    with np.errstate(invalid="ignore"):
        ok = np.isfinite(x1 + x2 + y1 + y2) & ((x1 != x2) | (y1 != y2))
    row, x1, y1, x2, y2, d0, d1 = (v[ok] for v in (row, x1, y1, x2, y2, d0, d1))
    up = (y1 < y2) | ((y1 == y2) & (x1 < x2))
    lx, ly, hx, hy = np.where(up, x1, x2), np.where(up, y1, y2), np.where(up, x2, x1), np.where(up, y2, y1)
    order, other = _by_row(row, lx, ly, hx, hy)
    first = np.flatnonzero(other)
    if not len(first):
        return tuple(v[:0] for v in (row, lx, ly, hx, hy, d0, d1))
    sums = [np.add.reduceat(np.where(up, d, -d)[order], first) for d in (d0, d1)]
    at, live = order[first], (sums[0] != 0) | (sums[1] != 0)
    return (*(v[at][live] for v in (row, lx, ly, hx, hy)), *(s[live] for s in sums))


def _width(counts: np.ndarray) -> np.ndarray:
    """Counts rounded up to a few sizes."""
    step = np.maximum(1, 2 ** np.maximum(np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) - 3, 0))
    return -(-counts // step) * step


def pairs(row: np.ndarray, rows: int, test: Callable[[np.ndarray, np.ndarray], np.ndarray], once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``i``, ``j`` of equal ``row`` for which ``test`` holds, ``i`` before ``j`` if ``once``.

    ``test`` gets numbers of entries; the number after the last stands for none, for which it must be false.
    """
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    widths, none = _width(counts), len(row)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for w in np.unique(widths[counts > int(once)]).tolist():
        at = np.flatnonzero(widths == w)
        place = np.arange(w)
        tall = max(1, min(w, BLOCK // w))
        many = max(1, BLOCK // (w * w))
        for lo in range(0, len(at), many):
            some = at[lo:lo + many]
            held = np.where(place < counts[some, None], first[some, None] + place, none)
            for top in range(0, w, tall):
                i, j = held[:, top:top + tall, None], held[:, None, top if once else 0:]
                hit = test(i, j)
                if once:
                    hit &= i < j
                r, a, b = np.nonzero(hit)
                out.append((held[r, a + top], held[r, b + (top if once else 0)]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def padded(*values: np.ndarray) -> list[np.ndarray]:
    """With a NaN at the end, for no entry."""
    return [np.append(v, np.nan) for v in values]


def meetings(row, rows: int, lx, ly, hx, hy) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row's edges whose boxes meet, each once."""
    x0, x1, y0, y1 = padded(np.minimum(lx, hx), np.maximum(lx, hx) + GRID, ly, hy + GRID)
    return pairs(row, rows, lambda i, j: (x0[i] <= x1[j]) & (x0[j] <= x1[i]) & (y0[i] <= y1[j]) & (y0[j] <= y1[i]), True)


class Meeting(NamedTuple):
    """How edges ``e`` and ``f`` meet: distances of each one's ends from the other's line, places of the ends along the other, whether they cross and where."""

    lo: np.ndarray
    hi: np.ndarray
    own_lo: np.ndarray
    own_hi: np.ndarray
    t_lo: np.ndarray
    t_hi: np.ndarray
    own_t_lo: np.ndarray
    own_t_hi: np.ndarray
    proper: np.ndarray
    x: np.ndarray
    y: np.ndarray


def met(e: Sequence[np.ndarray], f: Sequence[np.ndarray]) -> Meeting:
    (ax, ay, bx, by), (cx, cy, dx, dy) = e, f
    ex, ey, fx, fy = bx - ax, by - ay, dx - cx, dy - cy
    le, lf = np.hypot(ex, ey), np.hypot(fx, fy)
    lo, hi = (ex * (cy - ay) - ey * (cx - ax)) / le, (ex * (dy - ay) - ey * (dx - ax)) / le
    own_lo, own_hi = (fx * (ay - cy) - fy * (ax - cx)) / lf, (fx * (by - cy) - fy * (bx - cx)) / lf
    se, sf = ex * ex + ey * ey, fx * fx + fy * fy
    proper = (np.abs(lo) > GRID) & (np.abs(hi) > GRID) & (np.abs(own_lo) > GRID) & (np.abs(own_hi) > GRID) & ((lo > 0) != (hi > 0)) & ((own_lo > 0) != (own_hi > 0))
    den = ex * fy - ey * fx
    t = ((cx - ax) * fy - (cy - ay) * fx) / np.where(proper, den, 1.0)
    return Meeting(
        lo, hi, own_lo, own_hi, ((cx - ax) * ex + (cy - ay) * ey) / se, ((dx - ax) * ex + (dy - ay) * ey) / se,
        ((ax - cx) * fx + (ay - cy) * fy) / sf, ((bx - cx) * fx + (by - cy) * fy) / sf, proper, snap(ax + t * ex), snap(ay + t * ey))


def arrange(row, rows: int, lx, ly, hx, hy, d0, d1) -> tuple[np.ndarray, ...]:
    """See :func:`.overlay.arrange`."""
    i, j = meetings(row, rows, lx, ly, hx, hy)
    ends = (lx, ly, hx, hy)
    m = met([v[i] for v in ends], [v[j] for v in ends])
    on = lambda d, t: (np.abs(d) <= GRID) & (t > 0) & (t < 1)
    cuts = []
    for edge, other, lo, hi, t_lo, t_hi in ((i, j, m.lo, m.hi, m.t_lo, m.t_hi), (j, i, m.own_lo, m.own_hi, m.own_t_lo, m.own_t_hi)):
        a, b = np.flatnonzero(on(lo, t_lo)), np.flatnonzero(on(hi, t_hi))
        p = np.flatnonzero(m.proper)
        cuts += [(edge[p], m.x[p], m.y[p]), (edge[a], lx[other[a]], ly[other[a]]), (edge[b], hx[other[b]], hy[other[b]])]
    edge, x, y = (np.concatenate(c) for c in zip(*cuts, strict=True))
    if not len(edge):
        return row, lx, ly, hx, hy, d0, d1
    has = np.zeros(len(row), dtype=bool)
    has[edge] = True
    cut = np.flatnonzero(has)
    edge, x, y = np.concatenate([edge, cut, cut]), np.concatenate([x, lx[cut], hx[cut]]), np.concatenate([y, ly[cut], hy[cut]])
    ex, ey = hx[edge] - lx[edge], hy[edge] - ly[edge]
    t = ((x - lx[edge]) * ex + (y - ly[edge]) * ey) / (ex * ex + ey * ey)
    order = np.lexsort((y, x, t, edge))
    edge, x, y = edge[order], x[order], y[order]
    k = np.flatnonzero(edge[1:] == edge[:-1])
    whole = np.flatnonzero(~has)
    of = np.concatenate([whole, edge[k]])
    return canonical(
        row[of], np.concatenate([lx[whole], x[k]]), np.concatenate([ly[whole], y[k]]), np.concatenate([hx[whole], x[k + 1]]), np.concatenate([hy[whole], y[k + 1]]), d0[of], d1[of])


def covered(row, rows: int, lx, ly, hx, hy, d0, d1) -> Known:
    """See :func:`.overlay.covered`."""
    mx, my = (lx + hx) / 2, (ly + hy) / 2
    px, py, right, low, high = padded(mx, my, np.maximum(lx, hx) + GRID, ly, hy)
    i, j = pairs(row, rows, lambda i, j: (low[j] <= py[i]) & (high[j] >= py[i]) & (right[j] >= px[i]), False)
    x, y, ax, ay, bx, by = mx[i], my[i], lx[j], ly[j], hx[j], hy[j]
    hit = (i != j) & ((ay < y) | ((ay == y) & (ax < x))) & ((by > y) | ((by == y) & (bx > x))) & ((bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0)
    i, j = i[hit], j[hit]
    r0, r1 = (np.rint(np.bincount(i, weights=d[j], minlength=len(row))).astype(np.int64) for d in (d0, d1))
    return Known(row, lx, ly, hx, hy, d0, d1, r0, r1)


def windings(a: pa.Array | tuple, b: pa.Array | tuple | None, rows: int) -> Known:
    """See :func:`.overlay.windings`; sides are arrays of polygons or directed edges."""
    found = [directed(s) if isinstance(s, pa.Array) else s for s in (a, b) if s is not None]
    sizes = [len(s[0]) for s in found]
    passes = [np.concatenate([np.full(n, int(k == side), dtype=np.int64) for k, n in enumerate(sizes)]) for side in (0, 1)]
    edges = canonical(*(np.concatenate([s[c] for s in found]) for c in range(5)), *passes)
    known = arrange(edges[0], rows, *edges[1:])
    return covered(known[0], rows, *known[1:])


def border(known: Known, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Directed edges ``(row, x1, y1, x2, y2)`` of the region that is ``left`` or ``right`` of parts, the region on their left."""
    at = left != right
    row, lx, ly, hx, hy, up = (v[at] for v in (known.row, known.lx, known.ly, known.hx, known.hy, left))
    return row, np.where(up, lx, hx), np.where(up, ly, hy), np.where(up, hx, lx), np.where(up, hy, ly)


def edges_in(lists: pa.Array) -> tuple[np.ndarray, ...]:
    """Directed edges ``(row, x1, y1, x2, y2)`` of lists of ``struct<x1,y1,x2,y2>``."""
    row, _ = spread(_lengths(lists))
    return (row, *(lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")))


def edges_out(edges: tuple[np.ndarray, ...], rows: int) -> pa.Array:
    """Lists of :func:`edges_in`, of edges sorted by row."""
    row, *ends = (np.ascontiguousarray(v) for v in edges)
    held = pa.StructArray.from_arrays([pa.array(v) for v in ends], names=["x1", "y1", "x2", "y2"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32()), held)


def united(lists: pa.Array, rows: int) -> pa.Array:
    """Borders of what directed edges of several polygons cover, whose exteriors turn the same way."""
    known = windings(edges_in(lists), None, rows)
    return edges_out(border(known, known.l0 != 0, known.r0 != 0), rows)


def left_over(lists: pa.Array, rows: int) -> pa.Array:
    """Directed edges that opposite ones do not cancel."""
    row, x1, y1, x2, y2 = edges_in(lists)
    edges = canonical(row, x1, y1, x2, y2, np.ones(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64))
    row, lx, ly, hx, hy, d, _ = arrange(edges[0], rows, *edges[1:])
    up = d > 0
    return edges_out((row, np.where(up, lx, hx), np.where(up, ly, hy), np.where(up, hx, lx), np.where(up, hy, ly)), rows)


def edge_areas(edges: tuple[np.ndarray, ...], rows: int) -> np.ndarray:
    row, x1, y1, x2, y2 = edges
    return np.bincount(row, weights=x1 * y2 - x2 * y1, minlength=rows) / 2


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def _loops(row, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edge that follows each (see :func:`.rings.following`), whether there is one that follows no other, and the number of the corner where each starts."""
    n = len(row)
    order, new = _by_row(np.concatenate([row, row]), np.concatenate([x1, x2]), np.concatenate([y1, y2]))
    vertex = np.empty(2 * n, dtype=np.int64)
    vertex[order] = np.cumsum(new) - 1
    start, end = vertex[:n], vertex[n:]
    outs = np.bincount(start, minlength=int(new.sum()) + 1)
    first, out = np.cumsum(outs) - outs, np.argsort(start, kind="stable")
    ways = outs[end]
    after = np.where(ways > 0, out[np.minimum(first[end], max(n - 1, 0))], 0) if n else np.zeros(0, dtype=np.int64)
    forks = np.flatnonzero(ways > 1)
    if len(forks):
        i, at = spread(ways[forks])
        i = forks[i]
        o = out[first[end[i]] + at]
        turn = (np.arctan2(y1[i] - y2[i], x1[i] - x2[i]) - np.arctan2(y2[o] - y1[o], x2[o] - x1[o])) % (2 * np.pi)
        turn[turn == 0] = 2 * np.pi
        best = np.lexsort((turn, i))
        best = best[np.append(True, i[best][1:] != i[best][:-1])]
        after[i[best]] = o[best]
    return after, (ways > 0) & (np.bincount(after, minlength=n)[after] == 1 if n else ways > 0), start


def several(edges: tuple[np.ndarray, ...], rows: int) -> np.ndarray:
    """Rows whose directed edges may bound more than one exterior."""
    row, x1, y1, x2, y2 = edges
    after, plain, _ = _loops(*edges)
    many = np.zeros(rows, dtype=bool)
    many[row[~plain]] = True
    keep = np.flatnonzero(~many[row])
    new = np.zeros(len(row), dtype=np.int64)
    new[keep] = np.arange(len(keep))
    label = _labels(new[after[keep]], row[keep])
    area = np.bincount(label, weights=(x1 * y2 - x2 * y1)[keep], minlength=len(keep))
    many |= np.bincount(row[keep][np.flatnonzero(area > 0)], minlength=rows) > 1
    return np.flatnonzero(many)


def _labels(after: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The first edge of each edge's loop."""
    label, jump = np.arange(len(after)), after
    for _ in range(int(np.bincount(row).max(initial=1)).bit_length()):
        label, jump = np.minimum(label, label[jump]), jump[jump]
    return label


def _of_row(row: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of the entries ``a`` with each of ``b`` that has its ``row``."""
    b = b[np.argsort(row[b], kind="stable")]
    counts = np.bincount(row[b], minlength=rows)
    first = np.cumsum(counts) - counts
    i, at = spread(counts[row[a]])
    return a[i], b[first[row[a]][i] + at]


def traced(edges: tuple[np.ndarray, ...], rows: int) -> pa.Array:
    """Polygons of each row that directed edges bound, as :func:`.rings.with_polygons` makes them.

    Rows where a ring has a corner twice, or a hole could be of several exteriors, go
    through :mod:`.rings` one by one.
    """
    row, x1, y1, x2, y2 = edges
    after, plain, corner = _loops(*edges)
    odd_row = np.zeros(rows, dtype=bool)
    odd_row[row[~plain]] = True
    keep = np.flatnonzero(~odd_row[row])
    new = np.zeros(len(row), dtype=np.int64)
    new[keep] = np.arange(len(keep))
    after, of, x, y = new[after[keep]], row[keep], x1[keep], y1[keep]
    label = _labels(after, of)
    again = np.sort((label << 32) | corner[keep])
    again = again[np.flatnonzero(again[1:] == again[:-1])] >> 32
    odd_row[of[again]] = True
    roots = np.flatnonzero(label == np.arange(len(keep)))
    ring_of = np.zeros(len(keep), dtype=np.int64)
    ring_of[roots] = np.arange(len(roots))
    place, now, k = np.zeros(len(keep), dtype=np.int64), roots, 0
    root = roots
    while len(now):
        place[now] = k
        now, k = after[now], k + 1
        more = now != root
        now, root = now[more], root[more]
    order = np.argsort((ring_of[label] << 32) | place, kind="stable")
    x, y, ring = x[order], y[order], ring_of[label][order]
    ring_row, sizes = of[roots], np.bincount(ring, minlength=len(roots))

    def beside(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group, at = spread(sizes)
        first = np.arange(len(group)) - at
        size = sizes[group]
        return first + (at - 1) % size, first + (at + 1) % size

    if len(roots):
        before, nxt = beside(sizes)
        bend = ((x - x[before]) * (y[nxt] - y) - (y - y[before]) * (x[nxt] - x)) != 0
        bend |= (~np.logical_or.reduceat(bend, np.cumsum(sizes) - sizes))[ring]
        x, y, ring = x[bend], y[bend], ring[bend]
        sizes = np.bincount(ring, minlength=len(roots))
        _, nxt = beside(sizes)
        area = _sums(x * y[nxt] - x[nxt] * y, sizes) / 2
        starts = np.cumsum(sizes) - sizes
        lowest = np.lexsort((x, y, ring))[starts] - starts
        at = starts[ring] + (np.arange(len(x)) - starts[ring] - lowest[ring]) % sizes[ring]
        turned_x, turned_y = np.empty_like(x), np.empty_like(y)
        turned_x[at], turned_y[at] = x, y
        x, y = turned_x, turned_y
    else:
        starts, area = np.zeros(0, dtype=np.int64), np.zeros(0)
    shell = area > 0
    shells = np.bincount(ring_row[shell], minlength=rows)
    # rings too thin to tell how they turn
    odd_row[ring_row[np.abs(area) < 1e-6]] = True
    first_x, first_y = (x[starts], y[starts]) if len(starts) else (x[:0], y[:0])
    inside = np.arange(len(roots))
    hole = np.flatnonzero(~shell & (shells[ring_row] > 0))
    if len(hole):
        # the one exterior whose box holds a hole's first point; where boxes of several do, the row is odd
        low_x, low_y, high_x, high_y = (f.reduceat(v, starts) for f in (np.minimum, np.maximum) for v in (x, y))
        h, s = _of_row(ring_row, hole, np.flatnonzero(shell), rows)
        held = (area[s] >= -area[h]) & (low_x[s] <= first_x[h]) & (first_x[h] <= high_x[s]) & (low_y[s] <= first_y[h]) & (first_y[h] <= high_y[s])
        h, s = h[held], s[held]
        inside[h] = s
        times = np.bincount(h, minlength=len(roots))
        odd_row[ring_row[hole[times[hole] != 1]]] = True
    # rings that start in one point are ordered by their others
    for some in (np.flatnonzero(shell), np.flatnonzero(~shell)):
        some = some[np.lexsort((first_y[some], first_x[some], ring_row[some]))]
        tied = np.logical_and.reduce([v[some][1:] == v[some][:-1] for v in (first_x, first_y, ring_row)])
        odd_row[ring_row[some[1:][tied]]] = True
    live = ~odd_row[ring_row] & (shell | (shells[ring_row] > 0))
    ring_at = np.flatnonzero(live)
    ring_at = ring_at[np.lexsort((first_y[ring_at], first_x[ring_at], ~shell[ring_at], first_y[inside[ring_at]], first_x[inside[ring_at]], ring_row[ring_at]))]
    got_row, got_new, got_size = ring_row[ring_at], shell[ring_at].astype(np.int64), sizes[ring_at] if len(ring_at) else np.zeros(0, dtype=np.int64)
    group, at = spread(got_size)
    take = starts[ring_at][group] + at
    x, y = x[take], y[take]
    if odd_row.any():
        # put in by hand, rows in order
        flat_row, flat_new, flat_size, flat_x, flat_y = [got_row], [got_new], [got_size], [x], [y]
        order = np.argsort(row, kind="stable")
        lo, hi = np.searchsorted(row[order], np.flatnonzero(odd_row)), np.searchsorted(row[order], np.flatnonzero(odd_row), "right")
        for r, a, b in zip(np.flatnonzero(odd_row).tolist(), lo.tolist(), hi.tolist(), strict=True):
            some = order[a:b]
            ends = (x1[some].tolist(), y1[some].tolist(), x2[some].tolist(), y2[some].tolist())
            for polygon in R.from_edges([((p, q), (s, t)) for p, q, s, t in zip(*ends, strict=True)]):
                flat_row.append(np.full(len(polygon), r))
                flat_new.append(np.array([1] + [0] * (len(polygon) - 1)))
                flat_size.append(np.array([len(g) for g in polygon]))
                flat_x.append(np.array([p[0] for g in polygon for p in g]))
                flat_y.append(np.array([p[1] for g in polygon for p in g]))
        got_row, got_new, got_size, x, y = (np.concatenate(v) for v in (flat_row, flat_new, flat_size, flat_x, flat_y))
        order = np.argsort(got_row, kind="stable")
        begin = (np.cumsum(got_size) - got_size)[order]
        got_row, got_new, got_size = got_row[order], got_new[order], got_size[order]
        group, at = spread(got_size)
        take = begin[group] + at
        x, y = x[take], y[take]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    begins = np.flatnonzero(got_new)
    points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
    polygons = pa.ListArray.from_arrays(ends(np.diff(np.append(begins, len(got_new)))), pa.ListArray.from_arrays(ends(got_size), points))
    return pa.ListArray.from_arrays(ends(np.bincount(got_row[begins], minlength=rows)), polygons)


def slices(batch: pa.RecordBatch, shapes: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of some :data:`POINTS` points, a row at least."""
    total = np.zeros(batch.num_rows, dtype=np.int64)
    for name in shapes:
        column = batch.column(name)
        ends, held = np.concatenate([[0], np.cumsum(_lengths(column))]), column.flatten()
        sizes = np.concatenate([[0], np.cumsum(_lengths(held))]) if pa.types.is_list(held.type) else np.arange(len(held) + 1)
        total += sizes[ends[1:]] - sizes[ends[:-1]]
    part = (np.cumsum(total) - total) // POINTS
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if batch.num_rows else np.zeros(1, dtype=np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(lo, hi - lo)


def by_row(df: DataFrame, on: Sequence[str], shapes: dict[str, Column], make: Callable[..., dict[str, pa.Array]], schema: str) -> DataFrame:
    """``on`` and what ``make(rows, **shapes)`` gives for each row; ``schema`` says what.  ``on`` need not be unique."""
    kinds, names = dict(df.dtypes), list(shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names):
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    made = make(part.num_rows, **{n: part.column(n) for n in names})
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in on), *made.values()], names=[*on, *made])

    return df.select(*on, *[c.alias(n) for n, c in shapes.items()]).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in on), schema]))


class Edges(NamedTuple):
    """Edges with length of rings, in the rings' order: exteriors counter-clockwise, holes clockwise; ``before`` is the edge before each, ``many`` how many its ring has."""

    row: np.ndarray
    ring: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray
    before: np.ndarray
    many: np.ndarray


def oriented(polygons: pa.Array, backwards: bool = False) -> Edges:
    """Edges of polygons, turned as :func:`..functions.polygon.oriented` turns them, or all the other way."""
    p = points_of(polygons)
    new = np.ones(len(p.row), dtype=bool)
    new[1:] = (p.row[1:] != p.row[:-1]) | (p.ring[1:] != p.ring[:-1])
    of = np.cumsum(new) - 1
    x2, y2 = p.x[p.after], p.y[p.after]
    # as in Spark, NaN is greater than 0
    clockwise = ~(np.bincount(of, weights=(x2 - p.x) * (y2 + p.y)) <= 0)
    turn = (clockwise == (p.ring[new] == 0)) != backwards
    same = lambda a, b: (a == b) | (np.isnan(a) & np.isnan(b))
    kept = np.flatnonzero(~same(p.x, x2) | ~same(p.y, y2))
    row, ring, of = p.row[kept], p.ring[kept], of[kept]
    _, at = spread(sizes := np.bincount(of, minlength=int(new.sum())))
    many = sizes[of]
    first, back = np.arange(len(kept)) - at, turn[of]
    before = first + (at + np.where(back, 1, -1)) % np.maximum(many, 1)
    x1, y1, x2, y2 = p.x[kept], p.y[kept], x2[kept], y2[kept]
    return Edges(row, ring, np.where(back, x2, x1), np.where(back, y2, y1), np.where(back, x1, x2), np.where(back, y1, y2), before, many)


def snapped(row, x1, y1, x2, y2) -> tuple[np.ndarray, ...]:
    return row, snap(x1), snap(y1), snap(x2), snap(y2)


def closed(row: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Directed edges of rings of ``sizes`` points, ring by ring."""
    ring, at = spread(sizes)
    after = np.where(at + 1 < sizes[ring], np.arange(len(ring)) + 1, np.arange(len(ring)) - at)
    return snapped(row[ring], x, y, x[after], y[after])
