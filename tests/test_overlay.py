"""Overlay, union of many, validity, repair and buffers of polygons, held against slabs between the heights of all corners and crossings."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import buffers, overlay, rings, unions, validity

POLY = "array<array<struct<x:double,y:double>>>"


def edges_of(poly):
    return [(p, q) for ring in poly for p, q in zip(ring, [*ring[1:], ring[0]], strict=True) if p != q]


def meeting(e, f):
    """Heights where two edges cross."""
    (ax, ay), (bx, by) = e
    (cx, cy), (dx, dy) = f
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    if not den:
        return []
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
    return [ay + t * (by - ay)]


def slab_area(shapes, inside):
    """Area where ``inside`` holds of the even-odd coverings by each of the shapes."""
    shapes = [edges_of(s) for s in shapes]
    every = [e for s in shapes for e in s]
    ys = sorted({y for e in every for _, y in e} | {y for e, f in combinations(every, 2) for y in meeting(e, f)})
    total = 0.0
    for lo, hi in zip(ys, ys[1:], strict=False):
        mid, cuts = (lo + hi) / 2, []
        for k, s in enumerate(shapes):
            for (ax, ay), (bx, by) in s:
                if min(ay, by) <= lo and max(ay, by) >= hi:
                    cuts.append((ax + (bx - ax) * (mid - ay) / (by - ay), k))
        cuts.sort()
        state = [False] * len(shapes)
        for (x, k), (nxt, _) in zip(cuts, cuts[1:], strict=False):
            state[k] = not state[k]
            if inside(state):
                total += (nxt - x) * (hi - lo)
    return total


def frame(x, y, s, hole=True):
    """A square with a notch and, unless told otherwise, a square hole."""
    out = [[(x, y), (x + s, y), (x + s, y + s), (x + s / 2, y + s / 2), (x, y + s)]]
    return out + [[(x + s / 8, y + s / 8), (x + s / 4, y + s / 8), (x + s / 4, y + s / 4), (x + s / 8, y + s / 4)]] if hole else out


def star(rng, cx, cy, r, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [[(round(cx + r * rng.uniform(0.2, 1) * math.cos(t), 3), round(cy + r * rng.uniform(0.2, 1) * math.sin(t), 3)) for t in turns]]


def box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


RNG = random.Random(17)
PAIRS = [
    (frame(0, 0, 8), frame(4, 4, 8)),
    (frame(0, 0, 8), frame(0, 0, 8)),
    (frame(0, 0, 8), frame(8, 0, 8)),
    (frame(0, 0, 16), [box(2, 2, 4, 4)]),
    ([box(0, 0, 10, 10), box(2, 2, 8, 8)], [box(3, 3, 7, 7), box(4, 4, 6, 6)]),
    ([box(0, 0, 10, 10), box(2, 2, 8, 8)], [box(2, 2, 8, 8)]),
    ([box(0, 0, 4, 4)], [box(4, 4, 8, 8)]),
    ([box(0, 0, 4, 4)], [box(1, 4, 3, 9)]),
    ([box(0, 0, 4, 4)], [box(20, 20, 30, 30)]),
    ([[(0, 0), (4, 4), (4, 0), (0, 4)]], [box(1, 1, 3, 3)]),
    ([[(0, 0), (9, 0), (9, 9), (5, 0), (0, 9)]], [[(0, 5), (9, 5), (9, 6), (0, 6)]]),
    (star(RNG, 0, 0, 10, 60), star(RNG, 1, 1, 10, 80)),
    *[(star(RNG, 0, 0, 10, RNG.randint(3, 14)), star(RNG, RNG.uniform(-8, 8), RNG.uniform(-8, 8), 10, RNG.randint(3, 14))) for _ in range(25)],
]
OPS = {"union": lambda s: s[0] or s[1], "intersection": lambda s: s[0] and s[1], "difference": lambda s: s[0] and not s[1], "symmetric_difference": lambda s: s[0] != s[1]}


@pytest.fixture(scope="module")
def pairs(spark):
    odd = [(100, None, [box(0.0, 0.0, 2.0, 2.0)]), (101, [], []), (102, [[(1.0, 1.0), (2.0, 2.0)]], [box(0.0, 0.0, 1.0, 3.0)]), (103, [[(0.0, 0.0), (math.nan, 1.0), (1.0, 1.0)]], [box(0.0, 0.0, 1.0, 3.0)])]
    rows = [(i, [[(float(x), float(y)) for x, y in r] for r in a], [[(float(x), float(y)) for x, y in r] for r in b]) for i, (a, b) in enumerate(PAIRS)]
    return spark.createDataFrame(rows + odd, f"i int, a {POLY}, b {POLY}").repartition(3).cache()


@pytest.fixture(scope="module")
def areas(pairs):
    return {r["i"]: r for r in overlay.overlay_areas(pairs, ["i"], F.col("a"), F.col("b")).collect()}


def test_areas_equal_slabs(areas):
    for i, shapes in enumerate(PAIRS):
        want = {n: slab_area(shapes, f) for n, f in OPS.items()}
        for n, v in want.items():
            assert areas[i][n] == pytest.approx(v, abs=1e-6), (i, n)
        assert areas[i]["iou"] == pytest.approx(want["intersection"] / want["union"], abs=1e-7)


def test_areas_of_nothing(areas):
    assert (areas[100]["union"], areas[100]["intersection"], areas[100]["area_a"], areas[100]["iou"]) == (4, 0, 0, 0)
    assert areas[101]["union"] == 0 and areas[101]["iou"] is None and areas[101]["iooa"] is None
    assert areas[102]["union"] == 3


@pytest.mark.parametrize("how", sorted(OPS))
def test_polygons_have_the_area_and_the_form(pairs, how):
    for r in overlay.overlay(pairs, ["i"], F.col("a"), F.col("b"), how).collect():
        found = [[[(p["x"], p["y"]) for p in ring] for ring in poly] for poly in r["polygons"]]
        signed = [[rings.area(ring) for ring in poly] for poly in found]
        assert all(s[0] > 0 and all(h < 0 for h in s[1:]) for s in signed)
        assert all(len(set(ring)) == len(ring) for poly in found for ring in poly)
        if r["i"] < len(PAIRS):
            want = slab_area(PAIRS[r["i"]], OPS[how])
            assert sum(map(sum, signed)) == pytest.approx(want, abs=1e-6)
            flat = [ring for poly in found for ring in poly]
            assert slab_area([*PAIRS[r["i"]], flat], lambda s: s[2] != OPS[how](s)) == pytest.approx(0, abs=1e-5)


def test_touching_boxes_make_one_ring(spark):
    df = spark.createDataFrame([(1, [box(0.0, 0.0, 4.0, 4.0)], [box(4.0, 0.0, 8.0, 4.0)]), (2, [box(0.0, 0.0, 4.0, 4.0), box(1.0, 1.0, 3.0, 3.0)], [box(1.0, 1.0, 3.0, 3.0)])], f"i int, a {POLY}, b {POLY}")
    got = {r["i"]: r["polygons"] for r in overlay.overlay(df, ["i"], F.col("a"), F.col("b"), "union").collect()}
    assert [[(p["x"], p["y"]) for p in ring] for ring in got[1][0]] == [[(0, 0), (8, 0), (8, 4), (0, 4)]]
    assert [[(p["x"], p["y"]) for p in ring] for ring in got[2][0]] == [[(0, 0), (4, 0), (4, 4), (0, 4)]]


# unions of many ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def many(spark):
    """Groups of valid polygons: overlapping boxes and frames across tiles, copies, a comb of touching boxes, nested frames, one alone."""
    rng, rows = random.Random(4), []
    for _ in range(60):
        x, y, w, h = (rng.randint(0, 60), rng.randint(0, 60), rng.randint(3, 20), rng.randint(3, 20))
        rows.append(("boxes", [box(x, y, x + w, y + h)]))
    rows += [("frames", frame(rng.randint(-30, 30), rng.randint(-30, 30), rng.choice([4, 8, 16, 40]))) for _ in range(25)]
    rows += [("copies", frame(0, 0, 32))] * 20
    rows += [("comb", [box(4 * i, 0, 4 * i + 4, 16)]) for i in range(10)]
    rows += [("nested", [box(-k, -k, k, k), box(1 - k, 1 - k, k - 1, k - 1)]) for k in range(3, 30, 3)]
    rows += [("alone", star(random.Random(2), 8, 8, 12, 9)), ("alone", None), ("alone", [])]
    rows = [(g, None if p is None else [[(float(x), float(y)) for x, y in r] for r in p]) for g, p in rows]
    return rows, spark.createDataFrame(rows, f"g string, poly {POLY}").repartition(3)


def union_by_slabs(shapes):
    return slab_area(shapes, any)


@pytest.mark.parametrize("tile, fan", [(16.0, 4), (256.0, 32)])
def test_unions_of_many(many, tile, fan):
    rows, df = many
    got = {r["g"]: r["area"] for r in unions.union_areas(df, ["g"], F.col("poly"), tile, fan).collect()}
    groups = {g: [p for h, p in rows if h == g and p] for g, _ in rows}
    assert set(got) == set(groups)
    for g, shapes in groups.items():
        assert got[g] == pytest.approx(union_by_slabs(shapes), abs=1e-6), g


def test_rings_of_unions_are_stitched_over_tiles(many):
    rows, df = many
    found = {r["g"]: [[[(p["x"], p["y"]) for p in ring] for ring in poly] for poly in r["polygons"]] for r in unions.unary_union(df, ["g"], F.col("poly"), 16.0, 4).collect()}
    assert found["comb"] == [[[(0, 0), (40, 0), (40, 16), (0, 16)]]]
    assert found["copies"] == [[[(x, y) for x, y in r] for r in ([(0, 0), (32, 0), (32, 32), (16, 16), (0, 32)], [(4, 4), (4, 8), (8, 8), (8, 4)])]]
    assert len(found["nested"]) == 9 and all(len(p) == 2 for p in found["nested"])
    for g, polys in found.items():
        shapes = [p for h, p in rows if h == g and p]
        assert all(rings.area(p[0]) > 0 and all(rings.area(h) < 0 for h in p[1:]) for p in polys)
        flat = [ring for p in polys for ring in p]
        assert slab_area([*shapes, flat], lambda s: s[-1] != any(s[:-1])) == pytest.approx(0, abs=1e-5)


# validity, repair, buffers ------------------------------------------------------------

#: (polygon, explanation)
FAULTS = [
    ([box(0, 0, 4, 4)], None),
    ([box(0, 0, 4, 4)[::-1], box(1, 1, 2, 2)], None),
    ([[(0, 0), (4, 4), (4, 0), (0, 4)]], "Self-intersection[2 2]"),
    ([[(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4)]], "Self-intersection[2 4]"),
    ([[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]], "Ring Self-intersection[2 0]"),
    ([[(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4)]], "Ring Self-intersection[2 2]"),
    ([box(0, 0, 4, 4), box(6, 6, 8, 8)], "Hole lies outside shell[6 7]"),
    ([box(0, 0, 9, 9), box(1, 1, 8, 8), box(2, 2, 3, 3)], "Holes are nested[2 2.5]"),
    ([box(0, 0, 4, 4), box(2, 2, 6, 3)], "Self-intersection[4 2]"),
    ([box(0, 0, 8, 8), box(0, 2, 2, 4)], "Self-intersection[0 2]"),
    ([box(0, 0, 8, 8), [(0, 4), (4, 3), (4, 5)]], None),
    ([box(0, 0, 8, 8), [(0, 4), (4, 2), (8, 4), (4, 6)]], "Interior is disconnected[0 4]"),
    ([[(0, 0), (1, 1), (0, 0)]], "Too few points in geometry component[0 0]"),
    ([[(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4)]], None),
    ([[(0, 0), (math.inf, 0), (4, 4)]], "Invalid Coordinate"),
    ([], None),
    (None, None),
]


def as_rows(shapes):
    return [(i, None if p is None else [[(float(x), float(y)) for x, y in r] for r in p]) for i, p in enumerate(shapes)]


def test_faults_are_named(spark):
    df = spark.createDataFrame(as_rows([p for p, _ in FAULTS]), f"i int, poly {POLY}")
    got = {r["i"]: r for r in validity.explain_validity(df, ["i"], F.col("poly")).collect()}
    assert len(got) == len(FAULTS)
    for i, (_, want) in enumerate(FAULTS):
        assert got[i]["explanation"] == want and got[i]["is_invalid"] == (want is not None), i


def test_repaired_polygons_are_valid_and_cover_the_same(spark):
    rng = random.Random(8)
    shapes = [p for p, w in FAULTS if p and w != "Invalid Coordinate"] + [[[(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(rng.randint(4, 12))]] for _ in range(20)]
    df = spark.createDataFrame(as_rows(shapes), f"i int, poly {POLY}")
    fixed = validity.fix(df, ["i"], F.col("poly")).cache()
    found = {r["i"]: [[[(p["x"], p["y"]) for p in ring] for ring in poly] for poly in r["polygons"]] for r in fixed.collect()}
    for i, p in enumerate(shapes):
        flat = [ring for poly in found[i] for ring in poly]
        assert slab_area([p, flat], lambda s: s[0] != s[1]) == pytest.approx(0, abs=1e-6), i
    again = fixed.select("i", F.posexplode("polygons").alias("k", "poly"))
    assert again.count() and not [r for r in validity.explain_validity(again, ["i", "k"], F.col("poly")).collect() if r["is_invalid"]]


def outline(poly):
    """Length of all rings."""
    return sum(math.dist(p, q) for p, q in edges_of(poly))


def test_buffers(spark):
    shapes = [[box(0, 0, 8, 8)], frame(0, 0, 16), [[(0, 0), (9, 0), (9, 9), (5, 1), (0, 9)]], [box(0, 0, 20, 20)[::-1], box(5, 5, 15, 15)], [], None]
    df = spark.createDataFrame(as_rows(shapes), f"i int, poly {POLY}")
    area = lambda *a: {r["i"]: r["area"] for r in buffers.buffer_areas(df, ["i"], F.col("poly"), *a).collect()}
    for style, corner in (("mitre", 4.0), ("bevel", 2.0), ("round", 16 * 2 * math.sin(math.pi / 32))):
        got = area(1.0, style)
        assert got[0] == pytest.approx(64 + 32 + corner, abs=1e-6)
        # the inner ring's corners are inside corners, whose strips overlap
        assert got[3] == pytest.approx(300 + 80 + 40 + corner - 4, abs=1e-6)
    assert area(-1.0)[0] == pytest.approx(36, abs=1e-6) and area(-4.5)[0] == 0
    assert area(-1.0, "mitre")[3] == pytest.approx(18 * 18 - 12 * 12, abs=1e-6) and area(6.0, "mitre")[3] == pytest.approx(32 * 32, abs=1e-6)
    assert area(0.0) == pytest.approx({i: slab_area([p], lambda s: s[0]) if p else 0 for i, p in enumerate(shapes)}, abs=1e-6)
    assert area(2.0)[4] == area(2.0)[5] == 0
    # within the bound of the true round buffer, by points on a grid
    distance, step, poly = 1.5, 0.125, shapes[2]
    inside = near = 0
    for i in range(-24, 100):
        for j in range(-24, 100):
            x, y = i * step + 0.03, j * step + 0.02
            if rings.holds([(float(a), float(b)) for a, b in poly[0]], (x, y)):
                inside += 1
            else:
                for (ax, ay), (bx, by) in edges_of(poly):
                    t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                    if math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) <= distance:
                        near += 1
                        break
    assert area(distance)[2] == pytest.approx((inside + near) * step**2, rel=0.01)
    made = {r["i"]: r["polygons"] for r in buffers.buffer(df, ["i"], F.col("poly"), 1.0, "mitre").collect()}
    assert [[(p["x"], p["y"]) for p in ring] for ring in made[0][0]] == [[(-1, -1), (9, -1), (9, 9), (-1, 9)]] and len(made[3][0]) == 2 and made[5] == []
