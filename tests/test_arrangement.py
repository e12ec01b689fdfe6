"""Overlay within tasks gives what overlay by joins gives, and leaves rows where they are."""

import math
import random

import pytest
import test_overlay as T
from pyspark.sql import functions as F

from rasterloom.operators import arrangement, buffers, overlay, unions, validity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pairs(spark):
    rng, shapes = random.Random(5), list(T.PAIRS)
    grid = lambda n: [[(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(n)]]
    for _ in range(40):
        shapes.append((grid(rng.randint(3, 9)) + grid(3), grid(rng.randint(3, 9))))
        shapes.append((T.frame(rng.randint(0, 8), rng.randint(0, 8), 8), T.frame(rng.randint(0, 8), rng.randint(0, 8), 8)))
    rows = [(i, [[(float(x), float(y)) for x, y in r] for r in a], [[(float(x), float(y)) for x, y in r] for r in b]) for i, (a, b) in enumerate(shapes)]
    one = [T.box(0.0, 0.0, 1.0, 3.0)]
    rows += [(i, a, one) for i, a in enumerate([None, [], [[(1.0, 1.0), (2.0, 2.0)]], [[(0.0, 0.0), (math.nan, 1.0), (1.0, 1.0)]], [None]], 1000)]
    return spark.createDataFrame(rows, f"i int, a {T.POLY}, b {T.POLY}").repartition(3).cache()


@pytest.mark.parametrize("how", ["difference", "intersection", "symmetric_difference", "union"])
def test_polygons_within_tasks(pairs, how, monkeypatch):
    made = overlay.overlay(pairs, ["i"], F.col("a"), F.col("b"), how, within_tasks=True)
    assert "Join" not in plan(made)
    want = {r["i"]: r["polygons"] for r in overlay.overlay(pairs, ["i"], F.col("a"), F.col("b"), how).collect()}
    got = [(r["i"], r["polygons"]) for r in made.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_blocks_split_a_large_row(monkeypatch):
    """More edges than a block has pairs."""
    star = T.star(random.Random(3), 0, 0, 10, 90)[0]
    polygons = arrangement.pa.array([[[{"x": x, "y": y} for x, y in star]], [[{"x": x, "y": y} for x, y in star[:20]]]])
    whole = arrangement.windings(polygons, None, 2)
    monkeypatch.setattr(arrangement, "BLOCK", 50)
    for a, b in zip(whole, arrangement.windings(polygons, None, 2), strict=True):
        assert (a == b).all()


def test_areas_within_tasks(pairs):
    made = overlay.overlay_areas(pairs, ["i"], F.col("a"), F.col("b"), within_tasks=True)
    assert "Join" not in plan(made)
    want, got = ({r["i"]: r.asDict() for r in d.collect()} for d in (overlay.overlay_areas(pairs, ["i"], F.col("a"), F.col("b")), made))
    assert set(got) == set(want)
    for i, areas in want.items():
        assert got[i] == pytest.approx(areas, abs=1e-9), i


def test_buffers_within_tasks(pairs):
    for distance, style in ((0.75, "round"), (0.5, "mitre"), (0.5, "bevel"), (-0.5, "mitre"), (0.0, "round")):
        want, got = ({r["i"]: r["area"] for r in buffers.buffer_areas(pairs, ["i"], F.col("a"), distance, style, within_tasks=w).collect()} for w in (False, True))
        assert got == pytest.approx(want, abs=1e-6), (distance, style)
    made = buffers.buffer(pairs, ["i"], F.col("a"), -0.25, "mitre", within_tasks=True)
    assert "Join" not in plan(made)
    want = {r["i"]: r["polygons"] for r in buffers.buffer(pairs.where("i < 12 or i > 900"), ["i"], F.col("a"), -0.25, "mitre").collect()}
    assert {r["i"]: r["polygons"] for r in made.where("i < 12 or i > 900").collect()} == want


def test_repair_within_tasks_keeps_rows_of_one_key(pairs):
    made = validity.fix(pairs, ["i"], F.col("a"), within_tasks=True)
    want = {r["i"]: r["polygons"] for r in validity.fix(pairs, ["i"], F.col("a")).collect()}
    assert {r["i"]: r["polygons"] for r in made.collect()} == want
    # the driver's tables have rows of equal det_id and different shapes
    both = validity.fix(pairs.where("i in (0, 7)").withColumn("i", F.lit(1)), ["i"], F.col("a"), within_tasks=True).collect()
    assert sorted(map(str, (r["polygons"] for r in both))) == sorted(map(str, (want[0], want[7])))


def test_faults_within_tasks(spark, pairs):
    shapes = T.as_rows([p for p, _ in T.FAULTS] + [[[(0, 0), (4, 4), (0, 0), (4, 4)], T.box(0, 0, 2, 2)]])
    df = spark.createDataFrame(shapes, f"i int, poly {T.POLY}").unionByName(pairs.selectExpr("i + 5000 as i", "a as poly"))
    want, got = (sorted(map(str, validity.explain_validity(df, ["i"], F.col("poly"), within_tasks=w).collect())) for w in (False, True))
    assert got == want


many = T.many


def test_unions_within_tasks(many):
    rows, df = many
    for tile, fan in ((16.0, 4), (256.0, 32)):
        want, got = ({r["g"]: r["area"] for r in unions.union_areas(df, ["g"], F.col("poly"), tile, fan, w).collect()} for w in (False, True))
        assert got == pytest.approx(want, abs=1e-6)


def test_rings_of_unions_within_tasks(many):
    rows, df = many
    want, got = ({r["g"]: r["polygons"] for r in unions.unary_union(df, ["g"], F.col("poly"), 16.0, 4, w).collect()} for w in (False, True))
    assert got == want
