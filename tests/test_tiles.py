"""Tiled warps held against whole images, and contours of masks against their pixels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import contours, packed, runlength, tiles

SCHEMA = "image string, y int, x int, v double, extra int"


def frame(spark, images):
    return spark.createDataFrame([(k, y, x, None if math.isnan(v) else float(v), 1) for k, a in images.items() for (y, x), v in np.ndenumerate(a)], SCHEMA).repartition(3)


def arrays(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image"], {})[(r["y"], r["x"])] = r["v"]
    return out


RNG = np.random.default_rng(6)
IMAGES = {"wide": RNG.uniform(-1, 1, (5, 23)), "tall": RNG.uniform(-1, 1, (17, 4)), "dot": np.array([[2.0]])}


@pytest.mark.parametrize("kind, border", [("linear", "constant"), ("cubic", "wrap"), ("nearest", "reflect101")])
def test_tiles_give_what_whole_images_give(spark, kind, border):
    matrix = np.array([[0.8, 0.3, 2.0], [-0.4, 1.1, 1.5], [0, 0, 1]])
    source = tiles.tiled(frame(spark, IMAGES), ["image"], 4)
    got = arrays(tiles.untiled(tiles.warp(source, ["image"], matrix, 9, 14, 4, kind, border, 0.5), ["image"], 4))
    assert set(got) == set(IMAGES)
    for k, a in IMAGES.items():
        want = packed.warp(a[..., None], matrix, 9, 14, kind, border, 0.5)[..., 0]
        assert len(got[k]) == want.size
        for at, v in got[k].items():
            assert v == pytest.approx(want[at], abs=1e-9), (k, at)


def test_missing_pixels_stay_missing_only_where_they_are_read(spark):
    a = np.arange(36, dtype=float).reshape(6, 6)
    a[2, 3] = math.nan
    source = tiles.tiled(frame(spark, {"a": a}), ["image"], 4)
    same = arrays(tiles.untiled(tiles.warp(source, ["image"], np.eye(3), 6, 6, 4, "linear"), ["image"], 4))["a"]
    assert {at for at, v in same.items() if math.isnan(v)} == {(2, 3)}
    half = arrays(tiles.untiled(tiles.warp(source, ["image"], np.array([[1, 0, 0.5], [0, 1, 0], [0, 0, 1]]), 6, 6, 4, "linear"), ["image"], 4))["a"]
    assert {at for at, v in half.items() if math.isnan(v)} == {(2, 3), (2, 4)} and half[0, 1] == 0.5


def test_no_size_and_no_images(spark):
    source = tiles.tiled(frame(spark, IMAGES), ["image"], 4)
    assert tiles.warp(source, ["image"], np.eye(3), 0, 5, 4).count() == 0
    assert tiles.warp(source.where("false"), ["image"], np.eye(3), 5, 5, 4).count() == 0
    with pytest.raises(ValueError):
        tiles.warp(source, ["image"], np.eye(3), 5, 5, 4, border="mirror")


@pytest.mark.parametrize("order, tile", [("F", 4.0), ("C", 256.0)])
def test_masks_to_polygons_and_back(spark, order, tile):
    rng = random.Random(3)
    shapes = {f"m{i}": np.array([[float(rng.random() < p) for _ in range(w)] for _ in range(h)]) for i, (h, w, p) in enumerate([(9, 7, 0.5), (6, 13, 0.8), (5, 5, 1.0), (4, 6, 0.0), (1, 1, 1.0), (11, 11, 0.3)])}
    ring = np.ones((7, 7))
    ring[2:5, 2:5] = 0
    ring[3, 3] = 1
    shapes["nested"] = ring
    masks = runlength.encode_masks(frame(spark, shapes), ["image"], order)
    made = contours.mask_polygons(masks, ["image"], tile=tile).cache()
    back = {k: np.zeros(a.shape) for k, a in shapes.items()}
    for r in contours.polygon_runs(made, ["image"], 11, 13, F.col("polygons")).collect():
        back[r["image"]][r["y"], r["start"]:r["stop"]] = 1
    assert all((back[k] == a).all() for k, a in shapes.items())
    found = {r["image"]: r["polygons"] for r in made.collect()}
    assert "m3" not in found and sorted(len(p) for p in found["nested"]) == [1, 2]
    assert [(p["x"], p["y"]) for p in found["m2"][0][0]] == [(0, 0), (5, 0), (5, 5), (0, 5)]


@pytest.mark.parametrize("kind, border", [("lanczos", "replicate"), ("lanczos", "constant")])
def test_images_are_sampled_together(spark, kind, border, monkeypatch):
    """Images of one size and of others, one with a tile missing, are sampled in a few calls, whatever their number."""
    images = {f"a{k}": RNG.uniform(-1, 1, (8, 8)) for k in range(12)} | IMAGES
    images["a3"][:4, 4:] = math.nan
    matrix = np.array([[1.625, 0, 0.3125], [0, 0.75, -0.125], [0, 0, 1.0]])
    source = tiles.tiled(frame(spark, images), ["image"], 4)
    made = tiles.warp(source, ["image"], matrix, 6, 13, 4, kind, border, 0.25)
    assert "FlatMapGroupsInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    got = arrays(tiles.untiled(made, ["image"], 4))
    assert set(got) == set(images)
    for k, a in images.items():
        want = packed.warp(a[..., None], matrix, 6, 13, kind, border, 0.25)[..., 0]
        assert len(got[k]) == want.size
        if k != "a3":
            assert [got[k][at] for at in np.ndindex(*want.shape)] == pytest.approx(want.ravel().tolist(), abs=1e-9), k
    assert any(math.isnan(v) for v in got["a3"].values()) or border == "constant"
