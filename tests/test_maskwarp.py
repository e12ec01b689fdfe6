"""Masks warped on their runs, held against warps of their pixels."""

import numpy as np
import pytest

from rasterloom.operators import maskwarp, runlength

SCHEMA = "k string, mask struct<height:int,width:int,order:string,counts:array<int>>, extra int"


def frame(spark, images, order):
    rows = [(k, {"height": a.shape[0], "width": a.shape[1], "order": order, "counts": runlength.encode_array(a.ravel(order))}, 1) for k, a in images.items()]
    return spark.createDataFrame([*rows, ("null", None, 1)], SCHEMA).repartition(3)


def arrays(df):
    out = {}
    for r in df.collect():
        m = r["mask"]
        flat = np.repeat(np.arange(len(m["counts"])) % 2, m["counts"])
        assert 0 not in m["counts"][1:]
        out[r["k"]] = flat.reshape((m["height"], m["width"]), order=m["order"])
    return out


def brute(a, matrix, height, width):
    back = np.linalg.inv(matrix)
    out = np.zeros((height, width), int)
    for y in range(height):
        for x in range(width):
            u, v, w = (back[i, 0] * x + back[i, 1] * y + back[i, 2] for i in range(3))
            sx, sy = np.rint(u / w), np.rint(v / w)
            if 0 <= sy < a.shape[0] and 0 <= sx < a.shape[1]:
                out[y, x] = a[int(sy), int(sx)]
    return out


RNG = np.random.default_rng(4)
IMAGES = {"wide": (RNG.random((5, 31)) < 0.6).astype(int), "tall": (RNG.random((29, 4)) < 0.4).astype(int), "dot": np.array([[1]]), "none": np.zeros((6, 7), int), "full": np.ones((9, 9), int)}
MATRICES = {
    "same": np.eye(3), "half": np.array([[1, 0, 0.5], [0, 1, -0.5], [0, 0, 1.0]]), "double": np.diag([2.0, 2, 1]), "shrink": np.diag([0.5, 0.25, 1]), "flip": np.array([[-1, 0, 12.0], [0, -1, 9], [0, 0, 1]]),
    "turn": np.array([[0, -1, 10.0], [1, 0, 0], [0, 0, 1]]), "skew": np.array([[0.8, 0.7, -2], [-0.6, 1.3, 4], [0, 0, 1.0]]), "far": np.array([[1, 0, 1e6], [0, 1, 0], [0, 0, 1.0]]),
    "tilt": np.array([[1.1, 0.2, 1], [0.1, 0.9, 2], [0.01, 0.004, 1.0]]), "horizon in the mask": np.array([[1, 0, 0], [0, 1, 0], [-0.05, 0, 1.0]]), "negative": -np.array([[1.2, 0.1, 1], [0, 0.9, 1], [0, 0.003, 1.0]])}


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("name", MATRICES)
def test_warp(spark, name, order):
    m = MATRICES[name]
    got = arrays(maskwarp.warp_masks(frame(spark, IMAGES, order), ["k"], m, 15, 17))
    assert got.keys() == IMAGES.keys()
    for k, a in IMAGES.items():
        assert np.array_equal(got[k], brute(a, m, 15, 17)), k


def test_frames_and_refusals(spark):
    masks = frame(spark, IMAGES, "F")
    same = arrays(maskwarp.warp_masks(masks, ["k"], np.eye(3)))
    assert all(np.array_equal(same[k], a) for k, a in IMAGES.items())
    grown = arrays(maskwarp.scale_masks(masks, ["k"], (1.5, 2.3)))
    for k, a in IMAGES.items():
        assert np.array_equal(grown[k], brute(a, np.diag([1.5, 2.3, 1]), int(a.shape[0] * 2.3), int(a.shape[1] * 1.5)))
    for bad in (np.zeros((3, 3)), np.eye(2), np.full((3, 3), np.nan)):
        with pytest.raises(ValueError):
            maskwarp.warp_masks(masks, ["k"], bad)
    with pytest.raises(Exception, match="horizon"):
        maskwarp.warp_masks(masks, ["k"], np.array([[1, 0, 0], [0, 1, 0], [0.2, 0, 1.0]]), 15, 17).collect()
    assert maskwarp.warp_masks(masks.where("false"), ["k"], np.eye(3)).count() == 0


@pytest.mark.parametrize("order", ["C", "F"])
def test_patches(spark, order):
    df = maskwarp.mask_patches(frame(spark, IMAGES, order), ["k"])
    corners = {r["k"]: (r["x"], r["y"]) for r in df.collect()}
    got = arrays(df)
    assert got.keys() == {k for k, a in IMAGES.items() if a.any()}
    for k, part in got.items():
        ys, xs = np.nonzero(IMAGES[k])
        assert corners[k] == (xs.min(), ys.min())
        assert np.array_equal(part, IMAGES[k][ys.min():ys.max() + 1, xs.min():xs.max() + 1])
