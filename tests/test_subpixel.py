"""Patches between pixels held against loops."""

import math

import numpy as np
import pytest

from rasterloom.operators import subpixel

RNG = np.random.default_rng(9)
IMAGES = {"a": RNG.uniform(-1, 1, (9, 12)), "b": RNG.uniform(-1, 1, (3, 4))}
PATCHES = [(k, i, float(oy), float(ox), RNG.uniform(-2, 2, shape)) for k in ("a", "b", "unknown") for i, (oy, ox, shape) in enumerate(
    [(0, 0, (2, 2)), (1.25, 2.5, (3, 4)), (-1.5, 1, (3, 2)), (7.75, 10.25, (4, 4)), (2, 3.5, (1, 1)), (50, 50, (2, 2)), (1.5, 2.5, (3, 3))])]


def flat(a):
    return [(int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(a)]


def images(spark):
    rows = [(k, y, x, None if (k, y, x) == ("a", 2, 4) else v, 1) for k, a in IMAGES.items() for y, x, v in flat(a)]
    return spark.createDataFrame(rows, "k string, y int, x int, v double, patch int").repartition(3)


def brute(how):
    out = {k: a.copy() for k, a in IMAGES.items()}
    for k, _, oy, ox, p in PATCHES:
        if k not in out:
            continue
        dst, got = out[k], {}
        for sy, sx, v in flat(p):
            for cy in range(math.floor(oy + sy), math.ceil(oy + sy) + 1):
                for cx in range(math.floor(ox + sx), math.ceil(ox + sx) + 1):
                    w = (1 - abs(oy + sy - cy)) * (1 - abs(ox + sx - cx))
                    if 0 <= cy < dst.shape[0] and 0 <= cx < dst.shape[1]:
                        got[cy, cx] = got.get((cy, cx), 0) + w * v
        for c, v in got.items():
            dst[c] = {"add": dst[c] + v, "set": v, "max": max(dst[c], v), "min": min(dst[c], v)}[how]
    return out


@pytest.mark.parametrize("how", subpixel.COMBINERS)
def test_splat(spark, how):
    rows = [(k, i, oy, ox, y, x, v) for k, i, oy, ox, p in PATCHES for y, x, v in flat(p)] + [("a", 99, 0.5, 0.5, 0, 0, None)]
    patches = spark.createDataFrame(rows, "k string, patch int, oy double, ox double, y int, x int, v double").repartition(4)
    want = brute(how)
    got = subpixel.splat(images(spark), patches, ["k"], how=how).collect()
    assert len(got) == sum(a.size for a in IMAGES.values())
    for r in got:
        if (r["k"], r["y"], r["x"]) == ("a", 2, 4):
            assert r["v"] is None
        else:
            assert abs(r["v"] - want[r["k"]][r["y"], r["x"]]) < 1e-9
    same = subpixel.splat(images(spark), patches.where("false"), ["k"], how=how).collect()
    assert all(r["v"] is None or r["v"] == IMAGES[r["k"]][r["y"], r["x"]] for r in same) and len(same) == len(got)
    assert subpixel.splat(images(spark).where("false"), patches, ["k"], how=how).count() == 0
    with pytest.raises(ValueError):
        subpixel.splat(images(spark), patches, ["k"], how="mean")


def test_slices(spark):
    windows = [("a", 0, 0.0, 9.0, 0.0, 12.0), ("a", 1, 1.25, 4.25, -2.5, 3.5), ("a", 2, 6.5, 12.25, 9.0, 14.75), ("b", 3, 1.0, 1.0, 0.0, 4.0), ("b", 4, -3.0, -1.5, 0.0, 2.0), ("none", 5, 0.0, 1.0, 0.0, 1.0)]
    got = subpixel.slices(images(spark), spark.createDataFrame(windows, "k string, patch int, y0 double, y1 double, x0 double, x1 double"), ["k"])
    made = {(r["patch"], r["y"], r["x"]): r["v"] for r in got.collect()}
    want = {}
    for k, i, y0, y1, x0, x1 in windows:
        a = np.pad(np.where(np.arange(108).reshape(9, 12) == 28, 0, IMAGES["a"]) if k == "a" else IMAGES.get(k, np.zeros((1, 1))), 10)
        for y in range(math.ceil(y1 - y0)):
            for x in range(math.ceil(x1 - x0)):
                sy, sx = y0 + y, x0 + x
                fy, fx = math.floor(sy), math.floor(sx)
                want[i, y, x] = sum(a[fy + p + 10, fx + q + 10] * (1 - abs(sy - fy - p)) * (1 - abs(sx - fx - q)) for p in (0, 1) for q in (0, 1))
    assert made.keys() == want.keys()
    assert all(abs(made[c] - want[c]) < 1e-9 for c in want)
