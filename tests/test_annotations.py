"""Segmentations of mixed form, and heatmaps brought to one grid, held against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import matrix as M
from rasterloom.functions import segmentation
from rasterloom.operators import heatmap, runlength

SQUARE = [[0, 0], [4, 0], [4, 3], [0, 3]]
COUNTS = [3, 100, 7, 250, 1, 4000, 30, 609]
FORMS = [
    (None, None, None), ("null", None, None), ("[]", None, None),
    (json.dumps([0, 0, 4, 0, 4, 3, 0, 3]), "polygon", 12.0), (json.dumps([[0, 0, 4, 0, 4, 3, 0, 3], [0.5, 0, 1.5, 0, 1.5, 1]]), "multipolygon", 12.5),
    (json.dumps({"exterior": SQUARE, "interiors": [[[1, 1], [2, 1], [2, 2], [1, 2]]]}), "polygon", 11.0), (json.dumps({"exterior": SQUARE}), "polygon", 12.0),
    (json.dumps([{"exterior": SQUARE}, {"exterior": SQUARE, "interiors": []}]), "multipolygon", 24.0),
    (json.dumps({"type": "Polygon", "coordinates": [[*SQUARE, SQUARE[0]]]}), "polygon", 12.0), (json.dumps({"type": "MultiPolygon", "coordinates": [[[*SQUARE, SQUARE[0]]]]}), "multipolygon", 12.0),
    (json.dumps({"size": [50, 100], "counts": COUNTS}), "mask", 4959.0), (json.dumps({"shape": [50, 100], "counts": runlength.pack_counts(COUNTS), "order": "C"}), "mask", 4959.0),
    (json.dumps({"size": [0, 4], "counts": []}), "mask", 0.0)]


def test_forms_keep_order_and_count(spark):
    df = spark.createDataFrame([(k, i, FORMS[(i + k) % len(FORMS)][0]) for k in range(3) for i in range(len(FORMS))], "k int, i int, text string").repartition(4)
    lists = df.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda e: F.parse_json(e["text"])).alias("items"))
    out = lists.select("k", F.posexplode(segmentation.coerce_list(F.col("items"))).alias("i", "s")).select("k", "i", "s.kind", "s.mask", segmentation.area(F.col("s")).alias("area")).collect()
    assert len(out) == 3 * len(FORMS)
    for r in out:
        text, kind, area = FORMS[(r["i"] + r["k"]) % len(FORMS)]
        assert (r["kind"], r["area"]) == (kind, area), text
        if kind == "mask" and area:
            assert r["mask"]["counts"] == COUNTS and r["mask"]["order"] == ("C" if "order" in text else "F") and (r["mask"]["height"], r["mask"]["width"]) == (50, 100)


@pytest.mark.parametrize("policy", segmentation.NULL_POLICIES)
def test_null_policies(spark, policy):
    df = spark.createDataFrame([(None,), ("null",)], "text string").select(segmentation.coerce(F.parse_json("text"), policy).alias("s"))
    whole = spark.range(1).select(segmentation.coerce_list(F.lit(None).cast("array<variant>"), policy).alias("s"))
    for d in (df, whole):
        if policy == "raise":
            with pytest.raises(Exception, match="cannot accept null"):
                d.collect()
        else:
            assert {r["s"] for r in d.collect()} == {None}
    with pytest.raises(KeyError):
        segmentation.coerce(F.lit(None), "drop")


@pytest.mark.parametrize("bad", ['"text"', "7", "[1, 2, 3]", "[[1, 2], 5]", '{"a": 1}', '{"counts": [1, 2]}', '{"counts": [1, 2], "size": [2, 2]}', '{"counts": [-1, 5], "size": [2, 2]}', '{"type": "Point", "coordinates": [1, 2]}', '[{"exterior": [[0, 0]]}, {"b": 1}]'])
def test_others_are_refused(spark, bad):
    with pytest.raises(Exception, match="cannot interpret segmentation"):
        spark.createDataFrame([(bad,)], "text string").select(segmentation.coerce(F.parse_json("text"), "return-None").alias("s")).collect()


def test_compressed_counts(spark):
    rng = np.random.default_rng(2)
    cases = [[], [0], [5], [0, 31, 32], *[rng.integers(0, 1 << 20, n).tolist() for n in (3, 4, 40)]]
    df = spark.createDataFrame([(i, runlength.pack_counts(c)) for i, c in enumerate(cases)], "i int, t string").select("i", segmentation.unpack_counts(F.col("t")).alias("c"))
    assert {r["i"]: r["c"] for r in df.collect()} == dict(enumerate(cases))


MAPS = {"a": (np.random.default_rng(1).uniform(0, 1, (5, 7)), np.array([[2, 0, 0.5], [0, 3, -1], [0, 0, 1.0]])), "b": (np.random.default_rng(2).uniform(0, 1, (9, 4)), np.array([[1.5, 0.5, -2], [-0.5, 2, 3], [0, 0, 1.0]])), "c": (np.ones((3, 3)), None)}


def brute(a, to_img, target, height, width):
    back = np.linalg.inv(np.eye(3) if to_img is None else to_img) @ target
    out = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            u, v, w = back @ (x, y, 1)
            sx, sy = u / w, v / w
            for iy in (int(np.floor(sy)), int(np.floor(sy)) + 1):
                for ix in (int(np.floor(sx)), int(np.floor(sx)) + 1):
                    if 0 <= iy < a.shape[0] and 0 <= ix < a.shape[1]:
                        out[y, x] += a[iy, ix] * (1 - abs(sy - iy)) * (1 - abs(sx - ix))
    return out


def test_heatmaps_align_and_combine(spark):
    maps = spark.createDataFrame([(k, y, x, float(v), 1) for k, (a, _) in MAPS.items() for (y, x), v in np.ndenumerate(a)], "k string, y int, x int, v double, height int").repartition(3)
    flat = lambda m: None if m is None else tuple(float(v) for v in np.ravel(m))
    struct = "struct<" + ",".join(f"{n}:double" for n in M.NAMES) + ">"
    grid = MAPS["a"][1] * [[1], [1], [1]]
    frames = spark.createDataFrame([(k, flat(m), flat(grid), 6, 8) for k, (_, m) in MAPS.items()], f"k string, to_img {struct}, target {struct}, height int, width int")
    want = {k: brute(a, m, grid, 6, 8) for k, (a, m) in MAPS.items()}
    aligned = heatmap.align(maps, frames, ["k"])
    rows = aligned.collect()
    assert len(rows) == 3 * 48
    for r in rows:
        assert abs(r["v"] - want[r["k"]][r["y"], r["x"]]) < 1e-9
    both = heatmap.combine(aligned.where("k <> 'c'").withColumn("g", F.lit(1)), ["g"])
    for r in both.collect():
        assert abs(r["v"] - np.sqrt(want["a"][r["y"], r["x"]] * want["b"][r["y"], r["x"]])) < 1e-9
    for r in heatmap.upscale(maps, frames.drop("target"), ["k"]).collect():
        assert abs(r["v"] - brute(*MAPS[r["k"]], np.eye(3), 6, 8)[r["y"], r["x"]]) < 1e-9
    odd = frames.withColumn("to_img", F.when(F.col("k") == "a", M.make(0, 0, 0, 0, 0, 0)).otherwise(F.col("to_img"))).withColumn("width", F.when(F.col("k") == "b", F.lit(None)).otherwise(F.col("width")))
    got = heatmap.align(maps, odd, ["k"]).groupBy("k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {"a": 48, "c": 48} and next(r["s"] for r in got if r["k"] == "a") == 0
    assert heatmap.align(maps.where("false"), frames.where("false"), ["k"]).count() == 0
