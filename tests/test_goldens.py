"""Known results and invariants of single operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import box as B
from rasterloom.functions import color as C
from rasterloom.functions import matrix as M
from rasterloom.functions import points as P
from rasterloom.functions import polygon as G
from rasterloom.operators import detections, draw, joins, nms, packed, raster, runlength
from rasterloom.sources import images


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_box_goldens(spark):
    assert tuple(value(spark, B.to_format(B.make(5, 5, 50, 50), "xywh"))) == (5, 5, 45, 45)
    assert [value(spark, B.area(B.make(*b))) for b in ((0, 0, 10, 10), (5, 5, 50, 50), (20, 0, 30, 10))] == [100, 2025, 100]
    assert tuple(value(spark, B.to_format(B.quantize(B.from_format("xywh", 0.5, 0, 10, 10)), "xywh"))) == (0, 0, 11, 10)
    assert value(spark, B.height(B.resize(B.make(1, 1, 4, 4), new_width=10))) == 3
    one = [round(value(spark, B.iou(B.make(*b), B.make(6, 2, 20, 10), 1.0)), 2) for b in ((0, 0, 10, 10), (10, 0, 20, 10), (20, 0, 30, 10))]
    assert one == [0.21, 0.63, 0.04]
    assert [value(spark, B.isect_area(B.make(0, 0, 0, 0), B.make(0, 0, 0, 0), b)) for b in (0.0, 1.0)] == [0, 1]
    assert all(math.isnan(v) for v in value(spark, B.intersection(B.make(0, 0, 1, 1), B.make(2, 2, 3, 3))))
    assert math.isnan(value(spark, B.iou(B.make(0, 0, 0, 0), B.make(0, 0, 0, 0))))
    with pytest.raises(KeyError):
        B.canonical("what")


@pytest.mark.parametrize("impl", ["native", "numpy", "auto"])
@pytest.mark.parametrize("thresh,kept", [(0.5, [2, 1, 3]), (0.0, [2, 1]), (1.0, [2, 1, 3, 0])])
def test_nms_goldens(spark, impl, thresh, kept):
    boxes = [(0, 0, 100, 100, .1), (100, 100, 10, 10, .5), (10, 10, 100, 100, .9), (50, 50, 100, 100, .1)]
    d = spark.createDataFrame([(0, i, *map(float, b)) for i, b in enumerate(boxes)], "image_id int, det_id long, a double, b double, c double, d double, score double")
    d = d.select("image_id", "det_id", "score", B.make(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box"))
    got = nms.non_max_suppression(d, ["image_id"], thresh, impl=impl).orderBy("rank").collect()
    assert [r["det_id"] for r in got] == kept


def test_range_join_equals_all_pairs(spark):
    d = detections.random(spark, 60, 3, 300.0)
    near = joins.ious(d, d, ["image_id"], bias=1.0).where("iou > 0").select("l_det_id", "r_det_id", F.round("iou", 9))
    full = joins.all_ious(d, d, ["image_id"], bias=1.0).where("iou > 0").select("l_det_id", "r_det_id", F.round("iou", 9))
    assert set(map(tuple, near.collect())) == set(map(tuple, full.collect())) and near.count() == full.count()


def test_matrix_algebra(spark):
    m = M.affine((2, 3), (5, -1), 0.7, 0.2)
    d = value(spark, M.decompose(m))
    assert [round(v, 9) for v in d] == [5, -1, 2, 3, 0.2, 0.7]
    assert value(spark, M.isclose_identity(M.matmul(M.inv(m), m)))
    p = value(spark, M.decompose_projective(M.projective((2, 3), (5, -1), 0.7, 0.2, (0.001, 0.002))))
    assert [round(v, 6) for v in p] == [5, -1, 2, 3, 0.2, 0.7, 0.001, 0.002]
    assert value(spark, M.det(F.lit(None).cast("struct<" + ",".join(f"{n}:double" for n in M.NAMES) + ">"))) == 1
    turned = value(spark, M.warp_point(M.fliprot(None, 1, (4, 3)), P.point(3, 1)))
    assert tuple(turned) == (1, 0)


def test_fits(spark):
    rows = [("two", 0., 0., 1., 1.), ("two", 1., 0., 1., 3.), ("one", 2., 2., 5., 1.)]
    got = {r["g"]: r for r in M.fit_affine(spark.createDataFrame(rows, "g string, x double, y double, u double, v double"), ["g"]).collect()}
    assert [round(got["two"][n], 9) for n in M.NAMES[:6]] == [0, -2, 1, 2, 0, 1]
    assert [got["one"][n] for n in M.NAMES[:6]] == [1, 0, 3, 0, 1, -1]
    h = np.array([[1.2, 0.1, 3], [-0.2, 0.9, 1], [0.001, 0.002, 1]])
    pts = [(float(x), float(y)) for x in range(4) for y in range(4)]
    img = [(h @ [x, y, 1]) for x, y in pts]
    f = M.fit_projective(spark.createDataFrame([("g", *p, float(q[0] / q[2]), float(q[1] / q[2])) for p, q in zip(pts, img, strict=True)], "g string, x double, y double, u double, v double"), ["g"]).first()
    assert np.allclose([f[n] for n in M.NAMES], h.ravel(), atol=1e-6)


def mask_frame(spark, a, key=0):
    return spark.createDataFrame([(key, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(a)], "k int, y int, x int, v int")


def test_run_lengths(spark):
    assert runlength.encode_array([1, 0, 1, 1, 1, 0, 0, 1, 0]) == [0, 1, 1, 3, 2, 1, 1] and runlength.encode_array([]) == []
    a = np.random.default_rng(0).integers(0, 2, (4, 5))
    mask = runlength.encode_masks(mask_frame(spark, a), ["k"]).first()["mask"]
    assert list(mask["counts"]) == runlength.encode_array(a.ravel(order="F"))
    for counts in ([0, 3, 5], [7, 1, 100, 2000, 3, 1], [54], [0, 1]):
        assert runlength.unpack_counts(runlength.pack_counts(counts)) == counts
    t = value(spark, runlength.from_text(F.lit("o"), "."))
    assert t["data"] == [1]


def test_translate_every_small_mask(spark):
    masks = [np.array(bits).reshape(2, 3) for bits in itertools.product((0, 1), repeat=6)]
    frame = None
    for i, a in enumerate(masks):
        f = [(i, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(a)]
        frame = f if frame is None else frame + f
    encoded = runlength.encode_masks(spark.createDataFrame(frame, "k int, y int, x int, v int"), ["k"])
    for (dx, dy), (h, w) in itertools.product(((1, 1), (0, 0), (-1, -1)), ((4, 4), (2, 3), (2, 2))):
        got = {r["k"]: r["mask"] for r in runlength.translate(encoded, ["k"], dx, dy, h, w).collect()}
        for i, a in enumerate(masks):
            want = np.zeros((h, w), int)
            for (y, x), v in np.ndenumerate(a):
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    want[y + dy, x + dx] = v
            flat = [k % 2 for k, n in enumerate(got[i]["counts"]) for _ in range(n)]
            assert flat == want.ravel(order="F").tolist()


def test_polygons(spark):
    square = G.from_coco(F.array(*map(F.lit, (0., 0., 4., 0., 4., 2., 0., 2.))))
    assert value(spark, G.area(square)) == 8 and tuple(value(spark, G.centroid(square))) == (2, 1)
    holed = F.concat(square, F.array(F.array(P.point(1, 0.5), P.point(2, 0.5), P.point(2, 1.5), P.point(1, 1.5))))
    assert value(spark, G.area(holed)) == 7
    assert value(spark, G.to_wkt(square)) == "POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))"
    assert value(spark, G.to_coco(square)) == [0, 0, 4, 0, 4, 2, 0, 2] and value(spark, G.to_coco(holed)) is None
    assert tuple(value(spark, G.box(G.scale(square, 2, about="centroid")))) == (-2, -1, 6, 3)
    ring = value(spark, G.exterior(G.oriented(G.map_rings(square, F.reverse))))
    assert packed.ring_area(np.array(ring)) == 8
    kinds = {'[1,2,3,4]': "polygon", '[[1,2,3,4]]': "multipolygon", '{"counts":"04","size":[2,2]}': "rle", '{"type":"Polygon","coordinates":[]}': "geojson"}
    for text, kind in kinds.items():
        assert value(spark, G.segmentation_kind(F.lit(text))) == kind
    masks = draw.to_masks(spark.range(1).select("id", square.alias("poly")), ["id"], 3, 6).first()["mask"]
    assert sum(masks["counts"][1::2]) == 10


def test_shapes():
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(200, 2))
    hull = packed.convex_hull(pts)
    cx, cy, w, h, t = packed.oriented_box(pts)
    assert w >= h and -math.pi / 2 <= t < math.pi / 2 and w * h >= packed.ring_area(hull)
    r = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    local = (pts - [cx, cy]) @ r.T
    assert np.abs(local[:, 0]).max() <= w / 2 + 1e-9 and np.abs(local[:, 1]).max() <= h / 2 + 1e-9
    a, b = np.array([[0, 0], [2, 0], [2, 2], [0, 2]]), np.array([[1, 1], [3, 1], [3, 3], [1, 3]])
    assert packed.convex_iou(a, b) == pytest.approx(1 / 7)
    assert len(packed.simplify(np.array([[0, 0], [1, 0.01], [2, 0]]), 0.1)) == 2
    assert np.allclose(packed.morph_rings(a, a, 0.5), a)
    m = np.zeros((5, 5), int)
    m[1:4, 1:4] = 1
    m[2, 2] = 0
    rings = packed.contours(m)
    assert sorted(packed.ring_area(x) for x in rings) == [1, 9]


def test_resampling():
    a = np.random.default_rng(0).random((9, 7, 3))
    for kind in ("nearest", "linear", "cubic", "lanczos"):
        assert np.allclose(packed.warp(a, np.eye(3), 9, 7, kind), a)
        assert np.allclose(packed.resize(np.ones((6, 6, 1)), 11, 4, kind), 1)
    shifted = packed.warp(a, np.array([[1, 0, 2], [0, 1, 1], [0, 0, 1.]]), 9, 7)
    assert np.allclose(shifted[1:, 2:], a[:-1, :-2]) and np.allclose(shifted[0], 0)
    assert np.allclose(packed.resize(a, 3, 7, "area"), a.reshape(3, 3, 7, 3).mean(axis=1))
    assert np.allclose(packed.fourier_mask(a, np.ones((9, 7))), a)
    assert packed.target_size(100, 200, max_dim=50) == (25, 50) and packed.letterbox(a, 20, 20).shape == (20, 20, 3)
    with pytest.raises(ValueError):
        packed.target_size(1, 1, scale=2, max_dim=3)


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    for i, (shape, kind) in enumerate([((4, 5, 3), np.uint8), ((3, 6, 1), np.uint8), ((2, 2, 4), np.uint16)]):
        a = rng.integers(0, 200, shape).astype(kind)
        assert (images.decode(images.encode_png(a)) == a).all()
        (tmp_path / f"{i}.png").write_bytes(images.encode_png(a))
    (tmp_path / "p.ppm").write_bytes(images.encode_pnm(rng.integers(0, 255, (2, 3, 3))))
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert tuple(got["0.png"]["shape"]) == (4, 5, 3) and tuple(got["p.ppm"]["shape"]) == (2, 3, 3)
    assert images.to_array(got["2.png"]["raster"]).shape == (2, 2, 4)
    frame = images.read_images(spark, str(tmp_path)).select("path", "raster")
    px = images.to_pixels(frame, ["path"])
    assert px.count() == 4 * 5 * 3 + 3 * 6 + 2 * 2 * 4 + 2 * 3 * 3
    small = frame.select("path", packed.resize_udf(2, 2, "area")("raster").alias("raster"))
    assert {(r["raster"]["height"], r["raster"]["width"]) for r in small.collect()} == {(2, 2)}
    from rasterloom.__main__ import main

    main(["stack", str(tmp_path / "0.png"), str(tmp_path / "1.png"), str(tmp_path / "out.png"), "--axis", "0"])
    assert images.decode((tmp_path / "out.png").read_bytes()).shape == (7, 6, 3)


def test_colors(spark):
    for rgb in ((0.2, 0.4, 0.9), (1.0, 0.0, 0.0), (0.5, 0.5, 0.5)):
        cols = tuple(map(F.lit, rgb))
        for space in ("hsv", "hls", "lab"):
            back = C.convert(C.convert(cols, "rgb", space), space, "rgb")
            assert [round(value(spark, c), 4) for c in back] == [round(v, 4) for v in rgb]
    assert value(spark, C.to_hex(F.lit(1.0), F.lit(0.5), F.lit(0.0))) == "#ff7f00"
    assert value(spark, C.from_hex(F.lit("#ff8000"))) == [1.0, 128 / 255, 0.0]
    named = C.resolve(spark.createDataFrame([("red",), ("#00ff00",), ("nonsense",)], "c string"), "c").collect()
    assert {r["c"]: r["rgb"] for r in named} == {"red": [1, 0, 0], "#00ff00": [0, 1, 0], "nonsense": None}


def test_components(spark):
    a = np.array([[1, 1, 0, 0, 1], [0, 0, 0, 1, 1], [1, 0, 1, 0, 0], [1, 1, 1, 0, 1]])
    got = {r["label"]: r["area"] for r in raster.connected_components(mask_frame(spark, a), ["k"], 4).collect()}
    assert sorted(got.values()) == [1, 2, 3, 5]
    assert sorted(r["area"] for r in raster.connected_components(mask_frame(spark, a), ["k"], 8).collect()) == [1, 2, 8]


def test_stream(spark, tmp_path):
    from rasterloom.streaming import annotate

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id":1,"image_id":2,"bbox":[-5,0,20,10],"category_name":"x"}\n{"id":2}\n')
    q = annotate.write(annotate.canonical(annotate.read_annotations(spark, str(tmp_path / "in")), 10, 10), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r["id"], r["area"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 100.0)]


def test_boxes_of_any_size_meet_without_many_cells(spark):
    rng = np.random.default_rng(1)

    def table(n):
        corner, side = rng.uniform(-300, 300, (n, 2)), np.exp(rng.uniform(0, 9, (n, 2)))
        rows = [(i % 2, i, *map(float, (*c, *(c + s)))) for i, (c, s) in enumerate(zip(corner, side, strict=True))]
        inf, nan = float("inf"), float("nan")
        return rows + [(0, n, -5e7, -5e7, 5e7, 5e7), (1, n + 1, -inf, 0.0, inf, 1.0), (0, n + 2, nan, 0.0, 1.0, 1.0), (0, n + 3, 64.0, 64.0, 64.0, 64.0)]

    def frame(rows):
        flat = spark.createDataFrame(rows, "image_id int, id int, x1 double, y1 double, x2 double, y2 double")
        return flat.select("image_id", "id", F.struct("x1", "y1", "x2", "y2").alias("box"))

    a, b = table(40), table(50)
    meet = lambda p, q: p[0] == q[0] and max(p[2], q[2]) <= min(p[4], q[4]) and max(p[3], q[3]) <= min(p[5], q[5]) and not any(math.isnan(v) for v in p[2:] + q[2:])
    got = joins.overlapping_pairs(frame(a), frame(b), ["image_id"]).select("l_id", "r_id").collect()
    assert sorted(map(tuple, got)) == sorted((p[1], q[1]) for p in a for q in b if meet(p, q))
    assert joins.overlapping_pairs(frame(a).where("false"), frame(b), ["image_id"]).count() == 0

    # one giant box meets all small ones, which do not meet each other on its level
    small = [(0, i, float(x), float(y), float(x) + 20, float(y) + 20) for i, (x, y) in enumerate(rng.integers(0, 100_000, (3_000, 2)))]
    mixed = frame([*small, (0, 9_999, 0.0, 0.0, 5e7, 5e7)])
    levels = joins.levels_of(mixed, "box", 64.0)
    assert len(levels) == 2
    left, right = (joins.dealt(mixed, "box", levels, 64.0, role).groupBy("_role", "cell").count() for role in (0, 1))
    met = left.join(right.withColumnRenamed("count", "other"), ["_role", "cell"]).agg(F.sum(F.col("count") * F.col("other"))).first()[0]
    assert met < 20 * len(small)

    at = [(i % 2, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2000, 2000, (60, 2)))]
    points = spark.createDataFrame(at, "image_id int, pid int, x double, y double")
    got = joins.points_in_boxes(points, frame(b), ["image_id"]).select("pid", "id").collect()
    assert sorted(map(tuple, got)) == sorted((p[1], q[1]) for p in at for q in b if p[0] == q[0] and q[2] <= p[2] <= q[4] and q[3] <= p[3] <= q[5])


def test_suppression_agrees_and_tiles_leave_no_overlap(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 3, i, float(rng.random()), *map(float, (x, y, x + 30, y + 30))) for i, (x, y) in enumerate(rng.uniform(0, 300, (400, 2)))]
    rows.append((7, 400, None, 0.0, 0.0, 0.0, 0.0))
    # one pair across a border in x and a shifted border in y
    rows += [(8, 401, 0.9, 59.0, 29.0, 89.0, 59.0), (8, 402, 0.8, 61.0, 31.0, 91.0, 61.0)]
    dets = spark.createDataFrame(rows, "image_id int, det_id long, score double, x1 double, y1 double, x2 double, y2 double")
    dets = dets.select("image_id", "det_id", "score", F.struct("x1", "y1", "x2", "y2").alias("box"))
    auto, native, numpy = (sorted(map(tuple, nms.non_max_suppression(dets, ["image_id"], 0.4, impl=i).collect())) for i in ("auto", "native", "numpy"))
    assert auto == native == numpy
    kept = {r["det_id"] for r in nms.spatial_nms(dets, ["image_id"], 30.0, 0.4, tile=60.0).collect()}
    assert 401 in kept and 402 not in kept and 400 in kept
    left = [r for r in rows if r[1] in kept and r[0] < 3]
    for a in left:
        for b in left:
            if a[0] == b[0] and a[1] < b[1]:
                both = max(0.0, min(a[5], b[5]) - max(a[3], b[3])) * max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
                assert both / (1800 - both) <= 0.4


@pytest.mark.parametrize("side", [1, 2, 3, 9])
def test_blur_reflects_at_borders(spark, side):
    image = (np.arange(side * side) % 7).astype(float).reshape(side, side)
    pixels = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(side) for x in range(side)], "image_id int, y int, x int, v double")
    k = raster.gaussian_kernel(7)
    line = lambda v: np.convolve(np.pad(v, 3, mode="reflect") if side > 1 else np.repeat(v, 7), k, "valid")
    want = np.apply_along_axis(line, 0, np.apply_along_axis(line, 1, image))
    got = {(r["y"], r["x"]): r["v"] for r in raster.gaussian_blur(pixels, ["image_id"], 7).collect()}
    assert len(got) == side * side
    assert all(abs(got[y, x] - want[y, x]) < 1e-9 for y in range(side) for x in range(side))
