"""Fast suppression held against all pairs, rows of one id, missing values and boxes of very different sizes among them."""

import math
import random

from pyspark.sql import functions as F

from rasterloom.operators import nms


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w < 0 or h < 0:
        return 0.0
    size = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / size if size else 0.0


def test_all_pairs(spark):
    rng, rows = random.Random(11), []
    for k in range(900):
        side = rng.choice([8, 30, 60, 300, 3000])
        x, y = rng.uniform(0, 400), rng.uniform(0, 400)
        rows.append((k % 5, k % 400, round(rng.random(), 1), (x, y, x + rng.uniform(0, side), y + rng.uniform(0, side))))
    rows += [(0, 1, 0.5, (10.0, 10.0, 10.0, 10.0)), (0, 2, None, (0.0, 0.0, 300.0, 300.0)), (1, 3, 0.5, (math.nan, 0.0, 1.0, 1.0)), (None, 4, 0.1, (0.0, 0.0, 9.0, 9.0)), (None, 5, 0.9, (0.0, 0.0, 9.0, 9.0))]
    schema = "image_id int, det_id long, score double, box struct<x1:double,y1:double,x2:double,y2:double>"
    df = spark.createDataFrame(rows, schema).repartition(3)

    def beats(a, b):
        return a[0] == b[0] is not None and a[2] is not None and b[2] is not None and (a[2], a[1]) > (b[2], b[1]) and iou(a[3], b[3]) > 0.1

    want = sorted(map(repr, (r for r in rows if not any(beats(a, r) for a in rows))))
    made = nms.fast_nms(df, ["image_id"], 0.1)
    got = sorted(repr((r["image_id"], r["det_id"], r["score"], tuple(r["box"]))) for r in made.collect())
    assert got == want
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        # cells that go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(repr((r["image_id"], r["det_id"], r["score"], tuple(r["box"]))) for r in nms.fast_nms(df, ["image_id"], 0.1).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert nms.fast_nms(df.where(F.lit(False)), ["image_id"], 0.1).count() == 0
