"""Detections: annotation records to tables and back, and joint geometry of their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import box as B
from ..functions import matrix as M
from ..functions import points as P
from ..functions import polygon as G

ANNOTATION = "id bigint, image_id bigint, category_id bigint, category_name string, bbox array<double>, score double, weight double, prob array<double>, keypoints string, segmentation string"

#: Category tables up to so many rows are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_CATEGORIES = 50_000


def parse_annotations(lines: DataFrame, column: str = "value") -> DataFrame:
    """One annotation per JSON text; polymorphic fields stay text."""
    return lines.select(F.from_json(column, ANNOTATION).alias("a")).select("a.*")


def _lookup(categories: DataFrame) -> DataFrame:
    small = categories.limit(MAX_BROADCAST_CATEGORIES + 1).count() <= MAX_BROADCAST_CATEGORIES
    return F.broadcast(categories) if small else categories


def from_annotations(annotations: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """``det_id, image_id, class_idx, class, score, weight, probs, box, keypoints, segmentation``.

    ``categories(class_idx, category_id, name, ...)`` gives the class by id, or by name
    where there is no id; without it classes are numbered by name.  Fields that are missing
    are null in every row.
    """
    base = annotations.select(
        F.col("id").alias("det_id"), "image_id", "category_id", "category_name", "score", "weight", F.col("prob").alias("probs"),
        F.when(F.size("bbox") == 4, B.from_format("xywh", *[F.get("bbox", i) for i in range(4)])).alias("box"),
        P.from_coco_json(F.col("keypoints")).alias("keypoints"), "segmentation")
    if categories is None:
        names = base.select("category_name").where("category_name is not null").distinct()
        categories = names.select((F.row_number().over(W.orderBy("category_name")) - 1).alias("class_idx"), F.lit(None).cast("bigint").alias("category_id"), F.col("category_name").alias("name"))
    c = _lookup(categories.select("class_idx", F.col("category_id").alias("_cid"), F.col("name").alias("class")))
    on = F.coalesce(F.col("category_id").cast("string"), F.concat(F.lit("="), F.col("category_name")))
    keys = c.select("class_idx", "class", F.explode(F.array_compact(F.array(F.col("_cid").cast("string"), F.concat(F.lit("="), F.col("class"))))).alias("_key"))
    return base.withColumn("_k", on).join(keys, F.col("_k") == F.col("_key"), "left").select(
        "det_id", "image_id", "class_idx", F.coalesce("class", "category_name").alias("class"), "score", "weight", "probs", "box", "keypoints", "segmentation")


def to_annotations(dets: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """``id, image_id, category_id, category_name, bbox, score, weight, keypoints, segmentation, json``."""
    out = dets
    if categories is not None:
        out = dets.join(_lookup(categories.select("class_idx", "category_id")), "class_idx", "left")
    else:
        out = dets.withColumn("category_id", F.lit(None).cast("bigint"))
    record = out.select(
        F.col("det_id").alias("id"), "image_id", "category_id", F.col("class").alias("category_name"), B.to_coco(F.col("box")).alias("bbox"),
        "score", "weight", F.to_json(P.to_coco(F.col("keypoints"))).alias("keypoints"), "segmentation")
    return record.withColumn("json", F.to_json(F.struct(*record.columns)))


def ancestors(categories: DataFrame, max_depth: int = 32) -> DataFrame:
    """``name, ancestor, depth`` along supercategories; a category is its own ancestor at depth 0."""
    edges = _lookup(categories.select(F.col("name").alias("_n"), "supercategory"))
    level = categories.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, max_depth + 1):
        level = level.join(edges, F.col("ancestor") == F.col("_n")).where("supercategory is not null and supercategory <> ancestor").select(
            "name", F.col("supercategory").alias("ancestor"), F.lit(depth).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def warp(dets: DataFrame, m: Column) -> DataFrame:
    """Boxes, keypoints and polygons under one transform."""
    return _joint(dets, {"box": lambda c: B.warp(c, m), "keypoints": lambda c: F.transform(c, lambda p: _moved(m, p)), "polygon": lambda c: G.warp(c, m)})


def _moved(m: Column, p: Column) -> Column:
    x, y = M.apply(M.or_eye(m), p["x"], p["y"])
    return F.struct(x.alias("x"), y.alias("y"), p["class_idx"].alias("class_idx"), p["visible"].alias("visible"))


def scale(dets: DataFrame, sx: float, sy: float | None = None) -> DataFrame:
    return warp(dets, M.scale(sx, sy))


def translate(dets: DataFrame, dx: float, dy: float) -> DataFrame:
    return warp(dets, M.translate(dx, dy))


def _joint(dets: DataFrame, change: dict) -> DataFrame:
    return dets.withColumns({c: f(F.col(c)) for c, f in change.items() if c in dets.columns})


def concatenate(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def compress(dets: DataFrame, flag: Column) -> DataFrame:
    return dets.where(flag)


def take(dets: DataFrame, ids: Sequence, id_col: str = "det_id") -> DataFrame:
    """Rows of the given ids, in their order under ``pos``, repeats included."""
    spark = dets.sparkSession
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "pos int, _id long")
    return asked.join(dets, F.col("_id") == F.col(id_col)).drop("_id").orderBy("pos")


def ranked(dets: DataFrame, by: Sequence[str], reverse: bool = True) -> DataFrame:
    """Adds ``rank`` from 1 by score; ties by id in the same direction."""
    order = (F.desc("score"), F.desc("det_id")) if reverse else (F.asc("score"), F.asc("det_id"))
    return dets.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def labels(class_name: Column, score: Column) -> Column:
    """``class @ 0.1234``; just the class without a score."""
    return F.when(score.isNull(), class_name).otherwise(F.concat(class_name, F.lit(" @ "), F.format_string("%.4f", score)))


def alphas(score: Column) -> Column:
    return F.sqrt(score)


def random(spark, n: int, seed: int = 0, size: float = 100.0, classes: int = 3) -> DataFrame:
    """Seeded detections of one image."""
    return spark.range(n).select(
        F.lit(0).cast("long").alias("image_id"), F.col("id").alias("det_id"), B.random(seed, size).alias("box"),
        F.floor(F.rand(seed + 10) * classes).cast("int").alias("class_idx"), F.rand(seed + 11).alias("score"))
