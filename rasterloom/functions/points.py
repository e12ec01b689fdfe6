"""Coordinates and keypoints: ``array<struct<x,y[,class_idx,visible]>>`` Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .box import num


def point(x, y) -> Column:
    return F.struct(num(x).cast("double").alias("x"), num(y).cast("double").alias("y"))


def map_xy(pts: Column, fx: Callable, fy: Callable, extra: tuple = ()) -> Column:
    """Each point with new coordinates; ``extra`` names fields to carry."""
    return F.transform(pts, lambda p: F.struct(fx(p).alias("x"), fy(p).alias("y"), *[p[e].alias(e) for e in extra]))


def translate(pts: Column, dx, dy, extra: tuple = ()) -> Column:
    return map_xy(pts, lambda p: p["x"] + num(dx), lambda p: p["y"] + num(dy), extra)


def scale(pts: Column, sx, sy=None, about=(0, 0), extra: tuple = ()) -> Column:
    ax, ay = map(num, about)
    sx, sy = num(sx), num(sx if sy is None else sy)
    return map_xy(pts, lambda p: (p["x"] - ax) * sx + ax, lambda p: (p["y"] - ay) * sy + ay, extra)


def rotate(pts: Column, theta, about=(0, 0), extra: tuple = ()) -> Column:
    ax, ay = map(num, about)
    c, s = F.cos(num(theta)), F.sin(num(theta))
    return map_xy(
        pts, lambda p: (p["x"] - ax) * c - (p["y"] - ay) * s + ax, lambda p: (p["x"] - ax) * s + (p["y"] - ay) * c + ay, extra)


def warp(pts: Column, m: Column) -> Column:
    from .matrix import warp_points

    return warp_points(m, pts)


def round_half_even(pts: Column, decimals: int = 0, extra: tuple = ()) -> Column:
    return map_xy(pts, lambda p: F.bround(p["x"], decimals), lambda p: F.bround(p["y"], decimals), extra)


def cast(pts: Column, kind: str) -> Column:
    return F.transform(pts, lambda p: F.struct(p["x"].cast(kind).alias("x"), p["y"].cast(kind).alias("y")))


def swap_axes(pts: Column) -> Column:
    return map_xy(pts, lambda p: p["y"], lambda p: p["x"])


def compress(values: Column, flags: Column) -> Column:
    """Elements whose flag is true; null arrays stay null."""
    both = F.arrays_zip(values.alias("v"), flags.alias("f"))
    return F.transform(F.filter(both, lambda z: z["f"]), lambda z: z["v"])


def take(values: Column, indices: Column) -> Column:
    """Elements at 0-based indices, in their order, repeats allowed."""
    return F.transform(indices, lambda i: F.get(values, i))


def concat(*arrays: Column) -> Column:
    return F.concat(*arrays)


def to_wkt(pts: Column) -> Column:
    body = F.array_join(F.transform(pts, lambda p: F.concat(F.lit("("), _number(p["x"]), F.lit(" "), _number(p["y"]), F.lit(")"))), ", ")
    return F.when(F.size(pts) > 0, F.concat(F.lit("MULTIPOINT ("), body, F.lit(")"))).otherwise(F.lit("MULTIPOINT EMPTY"))


def _number(v: Column) -> Column:
    """Shortest decimal form: whole numbers without a fraction."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def to_coco(pts: Column, style: str = "orig") -> Column:
    """``orig``: flat x, y, v (v 2 when missing); ``new``: structs with class index."""
    v = lambda p: F.coalesce(p["visible"], F.lit(2)).cast("double")
    if style == "orig":
        return F.flatten(F.transform(pts, lambda p: F.array(p["x"], p["y"], v(p))))
    return F.transform(pts, lambda p: F.struct(
        F.array(p["x"], p["y"]).alias("xy"), v(p).cast("int").alias("visible"), p["class_idx"].alias("keypoint_category_id")))


def from_coco(flat: Column) -> Column:
    """Keypoints of a flat x, y, v array; class index is the position."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / 3).cast("int") - 1), lambda i: F.struct(
        F.get(flat, i * 3).cast("double").alias("x"), F.get(flat, i * 3 + 1).cast("double").alias("y"), i.cast("int").alias("class_idx"), F.get(flat, i * 3 + 2).cast("int").alias("visible")))


def from_coco_json(text: Column) -> Column:
    """Keypoints of a COCO string, flat or a list of ``{xy, visible, keypoint_category_id}``; null where neither fits."""
    rich = F.from_json(text, "array<struct<xy:array<double>,visible:int,keypoint_category_id:int>>")
    flat = F.from_json(text, "array<double>")
    listed = F.transform(rich, lambda p: F.struct(
        p["xy"][0].alias("x"), p["xy"][1].alias("y"), p["keypoint_category_id"].alias("class_idx"), F.coalesce(p["visible"], F.lit(2)).alias("visible")))
    return F.when(text.rlike(r"^\s*\[\s*\{"), listed).when(F.size(flat) % 3 == 0, from_coco(flat))


def random(seed: int, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(1 << 30)) / float(1 << 30)).alias("x"), (F.pmod(F.xxhash64(F.lit(seed + 1), i), F.lit(1 << 30)) / float(1 << 30)).alias("y")))
