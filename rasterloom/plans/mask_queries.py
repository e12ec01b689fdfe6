"""Queries of masks that are warped, scaled and cut on their runs; :mod:`.queries` adds them to its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import maskwarp, runlength
from . import fixtures
from .queries import ID, PIXELS, query
from .tile_queries import MATRIX, TILTED

#: Scale of eight pixels to 20 by 13.
FACTORS = (2.5, 1.7)


def masks(spark, sf_dir, order: str) -> DataFrame:
    """``vec_id, mask``; every mask is kept whole."""
    pixels = fixtures.pixels(spark, sf_dir).select("vec_id", "y", "x", F.col("b").alias("v"))
    return runlength.encode_masks(pixels, ID, order)


def places(made: DataFrame) -> DataFrame:
    """``vec_id, area, place``: number of ones and the sum of their places in the mask's own order, from its runs."""
    runs = runlength.one_runs(made, ID)
    n = F.col("stop") - F.col("start")
    return runs.groupBy("vec_id").agg(F.sum(n).cast("long").alias("area"), F.sum((F.col("start") + F.col("stop") - 1) * n / 2).cast("long").alias("place"))


def warped_sql(matrix: np.ndarray, height: int, width: int, place: str) -> str:
    """Ones of the result by looking up every pixel's source."""
    u, v, w = (f"({float(r[0])!r}*x+{float(r[1])!r}*y+{float(r[2])!r})" for r in np.linalg.inv(matrix))
    return f"""with {PIXELS}, g as (select i//{width} as y, i%{width} as x from range({height * width}) r(i)),
 p as (select y, x, round_even({v}/{w}, 0) as sy, round_even({u}/{w}, 0) as sx from g)
 select s.vec_id, count(*) as area, cast(sum({place}) as bigint) as place from p join pixels_v s on s.y=p.sy and s.x=p.sx where s.b=1 group by 1"""


@query("mask_warp_affine", warped_sql(MATRIX, 11, 10, "p.x*11+p.y"))
def mask_warp_affine(spark, sf_dir):
    return places(maskwarp.warp_masks(masks(spark, sf_dir, "F"), ID, MATRIX, 11, 10))


@query("mask_warp_projective", warped_sql(TILTED, 10, 9, "p.y*9+p.x"))
def mask_warp_projective(spark, sf_dir):
    return places(maskwarp.warp_masks(masks(spark, sf_dir, "C"), ID, TILTED, 10, 9))


@query("mask_scale", warped_sql(np.diag([*FACTORS, 1.0]), 13, 20, "p.y*20+p.x"))
def mask_scale(spark, sf_dir):
    return places(maskwarp.scale_masks(masks(spark, sf_dir, "C"), ID, FACTORS))


@query("mask_patch", f"""with {PIXELS}, o as (select vec_id, y, x from pixels_v where b=1 and y > 1 and x > 2),
 m as (select vec_id, min(x) as x0, min(y) as y0, max(x)-min(x)+1 as w, max(y)-min(y)+1 as h from o group by 1)
 select vec_id, cast(x0 as bigint) as x, cast(y0 as bigint) as y, cast(h as bigint) as height, cast(w as bigint) as width, count(*) as area, cast(sum((o.x-x0)*h+o.y-y0) as bigint) as place from o join m using (vec_id) group by all""")
def mask_patch(spark, sf_dir):
    pixels = fixtures.pixels(spark, sf_dir).select("vec_id", "y", "x", F.when((F.col("y") > 1) & (F.col("x") > 2), F.col("b")).otherwise(0).alias("v"))
    cut = maskwarp.mask_patches(runlength.encode_masks(pixels, ID), ID)
    return cut.select("vec_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *[F.col(f"mask.{c}").cast("long").alias(c) for c in ("height", "width")]).join(places(cut), "vec_id")
