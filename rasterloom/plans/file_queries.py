"""Queries of tiled image files: mosaics of embeddings are written, and windows, bands and overviews of them read; :mod:`.queries` adds them to its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import durable, tiles
from ..sources import tiff
from . import fixtures
from .queries import PIXELS, q6, query, r6

TILE = 16
#: Three images of 8x8 embeddings side by side, sixteen a row.
MOSAIC = f"{PIXELS}, mosaic as (select cast(vec_id%3 as varchar) as name, vec_id//3//16*8+y as y, vec_id//3%16*8+x as x, v from pixels_v)"


def mosaic(spark, sf_dir) -> DataFrame:
    """Pixels ``name, y, x, v`` of the mosaics."""
    k = F.floor(F.col("vec_id") / 3)
    return fixtures.pixels(spark, sf_dir).select(
        (F.col("vec_id") % 3).cast("string").alias("name"), (F.floor(k / 16) * 8 + F.col("y")).alias("y"), (k % 16 * 8 + F.col("x")).alias("x"), "v")


def files(pixels: DataFrame, **options) -> DataFrame:
    """Tiles of the files that ``pixels`` (``name, band, y, x, v``) are written to."""
    spark = pixels.sparkSession
    folder = durable.shared_folder(spark, "tiff")
    shape = tiles.sizes(pixels, ["name"])
    made = tiles.tiled(pixels, ["name", "band"], TILE).drop("height", "width").join(shape, "name")
    tiff.write_tiles(made, folder, TILE, **options)
    return tiff.read_tiles(spark, folder)


@query("tiff_window", f"with {MOSAIC} select name, y, x, {q6('v', 'v')} from mosaic where y >= 5 and y < 75 and x >= 20 and x < 100")
def tiff_window(spark, sf_dir):
    held = files(mosaic(spark, sf_dir).withColumn("band", F.lit(0)))
    return tiff.window(held, 5, 75, 20, 100).select("name", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("v", "v"))


@query("tiff_overview_nearest", f"with {MOSAIC} select name, y//4 as y, x//4 as x, {q6('v', 'v')} from mosaic where y%4=0 and x%4=0")
def tiff_overview_nearest(spark, sf_dir):
    held = files(mosaic(spark, sf_dir).withColumn("band", F.lit(0)), overviews=2)
    return tiff.window(held, 0, 1 << 30, 0, 1 << 30, 2).select("name", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("v", "v"))


@query("tiff_overview_average", f"with {MOSAIC} select name, y//2 as y, x//2 as x, {q6('avg(v)', 'v')} from mosaic group by 1, 2, 3")
def tiff_overview_average(spark, sf_dir):
    held = files(mosaic(spark, sf_dir).withColumn("band", F.lit(0)), dtype="float64", overviews=1, how="average")
    return tiff.window(held, 0, 1 << 30, 0, 1 << 30, 1).select("name", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("v", "v"))


@query("tiff_bands", f"with {MOSAIC} select name, 1 as band, y, x, round_even(least(-v, 1)*200, 0) as v from mosaic where v < 0")
def tiff_bands(spark, sf_dir):
    signed = mosaic(spark, sf_dir).withColumn("band", F.explode(F.array(F.lit(0), F.lit(1))))
    part = F.when(F.col("band") == 0, F.col("v")).otherwise(-F.col("v"))
    held = files(signed.withColumn("v", F.when(part > 0, F.bround(F.least(part, F.lit(1.0)) * 200))), dtype="uint8", nodata=255)
    return tiff.window(held.where("band = 1"), 0, 1 << 30, 0, 1 << 30).select("name", "band", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")
