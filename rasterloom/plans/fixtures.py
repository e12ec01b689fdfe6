"""Views of the shared tables as annotations and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import box as B

#: The same text runs in both engines.
BOXES_SQL = """
select l_orderkey % 997 as image_id,
  ((l_orderkey*10+l_linenumber)*1000000+l_partkey)*10000+l_suppkey as det_id,
  cast(l_partkey % 512 as double) as x1,
  cast((l_suppkey*37+l_linenumber*11) % 512 as double) as y1,
  cast(l_partkey % 512 as double)+l_quantity as x2,
  cast((l_suppkey*37+l_linenumber*11) % 512 as double)+1+(l_partkey*7+l_linenumber) % 64 as y2,
  l_linenumber % 3 as class_idx,
  l_discount+l_tax as score
from {lineitem}
"""

PIXELS_DUCK = "select vec_id, (i-1)//8 as y, (i-1)%8 as x, embedding[i]::double as v, (embedding[i]>0)::int as b from embeddings, unnest(range(1,65)) r(i)"
CORR_SQL = "select o_orderpriority, cast(o_custkey%100 as double) as x, cast(o_orderkey%97 as double) as y from {orders}"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections ``image_id, det_id, class_idx, score, box`` of lineitem rows."""
    flat = spark.sql(BOXES_SQL.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))
    return flat.select("image_id", "det_id", "class_idx", "score", B.make(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("box"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 rasters ``vec_id, y, x, v, b`` of embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    return rows.select("vec_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), F.col("e").cast("double").alias("v"), (F.col("e") > 0).cast("int").alias("b"))


def correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points ``o_orderpriority, x, y`` and where an affine transform takes them, ``u, v``."""
    base = spark.sql(CORR_SQL.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))
    return base.withColumns({"u": 2 * F.col("x") - F.col("y") + 3, "v": F.col("x") + 0.5 * F.col("y") - 1})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.col("event_type").alias("class"))
