"""Annotation expressions over streams: stateless, so they need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import box as B
from ..operators.detections import ANNOTATION


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of annotation files, one JSON record a line."""
    return spark.readStream.schema("value string").text(folder).select(F.from_json("value", ANNOTATION).alias("a")).select("a.*")


def canonical(stream: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes clipped to the image, with their areas; records without a box are dropped."""
    boxed = stream.where(F.size("bbox") == 4).withColumn("box", B.clip(B.from_format("xywh", *[F.get("bbox", i) for i in range(4)]), 0, 0, width, height))
    return boxed.select("id", "image_id", "category_name", "box", B.area(F.col("box")).alias("area"))


def write(stream: DataFrame, folder: str, checkpoint: str):
    """Appends to Parquet exactly once; ends when what is there has been read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
