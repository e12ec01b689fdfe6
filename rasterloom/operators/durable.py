"""Steps of iterative operators, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def _checkpoints(context: SparkContext) -> str:
    if not context.getCheckpointDir():
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rasterloom-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the cluster names, without its lineage.

    Only where none is named and all runs on one machine, as in tests, is a temporary
    folder made; on a cluster that is an error, as executors would write to their own disks.
    """
    _checkpoints(df.sparkSession.sparkContext)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for files that every executor reads and writes."""
    return f"{_checkpoints(spark.sparkContext)}/{name}-{uuid.uuid4().hex}"
