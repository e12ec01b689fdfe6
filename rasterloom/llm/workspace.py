"""Places that every executor can read: intermediate tables and checkpoints.

The folder comes from ``spark.checkpoint.dir``.  Only when the session has none and runs
on one machine (``local``, as in tests) is a temporary folder made and registered; on a
cluster a missing setting is an error, as executors would write to their own disks.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the folder shared by driver and executors."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Scratches made within each open ``passing`` block.
_passing: list[list[Scratch]] = []


@contextmanager
def passing() -> Iterator[None]:
    """Deletes, once the block has ended, all tables of scratches made in it: its results must be written elsewhere by then."""
    made: list[Scratch] = []
    _passing.append(made)
    try:
        yield
    finally:
        _passing.remove(made)
        for scratch in made:
            delete(scratch.spark, scratch.root)


class Scratch:
    """Written tables of one query; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = fresh_path(spark, name)
        self.n = 0
        if _passing:
            _passing[-1].append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back, so a lost executor costs no recomputation."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Lets Spark's cleaner delete shuffle files of steps whose results are written.

        The cleaner acts when the driver's collectors find a plan unreachable, which can be
        long after a table that replaces it is on disk.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, table._scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
