"""Running sums along a sort order that no single task holds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .workspace import Scratch


def swept(df: DataFrame, order: Sequence[Column | str], value: str, scratch: Scratch, name: str) -> DataFrame:
    """``df`` range-sorted by ``order`` and written, with ``_pid``, its range, and ``_at``, the sum of ``value`` over earlier rows of that range.

    ``order`` should tell rows apart, as equal ones share a range.  Ranges are cut by a
    sample of ``df``, which should therefore be a written table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sums = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False), dtype=np.int64) + total
            before = sums - batch.column(value).to_numpy(zero_copy_only=False)
            total = int(sums[-1]) if len(sums) else total
            yield batch.append_column("_at", pa.array(before))

    schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    return scratch.table(dealt.mapInArrow(scan, f"{schema}, _at long"), name)


def range_offsets(table: DataFrame, value: str, key: str | None = None) -> DataFrame:
    """What to add to ``_at`` of :func:`swept`: ``(_pid[, key], offset, total)``.

    With ``key``, by which the table must be sorted first, sums run within its values:
    ``offset`` counts a key's earlier ranges and takes off what lies before the key in this
    one, and ``total`` is the key's whole sum.  One row for each range and key in it.
    """
    keys = [key] if key else []
    each = table.groupBy("_pid", *keys).agg(F.sum(value).cast("long").alias("_sum"), F.min("_at").alias("_first"))
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = own.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) - (F.col("_first") if key else F.lit(0))
    return each.select("_pid", *keys, offset.cast("long").alias("offset"), F.sum("_sum").over(own).cast("long").alias("total"))
