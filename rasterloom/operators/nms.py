"""Non-maximum suppression within groups of detections."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import cells, level, levels_of

#: Groups with more boxes than this leave the expression engine for vectorised NumPy.
MAX_NATIVE_GROUP = 64


def available_nms_impls() -> list[str]:
    return ["auto", "native", "numpy"]


def _greedy(boxes: Column, thresh: float, bias: float) -> Column:
    """Kept ids of an array of boxes ordered by falling score."""
    kind = "array<struct<_score:double,_id:bigint,x1:double,y1:double,x2:double,y2:double>>"
    size = lambda b: (b["x2"] - b["x1"] + bias) * (b["y2"] - b["y1"] + bias)

    def hits(k, b):
        w = F.greatest(F.least(k["x2"], b["x2"]) - F.greatest(k["x1"], b["x1"]) + bias, F.lit(0.0))
        h = F.greatest(F.least(k["y2"], b["y2"]) - F.greatest(k["y1"], b["y1"]) + bias, F.lit(0.0))
        return F.coalesce(F.try_divide(w * h, size(k) + size(b) - w * h), F.lit(0.0)) > thresh

    return F.aggregate(boxes, F.array().cast(kind), lambda kept, b: F.when(F.exists(kept, lambda k: hits(k, b)), kept).otherwise(F.array_append(kept, b)))


def non_max_suppression(
    dets: DataFrame, by: Sequence[str], thresh: float = 0.5, bias: float = 0.0, id_col: str = "det_id",
    score_col: str | None = "score", class_col: str | None = None, impl: str = "auto",
) -> DataFrame:
    """Ids that greedy suppression keeps: ``by, [class,] id, rank`` with ``rank`` from 0 by falling score.

    A box goes if its IoU with a kept box of higher score exceeds ``thresh``; equal scores
    fall back on the greater id; an IoU of 0/0 counts as 0.  Missing scores count as 1.
    Suppression is sequential within a group.  ``auto`` folds groups up to
    ``MAX_NATIVE_GROUP`` boxes natively and sends larger ones to NumPy in Arrow batches,
    from one grouping; each group lies in one task, ``spatial_nms`` is for groups beyond
    a task's memory.
    """
    keys = [*by, class_col] if class_col else [*by]
    groups = _grouped(_rows(dets, keys, id_col, score_col), keys)
    if impl == "numpy":
        kept = _numpy_nms(groups, keys, thresh, bias)
    elif impl == "native":
        kept = _native_nms(groups, keys, thresh, bias)
    else:
        small = F.size("b") <= MAX_NATIVE_GROUP
        folded = groups.select(*keys, F.when(small, _greedy(F.col("b"), thresh, bias)).alias("folded"), F.when(~small, F.col("b")).alias("b"))
        kept = _numpy_nms(folded, keys, thresh, bias, "folded")
    return kept.select(*keys, F.col("e._id").alias(id_col), "rank")


def _rows(dets: DataFrame, keys: list[str], id_col: str, score_col: str | None) -> DataFrame:
    score = F.coalesce(F.col(score_col), F.lit(1.0)).cast("double") if score_col else F.lit(1.0)
    return dets.select(*keys, score.alias("_score"), F.col(id_col).cast("long").alias("_id"), *[F.col("box")[s].cast("double").alias(s) for s in ("x1", "y1", "x2", "y2")])


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's boxes in one array ``b``, by falling score, then id."""
    entry = F.struct((-F.col("_score")).alias("s"), (-F.col("_id")).alias("i"), "x1", "y1", "x2", "y2")
    fields = lambda e: F.struct((-e["s"]).alias("_score"), (-e["i"]).alias("_id"), *[e[c].alias(c) for c in ("x1", "y1", "x2", "y2")])
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("b")).withColumn("b", F.transform("b", fields))


def _native_nms(groups: DataFrame, keys: list[str], thresh: float, bias: float) -> DataFrame:
    """Kept entries ``e`` of each group with their ``rank``."""
    return groups.select(*keys, F.posexplode(_greedy(F.col("b"), thresh, bias)).alias("rank", "e")).select(*keys, "e", "rank")


def nms_indices(ltrb: np.ndarray, thresh: float, bias: float) -> list[int]:
    """Kept positions of boxes ordered by falling score."""
    x1, y1, x2, y2 = ltrb.T
    size = (x2 - x1 + bias) * (y2 - y1 + bias)
    left, kept = np.arange(len(ltrb)), []
    while len(left):
        i, left = left[0], left[1:]
        kept.append(int(i))
        w = np.clip(np.minimum(x2[i], x2[left]) - np.maximum(x1[i], x1[left]) + bias, 0, None)
        h = np.clip(np.minimum(y2[i], y2[left]) - np.maximum(y1[i], y1[left]) + bias, 0, None)
        with np.errstate(invalid="ignore", divide="ignore"):
            iou = np.nan_to_num(w * h / (size[i] + size[left] - w * h))
        left = left[iou <= thresh]
    return kept


def _entries(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list ends among the entries of all, and these, with fields that may be null, so that batches have one schema."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    names = [f.name for f in flat.type]
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pa.StructArray.from_arrays([flat.field(n) for n in names], names=names)


def _numpy_nms(groups: DataFrame, keys: list[str], thresh: float, bias: float, done: str | None = None) -> DataFrame:
    """Kept entries ``e`` of each group with their ``rank``; groups whose ``done`` is not null have their kept entries there."""
    kinds = dict(groups.dtypes)

    def rows(batch: pa.RecordBatch, entries: pa.Array, kept: list[np.ndarray]) -> pa.RecordBatch:
        n = [len(k) for k in kept]
        owner = pa.array(np.repeat(np.arange(len(kept)), n))
        at = pa.array(np.concatenate([*kept, []]).astype(np.int64))
        rank = pa.array(np.concatenate([*map(np.arange, n), []]).astype(np.int32))
        return pa.RecordBatch.from_arrays([*[batch.column(k).take(owner) for k in keys], entries.take(at), rank], names=[*keys, "e", "rank"])

    def run(batches):
        for batch in batches:
            ends, entries = _entries(batch.column("b"))
            ltrb = np.stack([entries.field(s).to_numpy(zero_copy_only=False) for s in ("x1", "y1", "x2", "y2")], axis=1)
            yield rows(batch, entries, [np.add(nms_indices(ltrb[lo:hi], thresh, bias), lo) for lo, hi in zip(ends[:-1], ends[1:], strict=True)])
            if done:
                ends, entries = _entries(batch.column(done))
                yield rows(batch, entries, [np.arange(lo, hi) for lo, hi in zip(ends[:-1], ends[1:], strict=True)])

    entry = kinds["b"].removeprefix("array<").removesuffix(">")
    kept = [*keys, "b", *([done] if done else [])]
    return groups.select(*kept).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"e {entry}", "rank int"]))


def fast_nms(dets: DataFrame, by: Sequence[str], thresh: float = 0.5, id_col: str = "det_id", score_col: str = "score", class_col: str | None = None, size: float = 64.0) -> DataFrame:
    """Rows that no box of higher score overlaps by more than ``thresh``: not greedy, fully parallel."""
    keys = [*by, class_col] if class_col else [*by]
    parts = ["x1", "y1", "x2", "y2"]
    slim = dets.select(*keys, F.col(id_col).alias("_id"), F.col(score_col).alias("_score"), "box").where(F.col(score_col).isNotNull() & F.col(id_col).isNotNull())
    levels = levels_of(slim, "box", size)
    own = level(F.col("box"), size)
    known = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda n: n >= own)
    cell = [F.col("_cell")[c].alias(f"_{c}") for c in ("level", "cx", "cy")]
    groups = [*keys, "_level", "_cx", "_cy"]
    known_keys = [F.col(k).isNotNull() for k in keys]
    dealt = slim.where(functools.reduce(Column.__and__, known_keys)).withColumn("_own", own).withColumn("_cell", F.explode(cells(F.col("box"), known, size))).select(
        *keys, *cell, "_score", "_id", *[F.col("box")[c].cast("double").alias(c) for c in parts], (F.col("_own") == F.col("_cell.level")).alias("_large"))
    kinds = dict(dealt.dtypes)
    values = ["_score", "_id", *parts]

    def run(batches):
        # rows come sorted by cell; the last one's may go on in the next batch
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None and held.num_rows else rows
            ends = _group_ends(rows, groups)
            held = rows.slice(ends[-2])
            yield from gone(rows, ends[:-1])
        if held is not None and held.num_rows:
            yield from gone(held, [0, held.num_rows])

    def gone(rows, ends):
        d = [rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in (*values, "_large")]
        found = [lo + beaten_of(*[v[lo:hi] for v in d], thresh) for lo, hi in zip(ends[:-1], ends[1:], strict=True) if hi - lo > 1]
        at = pa.array(np.concatenate([*found, np.zeros(0, dtype=np.int64)]).astype(np.int64))
        yield from rows.select([*keys, *values]).take(at).combine_chunks().to_batches()

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, *values))
    beaten = dealt.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, schema).select(
        *keys, F.col("_id").alias(id_col), *[F.col(c).alias(f"_{c}") for c in ("_score", *parts)])
    # a row is told by its values, as an id can occur twice
    told = dets.withColumns({"__score": F.col(score_col), **{f"_{c}": F.col("box")[c].cast("double") for c in parts}})
    return told.join(beaten, [*keys, id_col, "__score", *[f"_{c}" for c in parts]], "left_anti").select(*dets.columns)


def _group_ends(rows: pa.Table, groups: Sequence[str]) -> list[int]:
    """Where groups of a sorted table begin, and its end."""
    new = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for c in groups:
        held = rows[c].combine_chunks()
        new |= pc.not_equal(held.slice(1), held.slice(0, max(len(held) - 1, 0))).to_numpy(zero_copy_only=False).astype(bool)
    return [0, *(np.flatnonzero(new) + 1).tolist(), rows.num_rows]


def beaten_of(score, ids, x1, y1, x2, y2, large, thresh: float, at_once: int = 32) -> np.ndarray:
    """Positions of the boxes that one of higher score (or of equal score and higher id) overlaps by more than ``thresh``, of pairs with a ``large`` box.

    The best boxes are tried against all first, and what they beat is not tried again.
    """
    order = np.lexsort((ids, score))[::-1]
    score, ids, x1, y1, x2, y2, large = (v[order] for v in (score, ids, x1, y1, x2, y2, large))
    new = np.ones(len(order), dtype=bool)
    new[1:] = ~((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))) | (ids[1:] != ids[:-1])
    rank, area = np.cumsum(new), (x2 - x1) * (y2 - y1)
    left, gone = np.arange(len(order)), []
    for lo in range(0, len(order), at_once):
        # what is ranked above all attackers is safe from them
        left = left[np.searchsorted(rank[left], rank[lo], "right"):]
        if not len(left):
            break
        a, t = np.arange(lo, min(lo + at_once, len(order)))[:, None], left[None, :]
        w, h = np.minimum(x2[a], x2[t]) - np.maximum(x1[a], x1[t]), np.minimum(y2[a], y2[t]) - np.maximum(y1[a], y1[t])
        inter = np.maximum(w, 0) * np.maximum(h, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            iou = np.nan_to_num(inter / (area[a] + area[t] - inter), nan=0.0, posinf=0.0, neginf=0.0)
        hit = ((iou > thresh) & (w >= 0) & (h >= 0) & (rank[a] < rank[t]) & (large[a] | large[t])).any(axis=0)
        gone.append(left[hit])
        left = left[~hit]
    return order[np.concatenate([*gone, np.zeros(0, dtype=np.int64)]).astype(np.int64)]


def spatial_nms(dets: DataFrame, by: Sequence[str], diameter: float, thresh: float = 0.5, id_col: str = "det_id", score_col: str = "score", tile: float = 1024.0) -> DataFrame:
    """Approximate suppression for very large groups, on tiles of at least twice ``diameter``, the longest side of a box.

    Boxes are dealt over square tiles by their top left corner and suppressed there; the
    survivors go through tiles shifted by half along x, along y and along both.  Corners
    of two overlapping boxes are less than half a tile apart, so one of the four passes
    has both in one tile, and no two kept boxes overlap by more than ``thresh``.  Like any
    divide-and-conquer suppression it can differ from the exact one where chains of
    overlaps cross a border.
    """
    tile = max(tile, 2 * diameter)
    alive = _rows(dets, [*by], id_col, score_col)
    for dx, dy in ((0, 0), (tile / 2, 0), (0, tile / 2), (tile / 2, tile / 2)):
        dealt = alive.withColumns({"_tx": F.floor((F.col("x1") + dx) / tile), "_ty": F.floor((F.col("y1") + dy) / tile)})
        keys = [*by, "_tx", "_ty"]
        alive = _numpy_nms(_grouped(dealt, keys), keys, thresh, 0.0).select(*by, "e.*")
    return alive.select(*by, F.col("_id").alias(id_col))
