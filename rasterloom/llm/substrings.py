"""Substring deduplication over a log-structured index of window fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .workspace import Scratch

#: Words in a window, and in the grams of which a window's smallest hash is its fingerprint.
WINDOW, GRAM = 20, 8

U = np.uint64


class Windows:
    """Windows of a block of texts: their prefix sums and fingerprints, by document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int, check: bool = False):
        self.window = window
        self.starts, self.ends, self.first = hashing.word_spans(data, offsets)
        self.sums = [hashing.prefix(hashing.word_hashes(data, self.starts, self.ends, k), k) for k in range(1 + check)]
        n = len(self.starts)
        at = np.arange(max(0, n - gram + 1))
        self.marks = hashing.sliding_min(hashing.spans(self.sums[0], at, at + gram), window - gram + 1)

    def of(self, row: int) -> tuple[int, int]:
        """First word of the row's first window and the number of its windows."""
        a, b = int(self.first[row]), int(self.first[row + 1])
        return a, max(0, b - a - self.window + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        return hashing.spans(self.sums[which], starts, ends, which)

    def stretches(self, row: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs [i, j) of windows with one fingerprint, where that is in ``wanted``."""
        a, n = self.of(row)
        if not n or not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        marks = self.marks[a:a + n]
        cut = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
        stop = np.append(cut[1:], n)
        hit = np.isin(marks[cut], wanted)
        return a + cut[hit], a + stop[hit]


def _rows(batch: pa.RecordBatch, column: str, window: int, gram: int, check: bool) -> Iterator[tuple[int, int, Windows]]:
    for lo, hi, data, offsets in hashing.text_blocks(batch.column(column)):
        w = Windows(data, offsets, window, gram, check)
        for row in range(hi - lo):
            yield lo + row, row, w


def _longs(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy().view(U) if value.is_valid else np.zeros(0, U)


def _keyed(batch: pa.RecordBatch, at: list[int], parts: list[list[np.ndarray]], names: Sequence[str]) -> pa.RecordBatch:
    counts = [len(x) for x in parts[0]]
    ids = batch.column("id").take(pa.array(np.repeat(np.array(at, dtype=np.int64), counts)))
    cols = [pa.array(np.concatenate(p).view(np.int64)) for p in parts]
    return pa.RecordBatch.from_arrays([*cols, ids], names=[*names, "id"])


class FingerprintIndex:
    """Runs of ``(h, id)``, bucketed and sorted by fingerprint, one per batch until compacted.

    A window's fingerprint is the smallest hash of its ``gram``-word grams, so equal windows
    have equal fingerprints and a text has about one for every seven words.  ``ingest``
    writes a batch's run, merge-joins it with every earlier run bucket by bucket, and
    verifies the hits on whole windows of the texts concerned: stretches of windows first,
    then single windows where a stretch has not been seen whole.  Windows are compared by
    two 64-bit hashes.  ``compact`` merges runs; nothing is updated in place.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, id_type: str, window: int = WINDOW, gram: int = GRAM, fan_in: int = 4):
        self.spark, self.scratch, self.id_type = spark, scratch, id_type
        self.window, self.gram, self.fan_in = window, gram, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[DataFrame] = []
        self.texts: list[DataFrame] = []

    def _bucketed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """A table in the shared folder whose joins and groups on ``key`` need no exchange."""
        table = f"rl_{name}_{uuid.uuid4().hex}"
        (df.repartition(self.buckets, key).sortWithinPartitions(key).write.option("path", self.scratch.path(name))
         .option("compression", "zstd").bucketBy(self.buckets, key).sortBy(key).saveAsTable(table))
        self.scratch.release()
        return self.spark.table(table)

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Adds ``batch(id, text)``, whose ids must all exceed those before; returns ``(id, text, stretches, windows)``.

        ``stretches`` and ``windows`` hold the hashes of what an earlier document has too.
        """
        texts = self._bucketed(batch, "id", "texts")
        run = self._bucketed(self._fingerprints(texts), "h", "run")
        own = run.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).withColumn("seen", F.col("lo") < F.col("hi"))
        for old in self.runs:
            had = old.groupBy("h").agg(F.lit(True).alias("had"))
            own = own.join(had, "h", "left").withColumn("seen", F.col("seen") | F.col("had").isNotNull()).drop("had")
        shared = self._bucketed(own.where("seen").select("h"), "h", "shared")
        hits = reduce(DataFrame.unionByName, [r.join(shared, "h").select("id", "h") for r in [*self.runs, run]])
        hits = self.scratch.table(hits.groupBy("id").agg(F.collect_list("h").alias("hs")), "hits")
        involved = [t.join(hits, "id") for t in [*self.texts, texts]]
        whole = self._earlier(self.scratch.table(reduce(DataFrame.unionByName, map(self._stretches, involved)), "stretches"), "stretches")
        left = [t.join(whole, "id", "left") for t in involved]
        single = self._earlier(self.scratch.table(reduce(DataFrame.unionByName, map(self._windows, left)), "windows"), "windows")
        self.runs.append(run)
        self.texts.append(texts)
        if len(self.runs) >= self.fan_in:
            self.compact()
        return texts.join(hits, "id", "left").join(whole, "id", "left").join(single, "id", "left")

    def compact(self) -> None:
        """One run in place of all; rows are those of the runs."""
        self.runs = [self._bucketed(reduce(DataFrame.unionByName, self.runs).distinct(), "h", "run")]

    def _earlier(self, rows: DataFrame, name: str) -> DataFrame:
        """``(id, name)``: per document the keys ``h`` that a document with a smaller id has."""
        first = rows.groupBy("h", "c").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "c", "lo")
        first = self.scratch.table(first, f"first-{name}")
        later = rows.join(first, ["h", "c"]).where("id > lo")
        return self.scratch.table(later.groupBy("id").agg(F.collect_list("h").alias(name)), f"later-{name}")

    def _fingerprints(self, texts: DataFrame) -> DataFrame:
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, parts = [], []
                for i, row, w in _rows(batch, "text", window, gram, False):
                    a, n = w.of(row)
                    if n:
                        at.append(i)
                        parts.append(np.unique(w.marks[a:a + n]))
                if at:
                    yield _keyed(batch, at, [parts], ["h"])

        return texts.where("id is not null").select("id", "text").mapInArrow(run, f"h long, id {self.id_type}")

    def _stretches(self, involved: DataFrame) -> DataFrame:
        """``(h, c, id)`` of stretches whose fingerprint is shared; distinct within a document."""
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, h, c = [], [], []
                for i, row, w in _rows(batch, "text", window, gram, True):
                    lo, hi = w.stretches(row, _longs(batch.column("hs")[i]))
                    if len(lo):
                        one, first = np.unique(w.hashes(lo, hi + window - 1), return_index=True)
                        at.append(i)
                        h.append(one)
                        c.append(w.hashes(lo[first], hi[first] + window - 1, 1))
                if at:
                    yield _keyed(batch, at, [h, c], ["h", "c"])

        return involved.select("id", "text", "hs").mapInArrow(run, f"h long, c long, id {self.id_type}")

    def _windows(self, left: DataFrame) -> DataFrame:
        """``(h, c, id)`` of single windows in stretches that no earlier document has whole."""
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, h, c = [], [], []
                for i, row, w in _rows(batch, "text", window, gram, True):
                    lo, hi = w.stretches(row, _longs(batch.column("hs")[i]))
                    if not len(lo):
                        continue
                    rest = ~np.isin(w.hashes(lo, hi + window - 1), _longs(batch.column("stretches")[i]))
                    if rest.any():
                        starts = expand(lo[rest], hi[rest])
                        one, first = np.unique(w.hashes(starts, starts + window), return_index=True)
                        at.append(i)
                        h.append(one)
                        c.append(w.hashes(starts[first], starts[first] + window, 1))
                if at:
                    yield _keyed(batch, at, [h, c], ["h", "c"])

        return left.select("id", "text", "hs", "stretches").mapInArrow(run, f"h long, c long, id {self.id_type}")

    def cut(self, found: DataFrame, id_col: str) -> DataFrame:
        """Texts without the words that a repeated window covers; repeats inside one text count from the second on."""
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total, removed, spans, kept = [], [], [], []
                texts = batch.column("text")
                for i, row, w in _rows(batch, "text", window, gram, False):
                    a, n = w.of(row)
                    size = int(w.first[row + 1]) - a
                    gone = np.zeros(size, dtype=bool)
                    if n:
                        bad = repeats(w.hashes(np.arange(a, a + n), np.arange(a, a + n) + window))
                        lo, hi = w.stretches(row, _longs(batch.column("hs")[i]))
                        if len(lo):
                            whole = np.isin(w.hashes(lo, hi + window - 1), _longs(batch.column("stretches")[i]))
                            bad[expand(lo[whole], hi[whole]) - a] = True
                            starts = expand(lo[~whole], hi[~whole])
                            single = np.isin(w.hashes(starts, starts + window), _longs(batch.column("windows")[i]))
                            bad[starts[single] - a] = True
                        gone = covered(bad, window, size)
                    words = (texts[i].as_py() or "").encode().split()
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    total.append(size)
                    removed.append(int(gone.sum()))
                    spans.append(edges.reshape(-1, 2).tolist())
                    kept.append(b" ".join(words if not gone.any() else [x for x, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())],
                    names=[id_col, "n_words", "n_removed", "removed_spans", "kept_text"])

        return found.select("id", "text", "hs", "stretches", "windows").mapInArrow(
            run, f"{id_col} {self.id_type}, n_words long, n_removed long, removed_spans array<array<long>>, kept_text string")


def expand(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges [lo, hi)."""
    n = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)[:len(n)], n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)


def repeats(values: np.ndarray) -> np.ndarray:
    """Marks values that occurred before."""
    order = np.argsort(values, kind="stable")
    same = np.zeros(len(values), dtype=bool)
    same[order[1:]] = values[order[1:]] == values[order[:-1]]
    return same


def covered(bad: np.ndarray, window: int, size: int) -> np.ndarray:
    """Positions below ``size`` that a marked window of ``window`` covers."""
    at = np.flatnonzero(bad)
    change = np.bincount(at, minlength=size + 1) - np.bincount(at + window, minlength=size + 1)
    return np.cumsum(change[:-1]) > 0


def deduplicate_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, gram: int = GRAM, batches: int = 2, fan_in: int = 4,
) -> DataFrame:
    """``(id, n_words, n_removed, removed_spans, kept_text)`` of every document.

    A word goes if a window of ``window`` words that covers it starts earlier too: in a
    document with a smaller id, or before in the same one.  The documents enter a new index
    as ``batches`` batches in id order; the result doesn't depend on their number.

    Null and empty texts have no words.  Rows with the same id are one document: they don't
    remove words from each other.  Rows with a null id only lose repeats of their own.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numeric = kind in ("tinyint", "smallint", "int", "bigint")
    cuts: list = []
    if numeric and batches > 1:
        at = rows.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)])).first()[0]
        cuts = sorted(set(at or []))
    index = FingerprintIndex(spark, Scratch(spark, "substrings"), kind, window, gram, fan_in)
    found = []
    for i in range(len(cuts) + 1):
        part = rows
        if i:
            part = part.where(F.col("id") > cuts[i - 1])
        if i < len(cuts):
            part = part.where((F.col("id") <= cuts[i]) if i else (F.col("id") <= cuts[i]) | F.col("id").isNull())
        found.append(index.cut(index.ingest(part), id_col))
    return reduce(DataFrame.unionByName, found)
