"""Cross-tokenizer alignment: groups of tokens between common cuts, links, and link counts over the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe, slices
from .workspace import Scratch

#: Pairs a task holds before it merges them, and counts it holds before it hands them on.
HELD_PAIRS, HELD_COUNTS = 4 << 20, 1 << 20

#: Most frequent pairs sent to every task, 17 bytes each; documents look all others up by a join.
HEAD_PAIRS = 1 << 18

#: Salts of a pair in the first stage of counting.
SALTS = 16

#: Bytes of packed pairs in one Arrow batch; one document's at least.
BATCH_BYTES = 4 << 20


class PieceBPE:
    """Ids of whole texts by a sentence-piece model, and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.token_bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.token_bytes.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.space = self.model.piece_to_id("▁")
        # slices are right only if no piece holds a space after another character
        self.sliced = all("▁" not in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size()))

    def encode(self, text: str) -> np.ndarray:
        parts = list(slices(text)) if self.sliced else [text]
        # the model puts a space before a text, which a later slice has already
        ids = [[self.space] if k and p == " " else self.model.encode(p[1:] if k else p) for k, p in enumerate(parts)]
        return np.concatenate([np.array(x, dtype=np.uint32) for x in ids])


class Aligner:
    """Both tokenizers with the lengths of their tokens, and the digits of ids for group strings."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = byte_bpe(byte_path), PieceBPE(piece_path)
        self.size_a = np.array([len(t) for t in self.a.token_bytes], dtype=np.int64)
        self.size_b = np.array([len(t) for t in self.b.token_bytes], dtype=np.int64)
        n = max(len(self.size_a), len(self.size_b))
        self.stride = len(self.size_b)
        self.marked = [f"{i}{mark}" for mark in ",|;" for i in range(n)]
        self.n = n

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by either tokenizer; none if there is no text or either's bytes aren't the text's."""
        if not text:
            return None
        a, b = self.a.encode(f" {text}", specials=False), self.b.encode(text)
        raw = f" {text}".encode()
        for ids, table in ((a, self.a.token_bytes), (b, self.b.token_bytes)):
            if b"".join(map(table.__getitem__, ids.tolist())) != raw:
                return None
        return a, b

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, str]:
        """Number of groups, indices of linked tokens in ``a`` and ``b``, and the groups' sha256."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        # tokens of b that overlap each token of a: from the first that ends after its start to the first that ends at or after its end
        first = np.searchsorted(end_b, end_a - self.size_a[a], side="right")
        n = np.searchsorted(end_b, end_a, side="left") - first + 1
        link_a = np.repeat(np.arange(len(a)), n)
        link_b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)
        # ids in the order of the string, each with the mark that follows it
        text = np.empty(len(a) + len(b), dtype=np.int64)
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        text[np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")] = a + self.n * last_a
        text[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = b + 2 * self.n * last_b
        joined = "".join(map(self.marked.__getitem__, text.tolist()))[:-1]
        return len(cuts), link_a, link_b, hashlib.sha256(joined.encode()).hexdigest()


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compress well where most are small."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel().astype(np.int64)


def documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: its counts, groups' sha256, and its distinct pairs, ascending, with how often each is linked.

    A pair is one number, ``first id * stride + second id``; ``pairs`` holds differences.
    """
    schema = f"id {dict(docs.dtypes)[id_col]}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        for batch in batches:
            lo, rows, held = 0, [], 0
            for row, text in enumerate(batch.column(1)):
                tokens = both.tokens(text.as_py())
                if tokens is None:
                    rows.append((0, 0, 0, 0, "", b"", b""))
                else:
                    a, b = tokens
                    groups, link_a, link_b, sha = both.align(a, b)
                    pairs, times = np.unique(a[link_a].astype(np.int64) * both.stride + b[link_b], return_counts=True)
                    rows.append((len(a), len(b), groups, len(link_a), sha, packed(np.diff(pairs, prepend=0)), packed(times)))
                held += 16 * len(rows[-1][-1]) // 8 + 100
                if held >= BATCH_BYTES or row == batch.num_rows - 1:
                    columns = [batch.column(0).slice(lo, len(rows)), *(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:4])]
                    columns += [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[4:], (pa.string(), pa.binary(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", *names])
                    lo, rows, held = row + 1, [], 0

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def merged(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their counts."""
    found, which = np.unique(pairs, return_inverse=True)
    return found, np.bincount(which, weights=counts, minlength=len(found)).astype(np.int64)


def pair_counts(table: DataFrame) -> DataFrame:
    """``(pair, n)``: how many documents hold each pair.

    A task counts what its documents hold and hands on one row for each pair; rows are
    summed by pair and salt, then by pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def merge() -> None:
            nonlocal done, total, held, size
            if held:
                fresh = np.concatenate(held)
                done, total = merged(np.concatenate([done, fresh]), np.concatenate([total, np.ones(len(fresh), np.int64)]))
                held, size = [], 0

        for batch in batches:
            for data in batch.column(0):
                held.append(np.cumsum(unpacked(data.as_py())))
                size += len(held[-1])
                if size >= HELD_PAIRS:
                    merge()
                    if len(done) >= HELD_COUNTS:
                        yield pa.RecordBatch.from_arrays([pa.array(done), pa.array(total)], names=["pair", "n"])
                        done, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        merge()
        yield pa.RecordBatch.from_arrays([pa.array(done), pa.array(total)], names=["pair", "n"])

    counted = table.select("pairs").mapInArrow(run, "pair long, n long")
    salted = counted.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = salted.groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    return first.groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How two tokenizers cut each text, and how common its links are in the corpus.

    ``byte_path`` is a byte-level vocabulary file (A, of a space and the text),
    ``piece_path`` a sentence-piece model (B, which puts that space itself).  Cuts are the
    byte offsets where tokens of both end; tokens between two cuts are a group; tokens that
    share a byte are linked.  The count of a pair of ids is the number of documents in
    which they are linked.  Returns the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best`` (links whose count is the highest of their A id), ``count_sum`` (over links)
    and ``groups_sha256``.

    Documents are tokenized once; what is kept of each is its distinct pairs.  The most
    frequent pairs, at most ``HEAD_PAIRS``, go to every task; documents meet the counts of
    all others in a join, so no table that grows with the corpus is broadcast.  The highest
    count of each A id is broadcast: at most one number for each id of the vocabulary.

    Null and empty texts, and those whose tokens' bytes are not a space and the text, have
    no tokens: zeros and an empty string.  Repeated rows count each; texts of any length
    are encoded whole, in slices; extra columns are ignored whatever their names; an empty
    table has no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    table = scratch.table(documents(docs, byte_path, piece_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "documents")
    stride = aligner(byte_path, piece_path).stride
    found = scratch.table(pair_counts(table), "pairs")
    first = F.floor(F.col("pair") / stride)
    best = found.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    tier = F.floor(F.log2("n") * 8)
    counts = scratch.table(
        found.withColumn("first", first).join(F.broadcast(best), "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), tier.alias("tier")), "counts")
    # eight tiers for each doubling of counts
    least, room, rest = None, HEAD_PAIRS, False
    for r in counts.groupBy("tier").count().orderBy(F.desc("tier")).collect():
        if rest := r["count"] > room:
            break
        least, room = r["tier"], room - r["count"]
    head = counts.where(F.col("tier") >= least) if least is not None else counts.where("false")
    known = head.select("pair", "n", "best").toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]
    types = dict(table.dtypes)

    def links(pairs: bytes, times: bytes) -> tuple[np.ndarray, ...]:
        """A document's pairs and times, and where the pairs are in the head, if they are."""
        pair, n = np.cumsum(unpacked(pairs)), unpacked(times)
        keys = sent.value[0]
        at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        return pair, n, at, keys[at] == pair if len(keys) else np.zeros(len(pair), dtype=bool)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, counted, top = sent.value
            best, total = [], []
            for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                _, n, at, hit = links(pairs.as_py(), times.as_py())
                at, n = at[hit], n[hit]
                best.append(int(n[top[at]].sum()) if len(at) else 0)
                total.append(int((n * counted[at]).sum()) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=[*kept, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pairs, times in zip(*(batch.column(c) for c in ("row", "pairs", "times")), strict=True):
                pair, n, _, hit = links(pairs.as_py(), times.as_py())
                if not hit.all():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int((~hit).sum()), row.as_py())), pa.array(pair[~hit]), pa.array(n[~hit])], names=["row", "pair", "times"])

    scored = table.mapInArrow(score, ", ".join(f"{c} {types[c]}" for c in kept) + ", n_best long, count_sum long")
    if rest:
        rare = table.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, times long").join(counts.select("pair", "n", "best"), "pair")
        more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
        scored = scored.join(more, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return scored.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
