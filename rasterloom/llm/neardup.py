"""Near duplicates by HyperMinHash registers, banding, estimation and exact verification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .components import connected_components
from .workspace import Scratch

#: Words in a shingle, and the least Jaccard similarity of linked documents in percent.
SHINGLE_WORDS, PERCENT = 5, 75
#: Registers of a signature; each holds leading zeros (6 bits) and mantissa (10 bits) of its bucket's smallest hash.
BUCKETS, MANTISSA_BITS = 256, 10
#: Registers in a band.  At similarity 0.75 all 51 bands miss with a chance of about 1e-6.
BAND_ROWS = 5
#: Standard deviations by which an estimate may fall short before a pair is dropped unverified.
SLACK = 5.0
#: Members of a key compared at once; larger keys are dealt over pairs of blocks.
GROUP_ROWS = 2048
#: Other buckets that an empty one asks in turn for their register.
DONORS = 96

U = np.uint64
_DONOR = np.random.Generator(np.random.PCG64(7)).integers(0, BUCKETS, size=(DONORS, BUCKETS))


def shingle_sets(texts: pa.Array, n: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text; fewer than ``n`` words count as one shingle, none as the empty set."""
    for lo, hi, data, offsets in hashing.text_blocks(texts):
        data = hashing.lower(data)
        starts, ends, first = hashing.word_spans(data, offsets)
        sums = hashing.prefix(hashing.word_hashes(data, starts, ends))
        at = np.arange(max(0, len(starts) - n + 1))
        grams = hashing.spans(sums, at, at + n)
        for row in range(hi - lo):
            a, b = int(first[row]), int(first[row + 1])
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            elif b > a:
                yield hashing.spans(sums, np.array([a]), np.array([b]))
            else:
                yield np.zeros(0, dtype=U)


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (16 bits each) of a non-empty set of sorted hashes.

    The leading 8 bits choose a bucket, the others compete for the smallest; kept are its
    number of leading zeros and the mantissa bits after its first one.  An empty bucket
    takes the register of the first non-empty bucket in its own fixed order of donors,
    so two sets agree in it as often as in any other.
    """
    bucket = (shingles >> U(56)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    own = bucket[head]
    value = (shingles[head] << U(8)) | U(0xFF)
    zeros = np.minimum(63 - np.floor(np.log2(value.astype(np.float64))), 62).astype(np.int64)
    zeros = np.maximum(zeros, 0)
    # the float may round up to the next power of two
    zeros += ((value << zeros.astype(U)) >> U(63) == 0) & (zeros < 62)
    mantissa = (value << (zeros + 1).astype(U)) >> U(64 - MANTISSA_BITS)
    out, full = np.zeros(BUCKETS, dtype=np.uint16), np.zeros(BUCKETS, dtype=bool)
    out[own] = (zeros << MANTISSA_BITS) + mantissa.astype(np.int64)
    full[own] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        found = full[_DONOR[:, empty]]
        donor = _DONOR[found.argmax(axis=0), empty]
        lost = ~found.any(axis=0)
        if lost.any():
            nearest = own[np.searchsorted(own, empty[lost]) % len(own)]
            donor[lost] = nearest
        out[empty] = out[donor]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for each row of registers."""
    bands = BUCKETS // BAND_ROWS
    grid = regs[:, :bands * BAND_ROWS].reshape(len(regs), bands, BAND_ROWS).astype(U)
    key = np.broadcast_to(np.arange(bands, dtype=U) + U(1), grid.shape[:2]).copy()
    for i in range(BAND_ROWS):
        key = hashing.mix(key * U(hashing.BASES[0]) + grid[:, :, i])
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from agreeing registers, less the share that would agree by chance.

    Unequal minima agree in both parts of a register with a chance of about
    2**-mantissa / 3 each, whatever the set sizes, as leading zeros of two random minima
    agree about a third of the time.
    """
    agree = (a == b).mean(axis=1)
    chance = 2.0 ** -MANTISSA_BITS / 3.0
    return np.clip((agree - chance) / (1.0 - chance), 0.0, 1.0)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_shingles, f1, f2, regs)``: size, 128-bit fingerprint and registers of each document's set."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, f1, f2, regs = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                sizes.append(len(s))
                f1.append(int(hashing.mix(s ^ U(1)).sum(dtype=U).view(np.int64)))
                f2.append(int(hashing.mix(s * U(3)).sum(dtype=U).view(np.int64)))
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(regs, pa.binary())],
                names=["id", "n_shingles", "f1", "f2", "regs"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_shingles long, f1 long, f2 long, regs binary")


def banded(reps: DataFrame) -> DataFrame:
    """``(key, id)`` for every band of every representative."""
    kind = dict(reps.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
            keys = band_keys(regs)
            at = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column("id").take(pa.array(at))], names=["key", "id"])

    return reps.select("id", "regs").mapInArrow(run, f"key long, id {kind}")


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``(a, b, lo, hi)``: bounds on the Jaccard distance of pairs from their sizes and registers."""
    kind = dict(pairs.dtypes)["a"]
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS) for c in ("r_a", "r_b"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            j = estimate(a, b)
            slack = SLACK * np.sqrt(0.25 / np.minimum(BUCKETS, np.maximum(n_a, n_b)))
            most = np.minimum(np.minimum(n_a, n_b) / np.maximum(n_a, n_b), j + slack)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(1 - most), pa.array(np.minimum(1.0, 1 - j + slack))], names=["a", "b", "lo", "hi"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, f"a {kind}, b {kind}, lo double, hi double")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b, d, linked)``: Jaccard distance on full sets, and 100 * intersection >= PERCENT * union."""
    kind = dict(pairs.dtypes)["a"]
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, linked = [], []
            for x, y in zip(shingle_sets(batch.column("t_a")), shingle_sets(batch.column("t_b")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                d.append(1 - both / max(1, union))
                linked.append(both > 0 and 100 * both >= PERCENT * union)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "d", "linked"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(
        run, f"a {kind}, b {kind}, d double, linked boolean")


def across(loose: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between members of a key whose components differ, on full sets.

    ``loose(key, id, c, deals)`` is dealt by key; a key of several blocks meets pair by pair
    of blocks.  In a task, members outside a key's largest component look up all others
    through postings of shingles.
    """
    kind = dict(loose.dtypes)["id"]
    block = F.pmod(F.xxhash64("id"), F.col("deals")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("deals") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    dealt = loose.withColumn("block", block).withColumn("meet", F.explode(pairs)).select("key", "meet.i", "meet.j", "id", "c")
    rows = dealt.join(texts, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "id", "c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "id", "c")), sets, strict=True):
                if row[:3] != last and held:
                    yield from linked(held)
                    held = []
                held.append(row[3:])
                last = row[:3]
        if held:
            yield from linked(held)

    def linked(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, comps, sets = zip(*held, strict=True)
        numbers = {c: k for k, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([numbers[c] for c in comps])
        main = np.bincount(comp).argmax()
        size = np.array([len(x) for x in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        doc = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(code, kind="stable")
        posting, first = doc[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
        start = np.concatenate([[0], np.cumsum(size)])
        u, v = [], []
        for x in np.flatnonzero(comp != main).tolist():
            mine = code[start[x]:start[x + 1]]
            lo, n = first[mine], first[mine + 1] - first[mine]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            both = np.bincount(posting[at], minlength=len(sets))
            hit = (100 * both >= PERCENT * (size + size[x] - both)) & (comp != comp[x])
            for y in np.flatnonzero(hit).tolist():
                u.append(max(ids[x], ids[y]))
                v.append(min(ids[x], ids[y]))
        if u:
            kinds = pa.array(ids).type
            yield pa.RecordBatch.from_arrays([pa.array(u, kinds), pa.array(v, kinds)], names=["u", "v"])

    return rows.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every document.

    Documents with equal shingle sets form classes; the smallest id stands for each.
    Representatives that share a band key are candidates.  First each key's smallest
    member is compared with the others, where the register estimate allows; the links found
    join most members of a group.  Then the members of a key that are still in different
    components are compared with each other on their full sets, key by key, inside the tasks:
    only links leave them, so a group costs rows in proportion to its size.

    Null and empty texts have no shingles, link with nothing and are kept.  Rows with the
    same id are one document: all get its component.  Rows with a null id are returned with
    a null component and kept.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "neardup")
    sets = scratch.table(signatures(docs, id_col, text_col), "sets")
    named = sets.where("id is not null")
    classes = scratch.table(
        named.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep")), "classes")
    member = named.select("id", "f1", "f2", "n_shingles").join(classes, ["f1", "f2"]).select("id", "rep")
    # an id with several rows joins the classes of all of them
    same = member.groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("u")).where("u <> v").select("u", "v")
    reps = scratch.table(
        named.where("n_shingles > 0").join(classes.withColumnRenamed("rep", "id"), ["f1", "f2", "id"])
        .select("id", "n_shingles", "regs", "f1", "f2").dropDuplicates(["f1", "f2", "id"]).select("id", "n_shingles", "regs"), "reps")
    keys = banded(reps)
    centers = scratch.table(keys.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a"), "centers")
    shared = scratch.table(keys.join(centers, "key").select("key", F.col("id").alias("b"), "a"), "shared")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def fetched(ids: DataFrame) -> DataFrame:
        """Texts of the given documents; a merge join whatever the sizes, so that small runs foretell large ones."""
        return scratch.table(source.join(ids.hint("merge"), "id").dropDuplicates(["id"]), "texts")

    stars = scratch.table(estimated(shared.where("a <> b").select("a", "b").distinct(), reps), "stars")
    hopeful = stars.where(F.col("lo") <= 1 - PERCENT / 100 + 1e-9).select("a", "b")
    ids = hopeful.select(F.col("a").alias("id")).unionByName(hopeful.select(F.col("b").alias("id"))).distinct()
    exact = scratch.table(compared(hopeful, fetched(ids)), "compared")
    scratch.release()
    links = exact.where("linked").select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(same)
    found = scratch.table(connected_components(links, scratch), "components")
    # members of a key that the stars left apart
    at = shared.join(found.select(F.col("node").alias("b"), "component"), "b", "left").select("key", F.col("b").alias("id"), F.coalesce("component", "b").alias("c"))
    apart = at.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    loose = scratch.table(at.join(apart.select("key", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("deals")), "key"), "loose")
    if not loose.isEmpty():
        more = scratch.table(across(loose, fetched(loose.select("id").distinct())), "across")
        found = scratch.table(connected_components(links.unionByName(more), scratch), "components")
    of = member.groupBy("id").agg(F.min("rep").alias("rep")).join(
        found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    return (
        sets.select("id", "n_shingles").join(of, "id", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
