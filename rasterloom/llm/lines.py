"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

``signed_batch``, ``sketched`` and ``close`` do in Arrow batches what ``signatures``, ``sketches`` and ``linkable``
do as expressions (with another hash); no query calls them, tests hold the expressions against them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .components import connected_components
from .quality import let
from .workspace import Scratch

#: Lines of fewer words (blank lines) are left alone.
MIN_WORDS = 1
#: Characters of a shingle; one starts at every character.
SHINGLE_CHARS = 5
#: Links need 100 * intersection >= PERCENT * union of two lines' shingles.
PERCENT = 75
#: Signature values, and bands of them: band ``b`` takes the values ``(35 b + 6 i) mod VALUES``, so each value serves about two.
#: At similarity 0.75 all bands miss with a chance of 1.4 %, at 0.8 of 0.3 %, at 0.9 of 0.001 %.
VALUES, BANDS, ROWS = 48, 18, 5
#: Hashed items that a line gives each value's bucket on average.
ITEMS = 3
#: Classes of buckets, by remainder; the step between a band's buckets is a multiple of it.
CLASSES = 6
#: Leading bits of a hash that compete within a bucket.
PART = 52
#: Stands for a bucket without a value.
EMPTY = np.iinfo(np.uint64).max
#: Bits of the sketch that tells pairs apart before their texts are fetched.
ODD_BITS = 1024
ODD_WORDS = [f"o{i}" for i in range(ODD_BITS // 64)]
#: Bands whose keys are met at once; the others wait, so that fewer shuffled keys lie on disk.
AT_ONCE = 6
#: Sketches hold two bits of every signature value; at similarity 0.75 they differ in 12, deviation 3.9, at 0.1 in 43, deviation 5.
MAX_BITS_APART = 27

_W = r"\x20\x09-\x0D"


def numbered_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, line, l1, l2)`` of lines with a word; ``l1, l2`` is a 128-bit name of the line's text."""
    split = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    return split.where(F.col("line").rlike(rf"[^{_W}]")).select(
        "id", "pos", "line", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit("name"), "line").alias("l2"))


def line_values(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signature values of lines that lie end to end in ``data``, a row of ``VALUES`` each; ``EMPTY`` where nothing fell into a bucket."""
    n_lines = len(offsets) - 1
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(starts[:-1], offsets)
    n = np.maximum(np.diff(first) - (SHINGLE_CHARS - 1), 1)
    line = np.repeat(np.arange(n_lines), n)
    at = np.arange(len(line)) + (first[:-1] - (np.cumsum(n) - n))[line]
    hashes = H.spans(H.byte_prefix(data), starts[at], starts[np.minimum(at + SHINGLE_CHARS, first[1:][line])])
    full = VALUES * ITEMS
    turns = np.maximum(full // n, 1)[line]
    item = np.repeat(np.arange(len(line)), turns)
    turn = (np.arange(len(item)) - (np.cumsum(turns) - turns)[item]).astype(H.U)
    x = H.mix(hashes[item] + turn * H.U(H.BASES[0]))
    order, owner = x >> H.U(64 - PART), line[item]
    # a line of many shingles leaves out hashes above a bound, as lower ones fill its buckets
    top = np.where(n > full, (float(full << PART) / n).astype(H.U), H.U(1 << PART))
    kept = order < top[owner]
    bucket = ((x & H.U(0xFFF)) * H.U(VALUES) >> H.U(12)).astype(np.int64)
    values = np.full(n_lines * VALUES, EMPTY, dtype=H.U)
    np.minimum.at(values, (owner * VALUES + bucket)[kept], (turn << H.U(PART) | order)[kept])
    return values.reshape(n_lines, VALUES)


def signed_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``l1, l2, keys, s0, s1`` of a batch of ``l1, l2, line``."""
    blocks = [line_values(data, offsets) for _, _, data, offsets in H.text_blocks(batch.column(2))]
    values = np.concatenate(blocks) if blocks else np.zeros((0, VALUES), dtype=H.U)
    there = values != EMPTY
    named = np.where(there, H.mix(values + np.arange(1, VALUES + 1, dtype=H.U) * H.U(H.BASES[1])), H.U(0))
    keys, missing = np.zeros((len(values), BANDS), dtype=np.int64), np.zeros((len(values), BANDS), dtype=bool)
    for b in range(BANDS):
        chosen = [(35 * b + 6 * i) % VALUES for i in range(ROWS)]
        keys[:, b] = H.mix(np.bitwise_xor.reduce(named[:, chosen], axis=1) + H.U(b + 1)).view(np.int64)
        missing[:, b] = ~there[:, chosen].any(axis=1)
    bits = [np.where(there, (values >> H.U(i)) & H.U(1), H.U(0)) << np.arange(VALUES, dtype=H.U) for i in (0, 1)]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * BANDS, pa.int32()), pa.array(keys.ravel(), mask=missing.ravel()))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), lists, *[pa.array(np.bitwise_or.reduce(x, axis=1).view(np.int64)) for x in bits]], names=["l1", "l2", "keys", "s0", "s1"])


def shingle_hash(x: Column, byte: Column, *more: Column) -> Column:
    """Hash of the shingle from ``byte`` (from 1) of a line in UTF-32, and of ``more``."""
    return F.xxhash64(F.substring(x, byte, F.lit(4 * SHINGLE_CHARS)), *more)


def signatures(lines: DataFrame) -> DataFrame:
    """``(l1, l2, keys, s0, s1)`` of every distinct line: a key for each band of its MinHash signature, and bits of it.

    One hash a shingle chooses a bucket and competes in it; the smallest of each bucket is a
    signature value.  A line of few shingles hashes each again and again, and a later hash
    counts only where earlier ones left a bucket empty; a line of many shingles can leave out
    hashes above a bound, as lower ones fill its buckets.  So every line gives about ``ITEMS``
    hashes to a bucket, and lines of different length still agree in a value as often as their
    sets are similar.

    Copies are dropped by a shuffle on the line's name, the only one: a row for each hash
    then stays in its task, where a line's ``CLASSES`` classes of buckets, which no band
    leaves, are aggregated apart, so that a row updates few minima.
    """
    full = VALUES * ITEMS
    once = lines.select("l1", "l2", "line").dropDuplicates(["l1", "l2"])
    line = once.select("l1", "l2", F.encode("line", "UTF-32").alias("x"), F.greatest(F.length("line") - (SHINGLE_CHARS - 1), F.lit(1)).alias("n"))
    line = line.select(
        "l1", "l2", "x", "n", F.greatest(F.expr(f"cast({full} div n as int)"), F.lit(1)).alias("turns"),
        F.when(F.col("n") > full, F.floor(F.lit(float(full << PART)) / F.col("n"))).otherwise(F.lit(1 << PART)).alias("top"))
    items = line.select("l1", "l2", "x", "n", "top", F.explode(F.sequence(F.lit(0), F.col("n") * F.col("turns") - 1)).alias("i"))
    items = items.select("l1", "l2", "top", F.expr("cast(i div n as int)").alias("turn"), "x", (F.col("i") % F.col("n")).alias("at"))
    items = items.select("l1", "l2", "top", "turn", shingle_hash(F.col("x"), F.col("at") * 4 + 1, F.col("turn")).alias("h"))
    order, bucket = F.shiftrightunsigned("h", 64 - PART), F.shiftright(F.col("h").bitwiseAND(0xFFF) * VALUES, 12).cast("int")
    kept = items.where(order < F.col("top")).select("l1", "l2", bucket.alias("k"), F.shiftleft(F.col("turn").cast("long"), PART).bitwiseOR(order).alias("v"))
    kept = kept.select("l1", "l2", (F.col("k") % CLASSES).alias("class"), F.floor(F.col("k") / CLASSES).cast("int").alias("m"), "v")
    size = VALUES // CLASSES
    least = kept.groupBy("l1", "l2", "class").agg(*[F.min(F.when(F.col("m") == m, F.col("v"))).alias(f"v{m}") for m in range(size)])
    # band b takes buckets of class 35 b mod CLASSES only
    mine = [[b for b in range(BANDS) if 35 * b % CLASSES == c] for c in range(CLASSES)]

    def key(b: int) -> Column:
        values = [F.col(f"v{(35 * b + 6 * i) % VALUES // CLASSES}") for i in range(ROWS)]
        return F.when(F.coalesce(*values).isNotNull(), F.xxhash64(F.lit(b), *values))
    by_class = lambda made: reduce(lambda last, c: last.when(F.col("class") == c, made(c)), range(1, CLASSES), F.when(F.col("class") == 0, made(0)))
    bits = lambda i: reduce(Column.bitwiseOR, [
        F.shiftleft(F.coalesce(F.shiftright(f"v{m}", i).bitwiseAND(F.lit(1).cast("long")), F.lit(0).cast("long")), CLASSES * m) for m in range(size)])
    placed = lambda i: F.expr(f"shiftleft(p{i}, class)")
    part = least.select("l1", "l2", "class", *[by_class(lambda c, j=j: key(mine[c][j])).alias(f"k{j}") for j in range(BANDS // CLASSES)], bits(0).alias("p0"), bits(1).alias("p1"))
    whole = part.groupBy("l1", "l2").agg(
        *[F.bit_or(F.when(F.col("class") == c, F.col(f"k{j}"))).alias(f"b{b}") for c in range(CLASSES) for j, b in enumerate(mine[c])],
        F.bit_or(placed(0)).alias("s0"), F.bit_or(placed(1)).alias("s1"))
    return whole.select("l1", "l2", F.array(*[f"b{b}" for b in range(BANDS)]).alias("keys"), "s0", "s1")


def near(*differing: Column) -> Column:
    """Whether sketches that differ in these bits leave a link possible."""
    return reduce(Column.__add__, map(F.bit_count, differing)) <= MAX_BITS_APART


def shingle_set(line: str) -> set[str]:
    """Runs of ``SHINGLE_CHARS`` characters from every character on; a shorter line is its own and only one."""
    return {line[i:i + SHINGLE_CHARS] for i in range(max(1, len(line) - (SHINGLE_CHARS - 1)))}


def shingles(line: Column) -> Column:
    """Hashes of a line's distinct shingles."""
    starts = lambda x: F.sequence(F.lit(1), F.greatest(F.octet_length(x) - (4 * SHINGLE_CHARS - 1), F.lit(1)), F.lit(4))
    return F.array_distinct(let(F.encode(line, "UTF-32"), lambda x: F.transform(starts(x), lambda i: shingle_hash(x, i))))


def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``l1, n, odd`` of a batch of ``l1, line``: the number of distinct shingles, and the parity of how many fall on each of ``ODD_BITS`` bits."""
    sizes, sketches = [], []
    for _, _, data, offsets in H.text_blocks(batch.column(1)):
        starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(starts[:-1], offsets)
        sums = H.byte_prefix(data)
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            at = np.arange(lo, max(hi - SHINGLE_CHARS, lo) + 1)
            distinct = np.unique(H.spans(sums, starts[at], starts[np.minimum(at + SHINGLE_CHARS, hi)]))
            sizes.append(len(distinct))
            sketches.append(np.packbits(np.bincount((distinct & H.U(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS) & 1).tobytes())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], names=["l1", "n", "odd"])


def close(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``a, b`` of the pairs whose sketches leave a link possible."""
    odd = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(len(batch), ODD_BITS // 64) for c in ("odd_a", "odd_b")]
    apart = np.bitwise_count(odd[0] ^ odd[1]).sum(axis=1, dtype=np.int64)
    total = sum(batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
    return batch.select(["a", "b"]).filter(pa.array(apart * (100 + PERCENT) <= (100 - PERCENT) * total))


def sketches(texts: DataFrame) -> DataFrame:
    """``(l1, n, o0, o1, ...)`` of every text: the number of distinct shingles, and the parity of how many fall on each of ``ODD_BITS`` bits."""
    each = texts.select("l1", F.explode(shingles(F.col("line"))).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.shiftrightunsigned("h", 6).bitwiseAND(len(ODD_WORDS) - 1)
    each = each.select("l1", word.alias("word"), bit.alias("bit"))
    return each.groupBy("l1").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        *[F.coalesce(F.bit_xor(F.when(F.col("word") == i, F.col("bit"))), F.lit(0)).cast("long").alias(c) for i, c in enumerate(ODD_WORDS)])


def linkable(one: str, other: str) -> Column:
    """Whether the sketches in columns with these endings leave a link possible; ``close`` as an expression.

    A shingle that only one line has changes one bit of that line's sketch, so sketches
    differ in at most as many bits as the sets in shingles, and linked sets of ``n_a`` and
    ``n_b`` shingles differ in at most ``(100 - PERCENT) / (100 + PERCENT)`` of ``n_a + n_b``.
    """
    apart = reduce(Column.__add__, [F.bit_count(F.col(c + one).bitwiseXOR(F.col(c + other))) for c in ODD_WORDS])
    return apart * (100 + PERCENT) <= (100 - PERCENT) * (F.col("n" + one) + F.col("n" + other))


def likely(one: str, other: str) -> Column:
    """Whether rows of one key are of different components, and their small sketches and their distances from its smallest line leave a link possible."""
    c, s0, s1, d = ((F.col(x + one), F.col(x + other)) for x in ("c", "s0", "s1", "d"))
    return (
        (c[0] != c[1]) & near(s0[0].bitwiseXOR(s0[1]), s1[0].bitwiseXOR(s1[1]))
        & (F.coalesce(F.abs(d[0] - d[1]), F.lit(0.0)) <= 1 - PERCENT / 100 + 1e-9))


def sides(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` twice, to be joined by ``key``: the columns of the first end in ``_1``, of the second in ``_2``."""
    return (rows.select("key", *[F.col(x).alias(f"{x}_{i}") for x in rows.columns if x != "key"]) for i in (1, 2))


def partnered(loose: DataFrame) -> DataFrame:
    """Rows of ``loose`` that have a likely partner in their key.

    Most lines of large keys have none, and need neither text nor sketch.  As a semi-join this gives no
    more rows than it is given, however many lines a key has.
    """
    left, right = sides(loose)
    return left.join(right, (left["key"] == right["key"]) & likely("_1", "_2"), "left_semi").toDF(*loose.columns)


def met_once(held: DataFrame) -> DataFrame:
    """``(a, b)`` of likely pairs whose sketches allow a link: each once, in the smallest key of those that list both lines."""
    left, right = sides(held)
    first = F.col("key") == F.array_min(F.array_intersect("keys_1", "keys_2"))
    met = left.join(right, "key").where(likely("_1", "_2") & (F.col("b_1") < F.col("b_2")) & linkable("_1", "_2") & first)
    return met.select(F.col("b_1").alias("a"), F.col("b_2").alias("b"))


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b, u, v, d, linked)``: of pairs of hashes, the lines' names, their Jaccard distance, and whether they are similar enough.

    Sets are compared whole, by 64-bit hashes of their shingles.
    """
    side = lambda c, n: texts.select(F.col("l1").alias(c), F.struct("l1", "l2").alias(n), F.col("line").alias(f"t_{c}"))
    joined = pairs.join(side("a", "v"), "a").join(side("b", "u"), "b")
    sets = F.struct(shingles(F.col("t_a")).alias("x"), shingles(F.col("t_b")).alias("y"))
    counts = let(sets, lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("both"), (F.size(s["x"]) + F.size(s["y"])).alias("sum")))
    counted = joined.select("a", "b", "u", "v", counts.alias("c")).select("a", "b", "u", "v", F.col("c.both").alias("both"), F.expr("c.sum - c.both").alias("union"))
    return counted.select("a", "b", "u", "v", (1 - F.col("both") / F.col("union")).alias("d"), (F.col("both") * 100 >= PERCENT * F.col("union")).alias("linked"))


def contracted(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components ``(node, component)`` of ``found`` after more ``links(u, v)``: only those between components are followed."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    edges = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(
        "u", "v", F.coalesce("c_u", "u").alias("c_u"), F.coalesce("c_v", "v").alias("c_v"))
    edges = scratch.table(edges, "contracted")
    joined = scratch.table(connected_components(edges.select(F.col("c_u").alias("u"), F.col("c_v").alias("v")), scratch), "joined")
    new = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct().join(found, "node", "left_anti")
    every = found.select("node", "component").unionByName(new.select("node", F.col("node").alias("component")))
    merged = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return every.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def drop_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``(id, pos)`` of every line that goes: all but the first line of each component, ``pos`` counting from 0.

    Components join lines of equal text and lines whose shingle sets are similar; the
    first is that of the smallest id, then position.  Each band key's smallest line is
    compared with the others whose sketches allow a link; lines of a key that are then
    still in different components are paired where their sketches of both kinds, and their
    distances from that one if they were measured, allow a link.  Lines that the small
    sketches and distances leave without a partner go first, before texts are read.  The
    tests are part of the join, which adaptive execution splits where one key has many lines,
    so what leaves it are pairs close to the threshold or above, each from one of its keys.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    lines = numbered_lines(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    places = scratch.table(lines.select("id", "pos", "l1", "l2"), "places")
    signed = scratch.table(signatures(lines), "signed")
    scratch.release()
    met = []
    for b in range(0, BANDS, AT_ONCE):
        keys = signed.select(F.explode(F.slice("keys", b + 1, AT_ONCE)).alias("key"), F.col("l1").alias("b"), "s0", "s1").repartition("key")
        heads = keys.groupBy("key").agg(
            F.min("b").alias("a"), F.max("b").alias("last"), F.count(F.lit(1)).alias("n"), F.bit_xor("s0").alias("x0"), F.bit_xor("s1").alias("x1")).where("n > 1 and a <> last")
        # a key of two lines is settled by its sums; of larger ones, all lines are kept
        two = (F.col("n") == 2) & near("x0", "x1") & (F.col("a") != F.col("b"))
        both = keys.join(heads.hint("shuffle_hash"), "key").where(two | (F.col("n") > 2))
        met.append(scratch.table(both.select("key", "a", "b", "s0", "s1", "n"), "shared"))
        scratch.release()
    every = reduce(DataFrame.unionByName, met)
    pairs, shared = every.where("n = 2").select("a", "b"), every.where("n > 2").drop("n")
    stars = shared.where("a <> b").select("a", "b", "s0", "s1").distinct().join(signed.select(F.col("l1").alias("a"), F.col("s0").alias("a0"), F.col("s1").alias("a1")), "a")
    stars = stars.where(near(F.col("s0").bitwiseXOR(F.col("a0")), F.col("s1").bitwiseXOR(F.col("a1")))).select("a", "b")
    tried = scratch.table(stars.unionByName(pairs).distinct(), "stars")
    scratch.drop(signed)

    def fetched(names: DataFrame) -> DataFrame:
        """One text for each name."""
        return scratch.table(lines.select("l1", "l2", "line").join(names.distinct().hint("shuffle_hash"), "l1", "left_semi").dropDuplicates(["l1", "l2"]), "texts")

    texts = fetched(tried.select(F.explode(F.array("a", "b")).alias("l1")))
    stars = scratch.table(measured(tried, texts), "measured")
    scratch.drop(texts)
    scratch.release()
    found = scratch.table(connected_components(stars.where("linked").select("u", "v"), scratch), "components")
    of = found.select(F.col("node.l1").alias("b"), F.xxhash64("component.l1", "component.l2").alias("c"))
    at = shared.join(of, "b", "left").withColumn("c", F.coalesce("c", "b"))
    apart = at.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    loose = at.join(apart, "key").join(stars.groupBy("a", "b").agg(F.min("d").alias("d")), ["a", "b"], "left")
    loose = scratch.table(loose.select("key", "b", "c", "s0", "s1", F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.col("d")).alias("d")), "loose")
    scratch.drop(*met)
    scratch.release()
    near_by = scratch.table(partnered(loose), "partnered")
    if not near_by.isEmpty():
        texts = fetched(near_by.select(F.col("b").alias("l1")))
        own = near_by.groupBy("b").agg(F.collect_set("key").alias("keys"))
        held = scratch.table(near_by.join(own.join(sketches(texts).withColumnRenamed("l1", "b"), "b"), "b"), "held")
        rest = met_once(held).join(tried, ["a", "b"], "left_anti")
        rest = scratch.table(rest, "rest")
        scratch.drop(held)
        scratch.release()
        more = scratch.table(measured(rest, texts).where("linked").select("u", "v"), "links")
        scratch.drop(texts)
        found = scratch.table(contracted(found, more, scratch), "components")
    scratch.release()
    named = found.select(F.col("node.l1").alias("l1"), F.col("node.l2").alias("l2"), "component")
    distinct = places.groupBy("l1", "l2").agg(F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    joined = distinct.join(named, ["l1", "l2"], "left").where("n > 1 or component is not null").select(
        "l1", "l2", F.coalesce("component", F.struct("l1", "l2")).alias("component"), F.struct("first.id", "first.pos", "l1", "l2").alias("name"))
    joined = scratch.table(joined, "repeated")
    keep = joined.groupBy("component").agg(F.min("name").alias("keep"))
    rule = scratch.table(joined.join(keep, "component").select("l1", "l2", "keep"), "rule")
    return places.join(rule, ["l1", "l2"]).where(~(F.struct("id", "pos", "l1", "l2") == F.col("keep"))).select("id", "pos")


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and id with ``n_lines``, ``n_removed`` and ``kept_text`` of every document.

    Lines are cut at ``\\n``.  Of each component of equal or similar lines only the first
    stays; lines without a word always stay.  The lines that are left are
    joined by ``\\n`` again.

    Null text has no lines and stays null; an empty text is one empty line.  Rows with a
    null id are returned whole.  Rows with the same id and text keep or lose the same lines.
    An empty table gives an empty result.  Only ``keep`` is carried along.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = drop_similar_lines(docs, id_col, text_col, scratch)
    gone = scratch.table(gone.groupBy(F.col("id").alias("_gid")).agg(F.collect_set("pos").alias("_gone")), "gone")
    scratch.release()
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    split = F.split("_text", "\n")
    left = let(split, lambda x: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)))
    joined = rows.join(gone, rows["_id"] == gone["_gid"], "left")
    return joined.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_id").alias(id_col),
        F.coalesce(F.when(F.col("_text").isNotNull(), F.size(split)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n")).alias("kept_text"))
