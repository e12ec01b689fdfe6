"""Mixing sources to target weights by a low-discrepancy schedule of shuffled blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .workspace import Scratch

#: Words: maximal runs without ASCII space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Points live on a ring of 2**31; the golden ratio's fractional part on it is odd, so slots visit every point once.
RING = 2**31
GOLDEN = 1327217885

#: Sources known to the driver; more than this many raise instead of growing the plan.
MAX_SOURCES = 10_000

#: A source below so many blocks is cut into shorter ones, so that a slot more or less is a small part of it.
MIN_BLOCKS = 32


def cumulative(df: DataFrame, key: str, order: Sequence[str], value: str, out: str, n_buckets: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier rows of the same ``key``.

    ``order[0]`` must be a 64-bit hash.  Its leading bits cut each key into ``n_buckets``
    even buckets, so no task holds a whole key; sums of buckets are few and are added up
    separately.
    """
    cut = df.withColumn("_b", F.shiftright(F.col(order[0]), 64 - max(1, (n_buckets - 1).bit_length())))
    sums = cut.groupBy(key, "_b").agg(F.sum(value).alias("_s"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col(key).alias("_key"), F.col("_b").alias("_bucket"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    within = W.partitionBy(key, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("_l", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = local.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")))
    return joined.withColumn(out, F.col("_l") + F.col("_o")).drop("_b", "_l", "_o", "_key", "_bucket")


def capped_targets(sizes: Sequence[tuple], total: float, cap: float) -> list[float]:
    """Shares ``total`` over ``(size, weight)`` pairs; none above ``cap * size``; excess is shared again by weight."""
    target, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s[0] > 0 and s[1] > 0], float(total)
    while open_ and left > 0:
        weights = sum(sizes[i][1] for i in open_)
        full = [i for i in open_ if left * sizes[i][1] / weights >= cap * sizes[i][0]]
        if not full:
            for i in open_:
                target[i] = left * sizes[i][1] / weights
            break
        for i in full:
            target[i] = float(cap * sizes[i][0])
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 256,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every document with ``size, source_size, target, taken, blocks`` under its source's target.

    Sources ordered by code point, null last, take ``weights`` in turn.  Within a source
    documents follow a seeded hash, and their words form one stream that is cut into
    equal blocks of ``block`` words, or of a ``MIN_BLOCKS``-th of a smaller source.  Slot ``i``
    of the schedule maps the golden-ratio point ``i * phi mod 1`` through the cumulative
    targets, counted in blocks, to a source; the slot's rank within that source, modulo
    the source's blocks, is the block it reads.  ``taken`` counts the words that slots read
    from the document; ``blocks`` lists its uses as ``(block, words, times)``.

    Null text has no words and size 0; null is a source of its own; empty tables give
    empty results; repeated rows are separate documents.  No document is taken more than
    ``cap`` times (``cap`` whole): ranks past a source's ``cap`` passes are not scheduled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    base = docs.select(
        *named, F.col(id_col).alias("_id"), F.col(source_col).alias("_src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_h"),
        F.xxhash64(F.col(text_col)).alias("_t"), F.monotonically_increasing_id().alias("_row"))
    base = scratch.table(base, "sizes")
    per_source = base.groupBy("_src").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = sorted(per_source, key=lambda r: (r["_src"] is None, (r["_src"] or "").encode("utf-32-be")))
    sizes = [(int(r["n"]), float(weights[i % len(weights)])) for i, r in enumerate(sources)]
    total = share * sum(n for n, _ in sizes)
    targets = capped_targets(sizes, total, cap)
    lengths = [max(1, min(block, -(-n // MIN_BLOCKS))) for n, _ in sizes]
    n_blocks = [-(-n // b) for (n, _), b in zip(sizes, lengths, strict=True)]
    # a slot yields size / n_blocks words on average, less than a block where the last one is short
    wanted = [t / n * c if n else 0.0 for t, (n, _), c in zip(targets, sizes, n_blocks, strict=True)]
    plan, edge, scheduled = [], 0.0, sum(wanted)
    for i, r in enumerate(sources):
        lo, edge = edge, edge + (wanted[i] / scheduled if scheduled else 0.0)
        plan.append((i, r["_src"], sizes[i][0], targets[i], n_blocks[i], lengths[i], int(lo * RING)))
    plan_df = spark.createDataFrame(plan, "k int, _src string, source_size long, target double, n_blocks long, _len long, lo long")
    slots = schedule(plan_df, [p[-1] for p in plan], int(round(scheduled)), cap)
    uses = scratch.table(slots.groupBy("k", "block").agg(F.count(F.lit(1)).alias("times")), "uses")

    n_docs = sum(r["docs"] for r in sources)
    # what is kept stays in its table until the end, so texts are shuffled once, to their rows
    tagged = base.drop(*[f"_k{i}" for i in range(len(keep))]).join(F.broadcast(plan_df), base["_src"].eqNullSafe(plan_df["_src"])).drop(plan_df["_src"])
    placed = cumulative(tagged, "k", ["_h", "_id", "_t", "_row"], "size", "start", max(2, n_docs // 2_000))
    placed = scratch.table(placed.drop("_h", "_t", "_src", "lo"), "placed")
    first, last = F.floor(F.col("start") / F.col("_len")), F.floor((F.col("start") + F.col("size") - 1) / F.col("_len"))
    pieces = placed.where("size > 0").select("_row", "k", "start", "size", "_len", F.explode(F.sequence(first, last)).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("_len")) - F.greatest("start", F.col("block") * F.col("_len"))
    took = (
        pieces.withColumn("words", overlap).join(uses, ["k", "block"])
        .groupBy("_row").agg(
            F.sum(F.col("words") * F.col("times")).alias("taken"),
            F.sort_array(F.collect_list(F.struct("block", "words", "times"))).alias("blocks")))
    mixed = placed.join(took, "_row", "left").select(
        "_row", F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "blocks")
    if keep:
        mixed = base.select("_row", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]).join(mixed.hint("shuffle_hash"), "_row")
    return mixed.select(*keep, id_col, "size", "source_size", "target", "taken", "blocks")


def mixed_documents(mixed: DataFrame, text_col: str = "text", max_passes: int = 2) -> DataFrame:
    """The mix itself: a row for every pass over a document, from ``mix_sources`` with its text among ``keep``.

    Blocks are used in the order of the stream, so what a pass takes of a document is a
    prefix of its words; a whole document keeps its text as it is, a part is joined by
    spaces.  Documents that no slot reads, and those without words, give no row.
    """
    passes = mixed.where(F.size("blocks") > 0).withColumn("pass", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_passes), F.array_max(F.transform("blocks", lambda b: b["times"]))).cast("int"))))
    used = F.aggregate(F.filter("blocks", lambda b: b["times"] >= F.col("pass")), F.lit(0).cast("long"), lambda acc, b: acc + b["words"])
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = passes.withColumn("_used", used)
    return cut.withColumn(text_col, F.when(F.col("_used") >= F.col("size"), F.col(text_col)).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("_used").cast("int")), " "))).drop("_used")


def schedule(plan: DataFrame, starts: Sequence[int], n_slots: int, cap: float, chunk: int = 1 << 16) -> DataFrame:
    """Slots ``(slot, k, rank, block)``: golden-ratio points mapped through cumulative weights, ranked per source.

    ``starts[k]`` is where source ``k``'s interval begins on the ring.  Ranks come from
    counts per chunk of slots plus ranks inside each chunk, so a source with most slots is
    never ranked in one task.  ``plan`` has a row per source, at most ``MAX_SOURCES``, and
    is broadcast.
    """
    spark = plan.sparkSession
    point = F.pmod(F.pmod(F.col("id"), F.lit(RING)) * F.lit(GOLDEN), F.lit(RING))
    cumulative_weights = F.from_json(F.lit(str(list(starts))), "array<bigint>")
    owner = F.size(F.filter(cumulative_weights, lambda lo: lo <= F.col("u"))) - 1
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("u"), F.floor(F.col("id") / chunk).alias("c"))
    owned = slots.select("slot", "c", owner.alias("k")).join(F.broadcast(plan.select("k", "n_blocks")), "k")
    counts = owned.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("k").orderBy("c").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("k", "c", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = owned.withColumn("r", F.row_number().over(W.partitionBy("k", "c").orderBy("slot")) - 1).join(base, ["k", "c"])
    rank = (F.col("r") + F.col("before")).cast("long")
    return ranked.withColumn("rank", rank).where(F.col("rank") < F.floor(F.lit(cap)) * F.col("n_blocks")).select(
        "slot", "k", "rank", F.pmod(F.col("rank"), F.col("n_blocks")).alias("block"))
