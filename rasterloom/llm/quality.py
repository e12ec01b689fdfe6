"""Quality rules: per-document counts and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Scratch

SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: n-grams fall into so many buckets; one weight a bucket is all that every task gets (512 KB).
N_BUCKETS = 1 << 16

#: Log-ratio per word under which a document is rejected.
THRESHOLD = -0.15

#: Log-ratios are summed as integers of this fraction, so any order of summation gives one result.
UNIT = 1_000_000


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def base_counts(text: Column, words: Column, hashes: Column, pairs: Column, window: int = 8) -> dict[str, Column]:
    """Counts over the whole text, which is not null, from its words, their hashes and the hashes of neighbours."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.size(F.split(text, SYMBOL)) - 1).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(hashes, pairs, window),
    }


def joined_hashes(grams: Column, step: int) -> Column:
    """Hash of every element and the one ``step`` later; the last ``step`` have no such and mean nothing."""
    return let(grams, lambda g: F.zip_with(g, F.slice(g, step + 1, F.size(g)), lambda a, b: F.xxhash64(a, b)))


def gram_hashes(hashes: Column, pairs: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words, made of overlapping runs half as long.

    A run of ``n`` words costs about log n steps, not n, and starts from the pairs that
    bigrams need as well.
    """
    if n == 1:
        return hashes
    grams, length = pairs, 2
    while length < n:
        step = min(length, n - length)
        grams, length = joined_hashes(grams, step), length + step
    return F.slice(grams, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))


def repeated_words(hashes: Column, pairs: Column, window: int) -> Column:
    """Words covered by windows of ``window`` words that occur at least twice in the text.

    Window hashes of a text are compared with each other only (64 bits).  Texts without a
    repeat stop at one hash-set pass; the others sort their hashes with positions, so the
    cost is n log n in the length of a text.
    """
    def covered(g):
        def positions(s):
            same = lambda j, k: (k >= 1) & (k <= F.size(s)) & (F.get(s, j - 1)["g"] == F.get(s, k - 1)["g"])
            hit = lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False))
            return F.array_sort(F.transform(
                F.filter(F.sequence(F.lit(1), F.size(s)), hit), lambda j: F.get(s, j - 1)["i"]))

        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        gaps = let(let(ordered, positions), lambda p: F.zip_with(
            p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window)))))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    repeated = F.when(F.size(hashes) > window, let(gram_hashes(hashes, pairs, window), lambda g: F.when(
        F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))).otherwise(F.lit(0))
    return repeated.cast("long")


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with the words of ``_text`` as ``_words``, their hashes as ``_h`` and those of neighbours as ``_h2``."""
    return rows.withColumn("_words", words_of(F.col("_text"))).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).withColumn(
        "_h2", joined_hashes(F.col("_h"), 1))


def gram_buckets(hashes: Column, pairs: Column, orders: Sequence[int], n_buckets: int) -> Column:
    """Buckets of all word n-grams of the given orders."""
    grams = F.concat(*[gram_hashes(hashes, pairs, n) for n in orders])
    return F.transform(grams, lambda x: F.pmod(x, F.lit(n_buckets)).cast("int"))


def gram_weights(
    docs: DataFrame, trusted: DataFrame, scratch: Scratch, id_col: str, text_col: str,
    orders: Sequence[int], n_buckets: int, smoothing: float,
) -> DataFrame:
    """One row with ``weights``: by bucket, the log of target over raw probability in units of 1/UNIT.

    ``smoothing`` n-grams that both corpora have at the same rate are added to each
    bucket, so rarely seen buckets stay near 0 and small corpora are judged like large ones.

    Raw counts cover every document, target counts every document in ``trusted``, of
    which there may be any number.  Texts are shuffled to their ids at any size, so few
    trusted ids and many take the same plan and disk grows with the texts alone.
    """
    marked = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(
        trusted.select(F.col(id_col).alias("_id"), F.lit(1).alias("_t")).hint("shuffle_hash"), "_id", "left")
    grams = hashed(marked).select("_t", F.explode(gram_buckets(F.col("_h"), F.col("_h2"), orders, n_buckets)).alias("bucket"))
    counts = scratch.table(
        grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_t").alias("target")), "counts")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("target"), F.lit(0)).alias("t")).first()
    if total["t"]:
        rate = total["t"] / total["r"]
        ratio = F.log((F.col("target") + smoothing * rate) / ((F.col("raw") + smoothing) * rate))
        counts = counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("w"))
    else:
        counts = counts.select("bucket", F.lit(0).cast("long").alias("w"))
    every = docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("w", F.lit(0)).cast("long").alias("w")))), lambda x: x["w"]).alias("weights"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    orders: Sequence[int] = (1, 2),
    n_buckets: int = N_BUCKETS,
    smoothing: float = 32.0,
    threshold: float = THRESHOLD,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep`` and id with the base counts, ``base_failed``, ``score`` and ``kept``.

    The target multinomial comes from documents labelled 1, the raw one from all
    documents; a document's score is the log-ratio of all its n-grams, whatever their
    order, over its number of words.  It is kept if it passes the base rules and its score
    is at least ``threshold``.

    Null and empty texts have zero counts and fail the base rules.  Without labelled
    documents every ratio is 0 and the base rules alone decide.  Repeated rows are judged
    alike and all returned.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    trusted = labels.where(F.col(label_col) == 1).select(id_col).where(F.col(id_col).isNotNull()).distinct()
    weights = scratch.table(gram_weights(docs, trusted, scratch, id_col, text_col, orders, n_buckets, smoothing), "weights")
    rows = docs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text, words, h, h2 = (F.col(c) for c in ("_text", "_words", "_h", "_h2"))
    carried = [*[f"_k{i}" for i in range(len(keep))], "_id"]
    stats = hashed(rows).select(
        *carried, *[v.alias(c) for c, v in base_counts(text, words, h, h2).items()],
        gram_buckets(h, h2, orders, n_buckets).alias("_buckets"))
    # a projection of its own, used once, is merged with the next, so the weights are no part of any row
    stats = stats.withColumn("_weights", weights.scalar())
    total = F.aggregate("_buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.get("_weights", b))
    stats = stats.select(*carried, *BASE, F.when(F.col("n_words") > 0, total / F.col("n_words") / UNIT).otherwise(F.lit(0.0)).alias("score"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return stats.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_id").alias(id_col),
        *BASE, failed.alias("base_failed"), "score",
        (~failed & (F.col("score") >= threshold)).alias("kept"))
