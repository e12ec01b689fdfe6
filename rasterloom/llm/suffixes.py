"""Removal of byte strings that earlier documents hold, by deep-shallow suffix sorting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .substrings import covered, expand
from .workspace import Scratch

#: Bytes of a string that counts as repeated, and of the grams that stand for it.
LENGTH, GRAM = 50, 16
#: Bytes that the multikey sort compares; longer common prefixes go to blind tries.
SHALLOW = 24
#: Stretches of one fingerprint that are sorted together; larger groups are dealt over several.
GROUP_ROWS = 20_000
#: Bytes of stretches sorted at once within a task, few enough for arrays to stay in cache; one group at least, however large.
SORT_BYTES = 256 << 10

U = np.uint64


# sorting -----------------------------------------------------------------------------


def blind_trie(strings: Sequence[bytes]) -> list[list[int]]:
    """Indices of equally long strings in order, equal ones together.

    A blind trie keeps only the depths at which strings part.  Insertion first descends by
    those bytes alone, then compares the whole string with the leaf it met, once.
    """
    root: list = [0]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(s[depth]) or next(iter(children.values()))
        other = strings[node[0]]
        if s == other:
            node.append(i)
            continue
        lcp = _common(s, other)
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < lcp:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][s[lcp]] = [i]
            continue
        fork = (lcp, {other[lcp]: node, s[lcp]: [i]})
        if parent is None:
            root = fork
        else:
            parent[1][s[parent[0]]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            out.append(node)
    return out


def _common(a: bytes, b: bytes) -> int:
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def sort_suffixes(data: np.ndarray, at: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``data`` at ``at`` by their first ``length`` bytes, and the class of each in that order.

    Equal classes mean equal prefixes.  A multikey sort partitions groups of equal prefixes
    by their next symbol of up to 8 bytes, down to ``shallow`` bytes.  Groups still together there
    have long common prefixes: those that agree to the end are one leaf, the others are
    ordered by blind tries on the bytes that are left.
    """
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)
    symbols = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))  # 8 bytes from every position
    depth = 0
    while depth + 8 <= min(shallow, length):
        size = np.bincount(group, minlength=n)
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        # a group's number and its next symbol share one 64-bit key
        number = np.cumsum(np.concatenate([[True], group[open_][1:] != group[open_][:-1]])) - 1
        bits = int(number[-1]).bit_length()
        width = 8 - -(-bits // 8)
        key = symbols[at[order[open_]] + depth].astype(U)
        if width < 8:
            key = (key >> U(64 - 8 * width)) | (number.astype(U) << U(8 * width))
        rank = np.argsort(key)
        order[open_] = order[open_][rank]
        key = key[rank]
        step = np.zeros(n, dtype=np.int64)
        step[1:] = group[1:] != group[:-1]
        step[open_[1:]] |= key[1:] != key[:-1]
        group = np.cumsum(step)
        depth += width
    shallow = depth
    size = np.bincount(group, minlength=n) if n else np.zeros(0, np.int64)
    open_ = np.flatnonzero(size[group] > 1)
    if len(open_) and shallow < length:
        begin, own = at[order[open_]], group[open_]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        stop = np.append(head[1:], len(own))
        differs = np.zeros(len(own), dtype=bool)
        for depth in [*range(shallow, length - 8, 8), length - 8]:
            part = symbols[begin + depth]
            differs |= part != np.repeat(part[head], stop - head)
        mixed = np.flatnonzero(np.add.reduceat(differs, head) > 0)
        step = np.zeros(n, dtype=np.int64)
        for g in mixed.tolist():
            lo, hi = int(head[g]), int(stop[g])
            leaves = blind_trie([data[i + shallow:i + length].tobytes() for i in begin[lo:hi].tolist()])
            order[open_[lo:hi]] = order[open_[lo:hi]][[i for leaf in leaves for i in leaf]]
            k = lo
            for leaf in leaves[:-1]:
                k += len(leaf)
                step[open_[k]] = 1
        group = group + np.cumsum(step)
    return order, group


def repeated_across(data: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix: whether one with a smaller owner has the same ``length`` bytes, and the class it is in."""
    order, group = sort_suffixes(data, at, length)
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(owner[order], head)
    number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    later, classes = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64)
    later[order] = owner[order] > least[number]
    classes[order] = number
    return later, classes


# distribution ------------------------------------------------------------------------


class ByteWindows:
    """Strings of ``length`` bytes in a block of texts and their fingerprints, by document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int, check: bool = False):
        self.length, self.first, self.data = length, offsets, data
        self.sums = [hashing.byte_prefix(data, k) for k in range(1 + check)]
        self.marks = hashing.sliding_min(hashing.windows(self.sums[0], gram), length - gram + 1)

    def of(self, row: int) -> tuple[int, int]:
        a, b = int(self.first[row]), int(self.first[row + 1])
        return a, max(0, b - a - self.length + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        return hashing.spans(self.sums[which], starts, ends, which)

    def runs(self, row: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Position of the text, its fingerprints, and the runs [i, j) of windows that have them."""
        a, n = self.of(row)
        if not n:
            return a, np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        marks = self.marks[a:a + n]
        cut = np.flatnonzero(marks[1:] != marks[:-1]) + 1
        lo = np.concatenate([[0], cut])
        return a, marks[lo], a + lo, a + np.append(cut, n)


def _rows(batch: pa.RecordBatch, length: int, gram: int, check: bool) -> Iterator[tuple[int, int, ByteWindows]]:
    for lo, hi, data, offsets in hashing.text_blocks(batch.column("text")):
        w = ByteWindows(data, offsets, length, gram, check)
        for row in range(hi - lo):
            yield lo + row, row, w


def _longs(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy().view(U) if value.is_valid else np.zeros(0, U)


def among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each value is one of ``found``, as ``np.isin`` tells; a text's few hashes are sorted and searched, several times faster."""
    if not len(found):
        return np.zeros(len(values), dtype=bool)
    found = np.sort(found)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def _wanted(w: ByteWindows, row: int, hits: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    a, marks, lo, hi = w.runs(row)
    hit = among(marks, hits)
    return a, marks[hit], lo[hit], hi[hit]


def _keyed(batch: pa.RecordBatch, at: list[int], columns: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    counts = [len(x) for x in next(iter(columns.values()))]
    ids = batch.column("id").take(pa.array(np.repeat(np.array(at, dtype=np.int64), counts)))
    return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c).view(np.int64)) for c in columns.values()), ids], names=[*columns, "id"])


def deduplicate_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(id, n_bytes, n_removed, removed_spans, kept)`` of every document; ``kept`` is binary.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document
    with a smaller id (an integer).  Strings are judged on the input.

    Documents of equal text (by two hashes) are sorted as one under their smallest id: the
    others own no string that it doesn't own, and lose every byte of a text that has
    ``length`` of them.  Each string has the smallest hash of its ``gram``-byte grams for a
    fingerprint, about one in eighteen positions.  Strings whose fingerprint only one document has are unique.
    Of the others, stretches of strings with one fingerprint are looked up whole; the bytes
    of stretches that no earlier document has whole are dealt by fingerprint, and their
    suffixes sorted.  Groups over ``GROUP_ROWS`` are dealt over several sorts, whose classes
    are then reduced to the smallest id, so a very common string burdens no single task.

    Null and empty texts have no bytes.  Rows with the same id are one document and remove
    nothing from each other; rows with a null id are returned whole.  An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("ids must be integers")
    scratch = Scratch(spark, "suffixes")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
        table = f"rl_{name}_{uuid.uuid4().hex}"
        (df.repartition(buckets, key).sortWithinPartitions(key).write.option("path", scratch.path(name))
         .option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(table))
        scratch.release()
        return spark.table(table)

    def earlier(rows: DataFrame, name: str) -> DataFrame:
        first = rows.groupBy("h", "c").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "c", "lo")
        first = scratch.table(first, f"first-{name}")
        later = scratch.table(rows.join(first, ["h", "c"]).where("id > lo").select("id", "h"), f"later-{name}")
        scratch.drop(first)
        return later

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, h = [], []
            for i, row, w in _rows(batch, length, gram, False):
                _, marks, _, _ = w.runs(row)
                if len(marks):
                    at.append(i)
                    h.append(np.unique(marks))
            if at:
                yield _keyed(batch, at, {"h": h})

    def met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by (h, id), distinct; those whose fingerprint another document has too go on.

        A row is decided by its two neighbours, so nothing but the last row is held, however
        many documents a fingerprint has.
        """
        kept_h, kept_id, pending = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            h, ids = batch.column("h").to_numpy(), batch.column("id").to_numpy()
            if kept_h is not None:
                h, ids = np.concatenate([[kept_h], h]), np.concatenate([[kept_id], ids])
            same = (h[1:] == h[:-1]) & (ids[1:] != ids[:-1])
            hit = np.concatenate([[pending], same]) | np.concatenate([same, [False]])
            kept_h, kept_id, pending = h[-1], ids[-1], bool(hit[-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[:-1][hit[:-1]]), pa.array(ids[:-1][hit[:-1]])], names=["h", "id"])
        if pending:
            yield pa.RecordBatch.from_arrays([pa.array([kept_h]), pa.array([kept_id])], names=["h", "id"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, h, c = [], [], []
            for i, row, w in _rows(batch, length, gram, True):
                _, _, lo, hi = _wanted(w, row, _longs(batch.column("hs")[i]))
                if len(lo):
                    one, first = np.unique(w.hashes(lo, hi + length - 1), return_index=True)
                    at.append(i)
                    h.append(one)
                    c.append(w.hashes(lo[first], hi[first] + length - 1, 1))
            if at:
                yield _keyed(batch, at, {"h": h, "c": c})

    def remainders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, bodies = [], [], []
            for i, row, w in _rows(batch, length, gram, False):
                _, mark, lo, hi = _wanted(w, row, _longs(batch.column("hs")[i]))
                if len(lo):
                    rest = ~among(w.hashes(lo, hi + length - 1), _longs(batch.column("whole")[i]))
                    for m, a, b in zip(mark[rest].view(np.int64).tolist(), lo[rest].tolist(), hi[rest].tolist(), strict=True):
                        ids.append(i)
                        marks.append(m)
                        bodies.append(w.data[a:b + length - 1].tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(ids)), pa.array(marks, pa.int64()), pa.array(bodies, pa.binary())], names=["id", "mark", "body"])

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by (mark, deal); whole groups are gathered up to ``SORT_BYTES`` and sorted."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0]
            mark, deal = (held.column(c).to_numpy() for c in ("mark", "deal"))
            fresh = np.flatnonzero((mark[1:] != mark[:-1]) | (deal[1:] != deal[:-1])) + 1
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(held.column("body")).to_numpy().astype(np.int64))])
            lo = 0
            while (k := int(np.searchsorted(sizes[fresh], sizes[lo] + SORT_BYTES))) < len(fresh):
                yield from sort_held(held.slice(lo, fresh[k] - lo))
                lo = int(fresh[k])
            rest = [held.slice(lo)]
        for held in rest:
            yield from sort_held(held)

    def sort_held(held: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        body = held.column("body").cast(pa.large_binary())
        _, offsets, raw = body.buffers()
        start = np.frombuffer(offsets, dtype=np.int64)[body.offset:body.offset + len(body) + 1]
        data = np.concatenate([np.frombuffer(raw, dtype=np.uint8)[start[0]:start[-1]], np.zeros(64, dtype=np.uint8)])
        start = start - start[0]
        n = np.diff(start)
        at = expand(start[:-1], start[1:] - length + 1)
        row = np.repeat(np.arange(len(held)), n - length + 1)
        owner = held.column("id").to_numpy().astype(np.int64)[row]
        hot = held.column("hot").to_numpy(zero_copy_only=False)[row]
        later, classes = repeated_across(data, at, owner, length)
        # a hot group's classes are compared again across its deals: its smallest ids stay open
        open_ = hot & ~later
        pick = np.flatnonzero(later | open_)
        sums = [hashing.byte_prefix(data, k) for k in (0, 1)]
        h, c = (hashing.spans(sums[k], at[pick], at[pick] + length, k) for k in (0, 1))
        key = hashing.mix(hashing.mix(owner[pick].astype(U)) ^ h) ^ open_[pick].astype(U)
        _, first = np.unique(key, return_index=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(owner[pick][first]), pa.array(h[first].view(np.int64)), pa.array(c[first].view(np.int64)), pa.array(open_[pick][first])],
            names=["id", "h", "c", "open"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pc.or_(pc.is_valid(batch.column("whole")), pc.is_valid(batch.column("single")))
            rest = batch.filter(pc.invert(pc.and_(hit, pc.invert(batch.column("copy")))))
            if rest.num_rows:
                raw = pc.fill_null(rest.column("text"), "").cast(pa.binary())
                size = pc.binary_length(raw).cast(pa.int64())
                gone = pc.and_(rest.column("copy"), pc.greater_equal(size, length))
                spans = [[[0, n]] if g else [] for n, g in zip(size.to_pylist(), gone.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rest.column("id"), size, pc.if_else(gone, size, 0), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pc.if_else(gone, b"", raw)],
                    names=[id_col, "n_bytes", "n_removed", "removed_spans", "kept"])
            hit = pc.and_(hit, pc.invert(batch.column("copy")))
            batch = batch.filter(hit)
            total, removed, spans, kept = [], [], [], []
            for i, row, w in _rows(batch, length, gram, False):
                a, z = int(w.first[row]), int(w.first[row + 1])
                gone = np.zeros(z - a, dtype=bool)
                hits = _longs(batch.column("hs")[i])
                if len(hits) and z - a >= length:
                    bad = np.zeros(z - a - length + 1, dtype=bool)
                    _, _, lo, hi = _wanted(w, row, hits)
                    whole = among(w.hashes(lo, hi + length - 1), _longs(batch.column("whole")[i]))
                    bad[expand(lo[whole], hi[whole]) - a] = True
                    starts = expand(lo[~whole], hi[~whole])
                    bad[starts[among(w.hashes(starts, starts + length), _longs(batch.column("single")[i]))] - a] = True
                    gone = covered(bad, length, z - a)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                total.append(z - a)
                removed.append(int(gone.sum()))
                spans.append(edges.reshape(-1, 2).tolist())
                kept.append(w.data[a:z][~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "removed_spans", "kept"])

    text = F.col(text_col)
    texts = bucketed(docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit("copy"), text).alias("t2")), "id", "texts")
    first = texts.where("id is not null and text is not null").groupBy("t", "t2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("t", "t2", "lo")
    copies = texts.where("id is not null").select("id", "t", "t2").join(first, ["t", "t2"]).where("id > lo").groupBy("id").agg(F.collect_set("t").alias("copies"))
    copies = scratch.table(copies, "copies")
    texts = texts.join(copies, "id", "left").select("id", "text", F.coalesce(F.array_contains("copies", F.col("t")), F.lit(False)).alias("copy"))
    known = texts.where("id is not null and not copy")
    marks = known.select("id", "text").mapInArrow(fingerprints, f"h long, id {kind}").repartition(buckets, "h").sortWithinPartitions("h", "id")
    hits = scratch.table(marks.mapInArrow(met_again, f"h long, id {kind}").groupBy("id").agg(F.collect_list("h").alias("hs")), "hits")
    scratch.release()
    involved = known.join(hits, "id")
    rows = scratch.table(involved.select("id", "text", "hs").mapInArrow(stretches, f"h long, c long, id {kind}"), "stretches")
    later = earlier(rows, "stretches")
    whole = scratch.table(later.groupBy("id").agg(F.collect_list("h").alias("whole")), "whole")
    scratch.drop(rows, later)
    scratch.release()
    rest = involved.join(whole, "id", "left").select("id", "text", "hs", "whole")
    rest = scratch.table(rest.mapInArrow(remainders, f"id {kind}, mark long, body binary"), "remainders")
    scratch.release()
    sizes = rest.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    sizes = scratch.table(sizes.select("mark", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("deals")), "sizes")
    dealt = rest.join(sizes, "mark").select(
        "mark", F.pmod(F.xxhash64("id", "body"), F.col("deals")).cast("int").alias("deal"), "id", "body", (F.col("deals") > 1).alias("hot"))
    dealt = dealt.repartition("mark", "deal").sortWithinPartitions("mark", "deal")
    classes = scratch.table(
        dealt.mapInArrow(sort_groups, "id long, h long, c long, open boolean"), "classes")
    scratch.drop(rest, sizes)
    across = earlier(classes.where("open").select(F.col("id").cast(kind).alias("id"), "h", "c"), "dealt")
    single = classes.where("not open").select(F.col("id").cast(kind).alias("id"), "h").unionByName(across)
    single = scratch.table(single.groupBy("id").agg(F.collect_list("h").alias("single")), "single")
    scratch.drop(classes, across)
    scratch.release()
    found = texts.join(hits, "id", "left").join(whole, "id", "left").join(single, "id", "left")
    return found.select("id", "text", "copy", "hs", "whole", "single").mapInArrow(
        cut, f"{id_col} {kind}, n_bytes long, n_removed long, removed_spans array<array<long>>, kept binary")
