"""Mixture-controlled packing of documents into token sequences by deficit round-robin."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .mixing import cumulative
from .substrings import expand
from .workspace import Scratch

#: Words whose ids a worker keeps.  Ids must fit 16 bits.
MAX_CACHED_WORDS = 200_000

#: Sources known to the driver; more raise instead of growing every task's closure.
MAX_SOURCES = 10_000

#: Bytes of text tokenized at once within an Arrow batch, and ids cut at once; one document at least, however long.
BLOCK_BYTES, BLOCK_IDS = 1 << 20, 256 << 10


class WordTokenizer:
    """Ids of texts, word by word, for a BPE whose pre-tokenizer never crosses ASCII white space.

    Words of a block are told apart by 64-bit hashes; a sorted table of hashes leads to the
    ids of those met before (it starts anew beyond ``MAX_CACHED_WORDS``), and the ids of all
    texts are one gather.  New words of Latin letters, perhaps with a final stop or comma,
    are one or two pieces whatever stands around them: their stems are lower-cased together
    and go to the tokenizer's model through a plain split at spaces, whose ids are parted
    again at those that end a word.  All other words take the tokenizer's whole path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.stems = Tokenizer(self.tokenizer.model)
        self.stems.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(1 << 16, dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.stop, self.comma = (self._whole([m])[0] for m in ".,")
        # visible stand-ins of bytes, as byte-level vocabularies have them; line feeds part stems
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        stand_in = {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}
        self.table = "".join(stand_in[b] if b != 10 else " " for b in range(256))
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16)

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(words), 512) for e in self.tokenizer.encode_batch_fast(words[i:i + 512], add_special_tokens=False)]

    def _stem_ids(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the rows and where each ends; None if that can't be told from the ids."""
        found = self.stems.encode_batch_fast([" ".join(rows[i:i + 512]) for i in range(0, len(rows), 512)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.uint16) for e in found])
        stop = np.flatnonzero(self.ends[ids]) + 1
        return (ids, stop) if len(stop) == len(rows) else None

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at [starts, ends), laid end to end, and their numbers."""
        size = ends - starts
        text = np.full(int(size.sum()) + len(size), 10, dtype=np.uint8)
        stop = np.cumsum(size + 1) - 1
        start = stop - size
        text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[expand(starts, ends)]
        letter = ((text | 32) >= 97) & ((text | 32) <= 122)
        lead = text == 0xC3
        tail = np.concatenate([[False], lead[:-1]]) & (text >= 0x80) & (text <= 0xBF) & (text != 0x97) & (text != 0xB7)
        lead &= np.concatenate([tail[1:], [False]])
        mark = ((text == 46) | (text == 44)) & np.concatenate([text[1:] == 10, [False]])
        marked = mark[stop - 1]
        plain = np.logical_and.reduceat(letter | lead | tail | mark | (text == 10), start) & (size - marked > 0)
        counts, sources = np.zeros(len(size), np.int64), []
        if plain.any():
            low = text.copy()
            low[letter] |= 32
            low[tail & (text <= 0x9E)] += 32
            rows = low[np.repeat(plain, size + 1) & ~mark].tobytes()[:-1].decode("latin-1").translate(self.table).split(" ")
            number = {s: i for i, s in enumerate(dict.fromkeys(rows))}
            found = self._stem_ids(list(number))
            if found is None:
                plain[:] = False
            else:
                ids, last = found
                of = np.fromiter(map(number.__getitem__, rows), dtype=np.int64, count=len(rows))
                first = np.concatenate([[0], last[:-1]])
                counts[plain] = (last - first)[of] + marked[plain]
                sources.append((plain, ids, first[of], last[of]))
        rest = np.flatnonzero(~plain)
        whole = self._whole([data[starts[i]:ends[i]].tobytes().decode() for i in rest.tolist()])
        counts[rest] = [len(x) for x in whole]
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(int(at[-1]), np.uint16)
        for which, ids, lo, hi in sources:
            begin = at[:-1][which]
            out[expand(begin, begin + hi - lo)] = ids[expand(lo, hi)]
            closing = which & marked
            out[at[1:][closing] - 1] = np.where(text[stop[closing] - 1] == 46, self.stop[0], self.comma[0])
        for i, ids in zip(rest.tolist(), whole, strict=True):
            out[at[i]:at[i + 1]] = ids
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, ``end_id`` after each, and the number of ids of each text."""
        starts, ends, first = hashing.word_spans(data, offsets)
        words = np.diff(first)
        if not len(starts):
            return np.full(len(words), end_id, np.uint16), np.ones(len(words), np.int64)
        hashed = hashing.word_hashes(data, starts, ends)
        order = np.argsort(hashed)
        new = np.concatenate([[True], hashed[order[1:]] != hashed[order[:-1]]])
        head = order[new]
        distinct = hashed[head]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        if len(self.keys) > MAX_CACHED_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        fresh[inside] = self.keys[at[inside]] != distinct[inside]
        if fresh.any():
            ids, counts = self._learn(data, starts[head[fresh]], ends[head[fresh]])
            slots = np.arange(len(counts)) + len(self.size)
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(counts) - counts])
            self.size, self.pool = np.concatenate([self.size, counts]), np.concatenate([self.pool, ids])
            self.keys, self.slots = np.insert(self.keys, at[fresh], distinct[fresh]), np.insert(self.slots, at[fresh], slots)
            at = np.searchsorted(self.keys, distinct)
        slot = self.slots[at][which]
        size = self.size[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        own = total[first[1:]] - total[first[:-1]]
        out = np.full(int(total[-1]) + len(words), end_id, np.uint16)
        source = np.arange(int(total[-1])) + np.repeat(self.begin[slot] - total[:-1], size)
        out[np.arange(int(total[-1])) + np.repeat(np.arange(len(words)), own)] = self.pool[source]
        return out, own + 1


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer: Spark keeps workers for many tasks, and the vocabulary is parsed once in each."""
    return WordTokenizer(path)


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(id, source, row, n_tokens, ids)`` of whole texts; ids as little-endian unsigned 16-bit binary."""
    schema = f"id {dict(docs.dtypes)[id_col]}, source string, row long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            for lo, hi, data, offsets in hashing.text_blocks(batch.column(3), BLOCK_BYTES):
                ids, counts = coder.encode(data, offsets, end_id)
                cut = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cut * 2), pa.py_buffer(ids.astype("<u2").view(np.uint8))])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(counts), packed], names=["id", "source", "row", "n_tokens", "ids"])

    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


class Rounds:
    """Where each source's tokens lie in the stream that deficit round-robin serves.

    In every round a source earns credit in proportion to its weight and is served once
    its credit reaches one quantum, so its ``i``-th quantum is due at ``(i + 1/2) / n`` of
    the stream, ``n`` being its number of quanta: what other sources have been served
    before that moment is a count that follows from their totals alone.  The deficits of
    all sources at any window are therefore known everywhere, without a pass over the
    windows before it, and no window departs from the target proportions by more than one
    quantum a source.  Dues are compared as integers; equal ones are served in source order.
    """

    def __init__(self, totals: Sequence[int], quantum: int):
        self.totals = np.asarray(totals, dtype=np.int64)
        self.quantum = quantum
        self.n = -(-self.totals // quantum)

    def position(self, source: int, i: np.ndarray) -> np.ndarray:
        """Stream offset of the ``i``-th quantum of ``source``."""
        out = np.zeros(len(i), dtype=np.int64)
        own = int(self.n[source])
        for s, n in enumerate(self.n.tolist()):
            # quanta j of s with (2j + 1) / n before (2i + 1) / own; at equal dues sources take turns in order
            if s == source:
                served = i
            elif n * own > 2**60:
                served = np.array([(n * (2 * int(x) + 1) + own - (s > source)) // (2 * own) for x in i], dtype=np.int64)
            else:
                served = (n * (2 * i + 1) + own - (s > source)) // (2 * own)
            out += np.minimum(served * self.quantum, self.totals[s])
        return out


def cut_documents(start: np.ndarray, length: np.ndarray, source: np.ndarray, rounds: Rounds, window: int) -> tuple[np.ndarray, ...]:
    """Pieces ``(document, offset in it, length, sequence, offset in sequence)`` of documents at tokens [start, start+length) of their queues.

    Documents are cut at quanta, then at windows, then at the powers of two that the last
    window is split into; neighbouring parts that meet in a sequence are one piece.
    """
    q, total = rounds.quantum, int(rounds.totals.sum())
    first, last = start // q, (start + length - 1) // q
    n = last - first + 1
    doc = np.repeat(np.arange(len(start)), n)
    quantum = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    at = np.zeros(len(doc), dtype=np.int64)
    for s in np.unique(source).tolist():
        mine = source[doc] == s
        at[mine] = rounds.position(s, quantum[mine])
    lo = np.maximum(start[doc], quantum * q)
    hi = np.minimum((start + length)[doc], (quantum + 1) * q)
    stream = at + lo - quantum * q
    full, rest = divmod(total, window)
    ends = [full * window + sum(1 << b for b in range(bit, rest.bit_length()) if rest >> b & 1) for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
    # borders of sequences: every window, then the powers of two
    tails = np.array([full * window, *ends], dtype=np.int64)
    out = [[] for _ in range(5)]
    offset, left = lo - start[doc], hi - lo
    while len(doc):
        tail = np.searchsorted(tails, stream, side="right") - 1
        sequence = np.where(tail < 0, stream // window, full + np.maximum(tail, 0))
        begin = np.where(tail < 0, sequence * window, tails[np.maximum(tail, 0)])
        stop = np.where(tail < 0, begin + window, tails[np.minimum(np.maximum(tail, 0) + 1, len(tails) - 1)])
        now = np.minimum(left, stop - stream)
        for part, value in zip(out, (doc, offset, now, sequence, stream - begin), strict=True):
            part.append(value)
        more = now < left
        doc, offset, left, stream = doc[more], (offset + now)[more], (left - now)[more], (stream + now)[more]
    doc, offset, size, sequence, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    order = np.lexsort((offset, doc))
    doc, offset, size, sequence, place = doc[order], offset[order], size[order], sequence[order], place[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sequence[1:] != sequence[:-1]) | (place[1:] != place[:-1] + size[:-1])
    head = np.flatnonzero(new)
    return doc[head], offset[head], np.add.reduceat(size, head) if len(head) else size, sequence[head], place[head]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    window: int = 4096,
    quantum: int = 512,
    seed: int = 23,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens that all mix the sources alike.

    Target proportions are the sources' shares of all tokens, so every queue lasts to the
    end and each id is used exactly once.  Queues hold a source's documents in seeded hash
    order; a document can be cut between quanta and between windows.  Returns the id,
    ``start`` (ids of the document before the piece), ``length``, ``ids`` (binary, little
    endian), ``doc_tokens``, ``sequence_id`` and ``offset``.  Sequences are full but for
    the last window, which is split into powers of two, so nothing is padded.

    Null or empty text is just the end id; a null source is a queue of its own; an empty
    table has no pieces; repeated rows are packed each.  A document's id may repeat or be
    null; its row is what identifies it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    tokens = scratch.table(tokenize(docs, tokenizer_path, end_id, id_col, text_col, source_col), "tokens")
    lengths = tokens.select("row", "source", "n_tokens", F.xxhash64(F.lit(seed), "id").alias("h"), "id")
    totals = lengths.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    index = spark.createDataFrame([(r["source"], k) for k, r in enumerate(totals)], "source string, k int")
    rounds = Rounds([r["n"] for r in totals], quantum)
    placed = lengths.join(F.broadcast(index), lengths["source"].eqNullSafe(index["source"])).drop(index["source"])
    placed = cumulative(placed, "k", ["h", "row"], "n_tokens", "queue", max(2, sum(r["docs"] for r in totals) // 2_000))
    placed = scratch.table(placed.select("row", "k", "queue"), "queue")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(batch.column("n_tokens").to_numpy())
            lo = 0
            while lo < len(sizes):
                hi = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BLOCK_IDS, side="right"))
                hi = max(hi, lo + 1)
                yield cut_rows(batch.slice(lo, hi - lo))
                lo = hi

    def cut_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        k, queue, n = (batch.column(c).to_numpy() for c in ("k", "queue", "n_tokens"))
        doc, start, length, sequence, offset = cut_documents(queue, n, k, rounds, window)
        held = batch.column("ids").cast(pa.large_binary())
        _, edges, data = held.buffers()
        begin = np.frombuffer(edges, np.int64)[held.offset:held.offset + len(held)] // 2
        tokens = np.frombuffer(data, "<u2") if data is not None else np.zeros(0, "<u2")
        at = np.concatenate([[0], np.cumsum(length)])
        where = np.repeat(begin[doc] + start - at[:-1], length) + np.arange(int(at[-1]))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at * 4), pa.py_buffer(tokens[where].astype("<u4").view(np.uint8))])
        rows = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(rows), pa.array(start), pa.array(length), pieces.cast(pa.binary()), batch.column("n_tokens").take(rows), pa.array(sequence), pa.array(offset)],
            names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return tokens.join(placed, "row").select("id", "k", "queue", "n_tokens", "ids").mapInArrow(cut, schema)


def pieces_crc(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
