"""Best-fit packing of whole documents into token sequences by bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .byte_bpe import byte_bpe
from .sweeps import range_offsets, swept
from .workspace import Scratch

#: Bytes of pieces that leave a task in one Arrow batch; one document's at least.
BATCH_BYTES = 4 << 20


def cut(n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of ``n`` tokens: whole windows, the first piece the rest."""
    ends = np.arange(n, 0, -window)[::-1]
    starts = np.concatenate([[0], ends[:-1]])
    return starts, ends - starts


def tokenize_pieces(docs: DataFrame, path: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, ids)`` of whole texts, ids as little-endian unsigned 32-bit binary."""
    schema = f"id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        for batch in batches:
            rows, columns, held = [], [[] for _ in range(5)], 0

            def flush(batch=batch):
                nonlocal rows, columns, held
                piece, start, length, crc, ids = columns
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "piece", "start", "length", "ids_crc32", "ids"])
                rows, columns, held = [], [[] for _ in range(5)], 0
                return out

            for row, text in enumerate(batch.column(1)):
                ids = np.append(coder.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(zip(*cut(len(ids), window), strict=True)):
                    data = ids[s:s + n].tobytes()
                    rows.append(row)
                    for column, value in zip(columns, (k, int(s), int(n), zlib.crc32(data), data), strict=True):
                        column.append(value)
                    held += len(data)
                    if held >= BATCH_BYTES:
                        yield flush()
            if rows:
                yield flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def match(items: DataFrame, gaps: DataFrame, largest: int, scratch: Scratch) -> DataFrame:
    """One round: items ``(key, size)`` and gaps ``(sequence, free, filled)`` matched best first.

    A gap offers as many slots as items of the ``largest`` size fit it, one at least.
    Items and slots are range-sorted by size, an item before a slot of its size, and swept:
    an item goes one level up, a slot one level down, and a slot takes the item that came
    up to its level last, the largest that is left below it.  On a level, items and slots
    take turns, at most one of each for each size, so a level is a small group.  Items that
    meet no slot, and slots that meet no item, wait.

    Returns slots with the item they took (``key``, ``size``; null if none), ``offset`` in
    the sequence and what the sequence has then (``free``, ``filled``), and items left over
    (``sequence`` null).
    """
    of_largest = F.floor(F.col("free") / largest)
    number = F.greatest(of_largest, F.lit(1)).cast("int")
    slots = gaps.select("sequence", "free", "filled", number.alias("slots"), F.explode(F.sequence(F.lit(1), number)).alias("slot"))
    room = F.when(F.col("slot") < F.col("slots"), F.lit(largest)).otherwise(F.col("free") - F.lit(largest) * (F.col("slots") - 1))
    none = F.lit(None).cast("long")
    both = items.select(F.lit(1).alias("step"), F.col("size").alias("room"), "key", "size", none.alias("sequence"), none.alias("free"), none.alias("filled"), F.lit(None).cast("int").alias("slot")).unionByName(
        slots.select(F.lit(-1).alias("step"), room.cast("long").alias("room"), none.alias("key"), none.alias("size"), "sequence", "free", "filled", "slot"))
    # at equal room items come first
    sorted_ = swept(both, [F.asc("room"), F.desc("step"), F.asc("key"), F.asc("sequence"), F.asc("slot")], "step", scratch, "sorted")
    # one row for each range: at most as many as shuffle partitions
    levelled = sorted_.join(F.broadcast(range_offsets(sorted_, "step")), "_pid").withColumn(
        "level", F.col("_at") + F.col("offset") + F.when(F.col("step") > 0, 1).otherwise(0))
    on_level = W.partitionBy("level").orderBy("room", F.desc("step"))
    met = levelled.select(
        "step", "sequence", "free", "filled", "slot",
        F.when(F.col("step") > 0, F.col("key")).otherwise(F.lag("key").over(on_level)).alias("key"),
        F.when(F.col("step") > 0, F.col("size")).otherwise(F.lag("size").over(on_level)).alias("size"),
        F.lead("step").over(on_level).alias("next")).where("step < 0 or next is null")
    # an item left over is a group of its own
    own = W.partitionBy(F.coalesce("sequence", -1 - F.col("key"))).orderBy("slot")
    taken = F.coalesce("size", F.lit(0))
    before = F.coalesce(F.sum(taken).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(taken).over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    done = met.select(
        "key", "size", "sequence", "slot", (F.col("filled") + before).alias("offset"), (F.col("free") - total).alias("free"), (F.col("filled") + total).alias("filled"))
    return scratch.table(done, "matched")


def place(items: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """``(key, sequence, offset)`` of items ``(key, size)``, none above ``window``, in few sequences.

    Where no gap takes any item, the largest items open sequences: as many as the volume
    that is left needs, and all above half a window.  Then rounds of :func:`match` fill the
    gaps until nothing fits.  Each round sorts and sends only what is left, as rows of a
    few numbers; five counts reach the driver.
    """
    placed: list[DataFrame] = []
    gaps: DataFrame | None = None
    while True:
        state = items.agg(
            F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), F.max("size").alias("largest"), F.min("size").alias("least"),
            F.count_if(F.col("size") * 2 > window).alias("large")).first()
        if not state["n"]:
            break
        if gaps is not None:
            matched = match(items, gaps.where(F.col("free") >= state["least"]), state["largest"], scratch)
            found = matched.where("sequence is not null and key is not null")
            gaps = matched.where("slot = 1").select("sequence", "free", "filled")
            if not found.isEmpty():
                placed.append(found.select("key", "sequence", "offset"))
                items = matched.where("sequence is null").select("key", "size")
                continue
        n = max(-(-state["volume"] // window), state["large"])
        ranked = swept(items.withColumn("one", F.lit(1)), [F.desc("size"), F.asc("key")], "one", scratch, "ranked")
        ranked = ranked.join(F.broadcast(range_offsets(ranked, "one")), "_pid").withColumn("first", F.col("_at") + F.col("offset") < n)
        ranked = scratch.table(ranked.select("key", "size", "first"), "opened")
        opened = ranked.where("first")
        placed.append(opened.select("key", F.col("key").alias("sequence"), F.lit(0).cast("long").alias("offset")))
        fresh = opened.select(F.col("key").alias("sequence"), (F.lit(window) - F.col("size")).alias("free"), F.col("size").alias("filled"))
        gaps = gaps.unionByName(fresh) if gaps is not None else fresh
        items = ranked.where("not first").select("key", "size")
    out = placed[0] if placed else items.select("key", F.col("key").alias("sequence"), F.col("size").alias("offset"))
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


def best_fit(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 1024, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of documents in few sequences of at most ``window`` tokens, documents whole wherever they fit.

    A document is its ids and ``end_id``.  One longer than ``window`` is cut into whole
    windows and a shorter first piece; whole windows are sequences as they are, and only
    shorter pieces are packed (see :func:`place`).  Returns the id, ``piece`` (from 0),
    ``start``, ``length``, ``ids_crc32``, ``ids`` (binary, little endian), ``sequence_id``
    (the key of the piece that opened it) and ``offset``; sequences have no gaps inside.

    Null or empty text is just the end id; repeated rows and equal sizes are pieces each,
    told apart by their row; ids may be null; extra columns are ignored whatever their
    names; a text of any length is encoded whole, in slices; an empty table has no pieces.
    """
    scratch = Scratch(docs.sparkSession, "best-fit")
    pieces = tokenize_pieces(docs, tokenizer_path, end_id, window, id_col, text_col).withColumn("key", F.monotonically_increasing_id())
    pieces = scratch.table(pieces, "pieces")
    named = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "ids"]
    short = pieces.where(F.col("length") < window)
    places = place(short.select("key", F.col("length").alias("size")), window, scratch)
    whole = pieces.where(F.col("length") == window).select(*named, F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(short.join(places, "key").select(*named, F.col("sequence").alias("sequence_id"), "offset"))
