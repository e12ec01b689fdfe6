"""Merkle manifest of a dataset: a tree over each source's rows, a tree over the sources, and a proof for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sweeps import range_offsets, swept
from .workspace import Scratch

#: Characters of a digest in hexadecimal.
HEX = 64


def digest(values: Sequence[Column]) -> Column:
    """Hex sha256 of the values laid end to end: ``-`` for null, else byte count, colon and the value as text."""
    parts = [
        F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")))
        for v in values
    ]
    return F.sha2(F.concat(*parts), 256)


def n_levels(n: int, fanout: int) -> int:
    """Levels of hashing that leave one of ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def hashed_levels(leaves: np.ndarray, levels: int, fanout: int) -> list[np.ndarray]:
    """Digest matrices ``(n, 64)`` of an aligned block, from its leaves upwards; each row hashes ``fanout`` rows of the one below."""
    found = [np.ascontiguousarray(leaves)]
    for _ in range(levels):
        below = found[-1]
        whole = len(below) // fanout
        rows = list(below[:whole * fanout].reshape(whole, fanout * HEX))
        if len(below) % fanout:
            rows.append(below[whole * fanout:].reshape(-1))
        found.append(np.frombuffer(b"".join(hashlib.sha256(r).hexdigest().encode() for r in rows), np.uint8).reshape(-1, HEX))
    return found


def siblings(matrices: Sequence[np.ndarray], fanout: int) -> list[bytes]:
    """For each leaf of a block, the other digests of its run, level by level, left to right."""
    n = len(matrices[0])
    out = [b""] * n
    for level, digests in enumerate(matrices[:-1]):
        node = np.arange(n) // fanout**level
        run, place = node // fanout, node % fanout
        size = np.minimum(fanout, len(digests) - run * fanout)
        for width in np.unique(size).tolist():
            if width == 1:
                continue
            mine = np.flatnonzero(size == width)
            other = np.arange(width - 1)
            index = (run[mine] * fanout)[:, None] + other + (other >= place[mine][:, None])
            text, step = digests[index].tobytes(), (width - 1) * HEX
            for k, i in enumerate(mine.tolist()):
                out[i] += text[k * step:(k + 1) * step]
    return out


def folded(leaf: bytes, path: bytes, at: Sequence[tuple[int, int]], fanout: int) -> bytes:
    """Root that follows from a leaf and its path; ``at`` has position and number of leaves in the row's tree, then of its tree in the tree above."""
    used = 0
    for pos, n in at:
        while n > 1:
            run, place = divmod(pos, fanout)
            end = used + (min(fanout, n - run * fanout) - 1) * HEX
            others = path[used:end]
            leaf = hashlib.sha256(others[:place * HEX] + leaf + others[place * HEX:]).hexdigest().encode()
            used, pos, n = end, run, -(-n // fanout)
    return leaf


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


class Forest:
    """Trees of aligned blocks: tier 0 are the nodes given, tier ``t + 1`` has a node for each block of ``fanout**levels`` nodes of tier ``t``."""

    def __init__(self, nodes: DataFrame, fanout: int, levels: int, scratch: Scratch, name: str):
        self.fanout, self.levels, self.span = fanout, levels, fanout**levels
        self.tiers = [nodes]
        while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
            nodes = scratch.table(self._roots(nodes), f"{name}-{len(self.tiers)}")
            self.tiers.append(nodes)

    def _blocks(self, nodes: DataFrame):
        return nodes.withColumn("block", F.floor(F.col("pos") / self.span)).groupBy("tree", "block")

    def _roots(self, nodes: DataFrame) -> DataFrame:
        fanout, levels = self.fanout, self.levels

        def root(block: pa.Table) -> pa.Table:
            block = block.sort_by("pos")
            n = block["n"][0].as_py()
            top = hashed_levels(_matrix(block["digest"]), min(levels, n_levels(n, fanout)), fanout)[-1]
            return pa.table({
                "tree": block["tree"][:1], "pos": block["block"][:1], "n": [-(-n // fanout**levels)], "digest": [top.tobytes().decode()]})

        narrow = nodes.select("tree", "pos", "n", "digest")
        return self._blocks(narrow).applyInArrow(root, "tree long, pos long, n long, digest string")

    def roots(self) -> DataFrame:
        """``(tree, digest)``: the one node that remains of each tree."""
        return self.tiers[-1].select("tree", "digest")

    def paths(self, above: DataFrame, finish, schema: str, scratch: Scratch, name: str) -> DataFrame:
        """What ``finish(block, paths)`` makes of the nodes of tier 0 and their paths; ``above(tree, path, top)`` holds for whole trees.

        Paths go down tier by tier, to a block's nodes from the one row that the tier above
        has for the block, so no path is copied to rows before the task that uses it.
        """
        down = above.withColumn("pos", F.lit(0).cast("long"))
        for tier in range(len(self.tiers) - 1, -1, -1):
            # the last tier is one node a tree: its path is the tree's
            if tier and tier == len(self.tiers) - 1:
                continue
            function, returns = (_down, "tree long, pos long, path string, top string") if tier else (finish, schema)
            met = self._blocks(self.tiers[tier]).cogroup(down.withColumnRenamed("pos", "block").groupBy("tree", "block"))
            down = met.applyInArrow(self._within(function), returns)
            if tier:
                down = scratch.table(down, f"{name}-paths-{tier}")
        return down

    def _within(self, function):
        fanout, levels = self.fanout, self.levels

        def run(block: pa.Table, way: pa.Table) -> pa.Table:
            block = block.sort_by("pos")
            n = block["n"][0].as_py()
            own = siblings(hashed_levels(_matrix(block["digest"]), min(levels, n_levels(n, fanout)), fanout), fanout)
            rest = way["path"][0].as_py().encode()
            return function(block, [p + rest for p in own], way["top"][0].as_py())

        return run


def _down(block: pa.Table, paths: list[bytes], top: str) -> pa.Table:
    return pa.table({"tree": block["tree"], "pos": block["pos"], "path": [p.decode() for p in paths], "top": [top] * len(paths)})


def _ways(block: pa.Table, paths: list[bytes], top: str) -> pa.Table:
    """Paths of the subroots, each with the subroot itself, for the trees below."""
    return pa.table({"tree": block["pos"], "path": [p.decode() for p in paths], "top": block["digest"]})


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    source_col: str = "source",
    found: Mapping[str, Column] | None = None,
    fanout: int = 16,
    block_levels: int = 3,
) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether the row as ``found`` now still folds to the root.

    A leaf is the digest of ``fields``.  Leaves of a source ascend by id (null first, equal
    ids by leaf); every ``fanout`` consecutive nodes become the digest of their hex digests
    until one remains, the subroot; subroots in the order of sources (null first, by bytes)
    likewise give the root.  ``proof`` is the digest of all siblings from the leaf to the
    root.  ``found`` gives columns for fields as they are read now (default: unchanged).

    Positions come from a range sort by source and id with a running count, so a source of
    any size is spread over tasks; trees are built in aligned blocks of ``fanout **
    block_levels`` nodes, one task holds one block, and paths come down tier by tier.
    Only the root reaches the driver.

    Repeated rows are leaves each; null fields are ``-``; columns beside the fields are
    ignored, whatever their names; texts of any length are hashed as they are; an empty
    table has no rows.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    now = [(found or {}).get(f, F.col(f)) for f in fields]
    leaves = scratch.table(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), digest([F.col(f) for f in fields]).alias("digest"), digest(now).alias("now"), F.lit(1).alias("one")),
        "leaves")
    placed = swept(leaves, [F.asc_nulls_first("source"), F.asc_nulls_first("id"), F.asc("digest"), F.asc("now")], "one", scratch, "placed")
    ranges = scratch.table(range_offsets(placed, "one", "source"), "ranges")
    sources = scratch.table(ranges.select("source", F.lit(1).alias("one")).distinct(), "sources")
    listed = swept(sources, [F.asc_nulls_first("source")], "one", scratch, "listed")
    # ranges of sources: one row for each range, at most as many as shuffle partitions
    numbered = listed.join(F.broadcast(range_offsets(listed, "one")), "_pid").select(
        F.col("source").alias("_source"), (F.col("_at") + F.col("offset")).alias("tree"), F.col("total").alias("n_trees"))
    ranges = scratch.table(
        ranges.join(numbered, ranges["source"].eqNullSafe(numbered["_source"])).select(
            F.col("_pid").alias("_range"), "_source", "offset", F.col("total").alias("n"), "tree", "n_trees"),
        "numbered")
    met = (placed["_pid"] == ranges["_range"]) & placed["source"].eqNullSafe(ranges["_source"])
    nodes = scratch.table(
        placed.join(ranges, met).select("id", "digest", "now", "tree", (F.col("_at") + F.col("offset")).alias("pos"), "n", "n_trees"), "nodes")

    forest = Forest(nodes, fanout, block_levels, scratch, "trees")
    counts = ranges.select("tree", "n_trees").distinct()
    subroots = scratch.table(
        forest.roots().join(counts, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("n_trees").alias("n"), "digest"), "subroots")
    above = Forest(subroots, fanout, block_levels, scratch, "top")
    last = above.roots().first()
    root = last["digest"] if last else ""
    start = docs.sparkSession.range(1 if last else 0).select(F.lit(0).cast("long").alias("tree"), F.lit("").alias("path"), F.lit("").alias("top"))
    ways = scratch.table(
        above.paths(start, _ways, "tree long, path string, top string", scratch, "top"), "ways")

    kind = dict(docs.dtypes)[id_col]

    def finish(block: pa.Table, paths: list[bytes], subroot: str) -> pa.Table:
        n, tree, n_trees = (block[c][0].as_py() for c in ("n", "tree", "n_trees"))
        folds = [
            folded(leaf.encode(), path, [(pos, n), (tree, n_trees)], fanout).decode()
            for leaf, path, pos in zip(block["now"].to_pylist(), paths, block["pos"].to_pylist(), strict=True)
        ]
        return pa.table({
            "id": block["id"], "leaf": block["digest"], "subroot": [subroot] * len(folds),
            "proof": [hashlib.sha256(p).hexdigest() for p in paths], "folded_root": folds})

    done = forest.paths(ways, finish, f"id {kind}, leaf string, subroot string, proof string, folded_root string", scratch, "trees")
    return done.select(
        F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), F.col("proof").alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"))
