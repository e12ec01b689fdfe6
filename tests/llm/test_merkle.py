"""The manifest held against a tree built in plain Python, in blocks small enough for many tiers."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """Root, and for each leaf its siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for k, p in enumerate(at):
            run = runs[p // fanout]
            paths[k].append((run[:p % fanout], run[p % fanout + 1:]))
            at[k] = p // fanout
        nodes = [sha(*r) for r in runs]
    return nodes[0], paths


def brute(rows, fanout, changed):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0], leaf((r[0], r[3], r[2], r[4], r[1])), leaf((r[0], r[3], r[2], r[4], changed(r)))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    each = {s: sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for s in order}
    trees = {s: tree([x[1] for x in each[s]], fanout) for s in order}
    root, tops = tree([trees[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops, strict=True):
        for x, path in zip(each[s], trees[s][1], strict=True):
            fold = x[2]
            for before, after in [*path, *top]:
                fold = sha(*before, fold, *after)
            proof = sha(*(d for before, after in [*path, *top] for d in [*before, *after]))
            out.append((x[0], x[1], trees[s][0], root, proof, fold, fold == root))
    return sorted(out, key=repr)


def lowered(r):
    if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 5:
        return r[1]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])


@pytest.mark.parametrize("fanout, levels", [(16, 3), (2, 1), (3, 2)])
def test_manifest_equals_plain_tree(spark, rows, fanout, levels):
    odd = [(None, "No Id", None, None, None, 1, "k", 2, "u", 3), (None, None, "en", "s1", 4, 1, "k", 2, "u", 3)]
    more = [(500 + i, f"Short {i}", "en", "hot", i, 1, "k", 2, "u", 3) for i in range(60)]
    lone = [(700 + i, "Lone", "fr", f"z{i}", None, 1, "k", 2, "u", 3) for i in range(9)]
    every = [*rows, *odd, *more, *lone]
    docs = spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long, tree long, pos string, n int, digest string, block int")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle.merkle_manifest(docs.repartition(3), found={"text": text}, fanout=fanout, block_levels=levels)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(every, fanout, lowered)


def test_unchanged_rows_verify_and_any_change_is_found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a int, b string, c int, d string, e int")
    assert all(r["verified"] for r in merkle.merkle_manifest(docs, fanout=4, block_levels=1).collect())
    got = merkle.merkle_manifest(docs, found={"n_chars": F.col("n_chars") + 1}, fanout=4, block_levels=1).collect()
    assert len(got) == len(rows) and not any(r["verified"] for r in got)


def test_one_row_and_no_rows(spark, nothing):
    one = merkle.merkle_manifest(spark.createDataFrame([(7, "text", None, None, 4)], "doc_id long, text string, lang string, source string, n_chars long")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == sha()
    assert merkle.merkle_manifest(nothing).count() == 0
