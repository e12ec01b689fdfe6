"""Every stage of the corpus pipeline held against plain Python, on documents with odd cases among them."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and labels with nulls, an empty text, repeated rows, and two columns more."""
    at = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    odd = spark.createDataFrame(
        [(900_001, None, "en", "a", None), (900_002, "", None, None, 0), (None, "no id " * 30, "en", None, 5)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id < 3"))
    docs.withColumns({"key": F.lit("k"), "kept": F.lit(1)}).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def staged(spark, folder):
    """What goes into and comes out of each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, folder)
        done.write.parquet(f"{folder}/{name}")
        done = spark.read.parquet(f"{folder}/{name}")
        out.append((docs.collect(), done.collect()))
        docs = done
    return out


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    return Counter(tuple(r[c] for c in COLUMNS) for r in rows)


def test_quality_keeps_what_the_rules_keep(spark, folder, staged):
    before, after = staged[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = quality.quality_rules(docs, spark.read.parquet(f"{folder}/labels.parquet"), keep=["text"]).collect()
    kept = {(r["doc_id"], r["text"]) for r in judged if r["kept"]}
    assert plain(after) == plain(r for r in before if (r["doc_id"], r["text"]) in kept) and 0 < len(after) < len(before)
    assert all(len(WORD.findall(r["text"] or "")) >= 20 for r in after)


def test_lines_that_repeat_are_gone(staged):
    before, after = staged[1]
    first, left = {}, {r["doc_id"]: r["text"] for r in after}
    for r in sorted((r for r in before if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        kept = (left.get(r["doc_id"]) or "").split("\n")
        for line in filter(WORD.search, r["text"].split("\n")):
            owner = first.setdefault(line, r["doc_id"])
            assert owner == r["doc_id"] or line not in kept
    assert all(r["n_chars"] == len(r["text"]) and WORD.search(r["text"]) for r in after)


def test_one_document_of_a_group_stays(staged):
    before, after = staged[2]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before if r["doc_id"] is not None}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        met = Counter(j for x in s for j in holders[x])
        for j, both in met.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in s:
            holders[x].append(i)
    assert {r["doc_id"] for r in after} == {root(i) for i in sets} | ({None} if any(r["doc_id"] is None for r in before) else set())
    assert not plain(after) - plain(before)


def test_mixing_repeats_prefixes_up_to_twice(staged):
    before, after = staged[3]
    words = defaultdict(list)
    for r in before:
        words[r["doc_id"]].append(WORD.findall(r["text"]))
    uses = Counter(r["doc_id"] for r in after)
    assert after and all(n <= 2 * len(words[i]) for i, n in uses.items())
    for r in after:
        got = WORD.findall(r["text"])
        assert any(got == w[:len(got)] for w in words[r["doc_id"]]) and r["n_chars"] == len(r["text"])


def test_packing_uses_every_id_once(staged):
    before, after = staged[4]
    pieces, filled = defaultdict(int), defaultdict(list)
    for r in after:
        pieces[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    totals = defaultdict(set)
    for r in after:
        totals[r["doc_id"]].add(r["doc_tokens"])
    assert set(pieces) == {r["doc_id"] for r in before}
    assert all(pieces[i] >= max(t) for i, t in totals.items())
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_run_equals_its_stages(spark, folder, staged):
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, staged[-1][1]))


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_one_stage_on_disk(spark, folder, staged, monkeypatch):
    made, begin = [], corpus_pipeline.Scratch.__init__
    monkeypatch.setattr(corpus_pipeline.Scratch, "__init__", lambda self, *a: (begin(self, *a), made.append(self))[0])
    packed = corpus_pipeline.run(spark, folder)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda path: hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(path))
    kept = [s.root for s in made if there(s.root)]
    assert len(made) > 5 and len(kept) == 2
    assert Counter(map(tuple, packed.collect())) == Counter(map(tuple, staged[-1][1]))
