"""Alignment held against a plain reading of the definitions, with the libraries' own ids."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rasterloom.llm import align, byte_bpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    stands = byte_bpe.visible_bytes()
    with open(A, encoding="utf-8") as file:
        names = {i: bytes(stands[c] for c in t) for t, i in json.load(file)["model"]["vocab"].items() if not t.startswith("<|endof")}

    def pieces(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return lambda t: [(i, names[i]) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, pieces(i)) for i in b.encode(t)]


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(texts, coders):
    """One tuple for each text."""
    read, holders = [], Counter()
    for text in texts:
        a, b = (spans(f(text)) for f in coders) if text else ([], [])
        raw = " " + (text or "")
        if text and any(b"".join(d for _, d in f(text)) != raw.encode() for f in coders):
            a, b = [], []
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        holders.update(set(links))
        read.append((a, b, links))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, links in read:
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)))
            lo = hi
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), sha))
    return out


def texts_of(rows):
    rng = random.Random(9)
    marks = [*"abe  \n\t\r éß—“'s 'll1٣½　\xa0 中日\U0001f600<▁", "<s>", "<0x0A>", "<|endoftext|>", "the ", "tion"]
    short = [r[1] for r in rows if len(r[1] or "") < 400]
    return short + ["".join(rng.choices(marks, k=rng.randint(0, 25))) for _ in range(150)]


@pytest.mark.parametrize("head, held", [(align.HEAD_PAIRS, align.HELD_PAIRS), (40, 200), (0, 50)])
def test_alignment_equals_its_definition(spark, rows, coders, monkeypatch, head, held):
    monkeypatch.setattr(align, "HEAD_PAIRS", head)
    monkeypatch.setattr(align, "HELD_PAIRS", held)
    monkeypatch.setattr(align, "HELD_COUNTS", held)
    texts = texts_of(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, pairs int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in align.align_tokenizers(docs, A, B).collect()}
    want = dict(enumerate(brute(texts, coders)))
    assert got == want
    assert any(w[0] == 0 and t for w, t in zip(want.values(), texts, strict=True)) and any(w[2] != w[0] for w in want.values())


def test_slices_change_nothing(rows, monkeypatch):
    both = align.Aligner(A, B)
    texts = [t for t in texts_of(rows) if t] + [max((r[1] or "" for r in rows), key=len)]
    whole = [[ids.tolist() for ids in both.tokens(t) or ()] for t in texts]
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 7)
    assert [[ids.tolist() for ids in both.tokens(t) or ()] for t in texts] == whole


def test_nothing(nothing):
    assert align.align_tokenizers(nothing, A, B).count() == 0
