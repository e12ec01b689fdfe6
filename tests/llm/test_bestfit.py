"""Best-fit packing: ids against the vocabulary's own library, pieces exactly once, sequences near best-fit decreasing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rasterloom.llm import bestfit, byte_bpe
from rasterloom.llm.workspace import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library, rows):
    coder, rng = byte_bpe.byte_bpe(PATH), random.Random(3)
    marks = [*"ab  \n\t\r é—“'s 'll1٣½Ⅻ　\xa0 中日\U0001f600\x1c\x85.,!<", "<|endoftext|>"]
    texts = [r[1] or "" for r in rows] + ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == want
        assert [i for s in byte_bpe.slices(text, 5) for i in coder.encode(s).tolist()] == want
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    for text in texts[-500:]:
        assert coder.encode(text, specials=False).tolist() == plain.encode(text, add_special_tokens=False).ids
        assert b"".join(coder.token_bytes[i] for i in coder.encode(text, specials=False)) == text.encode()


def test_pieces_and_sequences(spark, docs, rows, nothing, library):
    window = 64
    got = bestfit.best_fit(docs, PATH, window=window).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    copies = Counter(r[0] for r in rows)
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], ids.tolist()))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % window + 1
        edges = [0, *range(first, len(ids) + 1, window)]
        want = [(k, a, ids[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        assert sorted(pieces[i]) == sorted(want * copies[i])
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert bestfit.best_fit(nothing, PATH).count() == 0


def decreasing(sizes, window):
    """Number of sequences of best-fit decreasing."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else window) - s)
    return len(gaps)


@pytest.mark.parametrize("name", ["even", "small", "equal", "middle", "large", "one"])
def test_about_as_few_sequences_as_best_fit_decreasing(spark, name):
    rng, window = random.Random(11), 100
    sizes = {
        "even": [rng.randint(1, 99) for _ in range(400)], "small": [rng.randint(1, 6) for _ in range(500)], "equal": [40] * 151,
        "middle": [rng.randint(26, 39) for _ in range(300)], "large": [60] * 50 + [1] * 30, "one": [99]}[name]
    items = spark.createDataFrame(list(enumerate(sizes)), "key long, size long")
    got = bestfit.place(items, window, Scratch(spark, "test")).collect()
    held = defaultdict(list)
    for r in got:
        held[r["sequence"]].append((r["offset"], sizes[r["key"]]))
    assert sorted(r["key"] for r in got) == list(range(len(sizes)))
    for parts in held.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= window
    assert len(held) <= decreasing(sizes, window) * 1.02 + 1
