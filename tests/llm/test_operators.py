"""Operators held against plain Python on small tables with every odd case in them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import hashing, html_text, lines, media, mixing, neardup, packing, quality, substrings, suffixes, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def by_id(rows):
    return {r[0]: r[1] or "" for r in rows}


# media -------------------------------------------------------------------------------


def test_media_round_trip(spark, docs, rows, nothing):
    got = media.media_column(docs).collect()
    assert len(got) == len(rows)
    want = by_id(rows)
    for r in got:
        data = want[r["doc_id"]].encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert len({r["media_sha256"] for r in got if want[r["doc_id"]] == ""}) == 1
    assert media.media_column(nothing).count() == 0


def test_media_reads_ranges_and_retries(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i} " * 200) for i in range(60)], "doc_id long, text string").repartition(2)
    archive = media.ArchiveWriter()
    blobs = {f"{i}".encode(): media.encode_png(media.padded(b"x%d" % i * 50), 100) for i in range(50)}
    for name, data in blobs.items():
        archive.add(name, data)
    (tmp_path / "a.zip").write_bytes(archive.finish())
    import zipfile

    assert zipfile.ZipFile(tmp_path / "a.zip").testzip() is None
    got = media.read_archives(spark, tmp_path.as_uri(), range_bytes=700).collect()
    assert {r["member"].encode(): bytes(r["content"]) for r in got} == blobs and len(got) == 50
    reader = media.ArchiveReader({"path": tmp_path.as_uri(), "range_bytes": "100000"})
    failures, original = [], media.read_member

    def flaky(source, offset, length, crc):
        if offset and offset not in failures:
            failures.append(offset)
            raise OSError("lost")
        return original(source, offset, length, crc)

    media.read_member = flaky
    try:
        rows = [m for p in reader.partitions() for b in reader.read(p) for m in b.column("member").to_pylist()]
    finally:
        media.read_member = original
    assert len(rows) == 50 and len(failures) == 49
    with pytest.raises(ValueError):
        media.decode_png(blobs[b"3"][:-20])


def test_media_string_ids_and_manifest(spark, tmp_path):
    ids = ["null", None, "", "'q", "7", "7"]
    got = media.media_column(spark.createDataFrame([(i, "text") for i in ids], "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted(ids, key=repr)

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").repartition(2)
    folder, manifest = (tmp_path / x for x in ("archives", "manifest"))
    media.write_archives(docs, folder.as_uri(), manifest.as_uri())
    orphan = media.ArchiveWriter()
    orphan.add(b"99", media.encode_png(media.padded(b"left by a failed attempt"), 24))
    (folder / "part-000000-999-00000.zip").write_bytes(orphan.finish())
    (folder / "part-000000-998-00000.zip").write_bytes(b"cut o")
    read = media.read_archives(spark, folder.as_uri(), manifest=manifest.as_uri())
    assert sorted(int(r["member"]) for r in read.collect()) == list(range(20))
    with pytest.raises(OSError):
        media.read_member(pa.BufferReader(b"short"), 0, 10, 0)


# packing -----------------------------------------------------------------------------


def test_packing(spark, docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(900, "It's 'rest **bold*** x,y ÀÉ× ß. don't café, 12.5% <|endoftext|>", "q")], "doc_id long, text string, source string")
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in by_id([*rows, (900, extra.first()["text"])]).items()}
    table = docs.select("doc_id", "text", "source").unionByName(extra)
    got = packing.pack(table, path, window=256, quantum=32).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    copies = Counter(r[0] for r in [*rows, (900,)])
    for i, ids in want.items():
        joined = [x for _, part in sorted(pieces[i]) for x in part]
        assert Counter(joined) == Counter(ids * copies[i])
        if copies[i] == 1:
            assert joined == ids
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(nothing, path).count() == 0


def test_rounds_keep_proportions():
    rounds = packing.Rounds([50_000, 10_000, 3_000], 32)
    seen = []
    for s in range(3):
        n = int(rounds.n[s])
        at = rounds.position(s, np.arange(n))
        seen += [(int(p), min(32, int(rounds.totals[s]) - 32 * i)) for i, p in enumerate(at)]
        # at any moment a source lags or leads its share by less than two quanta
        assert np.abs(at - np.arange(n) * 32 * (63_000 / rounds.totals[s])).max() < 63_000 / rounds.totals[s] * 64
    at = 0
    for p, n in sorted(seen):
        assert p == at
        at += n
    assert at == 63_000


# mixing ------------------------------------------------------------------------------


def test_mix_shuffles_texts_once_and_keeps_columns(spark, docs, rows, monkeypatch):
    made, table = {}, mixing.Scratch.table
    monkeypatch.setattr(mixing.Scratch, "table", lambda self, df, name: made.setdefault(name, table(self, df, name)))
    mixed = mixing.mix_sources(docs, keep=["text", "lang"])
    assert not [c for c in made["placed"].columns if c.startswith("_k")]
    texts = lambda found: sorted((r["doc_id"], r["text"] or "", r["lang"]) for r in found)
    assert texts(mixed.collect()) == texts(docs.collect())
    plain = mixing.mix_sources(docs).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in mixed.collect()) == sorted((r["doc_id"], r["size"], r["taken"]) for r in plain)


def test_mixing(docs, rows, nothing):
    got = mixing.mix_sources(docs, block=64).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes, source = Counter(), {r[0]: r[3] for r in rows}
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    taken = Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(by_id(rows)[r["doc_id"]])) and r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] <= 2 * r["source_size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for r in got:
        assert abs(taken[source[r["doc_id"]]] - r["target"]) <= 64 * 3
    again = mixing.mix_sources(docs.repartition(5), block=64).select("doc_id", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix_sources(nothing).count() == 0


def test_small_sources_reach_their_targets(spark):
    texts = [(i, "w " * 1000, "a") for i in range(100)] + [(100 + i, "w " * 60, f"b{i:02d}") for i in range(40)]
    got = mixing.mix_sources(spark.createDataFrame(texts, "doc_id long, text string, source string"))
    small = got.where("doc_id >= 100").collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.15 * r["target"] for r in small)
    assert abs(sum(r["taken"] - r["target"] for r in small)) <= 0.03 * sum(r["target"] for r in small)


def test_targets_are_capped_and_shared_again():
    assert mixing.capped_targets([(100, 3), (100, 1), (100, 2)], 450, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert sum(mixing.capped_targets([(1, 3), (1000, 1)], 1500, 2)) == pytest.approx(1500)


def test_mixed_documents_repeat_prefixes(docs):
    mixed = mixing.mix_sources(docs.withColumnRenamed("doc_id", "row"), id_col="row", block=64, keep=["text"])
    total = mixed.agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(mixed)
    assert out.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == total


# pages -------------------------------------------------------------------------------

PAGES = [
    (0, "http://a.org/x", "<html><head><title>t</title></head><body><nav><a>menu one</a></nav><article><h1>Head &amp; more</h1><p>First   text<br>here <b>bold</b>.</p><!-- x --><aside>side note</aside><p>Second&nbsp;one</p></article><footer>foot text</footer></body></html>"),
    (1, "http://b.org/x", ""), (2, None, None),
    (3, "http://c.org/x", "<body><script>var a='<p>no</p>'</script><div class='ad'>buy now</div><article><p>only this text is meant to stay</p></article></body>"),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_main_text(pages).collect()}
    assert got[0]["text"] == "Head & more First text here bold. Second one" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["text"] == "only this text is meant to stay"
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("head, tail", [
    ("<body class='has-sidebar sidebar'>", "</body>"), ("<div class='content with-sidebar'>", "</div>"), ("<div id='post' class='comments-open comments'>", "</div>"),
    ("<form id='all'>", "</form>"), ("<div class='navy'>", "</div>")])
def test_article_in_marked_wrapper(head, tail):
    inner = "<p>one two</p><figure><figcaption>a caption</figcaption></figure><p><label>named</label> <math><mi>x</mi></math> end</p><div class='ad'>buy</div>"
    plain = [p[2] for p in PAGES if p[2]]
    outside = "<body><figure><figcaption>far away words here</figcaption></figure><article><p>some text</p></article></body>"
    weights = html_text.fit_weights([*plain, outside])
    page = f"<html>{head}<nav>menu one</nav><article>{inner}</article><div class='sidebar'>see also</div>{tail}</html>"
    assert html_text.main_text(page, weights) == "one two a caption named x end"


def test_best_region_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        s = rng.integers(-4, 5, 12).tolist()
        best = max([0, *(sum(s[i:j]) for i in range(12) for j in range(i + 1, 13))])
        i, j = html_text.best_region(s)
        assert sum(s[i:j]) == best


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]



@pytest.mark.parametrize("unit", ['<a "', "<div>", "<a <b ", "<a<a", "<! ", "<a \"'", '<p "x" ', '</x y="', "<article><div>"])
def test_html_text_takes_linear_time_on_broken_pages(unit):
    weights = html_text.Weights()
    assert html_text.main_text("<article>some words</article>" + unit * 50_000, weights).startswith("some words")


def test_html_tags_end_outside_quotes():
    page = "a<!-- x > --><p class='q>\"'>b<a \"unclosed>c</p ><script>if (a<b) x</script >d<1>e<?x?>"
    found = [(t.name, t.closing, page[t.start:t.end]) for t in html_text.tags(page)]
    assert found == [
        ("", False, "<!-- x > -->"), ("p", False, "<p class='q>\"'>"), ("p", True, "</p >"),
        ("script", False, "<script>if (a<b) x</script >"), ("", False, "<?x?>")]
    assert list(html_text.tags("")) == [] and list(html_text.tags("<")) == [] and list(html_text.tags("<a")) == []

def test_urls(spark):
    pages = spark.createDataFrame([
        (0, "https://WWW.example.ORG/es/1?q#f", ""), (1, "http://x.example.org/en/2", None), (2, "http://a.com/de/x", "<link rel='canonical' href='http://b.net/y'>"),
        (3, "http://b.net/y", ""), (4, "nothing", ""), (5, None, None), (6, "http://c.net/z", "<meta http-equiv=\"refresh\" content=\"0; url=/w\">"),
        (7, "http://c.net/w", "<link href=//a.com/de/x rel=canonical>"), (8, "http://sexample.org", ""), (9, "http://d.com/fr/", "<link rel=canonical href=http://e.net/>"), (10, "http://e.net/", ""),
    ], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, URL_RULES, keep=["page_id"]).collect()}
    assert got[0] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("x.example.org", "/en/2", "org/", "allow")
    assert got[3][2:] == (None, "block") and got[6][2:] == (None, "block") and got[7][2:] == (None, "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[8] == ("sexample.org", "", None, "allow") and got[10][2:] == (None, "allow")
    many = [*URL_RULES, *(("block", f"h{i}.zz", "/") for i in range(80))]
    assert got == {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, many, keep=["page_id"]).collect()}
    assert url_filter.judge_urls(pages.limit(0), URL_RULES, keep=["page_id"]).count() == 0


def test_redirect_script_joins_no_sites(spark):
    pages = spark.createDataFrame([
        (0, "http://go.net/r?to=1", '<meta http-equiv="refresh" content="0; url=http://a.com/de/x">'),
        (1, "http://go.net/r?to=2&amp=1", '<link rel=canonical href="http://good.net/y?a=1&amp;b=2">'),
        (2, "http://good.net/y?a=1&b=2", ""), (3, "http://go.net/r", None),
    ], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, URL_RULES, keep=["page_id"]).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow"}


# deduplication -----------------------------------------------------------------------


def unique(rows):
    return sorted(by_id(rows).items())


@pytest.mark.parametrize("batches,fan_in", [(1, 4), (4, 2)])
def test_substrings(docs, rows, batches, fan_in):
    seen, want = {}, {}
    for i, t in unique(rows):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k:k + 20]), (i, k)) != (i, k):
                gone[k:k + 20] = [True] * 20
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    got = substrings.deduplicate_substrings(docs, batches=batches, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]
        assert sum(b - a for a, b in r["removed_spans"]) == r["n_removed"]


def test_bytes(docs, rows):
    seen, want = set(), {}
    for i, t in unique(rows):
        b = t.encode()
        gone, new = bytearray(len(b)), []
        for k in range(len(b) - 49):
            if b[k:k + 50] in seen:
                gone[k:k + 50] = b"\1" * 50
            new.append(b[k:k + 50])
        seen.update(new)
        want[i] = (len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g))
    got = suffixes.deduplicate_bytes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], bytes(r["kept"])) == want[r["doc_id"]]


def test_bytes_with_dealt_groups(spark, monkeypatch):
    texts = [(i, f"{i:03d} " + "the same passage that everybody copies, word for word, again and again" + f" {i * 7:04d}") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    whole = {r["doc_id"]: r["n_removed"] for r in suffixes.deduplicate_bytes(docs).collect()}
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 4)
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.deduplicate_bytes(docs).collect()} == whole
    assert whole[0] == 0 and min(v for k, v in whole.items() if k) > 50


def test_suffix_blocks_end_between_groups(spark, docs, monkeypatch):
    """The fewest bytes sorted at once, a group each time, give the same rows."""
    whole = {r["doc_id"]: r for r in suffixes.deduplicate_bytes(docs).collect()}
    assert sum(r["n_removed"] for r in whole.values()) > 0
    monkeypatch.setattr(suffixes, "SORT_BYTES", 1)
    assert {r["doc_id"]: r for r in suffixes.deduplicate_bytes(docs).collect()} == whole


def test_windows_and_minima_are_those_taken_one_by_one():
    rng = np.random.default_rng(4)
    for n in (0, 1, 15, 16, 17, 90):
        values = rng.integers(0, 2**63, n).astype(np.uint64)
        sums = hashing.prefix(values)
        at = np.arange(max(0, n - 15))
        assert (hashing.windows(sums, 16) == hashing.spans(sums, at, at + 16)).all()
        for width in (1, 2, 7, 16, 35):
            assert hashing.sliding_min(values, width).tolist() == [min(values[i:i + width]) for i in range(max(0, n - width + 1))]


def test_among_is_isin():
    rng = np.random.default_rng(3)
    for n, k in [(0, 0), (0, 4), (5, 0), (1, 1), (130, 7), (130, 300)]:
        values, found = (rng.integers(0, 200, x).astype(np.uint64) * np.uint64(2**56) for x in (n, k))
        found = np.append(found, np.uint64(2**64 - 1)) if k > 100 else found
        assert (suffixes.among(values, found) == np.isin(values, found)).all()


def test_suffix_order():
    rng = np.random.default_rng(1)
    data = np.frombuffer(bytes(rng.integers(97, 99, 400, dtype=np.uint8)) * 3 + bytes(64), dtype=np.uint8)
    at = np.arange(1200 - 50)
    order, group = suffixes.sort_suffixes(data, at)
    keys = [data[i:i + 50].tobytes() for i in at[order]]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:])] == (group[1:] == group[:-1]).tolist()


def test_empty_tables(nothing):
    assert substrings.deduplicate_substrings(nothing).count() == 0
    assert suffixes.deduplicate_bytes(nothing).count() == 0
    assert neardup.near_duplicates(nothing).count() == 0
    assert lines.deduplicate_lines(nothing).count() == 0


def shingle_set(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, rows):
    sets = {i: shingle_set(t) for i, t in unique(rows)}
    parent = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        root = find(parent, r["doc_id"])
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root, root == r["doc_id"])


def test_estimates_follow_similarity():
    rng = np.random.default_rng(2)
    for n, share in ((6, 0.5), (60, 0.8), (2000, 0.75)):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
            k = int(n * 2 * share / (1 + share))
            a, b = np.unique(np.concatenate([pool[:k], pool[k:n]])), np.unique(np.concatenate([pool[:k], pool[n:2 * n - k]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None])[0] - true)
        assert abs(np.mean(errors)) < 0.1


def test_lines(docs, rows):
    gone = brute_lines(unique(rows))
    got = lines.deduplicate_lines(docs.drop("key")).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if texts[r["doc_id"]] is None:
            assert r["kept_text"] is None and r["n_lines"] == 0
            continue
        parts = texts[r["doc_id"]].split("\n")
        left = [x for p, x in enumerate(parts) if (r["doc_id"], p) not in gone]
        assert (r["n_lines"], r["n_removed"], r["kept_text"]) == (len(parts), len(parts) - len(left), "\n".join(left))


def brute_lines(table):
    """(id, pos) of the lines that go, by 5-character shingles at every position."""
    first = {}
    for i, t in table:
        for p, x in enumerate(t.split("\n")):
            if WORD.search(x):
                first.setdefault(x, (i, p))
    sets = {x: {x[k:k + 5] for k in range(max(1, len(x) - 4))} for x in first}
    parent = {x: x for x in first}
    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and 100 * both >= 75 * len(sets[x] | sets[y]):
                parent[find(parent, x)] = find(parent, y)
    keep = {}
    for x, at in first.items():
        keep[find(parent, x)] = min(keep.get(find(parent, x), at), at)
    return {(i, p) for i, t in table for p, x in enumerate(t.split("\n")) if x in first and keep[find(parent, x)] != (i, p)}


def test_lines_with_one_changed_word(spark):
    import random

    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    texts = []
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(18)]
        v = list(w)
        v[rng.randrange(18)] = "xyz"
        texts += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    want = brute_lines(texts)
    assert len(want) > 30
    got = lines.deduplicate_lines(spark.createDataFrame(texts, "doc_id long, text string")).where("n_removed > 0").collect()
    assert {(r["doc_id"], 0) for r in got} == want


def test_line_bands_find_pairs_at_the_threshold(spark):
    """Recall of the bands, measured: pairs of lines of 40 to 400 shingles at a similarity of 0.75 to 0.8."""
    rng, texts = np.random.default_rng(3), []
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    sets = lambda x: {x[i:i + 5] for i in range(max(1, len(x) - 4))}
    while len(texts) < 800:
        line = rng.choice(letters, int(rng.integers(44, 404)))
        other = line.copy()
        for at in rng.choice(len(line), max(1, round(len(line) * rng.uniform(0.02, 0.035))), replace=False):
            other[at] = "#"
        a, b = "".join(line), "".join(other)
        if 75 * len(sets(a) | sets(b)) <= 100 * len(sets(a) & sets(b)) <= 80 * len(sets(a) | sets(b)):
            texts += [(len(texts), a), (len(texts) + 1, b)]
    got = lines.drop_similar_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(r["id"] % 2 for r in got) and len(got) >= 0.95 * len(texts) / 2


def test_line_sketches_leave_out_no_link():
    """The sketch test against plain sets: linked pairs all pass, pairs far below the threshold don't."""
    rng, pairs = np.random.default_rng(8), []
    for length in (1, 3, 6, 40, 300, 900):
        for share in (0, 0.01, 0.03, 0.05, 0.3):
            for _ in range(6):
                a = rng.choice(list("abcdefgh \u00e9\u6211\U0001f600"), length)
                b = np.where(rng.random(length) < share, "#", a)
                pairs.append(("".join(a), "".join(b)))
    texts = [x for p in pairs for x in p]
    got = lines.sketched(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["l1", "line"]))
    sets = [lines.shingle_set(x) for x in texts]
    assert got.column("n").to_pylist() == [len(x) for x in sets]
    n, odd = got.column("n"), got.column("odd")
    even, uneven = pa.array(range(0, len(texts), 2)), pa.array(range(1, len(texts), 2))
    kept = lines.close(pa.RecordBatch.from_arrays(
        [even, uneven, n.take(even), n.take(uneven), odd.take(even), odd.take(uneven)], names=["a", "b", "n_a", "n_b", "odd_a", "odd_b"]))
    kept = set(kept.column("a").to_pylist())
    for i in range(0, len(texts), 2):
        both, union = len(sets[i] & sets[i + 1]), len(sets[i] | sets[i + 1])
        assert i in kept or 100 * both < 75 * union
        assert i not in kept or both >= 0.5 * union


def test_line_joins_test_sketches_as_batches_do(spark):
    """The join's condition against ``close``, on the same pairs."""
    rng, texts = np.random.default_rng(9), []
    for length in (3, 40, 300):
        for share in (0, 0.02, 0.04, 0.3):
            a = rng.choice(list("abcdefgh \u00e9"), length)
            texts += ["".join(a), "".join(np.where(rng.random(length) < share, "#", a))]
    ids = pa.array(range(len(texts)))
    got = lines.sketched(pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["l1", "line"]))
    n, odd, even, uneven = got.column("n"), got.column("odd"), ids.take(pa.array(range(0, len(texts), 2))), ids.take(pa.array(range(1, len(texts), 2)))
    want = lines.close(pa.RecordBatch.from_arrays(
        [even, uneven, n.take(even), n.take(uneven), odd.take(even), odd.take(uneven)], names=["a", "b", "n_a", "n_b", "odd_a", "odd_b"]))
    found = lines.sketches(spark.createDataFrame(list(enumerate(texts)), "l1 long, line string"))
    side = lambda i: found.select(*[F.col(c).alias(f"{c}_{i}") for c in found.columns])
    pairs = side(1).join(side(2), (F.col("l1_1") % 2 == 0) & (F.col("l1_2") == F.col("l1_1") + 1) & lines.linkable("_1", "_2"))
    assert sorted(r["l1_1"] for r in pairs.collect()) == want.column("a").to_pylist()
    assert 0 < len(want) < len(texts) / 2


def test_lines_pair_only_likely_ones_of_a_large_group(spark, monkeypatch):
    """Lines far below the threshold share band keys in numbers; they are not paired with each other."""
    rng, made = np.random.default_rng(6), {}
    base = rng.choice(list("abcdefghijklmnop "), 300)
    texts = [(i, "".join(np.where(rng.random(300) < 0.025, rng.choice(list("QRSTUVW"), 300), base))) for i in range(150)]
    table = lines.Scratch.table
    monkeypatch.setattr(lines.Scratch, "table", lambda self, df, name: made.setdefault(name, table(self, df, name)) if name == "rest" else table(self, df, name))
    gone = lines.drop_similar_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    sets = [lines.shingle_set(t) for _, t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])
    of = {r["l1"]: r["id"] for r in lines.numbered_lines(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    assert {(r["id"], r["pos"]) for r in gone} <= brute_lines(texts)
    assert "rest" in made and all(near(of[r["a"]], of[r["b"]]) for r in made["rest"].collect())


def test_lines_of_several_keys_are_paired_once(spark, monkeypatch):
    """Lines of one group share many band keys: each pair leaves the join once, and lines without a partner don't reach it."""
    rng, made = np.random.default_rng(7), {}
    base = rng.choice(list("abcdefghijklmnop "), 300)
    texts = [(i, "".join(np.where(rng.random(300) < 0.025, rng.choice(list("QRSTUVW"), 300), base))) for i in range(150)]
    table = lines.Scratch.table
    monkeypatch.setattr(lines.Scratch, "table", lambda self, df, name: made.setdefault(name, table(self, df, name)) if name in ("held", "rest") else table(self, df, name))
    monkeypatch.setattr(lines.Scratch, "drop", lambda self, *tables: None)
    lines.drop_similar_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    pairs = [(r["a"], r["b"]) for r in lines.met_once(made["held"]).collect()]
    shared = defaultdict(list)
    for r in made["held"].collect():
        shared[r["key"]].append(r)
    close = lambda x, y: bin((x["s0"] ^ y["s0"]) & (1 << 64) - 1).count("1") + bin((x["s1"] ^ y["s1"]) & (1 << 64) - 1).count("1") <= lines.MAX_BITS_APART
    apart = lambda x, y: sum(bin((x[c] ^ y[c]) & (1 << 64) - 1).count("1") for c in lines.ODD_WORDS)
    likely = lambda x, y: x["c"] != y["c"] and close(x, y) and (None in (x["d"], y["d"]) or abs(x["d"] - y["d"]) <= 0.25 + 1e-9)
    by_key = [(x["b"], y["b"]) for rows in shared.values() for x in rows for y in rows if x["b"] < y["b"] and likely(x, y) and apart(x, y) * 175 <= 25 * (x["n"] + y["n"])]
    assert len(pairs) == len(set(pairs)) < len(by_key)
    # a pair that one of its keys' distances rules out is no link, so it may be missing
    assert set(pairs) <= set(by_key)
    sets, of = [lines.shingle_set(t) for _, t in texts], {r["l1"]: r["id"] for r in lines.numbered_lines(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    jaccard = lambda a, b: len(sets[of[a]] & sets[of[b]]) / len(sets[of[a]] | sets[of[b]])
    assert all(jaccard(a, b) < 0.75 for a, b in set(by_key) - set(pairs))
    assert all(any(likely(x, y) for y in rows) for rows in shared.values() for x in rows)
    assert set(pairs) >= {(r["a"], r["b"]) for r in made["rest"].collect()}


def test_line_signatures_of_blocks(monkeypatch):
    """Signatures don't depend on how a batch is cut, and equal shingle sets give equal ones."""
    texts = ["abcdefghijkl " * 30, "x", "", "\u6211\u4eec" * 400, "hello there, world", "abcdefghijkl " * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(range(6)), pa.array(texts)], names=["l1", "l2", "line"])
    whole = lines.signed_batch(batch)
    monkeypatch.setattr(lines.H, "BLOCK_BYTES", 1)
    assert lines.signed_batch(batch).equals(whole)
    assert whole.column("keys")[0] == whole.column("keys")[5]
    assert all(len(x) == lines.BANDS for x in whole.column("keys").to_pylist())


def test_lines_are_compared_without_python(spark, monkeypatch):
    """Signatures, sketches and distances are expressions, so that no step of the operator starts Python on executors."""
    frame = type(spark.range(1))
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(frame, name, lambda *args, **more: pytest.fail("Python on the executors"))
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep woods"
    texts = [(i, base.replace("fox", f"f{i}x") if i < 5 else f"{i} " * 40) for i in range(8)]
    gone = lines.drop_similar_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r["id"], r["pos"]) for r in gone} == brute_lines(texts) and gone


def test_line_distances_of_whole_sets(spark):
    """Distances and links against plain sets, with lines below five characters and beyond two bytes a character."""
    texts = ["abcdefgh", "abcdefghi", "abc", "abcd", "aaaaaaaaaa", "aaaaa", "\u6211\u4eec\u5728\u8fd9\u91cc\U0001f600", "\u6211\u4eec\u5728\u8fd9\u91cc", "\U0001f600", "abcdefgh" * 50]
    table = spark.createDataFrame([(i, -i, t) for i, t in enumerate(texts)], "l1 long, l2 long, line string")
    pairs = spark.createDataFrame([(a, b) for a in range(len(texts)) for b in range(a)], "a long, b long")
    sets, got = [lines.shingle_set(t) for t in texts], lines.measured(pairs, table).collect()
    assert len(got) == len(texts) * (len(texts) - 1) // 2
    for r in got:
        both, union = len(sets[r["a"]] & sets[r["b"]]), len(sets[r["a"]] | sets[r["b"]])
        assert abs(r["d"] - (1 - both / union)) < 1e-12 and r["linked"] == (100 * both >= 75 * union)
        assert (r["v"]["l1"], r["u"]["l2"]) == (r["a"], -r["b"])


def test_line_signatures_as_expressions(spark):
    """Equal sets of shingles give equal keys, near ones equal values mostly; all keys and both words of bits are there."""
    base = "one line of some length, as lines of documents are, with words and a few more of them"
    texts = [base, base.replace("few", "new"), "abcabc" * 40, "abcabc" * 41, "x", "something else altogether that shares nothing with the others here", "\u6211\u4eec" * 400]
    table = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts + texts[:1])], "l1 long, l2 long, line string")
    got = {r["l1"]: r for r in lines.signatures(table).collect()}
    assert len(got) == len(texts) + 1 and all(len(r["keys"]) == lines.BANDS for r in got.values())
    apart = lambda x, y: sum(bin((got[x][s] ^ got[y][s]) & (1 << 64) - 1).count("1") for s in ("s0", "s1"))
    shared = lambda x, y: sum(a == b is not None for a, b in zip(got[x]["keys"], got[y]["keys"], strict=True))
    assert got[0]["keys"] == got[len(texts)]["keys"] and apart(0, len(texts)) == 0
    assert apart(0, 1) <= lines.MAX_BITS_APART and shared(0, 1) > 0
    assert apart(0, 5) > lines.MAX_BITS_APART and shared(0, 5) == 0
    assert all(0 <= r[s] < 1 << lines.VALUES for r in got.values() for s in ("s0", "s1"))


def test_short_and_unspaced_lines(spark):
    same = "\u6211\u4eec\u5728\u8fd9\u91cc\u5199\u4e86\u4e00\u884c\u6ca1\u6709\u7a7a\u683c\u7684\u4e2d\u6587\u5b57"
    texts = [(0, f"All rights reserved.\n{same}\nHi\n"), (1, f"All rights reserved.\n{same}\nHi\n \nother"), (2, f"{same}\U0001f600\nHo\nother\n ")]
    got = {r["doc_id"]: r["kept_text"] for r in lines.deduplicate_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {0: texts[0][1], 1: " \nother", 2: "Ho\n "}


# quality -----------------------------------------------------------------------------


def counts(t):
    w = WORD.findall(t)
    where = defaultdict(list)
    for k in range(len(w) - 7):
        where[tuple(w[k:k + 8])].append(k)
    hit = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(8)}
    ls = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(hit)


def test_quality(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(50)], "doc_id long, quality int")
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        want = counts(by_id(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(nothing, labels).count() == 0
    plain = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in plain)


def test_quality_separates_held_out_junk(spark):
    import random

    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    texts = []
    for i in range(300):
        w = [rng.choice(vocab) for _ in range(60)]
        texts.append((i, " ".join(x.upper() + "!!" for x in w) if i % 6 == 0 else " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(0, 150)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, labels).collect()}
    assert all(kept[i] == (i % 6 > 0) for i in range(150, 300))


def test_quality_counts_every_trusted_document(spark):
    """Where all documents are trusted, both corpora are one and every log-ratio is 0, however many there are."""
    docs = spark.range(20_050).selectExpr("id doc_id", "repeat(concat('w', id, ' '), 20) text")
    scores = quality.quality_rules(docs, docs.selectExpr("doc_id", "1 quality")).select("score").distinct().collect()
    assert [r["score"] for r in scores] == [0.0]


def test_quality_plan_is_one_for_few_trusted_and_many(spark, docs, monkeypatch):
    plans = []
    table = quality.Scratch.table
    monkeypatch.setattr(quality.Scratch, "table", lambda self, df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), table(self, df, name))[1])
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    quality.quality_rules(docs, labels)
    assert "ShuffledHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_quality_judges_word_order(spark):
    """The same words in another order are no good text."""
    sentence = [f"w{i}" for i in range(24)]
    texts = [" ".join(sentence if i % 3 else sentence[::-1]) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, labels).collect()}
    assert all(kept[i] == (i % 3 > 0) for i in range(150, 300))
