"""Queries over the shared tables, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bestfit, html_text, lines, media, merkle, mixing, neardup, packing, quality, substrings, suffixes, url_filter

#: Fixed values of the URL query: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary file that the packing query names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_crc(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.deduplicate_substrings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.deduplicate_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("score", 4).alias("score"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.deduplicate_bytes(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = bestfit.best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(tampered, F.translate("text", upper, lower)).otherwise(F.col("text"))
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"), found={"text": text})


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align_tokenizers(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_packing": op2_packing,
    "op3_mix_sources": op3_mix_sources,
    "op4_html_text": op4_html_text,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_best_fit": op11_best_fit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
}

_AFTER = "substr(url, position('://' in url) + 3)"
_HAS = "position('://' in coalesce(url, '')) > 0"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {
    # the tables hold no redirects or canonical links, so the method allows what no rule decides
    "op5_url_filter": f"""
with u as (
  select page_id,
    case when {_HAS} then translate(regexp_extract({_AFTER}, '^[^/?#]*'), {_LOWER}) else '' end as host,
    case when {_HAS} then regexp_extract({_AFTER}, '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
r as (select * from (values {", ".join(str(r) for r in URL_RULES)}) t(v, h, p)),
m as (
  select u.*, r.h || r.p as rule, r.v,
    row_number() over (partition by page_id, host, path order by length(r.h || r.p) desc, r.v) as k
  from u join r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p))
select u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') as verdict
from u left join m on m.page_id = u.page_id and m.host = u.host and m.path = u.path and m.k = 1""",
    "op6_substring_dedup": f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i+19], ' ') as s from w, unnest(range(1, greatest(len(ws) - 18, 1))) t(i)),
dup as (select doc_id, i from win qualify row_number() over (partition by s order by doc_id, i) > 1),
gone as (select distinct doc_id, i + d as p from dup, unnest(range(20)) t(d)),
word as (select doc_id, p, ws[p] as word from w, unnest(range(1, len(ws) + 1)) t(p)),
kept as (
  select word.doc_id, string_agg(word, ' ' order by word.p) filter (where g.p is null) as t, count(g.p) as n
  from word left join gone g on g.doc_id = word.doc_id and g.p = word.p group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)""",
    "op9_suffix_dedup": """
with w as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, cast(length(hex(encode(coalesce(text, '')))) // 2 as bigint) as n from documents),
win as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from w, unnest(range(greatest(n - 49, 0))) t(i)),
bad as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as lo from win) where doc_id > lo),
cut as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from bad),
span as (
  select doc_id, min(i) as a, max(i) + 50 as b
  from (select *, sum(fresh) over (partition by doc_id order by i) as g from cut) group by doc_id, g),
seg as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as p from span),
part as (
  select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as e,
    string_agg(substr(h, cast(2 * p + 1 as bigint), cast(2 * (a - p) as bigint)), '' order by a) as k
  from seg join w using (doc_id) group by doc_id)
select w.doc_id, w.n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(k, '') || substr(h, cast(2 * coalesce(e, 0) + 1 as bigint)))) as kept_sha256
from w left join part using (doc_id)""",
    "op10_near_duplicates": f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) as ws from documents),
sh as (
  select distinct doc_id, array_to_string(ws[i:i+4], ' ') as s
  from w, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) t(i)),
n as (select doc_id, count(*) as n from sh group by 1),
inter as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (
  select x, y from inter join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
e as (select x, y from link union select y, x from link),
reach as (select doc_id as x, doc_id as y from w union select r.x, e.y from reach r join e on e.x = r.y),
comp as (select x as doc_id, min(y) as component_id from reach group by 1)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, component_id = w.doc_id as kept
from w left join n using (doc_id) join comp using (doc_id)""",
}


def _merkle_sql(tree_levels: int = 6, top_levels: int = 4, fanout: int = 16) -> str:
    """Trees of at most ``fanout ** tree_levels`` rows a source and ``fanout ** top_levels`` sources, a level at a time."""
    leaf = lambda text: "sha256(" + " || ".join(
        f"case when {v} is null then '-' else strlen(cast({v} as varchar)) || ':' || cast({v} as varchar) end" for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # crc32 bit by bit: nine steps for each digit, the first takes the digit in
    steps = [f"""
with recursive bits as (
  select distinct doc_id, cast(doc_id as varchar) as s, 0 as k, cast(4294967295 as bigint) as v from documents where doc_id is not null
  union all
  select doc_id, s, k + 1, case when k % 9 = 0 then xor(v, ascii(s[k // 9 + 1])) else xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end) end
  from bits where k < 9 * length(s)),
b as (
  select d.doc_id, source, {leaf("text")} as leaf,
    {leaf(f"case when xor(v, 4294967295) % 5 = 0 then translate(text, {_LOWER}) else text end")} as now
  from documents d left join (select doc_id as i, v from bits where k = 9 * length(s)) c on c.i = d.doc_id),
w0 as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, leaf as node, now as fold, '' as proof,
    dense_rank() over (order by source nulls first) - 1 as tree
  from b)"""]
    total = tree_levels + top_levels
    for level in range(total):
        if level == tree_levels:
            steps.append(f"w{level}t as (select * replace (0 as tree, tree as pos), node as subroot from w{level})")
        source = f"w{level}t" if level == tree_levels else f"w{level}"
        subroot = ", subroot" if level >= tree_levels else ""
        steps.append(f"""
r{level} as (
  select tree, pos // {fanout} as run, list(node order by pos) as ds, sum(count(*)) over (partition by tree) as n
  from (select distinct tree, pos, node from {source}) group by 1, 2),
w{level + 1} as (
  select doc_id, source, leaf, now, tree{subroot},
    case when n = 1 then pos else pos // {fanout} end as pos,
    case when n = 1 then node else sha256(array_to_string(ds, '')) end as node,
    case when n = 1 then fold else sha256(array_to_string(ds[:pos % {fanout}] || [fold] || ds[pos % {fanout} + 2:], '')) end as fold,
    proof || array_to_string(ds[:pos % {fanout}] || ds[pos % {fanout} + 2:], '') as proof
  from {source} w join r{level} using (tree) where run = pos // {fanout})""")
    return ",".join(steps) + f"""
select doc_id, leaf, subroot, node as root, sha256(proof) as proof_sha256, fold as folded_root, fold = node as verified from w{total}"""



ORACLE["op12_merkle_manifest"] = _merkle_sql()
