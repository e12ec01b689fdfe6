"""URL filters: host and path rules, spread over redirect and canonical-link aliases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Up to so many rules are compiled into the plan; more are joined on host suffixes.
MAX_INLINE_RULES = 64


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """What redirects and canonical links join: host, path and query, without the fragment; else empty."""
    return F.concat(url_host(url), F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(u, v)``: a page's host, path and query and those of its canonical link or refresh target.

    Absolute, scheme-relative, root-relative and directory-relative targets are
    resolved.  Ends can be empty or equal; ``judge_urls`` drops such rows after writing
    them, so that no filter on them is evaluated inside the extraction.
    """
    tags = F.concat(
        F.regexp_extract_all(F.col(html), F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0)),
        F.regexp_extract_all(F.col(html), F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0)))
    target = F.trim(F.regexp_replace(
        F.regexp_extract("tag", r"(?is)(?:\bhref\s*=\s*|\burl\s*=\s*)([\"']?[^\"'>\s]+)", 1), "^[\"']|(?<=&)amp;", ""))
    tagged = (
        pages.where(F.col(html).rlike("(?i)canonical|refresh"))
        .select(F.col(url).alias("from"), F.explode(tags).alias("tag"))
        .select("from", target.alias("to")))
    host, path, to = url_host(F.col("from")), url_path(F.col("from")), F.col("to")
    base = F.concat(F.lit("x://"), host)
    full = (
        F.when(to == "", to)
        .when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.lit("x:"), to))
        .when(to.startswith("/"), F.concat(base, to))
        .otherwise(F.concat(base, F.regexp_replace(path, "[^/]*$", ""), to)))
    return tagged.select(url_node(F.col("from")).alias("u"), full.alias("to")).select("u", url_node(F.col("to")).alias("v"))


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits ``host`` and ``path``.

    A rule ``(verdict, host, path)`` fits its host and all subdomains when the path
    starts with the rule's.  Of equally long rules an allow wins.  Few rules become an
    expression; a DataFrame or a long list is joined on the suffixes of the host.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= MAX_INLINE_RULES:
        ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))
        def fits(r):
            return ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])
        pick = lambda get: F.coalesce(*[F.when(fits(r), F.lit(get(r))) for r in ordered]) if ordered else F.lit(None).cast("string")
        return urls.withColumns({"rule": pick(lambda r: r[1] + r[2]), "rule_verdict": pick(lambda r: r[0])})
    spark = urls.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")
    table = table.select(F.col("host").alias("_suffix"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = urls.select("host", "path").distinct()
    best = (
        keys.withColumn("_suffix", F.explode(suffixes)).join(table, "_suffix")
        .where(F.col("path").startswith(F.col("_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            F.length(F.concat("_suffix", "_path")).alias("n"), (F.col("_verdict") == "allow").alias("a"),
            F.concat("_suffix", "_path").alias("rule"), F.col("_verdict").alias("verdict"))).alias("b")))
    return (
        urls.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("b.rule"), "rule_verdict": F.col("b.verdict")}).drop("b"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame,
    redirects: DataFrame | None = None,
    url: str = "url",
    html: str | None = "html",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep`` columns with ``host, path, rule, verdict, component`` for every page.

    A url's own rule decides.  Without one, the urls that redirects and canonical links
    join to it decide: an explicit allow among them wins, else a block, else the url is
    allowed.  ``redirects`` may add ``(from_url, to_url)`` edges to those in the html.
    Urls that differ in their query are different ends of an edge, as one redirect script
    leads to many sites; rules look at host and path alone.

    Null urls have empty host and path, no rule and are allowed.  Repeated rows are
    judged alike and all returned; other columns of ``pages`` are untouched because only
    ``keep`` is carried, under its own names.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    base = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), url_node(F.col(url)).alias("key"))
    sources = [link_edges(pages, url, html)] if html else []
    if redirects is not None:
        sources.append(redirects.select(url_node(F.col("from_url")).alias("u"), url_node(F.col("to_url")).alias("v")))
    judged = match_rules(base, rules)
    members = None
    if sources:
        edges = scratch.table(reduce(DataFrame.unionByName, sources), "links").where("u <> '' and v <> '' and u <> v")
        if not edges.isEmpty():
            members = scratch.table(connected_components(edges, scratch), "members")
    if members is None:
        out = judged.withColumn("component", F.col("key")).withColumn("by_alias", F.lit(None).cast("string"))
    else:
        at = members.select(F.regexp_extract("node", "^[^/?]*", 0).alias("host"), F.regexp_extract("node", "^[^/?]*([^?]*)", 1).alias("path"), "component")
        votes = scratch.table(
            match_rules(at, rules).groupBy("component").agg(
                F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked")),
            "votes")
        alias = scratch.table(
            members.join(votes, "component").select(
                F.col("node").alias("key"), "component",
                F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("by_alias")), "alias")
        out = judged.join(alias, "key", "left").withColumn("component", F.coalesce("component", "key"))
    out = out.withColumn("verdict", F.coalesce("rule_verdict", "by_alias", F.lit("allow")))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", "verdict", "component")
