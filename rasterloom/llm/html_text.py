"""Main text of web pages: the maximum-scoring stretch of words and tags, with learned weights."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages (with one article or main element) that fit the weights, and their greatest length.
MAX_LABELLED, MAX_LABELLED_CHARS = 400, 200_000

#: Elements by their role.
CONTENT = frozenset("article main".split())
RAW = frozenset("script style noscript template textarea iframe svg object select".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button title head label fieldset figcaption math".split()) | RAW
#: Boilerplate outside an article, but part of the text inside one.
KEPT = frozenset("figcaption label math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary table "
    "tbody td textarea tfoot th thead title tr ul video audio canvas".split())
CLOSES_P = BLOCKS - {"br", "button", "option", "body", "html"}
#: Whole tokens of a class, id or role that mark an element.
UNWELCOME = re.compile(
    r"(?i)(?:ads?|advert(?:s|isement|isements|ising)?|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|menu|nav|navbar|navigation|newsletter|"
    r"notices?|popup|promos?|promotions?|related|replies|share|sharing|sidebar|social|sponsor(?:s|ed)?|subscribe|widget)")

_ATTRIBUTE = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


@dataclass
class Piece:
    """A tag (``words`` 0) or a run of text, with its context: nearest structural element and whether one around it is boilerplate."""

    key: str
    words: int = 0
    text: str = ""
    breaks: bool = False
    inside: bool = False
    unwelcome: bool = False


class First:
    """Start of the first match at or after a position, for positions that never fall; the page's length if there is none."""

    def __init__(self, pattern: str, page: str):
        self.pattern, self.page, self.found = re.compile(pattern), page, -1

    def __call__(self, at: int) -> int:
        if self.found < at:
            m = self.pattern.search(self.page, at)
            self.found = m.start() if m else len(self.page)
        return self.found


@dataclass
class Tag:
    """``page[start:end]``, with all of a raw element's content; ``name`` is empty for comments and declarations."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""


def tags(page: str) -> Iterator[Tag]:
    """Tags, comments and declarations in page order.

    A tag ends at the first ``>`` outside quotes; what has no such end is text.  Where a
    quote leads is worked out once for each quote, and searches don't go back, so the time
    is linear in the page's length also where quotes or tags are never closed.
    """
    size, last = len(page), page.rfind(">")
    name_end, special, bracket = First(r"[\s/>]", page), First(r"[>\"']", page), First(">", page)
    either = re.compile(r"[>\"']")
    after: dict[int, int] = {}

    def end_of(at: int) -> int:
        """Position of the ``>`` that ends a tag whose next special character is at ``at``; -1 if none does."""
        path = []
        while at < size and page[at] != ">" and at not in after:
            path.append(at)
            close = page.find(page[at], at + 1)
            m = either.search(page, close + 1) if close >= 0 else None
            at = m.start() if m else size
        end = -1 if at >= size else after.get(at, at)
        after.update(dict.fromkeys(path, end))
        return end

    at = page.find("<")
    while at >= 0:
        found = None
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            found = Tag(at, size if close < 0 else close + 3)
        elif at < last and page[at + 1] in "!?":
            found = Tag(at, bracket(at) + 1)
        elif at < last:
            first = at + 1 + (page[at + 1] == "/")
            if page[first].isascii() and page[first].isalpha():
                stop = name_end(first)
                end = end_of(special(stop))
                if end >= 0:
                    found = Tag(at, end + 1, page[first:stop].lower(), first > at + 1, page[stop:end])
                    if found.name in RAW and not found.closing and not found.attributes.rstrip().endswith("/"):
                        m = re.compile(rf"</{re.escape(found.name)}\s*>", re.I).search(page, found.end)
                        found.end = m.end() if m else size
        if found:
            yield found
        at = page.find("<", found.end if found else at + 1)


def _around_content(found: Sequence[Tag]) -> set[int]:
    """Starts of the tags of elements that hold an article or main element."""
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    around: set[int] = set()
    for tag in found:
        if not tag.name or tag.name in VOID or tag.name in RAW and not tag.closing:
            continue
        if not tag.closing:
            if tag.name in CONTENT:
                for _, start in reversed(stack):
                    if start in around:
                        break
                    around.add(start)
            stack.append((tag.name, tag.start))
            opened[tag.name] += 1
        elif opened[tag.name]:
            name = ""
            while name != tag.name:
                name, _ = stack.pop()
                opened[name] -= 1
    return around


@dataclass
class Open:
    """An open element with what holds for text inside it."""

    name: str
    key: str
    unwelcome: bool
    inside: bool


def pieces(page: str) -> Iterator[Piece]:
    """Tags and texts in page order.  Comments vanish; raw elements are one tag each, without text; missing end tags are tolerated.

    An article or main element is welcome whatever surrounds it, and what surrounds one
    isn't judged by its class or id.  Every open element carries the context of its text,
    so the time doesn't depend on how deep elements are nested.
    """
    found = list(tags(page))
    around = _around_content(found)
    stack = [Open("", "", False, False)]
    opened: Counter[str] = Counter()

    def text(raw: str) -> Iterator[Piece]:
        decoded = html.unescape(raw)
        if decoded:
            top = stack[-1]
            yield Piece(top.key, len(decoded.split()), decoded, False, top.inside, top.unwelcome)

    def pop_to(name: str) -> None:
        popped = ""
        while popped != name:
            popped = stack.pop().name
            opened[popped] -= 1

    at = 0
    for tag in found:
        if tag.start > at:
            yield from text(page[at:tag.start])
        at, name, inside = tag.end, tag.name, stack[-1].inside
        if not name:
            continue
        if tag.closing:
            if opened[name]:
                pop_to(name)
                yield Piece(f"</{name}", breaks=name in BLOCKS, inside=inside and stack[-1].inside)
            continue
        marks = " ".join(next(x for x in a if x) for a in _ATTRIBUTE.findall(tag.attributes) if any(a)).split()
        label = f"{name}.{marks[0].lower()}" if marks else name
        if name in CLOSES_P and any(x.name == "p" for x in stack[-3:]):
            pop_to("p")
        yield Piece(f"<{label}", breaks=name in BLOCKS, inside=inside)
        if name in VOID or name in RAW and not tag.attributes.rstrip().endswith("/"):
            continue
        top = stack[-1]
        structural = name in BLOCKS and (bool(marks) or not re.fullmatch(r"p|h[1-6]|br|li|ul|ol|blockquote|pre|t[rdh]|table|tbody|d[ltd]", name))
        kept = name in KEPT and top.inside
        marked = name in BLOCKS and name not in CONTENT and name not in ("html", "body") and tag.start not in around
        unwelcome = name in BOILERPLATE and not kept or marked and any(UNWELCOME.fullmatch(x) for x in marks)
        named = not kept and (structural or name in BOILERPLATE)
        stack.append(Open(
            name, label if named else top.key, unwelcome or name not in CONTENT and top.unwelcome, name in CONTENT or top.inside))
        opened[name] += 1
    if at < len(page):
        yield from text(page[at:])


@dataclass
class Weights:
    """Score of a word by its context and of a tag by its name; unknown ones fall back on their role."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, piece: Piece) -> float:
        return min(self.words.get(piece.key, 1.0), -1.0) if piece.unwelcome else self.words.get(piece.key, 1.0)

    def tag(self, piece: Piece) -> float:
        return self.tags.get(piece.key, -1.0)


def fit_weights(pages: Iterable[str], limit: float = 6.0) -> Weights:
    """Log-odds of lying in the labelled element, for words by context and for tags.

    A page is labelled by its only article or main element.  Words of a context that is
    mostly content score positive, others negative; every tag scores below zero, the more
    so the more often it stands outside.
    """
    word_in, word_out, tag_in, tag_out = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        if len(re.findall(r"<(?:article|main)\b", page, re.I)) != 1:
            continue
        for p in pieces(page):
            if p.words:
                (word_in if p.inside and not p.unwelcome else word_out)[p.key] += p.words
            elif not p.text:
                (tag_in if p.inside else tag_out)[p.key] += 1
    odds = lambda a, b: max(-limit, min(limit, math.log((a + 0.5) / (b + 0.5))))
    return Weights(
        {k: odds(word_in[k], word_out[k]) for k in {*word_in, *word_out}},
        {k: -0.25 - max(0.0, odds(tag_out[k], tag_in[k])) for k in {*tag_in, *tag_out}})


def best_region(scores: Sequence[float]) -> tuple[int, int]:
    """[i, j) of the contiguous stretch with the greatest sum, in one scan; of equal ones the first; empty if none is positive."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, lo, hi = total, start, i + 1
    return lo, hi


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the best region: blocks with single spaces inside, joined by one space; empty if there is none."""
    if not page:
        return ""
    found = list(pieces(page))
    lo, hi = best_region([weights.word(p) * p.words if p.text else weights.tag(p) for p in found])
    blocks, current = [], []
    for p in found[lo:hi]:
        if p.text:
            if not p.unwelcome and weights.word(p) > 0:
                current.append(p.text)
        elif p.breaks:
            blocks.append("".join(current))
            current = []
    blocks.append("".join(current))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def labelled_sample(pages: DataFrame, id_col: str, html_col: str, limit: int) -> list[str]:
    """At most ``limit`` pages with an article or main element, by smallest hash of their id; of rows with one id the smallest page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(
        F.col("html").rlike(r"(?i)<(?:article|main)\b") & (F.length("html") <= MAX_LABELLED_CHARS))
    rows = rows.withColumn("h", F.xxhash64("id"))
    # hashes alone are ranked; only one page for each of them comes to the driver
    ranked = rows.select("h").distinct().orderBy("h").limit(limit).collect()
    if not ranked:
        return []
    found = rows.where(F.col("h") <= ranked[-1]["h"]).groupBy("h").agg(F.min("html").alias("html")).collect()
    return [r["html"] for r in sorted(found, key=lambda r: r["h"])]


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    weights: Weights | None = None, max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``(id, url, text, n_chars)`` of every page.

    Weights are fitted on at most ``max_labelled`` labelled pages unless given.  Null or
    empty html, and pages without content, give empty text; an empty table gives an empty
    result; repeated rows are extracted each; other columns are not read.  A page is held
    whole by one task, whose time is linear in the page's length.
    """
    if weights is None:
        weights = fit_weights(labelled_sample(pages, id_col, html_col, max_labelled))
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")
