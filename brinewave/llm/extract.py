"""Main text of web pages by the maximum-scoring run of tokens.

A page becomes a sequence of tags and words. Words score above zero, more so where labelled
pages have article words (after the same block tag); tags score below zero, more so if
labelled pages have them outside the article. The contiguous run with the largest sum, found
in one scan, is the content. Parts of the run that are menus, forms, adverts, notices or
reader comments by their tag, class, id or role are left out; class names are read as whole
tokens, and an element around the article is never left out for its name. (Weights of class
names cannot be learned from pages that mark their own article: adverts inside it are marked
as article too.)

Weights are log-odds from pages that mark their article themselves (an ``article`` or
``main`` element): those with one of the first ``SAMPLE_PAGES`` hashes of their html, copies included;
scripts, styles and titles are never text.

Defined cases: null or empty html and pages without words give an empty text; without any
labelled page words weigh ``WORD`` and tags ``TAG``; among equal runs the first one wins;
unclosed elements end where the next block begins; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import llm_query, schema_with, slices, table

SAMPLE_PAGES = 2000
WORD, TAG = 1.0, -1.5
#: a tag of page furniture; its words count nothing, so an advert does not cut an article in two
FURNITURE_TAG = -0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<shut>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\Z)|[^>]*+(?:>|\Z))",
    re.S,
)
#: name and value of the next attribute; a quote that is not closed takes the rest
_ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?")
_SPACE = re.compile(r"\s+")
# fixed values: kinds of elements of the format
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPTIONAL = frozenset("p li dt dd td th tr option".split())
_FURNITURE = frozenset("nav aside footer form noscript template svg math button select dialog menu object audio video canvas datalist search".split())
# fixed values: words for page furniture, and words for a part of a page that say nothing about its kind
_NAMES = re.compile(
    r"ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription"
    r"|share|sharing|social\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|related|recommend\w*|widget\w*|pagination|pager|login"
    r"|signup|hidden|search|complementary|contentinfo|skip"
)
_COMMENTS = re.compile(r"comments?|commentlist|respond|replies|disqus\w*")
_NEUTRAL = frozenset(
    "area bar block body box button buttons card column container content count form group header heading icons inner item items label layout link links list main "
    "message outer pane panel policy posts row section site slot template text thread title top unit widget wrap wrapper".split()
)
_MODIFIERS = frozenset("has have no not with without non is hide hides".split())
#: an element that is named like furniture but holds more than this share of the page's words is layout
MOST_WORDS = 0.5


class Part:
    """A tag or a text of a page."""

    __slots__ = ("tag", "shut", "text", "furniture", "sign", "words", "kind")

    def __init__(self, tag=None, shut=False, text="", sign=""):
        self.tag, self.shut, self.text, self.sign = tag, shut, text, sign
        self.furniture = bool(sign)
        self.words, self.kind = 0, ""


def _named(value: str, names: re.Pattern, in_article: bool) -> bool:
    """Whether a class token, id or role is a name of furniture.

    A token is read as words. It names what its last word says, or the one before words that
    only say "part" (``cookie-notice``, ``related-posts``); ``has-sidebar`` and ``no-comments`` say
    something about the page. Outside an article the first word counts too; inside one,
    ``related-work`` and ``notice-text`` are its own sections.
    """
    for token in value.lower().split():
        words = [w for w in re.split(r"[-_]+", token) if w]
        if not words or _MODIFIERS.intersection(words[:-1]):
            continue
        last = len(words) - 1
        while last and words[last] in _NEUTRAL and not (in_article and words[last] == "text"):
            last -= 1
        if names.fullmatch(words[last]) or not in_article and names.fullmatch(words[0]):
            return True
    return False


def _is_furniture(name: str, attrs: str, in_article: bool) -> str:
    """How an element shows that it is furniture: by its ``tag``, as ``hidden``, as ``comments``, by a ``name``, or not ("")."""
    if name in _FURNITURE:
        return "tag"
    if name == "header":
        return "" if in_article else "tag"
    if name in ("html", "body", "main") or not attrs or "=" not in attrs and "hidden" not in attrs:
        return ""
    for found in _ATTR.finditer(attrs):
        key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "hidden"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "hidden"
        if key in ("class", "id", "role"):
            if _named(value, _COMMENTS, in_article):
                return "comments"
            if _named(value, _NAMES, in_article):
                return "name"
        if key in ("class", "id") and not in_article and "header" in re.split(r"[\s_-]+", value.lower()):
            return "name"
    return ""


def parts_of(html: str) -> list[Part]:
    """Tags and texts in page order; raw text elements are left out."""
    out: list[Part] = []
    at, size = 0, len(html)
    articles = 0
    while at < size:
        found = _TOKEN.search(html, at)
        if found is None:
            out.append(Part(text=html[at:]))
            break
        if found.start() > at:
            out.append(Part(text=html[at : found.start()]))
        at = found.end()
        if found["name"] is None:
            if found[0].startswith("<![CDATA["):
                out.append(Part(text=found[0][9:].removesuffix("]]>").replace("&", "&amp;")))
            continue
        name, shut = found["name"].lower(), bool(found["shut"])
        if name in _RAW and not shut:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            at = size if end is None else (html.find(">", end.start()) + 1 or size)
            continue
        out.append(Part(name, shut, sign="" if shut else _is_furniture(name, found["attrs"], articles > 0)))
        if name in ("article", "main"):
            articles = max(0, articles + (-1 if shut else 1))
    _spread(out)
    return out


def _spread(parts: list[Part]) -> None:
    """Marks everything inside a furniture element, but for elements that lay out the page.

    An element named like furniture is layout if the longest article or main element lies in
    it, or, on a page that has none, more than ``MOST_WORDS`` of the words. Comments are never.
    """
    before = [0]
    for part in parts:
        before.append(before[-1] + (len(part.text.split()) if part.tag is None else 0))
    words = lambda i: before[_end(parts, i)] - before[i]
    marked = [i for i, p in enumerate(parts) if p.tag in ("article", "main") and not p.shut and not p.sign]
    longest = max(marked, key=words, default=None)
    i = 0
    while i < len(parts):
        part = parts[i]
        if not part.furniture:
            i += 1
            continue
        end = _end(parts, i)
        if part.sign == "name" and (i <= longest < end if longest is not None else before[end] - before[i] > MOST_WORDS * before[-1]):
            part.furniture = False
            i += 1
            continue
        for k in range(i, end):
            parts[k].furniture = True
        i = max(end, i + 1)


def _end(parts: list[Part], i: int) -> int:
    """Index after the element that opens at ``i``."""
    name, depth = parts[i].tag, 0
    if name in _VOID:
        return i + 1
    for k in range(i, len(parts)):
        tag = parts[k].tag
        if tag == name:
            if name in _OPTIONAL and not parts[k].shut and k > i:
                return k
            depth += -1 if parts[k].shut else 1
            if depth == 0:
                return k + 1
        elif name in _OPTIONAL and parts[k].shut and tag in _BLOCK and tag not in _OPTIONAL:
            return k
    # never closed: up to the next block
    return next((k for k in range(i + 1, len(parts)) if parts[k].tag in _BLOCK), len(parts))


def classify(parts: list[Part]) -> None:
    """Words and kind of every part: a word's kind is the block or link it follows."""
    place = "start"
    for part in parts:
        if part.tag is None:
            part.words, part.kind = len(part.text.split()), f"word {place}"
            continue
        part.kind = f"tag {part.tag if part.tag in _BLOCK or part.tag in ('a', 'b', 'br', 'i', 'em', 'strong', 'img', 'span', 'input', 'meta', 'link') else 'other'}"
        if part.tag in _BLOCK or part.tag == "a":
            place = "/" + part.tag if part.shut else part.tag


def labelled_counts(html: str | None) -> tuple[Counter, Counter] | None:
    """Parts inside and outside the article a page marks, furniture apart; None if it marks none."""
    parts = parts_of(html or "")
    classify(parts)
    start = next((i for i, p in enumerate(parts) if p.tag in ("article", "main") and not p.shut and not p.furniture), None)
    if start is None:
        return None
    end = _end(parts, start)
    if not any(p.tag == parts[start].tag and p.shut for p in parts[start:]):
        end = len(parts)
    inner, outer = Counter(), Counter()
    for i, part in enumerate(parts):
        if i in (start, end - 1) or part.furniture:
            continue
        (inner if start < i < end - 1 else outer)[part.kind] += part.words if part.tag is None else 1
    return inner, outer


class Weights:
    """Log-odds of part kinds to be inside an article; words stay above zero, tags below."""

    def __init__(self, inner: Counter, outer: Counter):
        inside, outside = max(1, sum(inner.values())), max(1, sum(outer.values()))
        odds = lambda k: math.log((inner[k] + 0.5) / (inside + 1)) - math.log((outer[k] + 0.5) / (outside + 1))
        self.known = {}
        for kind in {*inner, *outer}:
            self.known[kind] = min(3.0, max(0.05, odds(kind))) if kind.startswith("word") else max(-8.0, min(-0.05, odds(kind)))
        self.trained = bool(inner)

    def __getitem__(self, part: Part) -> float:
        if part.furniture:
            return 0.0 if part.tag is None else FURNITURE_TAG
        if part.tag is None:
            return part.words * self.known.get(part.kind, 0.5 if self.trained else WORD)
        return self.known.get(part.kind, -0.2 if self.trained else TAG)


def best_run(scores: list[float]) -> tuple[int, int]:
    """``[start, end)`` of the contiguous run with the largest positive sum, the first of equals."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total > best:
            best, found = total, (start, i + 1)
        if total <= 0:
            total, start = 0.0, i + 1
    return found


def extract(html: str | None, weights: Weights) -> str:
    """Blocks of the best run, one to a line."""
    parts = parts_of(html or "")
    classify(parts)
    start, end = best_run([weights[p] for p in parts])
    blocks, open_ = [], []
    for part in parts[start:end]:
        if part.furniture:
            if part.tag in _BLOCK:
                blocks.append("".join(open_))
                open_ = []
        elif part.tag is None:
            open_.append(part.text)
        elif part.tag in _BLOCK:
            blocks.append("".join(open_))
            open_ = []
        elif part.tag == "br":
            open_.append(" ")
    blocks.append("".join(open_))
    clean = (_SPACE.sub(" ", unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def train(pages: DataFrame, html: str = "html", most: int = SAMPLE_PAGES) -> Weights:
    """Weights of the pages that mark their article."""
    marked = pages.where(F.col(html).rlike("(?i)<(article|main)[\\s>]"))
    chosen = marked.select(F.xxhash64(html).alias("h"), F.col(html).alias("html"))
    # the threshold for a share of hashes is bounded by `most`; only hashes are ordered
    last = chosen.select("h").orderBy("h").limit(most).agg(F.max("h").alias("h")).first().h
    if last is None:
        return Weights(Counter(), Counter())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = labelled_counts(text)
                if found:
                    inner.update(found[0])
                    outer.update(found[1])
        kinds = sorted({*inner, *outer})
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array([inner[k] for k in kinds], pa.int64()), pa.array([outer[k] for k in kinds], pa.int64())], ["kind", "inner", "outer"]
        )

    # kinds are the format's element names, so the sums are a small table
    sums = chosen.where(F.col("h") <= last).select("html").mapInArrow(run, "kind string, inner long, outer long")
    rows = sums.groupBy("kind").agg(F.sum("inner").alias("inner"), F.sum("outer").alias("outer")).collect()
    return Weights(Counter({r.kind: r.inner for r in rows}), Counter({r.kind: r.outer for r in rows}))


def extract_text(pages: DataFrame, weights: Weights, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with their main text."""
    at = pages.columns.index(html)
    schema = schema_with(pages, **{name: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html, 4 << 20):
            texts = pa.array([extract(h, weights) for h in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], schema.names)

    return pages.mapInArrow(run, schema)


@llm_query("op6_max_subsequence_text")
def op6(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    found = extract_text(pages.select("page_id", "url", "html"), train(pages)).drop("html")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
