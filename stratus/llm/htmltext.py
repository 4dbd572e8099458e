"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score by the place they stand
in, tags cost a little, and one linear scan finds the contiguous region of the
greatest sum.  The weights come from labelled pages, those that mark their
article themselves (``<article>`` or ``<main>``): how often words of a block
element, words under a class, id or role, and tags stand inside and outside of
that mark.  On a page with a mark the words score by it as well.

Elements that are never part of an article (menus, headers, footers, sidebars,
forms, scripts ...) cost a fixed amount as a whole and give no text, so they
neither split nor enter the region.  An element whose class, id or role hints
at a notice, an advert, readers' comments and the like goes the same way only
if its own words score below zero with the hint's weight.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import text_key

SAMPLE = 2_000  # labelled pages the weights are taken from, at most (about)

# Element names and words of class, id and role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = set("nav header footer aside form script style noscript template head title select textarea button iframe object svg math menu dialog canvas audio video datalist".split())
DROPPED_WORDS = set(
    "nav navbar navigation menu header footer sidebar aside notice notices cookie cookies consent banner ad ads advert adverts advertisement sponsor sponsored promo promotion "
    "comment comments disqus reply replies share sharing social related recommended breadcrumb breadcrumbs popup modal newsletter subscribe subscription signup login search widget toolbar pagination pager".split()
)
STRUCTURE = {"nav", "header", "footer", "aside", "form", "menu"}  # of those, the ones that hold words like a text's
ARTICLE = {"article", "main"}
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption article main section".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|iframe|template)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.S | re.I,
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


def hints(name: str, attributes: str) -> tuple[str, ...]:
    """The classes, id and role of an element, lower case; the page itself and articles have none."""
    if name in ARTICLE or name in ("body", "html") or not attributes:
        return ()
    return tuple(w for m in _MARKS.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split())


def events(page: str, structure: bool = False):
    """``(kind, value, place, inside, marks)`` of each piece outside dropped elements, in page order.

    kind "text": value is the decoded text, its place (inside an article,
    innermost block element); "tag": its name, place True for a block
    boundary; "dropped": an element without article text.  ``inside``: the
    piece stands in an article.  ``marks``: the enclosing elements with hints,
    as (number, hints).  With ``structure``, menus, headers and the like are
    ordinary elements, and their own marks ("<nav" ...) tell them.
    """
    stack: list[tuple[str, bool, str, bool]] = []  # name, starts a dropped element, block, has a mark
    marks: list[tuple[int, tuple[str, ...]]] = []
    drops = articles = made = 0

    def pop() -> None:
        nonlocal drops, articles
        name, bad, _, marked = stack.pop()
        drops -= bad
        articles -= name in ARTICLE
        if marked:
            marks.pop()

    for m in _TOKEN.finditer(page):
        name = m[3] or m[6]
        if name is None:
            raw = m[0]
            if m[1]:
                if not drops:
                    yield "dropped", m[1].lower(), None, articles > 0, tuple(marks)
            elif raw[0] != "<" or raw == "<":
                if not drops:
                    yield "text", html.unescape(raw), (articles > 0, stack[-1][2] if stack else ""), articles > 0, tuple(marks)
            continue
        name, closing = name.lower(), bool(m[2] or m[5])
        if closing:
            if any(s[0] == name for s in stack):
                hidden = drops
                while True:
                    top = stack[-1][0]
                    pop()
                    if top == name:
                        break
                if hidden and not drops:
                    continue
            if not drops:
                yield "tag", name, name not in INLINE, articles > 0, tuple(marks)
            continue
        if name not in INLINE:  # a block element ends an open paragraph, an item the item before it
            ends = {"p"} | ({name} if name in ("li", "option", "td", "th", "tr", "dd", "dt") else set())
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] in INLINE:
                depth -= 1
            if depth >= 0 and stack[depth][0] in ends:
                while len(stack) > depth:
                    pop()
        attributes = m[4] or m[7] or ""
        own = hints(name, attributes)
        if structure and name in STRUCTURE:
            own = (*own, f"<{name}")
        bad = name in DROPPED and not (structure and name in STRUCTURE)
        if not drops:
            yield ("dropped", name, None, articles > 0, tuple(marks)) if bad else ("tag", name, name not in INLINE, articles > 0, tuple(marks))
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, bad, (stack[-1][2] if stack else "") if name in INLINE else name, bool(own)))
            drops += bad
            articles += name in ARTICLE
            if own:
                made += 1
                marks.append((made, own))


def parse(page: str):
    """``(kind, value, place)`` of ``events``."""
    for kind, value, place, _, _ in events(page):
        yield kind, value, place


def ruled_out(hint: str) -> bool:
    """A class, id or role that names what no article holds, or one of the elements' own marks."""
    return hint in DROPPED_WORDS or hint[0] == "<"


def count(page: str) -> dict[str, list[int]]:
    """Words and tags inside and outside of a page's own article, by block element and by hint; empty for a
    page without one.  What an article holds without being its text (menus, notices ...) isn't counted."""
    out: dict[str, list[int]] = {}
    marked = False
    for kind, value, place, inside, marks in events(page, structure=True):
        if inside and any(ruled_out(h) for _, own in marks for h in own):
            continue
        if kind == "text":
            marked |= inside
            n = len(value.split())
            if n:
                for key in {f"any {place[1]}", *(f"hint {h}" for _, own in marks for h in own)}:
                    out.setdefault(key, [0, 0])[not inside] += n
        elif kind == "tag":
            out.setdefault(f"tag {value}", [0, 0])[not inside] += 1
    return out if marked else {}


MARK = 2.5  # a word's score for standing in the page's article: above any block's own weight (2 at most), for the contract drops nothing of it
RULED_OUT, HINTED = -5.0, -3.0  # a hint that names what no article holds, and one with such a word in it


class Weights:
    """Scores of words by place and hint, and of tags by name."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.odds = {k: max(-2.0, min(2.0, math.log((i + 1) / (o + 1)))) for k, (i, o) in counts.items() if not k.startswith("tag ")}
        self.tags = {k[4:]: -0.02 - 0.2 * o / (i + o) for k, (i, o) in counts.items() if k.startswith("tag ") and i + o}

    def word(self, article: bool, block: str, marked: bool) -> float:
        """A word by its block element, and by the page's own mark where it has one."""
        if marked:
            return self.odds.get(f"any {block}", 0.0) + (MARK if article else -MARK)
        return self.odds.get(f"any {block}", 1.0 if block in TEXT_BLOCKS else -0.5)

    def hint(self, own: tuple[str, ...], article: bool) -> float:
        """What an element's classes, id and role add to each of its words.  In an
        article a compound ("share-price") says little about its parts."""
        total = 0.0
        for h in own:
            total += self.odds.get(f"hint {h}", 0.0)
            if ruled_out(h):
                total += RULED_OUT
            elif any(w in DROPPED_WORDS for w in _PARTS.findall(h)):
                total += -0.5 if article else HINTED
        return total

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.1)


DROP_COST = -0.5


def kept_pieces(page: str, weights: Weights) -> tuple[list, bool]:
    """Pieces with their words' scores, without the elements that their hints rule out; is an article marked."""
    found = list(events(page))
    marked = any(kind == "text" and inside and value.strip() for kind, value, _, inside, _ in found)
    score: dict[int, float] = {}
    words = []
    for kind, value, place, inside, marks in found:
        n = len(value.split()) if kind == "text" else 0
        w = weights.word(place[0], place[1], marked) if n else 0.0
        words.append(n * w)
        for number, own in marks if n else ():
            score[number] = score.get(number, 0.0) + n * (w + weights.hint(own, inside and marked))
    gone = {k for k, v in score.items() if v < 0}
    out, last = [], None
    for (kind, value, place, _, marks), w in zip(found, words):
        of = next((number for number, _ in marks if number in gone), None)
        if of is None:
            out.append((kind, value, place, w))
        elif of != last:
            out.append(("dropped", "div", None, 0.0))
        last = of
    return out, marked


def extract(page: str | None, weights: Weights) -> str:
    """Text of the best region: blocks in page order, white space as single spaces."""
    pieces, _ = kept_pieces(page or "", weights)
    best, best_at, run, run_start = 0.0, (0, 0), 0.0, 0
    for i, (kind, value, _, words) in enumerate(pieces):
        run += words if kind == "text" else weights.tag(value) if kind == "tag" else DROP_COST
        if run <= 0:
            run, run_start = 0.0, i + 1
        elif run > best:
            best, best_at = run, (run_start, i + 1)
    parts = []
    for kind, value, place, _ in pieces[slice(*best_at)]:
        if kind == "text":
            parts.append(value)
        elif kind == "dropped" and value not in INLINE or place:
            parts.append(" ")
    return " ".join("".join(parts).split())


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", size: int = SAMPLE) -> Weights:
    """Weights from at most about ``size`` pages that mark their article, drawn by a hash of id and page."""
    own = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[ >]"))
    draw = F.pmod(F.xxhash64("id", text_key(F.col("html")), F.lit(9)), F.lit(1 << 40))
    n = own.count()
    drawn = own.filter(draw < int((1 << 40) * min(1.0, size / max(n, 1)))).select("html")

    def run(parts):
        for part in parts:
            rows = [(k, i, o) for x in part.column(0) for k, (i, o) in count(x.as_py()).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["k", "i", "o"])

    counts = drawn.mapInArrow(run, "k string, i long, o long").groupBy("k").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return Weights({r["k"]: (r["i"], r["o"]) for r in counts.collect()})  # element names of the sample


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row.

    Null, empty and article-less pages without text blocks give an empty text;
    nothing is cut; repeated rows have their text each; an empty table gives an
    empty result; other columns are neither read nor returned.  A page is one
    row of a task, however long."""

    def run(parts):
        for part in parts:
            texts = [extract(x.as_py(), weights) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [f"{c} {given.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return given.mapInArrow(run, ", ".join([*kinds, "text string, n_chars long"]))
