"""Main text of web pages: the maximum-scoring contiguous region of words and tags, weights from labelled pages.

The method is that of maximum subsequence segmentation (Pasternack and Roth, 2009): words score by what the tags around
them tell, tags cost, and one linear scan finds the best region.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of a page, and those whose raw content ends only at their own end tag.
UNSEEN = frozenset("head script style noscript template svg iframe object textarea select button datalist canvas audio video map".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
#: A start of these ends what an author left open, and article or main ends what stands before it.
_SITE = frozenset("nav header footer aside form menu".split())
_HOLDERS = frozenset("article main section div td".split())
_STORY = frozenset({"article", "main"})
#: Log odds of a feature that rejects a block by itself: seen several times, on other blocks only.
REJECTS = -2.0
#: What tells of a block's words, not of its place.
_SHAPE = frozenset({"links most", "links few", "no sentence", "sentences", "right to copy"})
_LABEL = "data-label"
LABELLED = Path(__file__).with_name("labelled_pages.html")
_OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|data-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SENTENCE = re.compile(r"[.!?:;…][\"'”’»)]*$")


class Element:
    __slots__ = ("main", "names", "tag", "unseen", "words")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.words, self.names = tag, 0, ()
        self.unseen, self.main = tag in UNSEEN, False
        if attributes and tag not in ("html", "body"):
            names = []
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role"):
                    names += [x.lower() for x in _NAME.findall(value)]
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                    self.unseen = True
                elif key == _LABEL:
                    self.main = True
            self.names = tuple(dict.fromkeys(names))


def markup(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of text, start and end tags in order, in time linear in the page."""
    at, n = 0, len(html)
    last_close = html.rfind(">")
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last_close:
            yield "text", html[at:], ""
            return
        mark = html[lt + 1 : lt + 2]
        name = _OPEN.match(html, lt + 1 + (mark == "/"))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            end = n if end < 0 else end + 3
        elif mark and mark in "!?":
            end = html.find(">", lt) + 1
        elif name:
            m = _ATTRIBUTES.match(html, name.end())
            end = m.end() if m else html.find(">", lt) + 1
        else:  # a bare less-than sign
            yield "text", html[at : lt + 1], ""
            at = lt + 1
            continue
        if lt > at:
            yield "text", html[at:lt], ""
        at = end
        if name and mark != "!":
            tag = name[0].lower()
            if mark == "/":
                yield "end", tag, ""
                continue
            yield "start", tag, html[name.end() : end - 1]
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = close.end() if close else n
                yield "end", tag, ""


def parse(html: str) -> list[tuple[str, object]]:
    """(open, element), (close, element) and (text, string) in order, well nested; words of elements are counted."""
    items: list[tuple[str, object]] = []
    stack: list[Element] = []
    counts: Counter = Counter()  # open elements by tag
    unseen = words = 0
    begun: list[int] = []

    def close_one() -> None:
        nonlocal unseen
        e = stack.pop()
        e.words = words - begun.pop()
        counts[e.tag] -= 1
        unseen -= e.unseen
        items.append(("close", e))

    def close_down(tags: frozenset[str]) -> None:
        """Close up to and with the lowest open element of these tags, if there is one."""
        while any(counts[t] for t in tags):
            close_one()

    for kind, value, attributes in markup(html):
        if kind == "text":
            if value and not unseen:
                shown = unescape(value)
                words += len(shown.split())
                items.append(("text", shown))
            continue
        if kind == "end":
            if counts[value]:
                while stack[-1].tag != value:
                    close_one()
                close_one()
            elif value in BLOCKS:
                items.append(("mark", value))
            continue
        if value == "body":
            close_down(frozenset(t for t in counts if t != "html"))
        elif value in _STORY:
            close_down(_SITE)
        elif value in BLOCKS and value != "br" and counts["p"]:
            close_down(frozenset({"p"}))
        if value in VOID or attributes.endswith("/"):
            items.append(("mark", value))
            continue
        e = Element(value, attributes)
        if value == "header" and (counts["article"] or counts["main"]):
            e.names = (*e.names, "_articleheader")
        stack.append(e)
        begun.append(words)
        counts[value] += 1
        unseen += e.unseen
        items.append(("open", e))
    while stack:
        close_one()
    return items


@dataclass
class Block:
    """A run of text between block tags."""

    text: str
    n: int
    features: frozenset[str]
    tags: list[tuple[str, int]]
    holder: int = 0
    story: bool = False
    main: bool = False


@dataclass
class _Place:
    """What is open at one point of the page, kept in step with it: features by how many elements have them."""

    total: int
    features: Counter = field(default_factory=Counter)
    holders: list[int] = field(default_factory=lambda: [0])  # those open; the page itself is the first
    held: dict[int, tuple[int, int]] = field(default_factory=dict)  # the first and the end of each one's blocks
    links: int = 0
    stories: int = 0
    mains: int = 0
    seen: int = 0

    def of(self, e: Element) -> list[str]:
        found = [] if e.tag == "a" or (e.tag == "header" and "_articleheader" in e.names) else [f"tag {e.tag}"]
        if e.words <= 0.5 * self.total or e.tag in _SITE:  # names of what holds most of a page tell nothing of its parts
            found += [f"name {x}" for x in e.names]
        return found

    def step(self, e: Element, by: int, n_blocks: int) -> None:
        for f in self.of(e):
            self.features[f] += by
            if not self.features[f]:
                del self.features[f]
        self.links += by * (e.tag == "a")
        self.stories += by * (e.tag in _STORY)
        self.mains += by * e.main
        if e.tag in _HOLDERS:
            if by > 0:
                self.seen += 1
                self.holders.append(self.seen if e.tag not in _STORY else -self.seen)
                self.held[self.holders[-1]] = (n_blocks, n_blocks)
            else:
                holder = self.holders.pop()
                self.held[holder] = (self.held[holder][0], n_blocks)


def blocks(items: list[tuple[str, object]]) -> list[Block]:
    """The page's blocks with the features of their place and shape, and the tags that stand before each."""
    return placed(items)[0]


def placed(items: list[tuple[str, object]]) -> tuple[list[Block], dict[int, tuple[int, int]]]:
    """The page's blocks, and of each holder, known by its number (of a story below 0, of the page 0), the first block in it and the end of them."""
    found: list[Block] = []
    place = _Place(sum(len(x.split()) for kind, x in items if kind == "text"))
    parts: list[str] = []
    tags: list[tuple[str, int]] = []
    n = linked = 0
    at: tuple | None = None

    def close() -> None:
        nonlocal parts, n, linked, tags, at
        joined = " ".join("".join(parts).split())
        if joined:
            features, holder, story, main = at
            shape = {"links most" if linked > 0.6 * n else "links few"}
            if n >= 8:  # fewer words, a heading or a short answer, tell nothing by their end
                shape.add("sentences" if _SENTENCE.search(joined) else "no sentence")
            if _RIGHTS.match(joined):
                shape.add("right to copy")
            found.append(Block(joined, n, features | shape, tags, holder, story, main))
            tags = []
        parts, n, linked, at = [], 0, 0, None

    for kind, value in items:
        if kind == "text":
            words = len(value.split())
            if words and not n:
                at = (frozenset(place.features), place.holders[-1], place.stories > 0, place.mains > 0)
            parts.append(value)
            n += words
            linked += words * (place.links > 0)
            continue
        tag = value if kind == "mark" else value.tag
        if tag in BLOCKS:
            close()
        tags.append((f"/{tag}" if kind == "close" else tag, 0 if kind == "mark" else value.words))
        if kind != "mark":
            place.step(value, 1 if kind == "open" else -1, len(found))
    close()
    return found, place.held | {0: (0, len(found))}


#: Words that one unit of a tag's log odds weighs.
TAG_WORDS = 1.5
#: A holder belongs to the region if it holds at most so many times its words.
WIDEN = 1.5


@dataclass
class Weights:
    """Log odds of main over other words by feature, and what a tag costs, in words."""

    words: dict[str, float]
    tags: dict[str, float]


def learn(pages: list[str]) -> Weights:
    """Weights from pages whose main blocks carry the label: a naive Bayes score of words by their features; of tags, how
    much more often each stands before other blocks than before main ones."""
    main, other, tags_main, tags_other = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        for b in blocks(parse(page)):
            for f in [*b.features, ""]:
                (main if b.main else other)[f] += 1
            (tags_main if b.main else tags_other).update({t for t, _ in b.tags})
    prior = math.log(main[""] / other[""])
    odds = {f: math.log((main[f] + 0.1) / (other[f] + 0.1)) - prior for f in {*main, *other} if f}
    odds[""] = 0.0  # main and other blocks are as likely before anything is known
    cost = {t: math.log1p((tags_other[t] + 0.5) / (tags_main[t] + 0.5) * main[""] / other[""]) for t in {*tags_main, *tags_other}}
    return Weights(odds, cost)


def labelled_pages() -> list[str]:
    return LABELLED.read_text(encoding="utf-8").split("\n====\n")[1:]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, in one pass; the first of equals."""
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += x
        if run > best:
            best, found = run, (start, k + 1)
    return found


def tag_cost(weights: Weights, tag: str, words: int) -> float:
    """A tag's cost grows with what its element holds: to leave or enter a large part is dearer than a line."""
    return TAG_WORDS * weights.tags.get(tag, 0.5) * max(1.0, math.log1p(words) / math.log1p(10))


def scored(found: list[Block], weights: Weights) -> tuple[list[float], list[float], list[bool]]:
    """By block: the score of its words, the cost of the tags before it, and whether it may stay in a region.

    One open tag or name that labelled pages have beside main text alone rejects a block. So does being linked most or
    beginning with a copyright sign, but not in an article or main element, where text may be linked or speak of that.
    """
    words, costs, fine = [], [], []
    for b in found:
        logit = weights.words[""] + sum(weights.words.get(f, 0.0) for f in b.features)
        place = min((weights.words.get(f, 0.0) for f in b.features - _SHAPE), default=0.0)
        words.append(b.n * math.tanh(logit / 2))
        costs.append(sum(tag_cost(weights, t, n) for t, n in b.tags))
        fine.append(place > REJECTS and (b.story or not b.features & {"links most", "right to copy"} or logit > 0))
    return words, costs, fine


def main_text(html: str, weights: Weights) -> str:
    """The text of the best region, joined by one space.

    The scan runs over words and tags: each block's words add their score, the tags before it take their cost. Blocks
    in the region that their place rejects (an advert in a story) go. The scan is widened to the article or main element
    that holds the region, else to its innermost holder, if that holds little more, or to what stands in it directly, so
    that an end which an advert cuts off stays.
    """
    found, held_by = placed(parse(html))
    words, costs, fine = scored(found, weights)
    start, end = best_region([x for w, c in zip(words, costs, strict=True) for x in (-c, w)])
    if not end:
        return ""
    start, end = start // 2, (end + 1) // 2  # a best run begins and ends with words
    shared = [h for h, (first, last) in held_by.items() if first <= start and end <= last]
    holder = max((h for h in shared if h < 0), default=max(shared, default=0))
    first, last = held_by[holder]
    region = sum(b.n for b, ok in zip(found[start:end], fine[start:end], strict=True) if ok)
    held = sum(b.n for b, ok in zip(found[first:last], fine[first:last], strict=True) if ok)
    deep = holder < 0 or (holder > 0 and held <= WIDEN * region)
    kept = []
    for k, b in enumerate(found):
        own = first <= k < last if deep else holder == b.holder
        inside = start <= k < end
        if (inside or own) and fine[k]:
            kept.append(b.text)
    return " ".join(kept)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``; a null or empty html has the empty text.

    Weights are learned from the labelled pages beside this module unless given. Repeated rows give repeated rows; null
    ids and urls stay null; other columns, whatever their names, are left out; an empty table gives an empty table. A
    page of any length is read whole, in time linear in it; what follows an unclosed comment, script or style is part
    of it, as browsers read it.
    """
    known = weights or learn(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, known) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
