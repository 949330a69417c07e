"""Main text of HTML pages as the maximum-scoring subsequence of words and tags.

A page is a sequence of tags and runs of words.  A word scores the log-odds of being article text that its surroundings
have on labelled pages: the enclosing elements, what their class, id and role say (menu, advert, form, comments ...), and
whether its block holds sentences or mostly links, as features beside each other.  A name that only contains a word of
these (popular-music, follow-up, with-sidebar), or one that articles use themselves, is a soft mark, a feature that what the
text itself looks like outweighs.  A tag scores a negative constant by its kind, from the same pages; so does, once and
whatever it holds, a marked part whose words score negative.  One linear scan finds the contiguous region with the largest sum;
what is marked and scores negative inside it is left out, and text in links is kept.

A plain mark on an element that holds most of the page's text, and more than all that no other mark covers, says nothing of that
text: it is a wrapper, and that is a feature of its own.

The text is that of the remaining blocks: character references decoded, white space inside a block turned into one space,
trimmed, and the blocks that aren't empty joined in page order by one line end.

Edge cases: null html counts as empty and gives an empty text; so does a page on which nothing scores above zero; unclosed
and misnested elements end with the nearest enclosing element that is closed, also scripts, styles, text areas and frames;
a page cut off in the middle of a tag ends there; scripts, styles and comments are never text, and `<!-->` is a comment;
formulas and drawings stand in their line; repeated rows give equal rows.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .html_labels import labelled_pages
from .shared import by_bytes

#: One markup item: a comment, a declaration, or a tag with its attributes.
MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
MARK_ATTRIBUTES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
CONTENT_MARKS = re.compile(r"<!--(/?)content-->")

SENTENCE = re.compile(r"[.!?…。！？](?:[\s\"'»”’)\]]|$)")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DRAWN = frozenset("math svg".split())  # all inside them is inline
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("p div ul ol li table article section header footer nav aside form h1 h2 h3 h4 h5 h6 blockquote pre main dl figure hr".split())
#: Words in class, id or role that mark a part of a page.
MARKS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc pagination pager skip tabs toolbar",
    "header": "header masthead topbar banner hero",
    "footer": "footer copyright colophon contentinfo legal",
    "sidebar": "sidebar aside widget complementary rail related recommended trending popular",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription paywall toast",
    "advert": "ad ads adv advert adverts advertisement advertising promo promotion promoted sponsor sponsored adsense dfp",
    "comments": "comment comments commentlist reply replies respond disqus discussion",
    "share": "share sharing social follow like tweet",
    "form": "form login signup search searchbox captcha",
}
MARK_OF = {word: mark for mark, words in MARKS.items() for word in words.split()}
#: Words of these that parts of articles are named by as well.
SOFT_WORDS = frozenset("popular trending dialog alert discussion hero tabs promotion skip like follow".split())
#: Words that say nothing beside a mark: site-footer, ad-slot; so do those of content beside comments and adverts: comment-body.
PLAIN_WORDS = frozenset("site page post article main global primary secondary mobile desktop slot box bar block wrap wrapper container section list item items link links area panel unit group holder top bottom left right inner outer center fixed small large wide row col column".split())
CONTENT_WORDS = frozenset("content article post entry main story body text page".split())
ELEMENT_MARK = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "button": "form", "label": "form", "legend": "form", "select": "form", "head": "head", "title": "head", "dialog": "notice"}
WORD_FEATURES = ("bias", *MARKS, "head", "hidden", "soft", "form element", "wrapper", "link", "p", "heading", "li", "cell", "article", "beside", "sentences", "links")
TAG_KINDS = ("inline", "link", "p", "heading", "li", "part", "other", "marked")
#: Marks that shift a score but don't make a part one that can be left out by its element alone.
SHIFTS = frozenset(["soft", "form element", "wrapper"])
#: Marks that no wrapper has by its name.
NEVER_AROUND = frozenset(["advert", "comments", "notice", "hidden", "head"])


def marks_of(name: str, attributes: str, in_article: bool) -> frozenset:
    """What an element's name, class, id and role say of the part it encloses."""
    marks = {ELEMENT_MARK[name]} if name in ELEMENT_MARK else set()
    if name == "header" and not in_article:
        marks.add("header")
    if name == "form":
        marks.add("form element")
    if name in ("html", "body", "main") or not attributes:
        return frozenset(marks)
    words: set[str] = set()
    named: set[str] = set()
    for key, value in MARK_ATTRIBUTES.findall(attributes):
        if key.lower() == "hidden" or key.lower() == "aria-hidden" and value.strip("\"'").lower() == "true":
            marks.add("hidden")
            continue
        for token in value.strip("\"'").split():
            parts = [w.lower() for w in NAME_PARTS.findall(token)]
            words.update(parts)
            found = {MARK_OF[w] for w in parts if w in MARK_OF}
            beside = PLAIN_WORDS | CONTENT_WORDS if found & {"comments", "advert"} else PLAIN_WORDS
            plain = all(w in beside or w in MARK_OF and w not in SOFT_WORDS for w in parts)
            named |= found if plain else {"soft"} if found else set()
    if name == "article":
        named &= {"comments", "advert"}
    elif words & CONTENT_WORDS:
        named -= {"sidebar", "header", "menu"}
    return frozenset(marks | named)


@dataclass
class Element:
    """An open element: its marks (those of its ancestors too, once the page is read), the names of it and its ancestors, and
    what it holds."""

    name: str
    parent: Element | None
    marks: frozenset
    names: frozenset
    words: int = 0  # outside links, and not in a marked element inside
    all_words: int = 0  # outside links


@dataclass
class Run:
    """A run of words, or of white space, the element that it stands in, and what its block is like."""

    text: str
    inside: Element
    n_words: int
    block: frozenset = frozenset()


@dataclass
class Tag:
    kind: str
    breaks: bool
    inside: Element


def parse(page: str) -> list[Run | Tag]:
    """The page's runs and tags in page order, with the marks of wrappers taken off."""
    top = Element("", None, frozenset(), frozenset())
    stack, elements, out = [top], [top], []
    at, n = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a:
            out.append(Run(page[a:b], stack[-1], len(page[a:b].split())))

    def close(names: frozenset, within: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in within:
                return

    while at < n and (found := MARKUP.search(page, at)):
        text(at, found.start())
        at = found.end()
        ending, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not ending:
            if not attributes.endswith("/"):
                own = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                # without an end tag it ends where an enclosing element does
                open_names = "|".join(sorted({re.escape(e.name) for e in stack[1:]}))
                outer = None if own or not open_names else re.compile(rf"(?=</(?:{open_names})\b)", re.I).search(page, at)
                at = own.end() if own else outer.end() if outer else n
            continue
        kind = "link" if name == "a" else "inline" if name in INLINE else "p" if name in ("p", "br") else "heading" if name in HEADINGS else "li" if name in ("li", "ul", "ol") else "part" if name in ELEMENT_MARK else "other"
        inline = name in INLINE or name in DRAWN or bool(stack[-1].names & DRAWN)
        out.append(Tag("inline" if inline and kind == "other" else kind, not inline, stack[-1]))
        if ending:
            close(frozenset([name]), frozenset() if not inline and name != "p" else CLOSES_P - {"p"})
        elif name not in VOID and not attributes.endswith("/"):
            if name in CLOSES_P:
                close(frozenset(["p"]), CLOSES_P - {"p"})
            if name == "li":
                close(frozenset(["li"]), frozenset(["ul", "ol"]))
            if name == "body":
                close(frozenset(["head"]), frozenset())
            parent = stack[-1]
            stack.append(Element(name, parent, marks_of(name, attributes, bool(parent.names & {"article", "main"})), parent.names | {name}))
            elements.append(stack[-1])
    text(at, n)
    spread_marks(elements, [x for x in out if isinstance(x, Run)])
    tell_blocks(out)
    return out


def tell_blocks(items: list[Run | Tag]) -> None:
    """Says of every run whether its block, which ends at a tag that breaks, holds a sentence or many words, and whether mostly links."""
    block: list[Run] = []
    for item in [*items, Tag("other", True, Element("", None, frozenset(), frozenset()))]:
        if isinstance(item, Run):
            block.append(item)
        elif item.breaks and block:
            total = sum(r.n_words for r in block)
            linked = sum(r.n_words for r in block if "a" in r.inside.names)
            sentences = total >= 12 or SENTENCE.search(" ".join("".join(r.text for r in block).split()))
            said = frozenset((["sentences"] if sentences else []) + (["links"] if 2 * linked > total else []))
            for r in block:
                r.block = said
            block = []


def spread_marks(elements: list[Element], runs: list[Run]) -> None:
    """Takes the marks off wrappers, then gives every element the marks of its ancestors."""

    def marked(e: Element | None) -> Element | None:
        while e is not None and not e.marks:
            e = e.parent
        return e

    free = 0
    for run in runs:
        holder = marked(run.inside)
        if run.n_words and "a" not in run.inside.names:
            run.inside.all_words += run.n_words
            if holder is None:
                free += run.n_words
            else:
                holder.words += run.n_words
    for e in reversed(elements[1:]):  # children come before their parents
        e.parent.all_words += e.all_words
    whole = elements[0].all_words
    for e in reversed(elements):
        if e.marks and e.name not in ELEMENT_MARK and not e.marks & NEVER_AROUND and e.words > free and 2 * e.all_words > whole:
            e.marks = e.marks & SHIFTS | {"wrapper"}
            outer = marked(e.parent)
            if outer is None:
                free += e.words
            else:
                outer.words += e.words
    for e in elements[1:]:
        e.marks |= e.parent.marks


@functools.lru_cache(maxsize=4096)
def features(marks: frozenset, names: frozenset, block: frozenset, has_article: bool) -> tuple[int, ...]:
    """Indexes of the features that hold for a word."""
    held = {"bias", *marks, *block}
    if has_article and not names & {"article", "main"}:
        held.add("beside")
    held |= {f for f, group in (("link", {"a"}), ("p", {"p", "blockquote", "pre"}), ("heading", HEADINGS), ("li", {"li", "dt", "dd"}), ("cell", {"td", "th"}), ("article", {"article", "main"})) if names & group}
    return tuple(k for k, f in enumerate(WORD_FEATURES) if f in held)


def part_of(e: Element | None) -> Element | None:
    """The outermost marked element around, itself included: the part that it belongs to."""
    part = None
    while e is not None:
        if e.marks - {"wrapper"}:
            part = e
        e = e.parent
    return part


@functools.lru_cache(maxsize=1)
def weights() -> tuple[np.ndarray, dict[str, float]]:
    """Word weights by logistic regression, and tag scores, from the labelled pages."""
    rows: dict[tuple, np.ndarray] = {}  # words outside and inside the article by their features
    tags = {kind: np.array([1.0, 1.0]) for kind in TAG_KINDS}
    for page in labelled_pages():
        inside, has_article = False, bool(ARTICLE.search(page))
        for item in parse(CONTENT_MARKS.sub(lambda m: f"<{m[1]}content-mark>", page)):
            # the label marks are read as tags, which open and close the labelled stretch
            if isinstance(item, Run):
                inside = "content-mark" in item.inside.names
                if item.n_words:
                    held = features(item.inside.marks, item.inside.names - {"content-mark"}, item.block, has_article)
                    rows.setdefault(held, np.zeros(2))[int(inside)] += item.n_words
                    if part_of(item.inside) is not None:
                        tags["marked"][int(inside)] += 1
            else:
                tags[item.kind][int(inside)] += 1
    x = np.array([[k in held for k in range(len(WORD_FEATURES))] for held in rows], dtype=float)
    counts = np.array(list(rows.values()))
    n, y = np.sqrt(counts.sum(1)), counts[:, 1] / counts.sum(1)
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.5 * (x.T @ (n * (p - y)) / n.sum() + 0.002 * w)
    return w, {kind: -0.01 - 0.05 * float(out / (out + own)) for kind, (out, own) in tags.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first and last + 1 place of the contiguous stretch with the largest sum, (0, 0) if no sum is above zero; of equal
    ones the one that ends first."""
    best = total = 0.0
    region, start = (0, 0), 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, region = total, (start, k + 1)
    return region


def scored(page: str) -> list[tuple[float, bool, Run | Tag]]:
    """(score, is left out, run or tag) of a page; a part of which something is left out costs once, and its tags nothing."""
    word_weights, tag_scores = weights()
    has_article, out, paid = bool(ARTICLE.search(page)), [], set()
    for item in parse(page):
        part = part_of(item.inside)
        if isinstance(item, Tag):
            out.append((0.0 if part is not None else tag_scores[item.kind], False, item))
            continue
        score = float(word_weights[list(features(item.inside.marks, item.inside.names, item.block, has_article))].sum())
        left_out = score < 0 and part is not None
        if left_out and item.n_words:
            cost = 0.0 if id(part) in paid else tag_scores["marked"]
            paid.add(id(part))
        else:
            cost = score * item.n_words
        out.append((cost, left_out, item))
    return out


def main_text(page: str) -> str:
    """The main text of one page."""
    parts = scored(page)
    blocks: list[list[str]] = [[]]
    for _, left_out, item in parts[slice(*best_region([p[0] for p in parts]))]:
        if isinstance(item, Run) and not left_out:
            blocks[-1].append(item.text)
        elif (left_out or item.breaks) and blocks[-1]:
            blocks.append([])
    return "\n".join(x for b in blocks if (x := " ".join(html.unescape("".join(b)).split())))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars.  Input columns of these names are replaced."""
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, column):
            texts = [main_text(x) for x in batch.column(column).to_pylist()]
            columns = [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "text", "n_chars"])

    schema = StructType([*(pages.schema[c] for c in kept), StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*kept, F.coalesce(column, F.lit("")).alias(column)).mapInArrow(run, schema)
