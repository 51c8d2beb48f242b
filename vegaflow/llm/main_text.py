"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text with no block-level tag inside.
Each block has features from its ancestors (tags, and the words of their class,
id and role) and from its text (length, share of linked characters, closing
mark, place). Two states, article or not, with learned transitions, are decoded
by Viterbi. The field is trained on labelled pages: pages built here from parts
whose label is known, and a bounded sample of the input labelled by its own
semantic tags.
"""

from __future__ import annotations

import bisect
import dataclasses
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vegaflow.llm.crf import forward_backward, viterbi

#: Elements whose content is raw text: no tag counts in them but their own end. Those of the second kind end with the page.
RAW, RAW_TO_END = frozenset("script style title textarea iframe xmp".split()), frozenset(("script", "style"))
#: Ordinary elements whose content is not text of the page.
HIDDEN = frozenset("template svg select button noscript object canvas audio video".split())
#: How a tag, a comment or a declaration begins; of a name, so many characters count.
OPENING = re.compile(r"<(?:(!--)|(/?)([a-z][^\s/>]{0,63})|[!?/])", re.I)
RAW_END = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for name in RAW}
MARKS = re.compile("[>\"']")
#: Elements that run inside a line of text and do not part blocks.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the left kind ends where one of the right kinds starts.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+")

OTHER, ARTICLE = 0, 1
#: Bounds of what is learnt from the input: pages, about, and blocks of each, which lie anywhere in it.
MAX_PAGES, MAX_RUN = 200, 200


@dataclasses.dataclass
class Block:
    """Text with the innermost element around it, all elements and the words of their names, and how much is linked."""

    text: str
    own: str
    tags: frozenset[str]
    names: frozenset[str]
    linked: int


@dataclasses.dataclass(slots=True)
class Tag:
    """A tag of a page: where it starts and where text goes on behind it, and the place of its end tag if it has one."""

    start: int
    after: int
    name: str
    closing: bool
    attributes: str
    end: int | None = None


class TagEnds:
    """Where the tag that is open at a place ends: the next ``>`` outside quotes.

    Marks are listed once, and each knows the end behind it once it was asked for,
    so all questions about a page take time linear in its length.
    """

    def __init__(self, page: str):
        self.places = [m.start() for m in MARKS.finditer(page)]
        self.kinds = [page[p] for p in self.places]
        self.closing, last = [0] * len(self.places), {}
        for i in range(len(self.places) - 1, -1, -1):
            self.closing[i] = last.get(self.kinds[i], -1)
            last[self.kinds[i]] = i
        self.known: dict[int, int] = {}

    def after(self, place: int) -> int:
        """The place of that ``>``, or -1 where there is none or a quote is never closed."""
        i, way, found = bisect.bisect_left(self.places, place), [], -1
        while i < len(self.places):
            if i in self.known:
                found = self.known[i]
                break
            way.append(i)
            if self.kinds[i] == ">":
                found = self.places[i]
                break
            if self.closing[i] < 0:
                break
            i = self.closing[i] + 1
        self.known.update(dict.fromkeys(way, found))
        return found


def tags_of(page: str) -> list[Tag]:
    """Tags in page order (a comment is one without a name); raw elements are one tag with all they hold.

    A raw element without an end tag holds nothing, but for scripts and styles,
    which run to the end of the page; a self-closed one holds nothing either. An
    end tag of a raw element may carry anything behind its name.
    """
    out: list[Tag] = []
    endless: set[str] = set()
    ends, at, last = TagEnds(page), 0, page.rfind(">")
    while m := OPENING.search(page, at):
        start, name, attributes = m.start(), (m[3] or "").lower(), ""
        if m[1]:
            at = page.find("-->", m.end())
            at = at + 3 if at >= 0 else len(page)
        elif m.end() > last:  # no tag from here on has an end
            at = start + 1
            continue
        elif name:
            end = ends.after(m.end())
            if end < 0:
                at = start + 1
                continue
            attributes, at = page[m.end() : end], end + 1
        else:
            at = page.find(">", m.end()) + 1
        if name in RAW:
            if not m[2] and not attributes.endswith("/"):
                end = None if name in endless else RAW_END[name].search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(name)
                    at = len(page) if name in RAW_TO_END else at
            name = ""
        out.append(Tag(start, at, name, bool(m[2]), attributes))
    return out


def pair(tags: list[Tag]) -> None:
    """Sets the end of hidden elements whose end tag comes before that of an element around them."""
    stack: list[Tag] = []
    held: Counter[str] = Counter()
    for i, t in enumerate(tags):
        if not t.name or (t.name in INLINE and t.name not in HIDDEN) or t.name in VOID:
            continue
        if not t.closing:
            if not t.attributes.endswith("/"):
                stack.append(t)
                held[t.name] += 1
            continue
        while held[t.name]:
            top = stack.pop()
            held[top.name] -= 1
            if top.name == t.name:
                top.end = i if t.name in HIDDEN else None
                break


#: Elements inside each other whose tags and names count; deeper ones take those of the element around them.
DEPTH = 512


@dataclasses.dataclass(slots=True)
class Element:
    tag: str
    tags: frozenset[str]
    names: frozenset[str]


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order; white space is one space, references are decoded.

    Hidden elements are left out. One that is never closed hides only the text up
    to the next block, so that a forgotten end tag cannot swallow an article.
    """
    if not page:
        return []
    tags = tags_of(page)
    pair(tags)
    out: list[Block] = []
    stack = [Element("none", frozenset(), frozenset())]
    open_ones: Counter[str] = Counter()
    held: list[str] = []
    links, linked, muted = 0, 0, False

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, stack[-1].tag, stack[-1].tags, stack[-1].names, linked))
        held.clear()
        linked = 0

    def text_of(piece: str) -> None:
        nonlocal linked
        if piece and not muted:
            piece = html.unescape(piece)
            held.append(piece)
            if links:
                linked += len(piece.strip())

    at = i = 0
    while i < len(tags):
        t = tags[i]
        text_of(page[at : t.start])
        at, i = t.after, i + 1
        if t.name in HIDDEN:
            if t.end is not None:
                at, i = tags[t.end].after, t.end + 1
            else:
                muted = not t.closing and not t.attributes.endswith("/")
            continue
        if not t.name:
            continue
        if t.name in INLINE:
            if t.name == "a":
                links = 0 if t.closing else 1
            elif t.name == "br":
                held.append(" ")
            continue
        if muted and t.name in ("option", "optgroup", "param", "source", "track", "path", "g"):
            continue
        end_block()
        links, muted = 0, False
        if t.closing:
            while open_ones[t.name]:
                top = stack.pop()
                open_ones[top.tag] -= 1
                if top.tag == t.name:
                    break
            continue
        if stack[-1].tag == "p" or t.name in CLOSED_BY.get(stack[-1].tag, ()):
            open_ones[stack.pop().tag] -= 1
        if t.name not in VOID and not t.attributes.endswith("/"):
            around = stack[-1]
            tags_now, names = around.tags, around.names
            if len(stack) <= DEPTH:
                own = {w for g in NAMES.findall(t.attributes) for w in NAME_WORD.findall("".join(g).lower())}
                tags_now, names = tags_now if t.name in tags_now else tags_now | {t.name}, names if own <= names else names | own
            stack.append(Element(t.name, tags_now, names))
            open_ones[t.name] += 1
    text_of(page[at:])
    end_block()
    return out


def features_of(blocks: list[Block]) -> list[set[str]]:
    has_main = any(not MAIN_TAGS.isdisjoint(b.tags) for b in blocks)
    out = []
    for i, b in enumerate(blocks):
        words, share = b.text.count(" ") + 1, b.linked / len(b.text)
        f = {"own " + b.own, f"words {min(5, words.bit_length())}", f"linked {min(3, int(share * 3.3))}", "always"}
        f.update("in " + t for t in b.tags)
        f.update("name " + n for n in b.names)
        if has_main:
            f.add("inside" if not MAIN_TAGS.isdisjoint(b.tags) else "outside")
        if b.text[-1] in ".!?\"'”»:;":
            f.add("closed")
        if i == 0:
            f.add("first")
        if i == len(blocks) - 1:
            f.add("last")
        out.append(f)
    return out


@dataclasses.dataclass(frozen=True)
class BlockModel:
    index: dict[str, int]
    weights: np.ndarray
    transition: np.ndarray

    def states(self, blocks: list[Block]) -> list[int]:
        if not blocks:
            return []
        scores = np.zeros((len(blocks), 2))
        for i, f in enumerate(features_of(blocks)):
            known = [self.index[x] for x in f if x in self.index]
            scores[i] = self.weights[known].sum(axis=0)
        return viterbi(scores, self.transition)

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page)
        return "\n\n".join(b.text for b, s in zip(blocks, self.states(blocks), strict=True) if s == ARTICLE)


def fit(pages: list[tuple[list[set[str]], list[int]]], rounds: int = 150, rate: float = 0.1, l2: float = 1e-4) -> BlockModel:
    """Maximum conditional likelihood by Adam over all labelled pages: features and label of each block."""
    pages = [(f, y) for f, y in pages if f]
    feats = [f for f, _ in pages]
    index: dict[str, int] = {}
    for fs in feats:
        for f in fs:
            for x in sorted(f):
                index.setdefault(x, len(index))
    steps = max(map(len, feats))
    mask, hot = np.zeros((len(pages), steps), bool), np.zeros((len(pages), steps, 2))
    where, which = [], []
    for p, (fs, (_, y)) in enumerate(zip(feats, pages, strict=True)):
        mask[p, : len(fs)] = True
        hot[p, np.arange(len(fs)), y] = 1
        for i, f in enumerate(fs):
            where += [p * steps + i] * len(f)
            which += [index[x] for x in f]
    where, which = np.array(where), np.array(which)
    states = hot.argmax(axis=2)
    both, seen = mask[:, 1:] & mask[:, :-1], np.zeros((2, 2))
    np.add.at(seen, (states[:, :-1][both], states[:, 1:][both]), 1)
    w, trans = np.zeros((len(index), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(x) for x in (w, w, trans, trans)]
    total = mask.sum()
    for step in range(1, rounds + 1):
        score = np.stack([np.bincount(where, w[which, c], mask.size) for c in (0, 1)], axis=1).reshape(*mask.shape, 2)
        marginal, moved = forward_backward(score, mask, trans, pairs=True)
        gap = np.where(mask[..., None], marginal - hot, 0).reshape(-1, 2)
        grad = np.stack([np.bincount(which, gap[where, c], len(index)) for c in (0, 1)], axis=1) / total + l2 * w
        for x, g, a, b in ((w, grad, *moments[:2]), (trans, (moved - seen) / total + l2 * trans, *moments[2:])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return BlockModel(index, w, trans)


#: Parts of built pages: (markup around the blocks, tag of the blocks, words to a block, blocks, is it linked). ``*`` marks an article part.
ARTICLE_FRAMES = ['<article>*</article>', '<main><article>*</article></main>', '<main>*</main>', '<div class="content">*</div>', '<div id="main-content"><div class="post entry">*</div></div>', '<div class="article-body story">*</div>', '<section class="post-content">*</section>', '<div role="main">*</div>', '<div class="page"><div class="text">*</div></div>']
OUTSIDE = [
    ('<nav><ul>*</ul></nav>', "li", 2, 6, True), ('<nav class="menu">*</nav>', "div", 2, 5, True), ('<div class="menu navbar"><ul>*</ul></div>', "li", 2, 7, True), ('<div id="navigation breadcrumb breadcrumbs">*</div>', "p", 3, 1, True),
    ('<header>*</header>', "p", 4, 2, False), ('<header class="site-header masthead top">*</header>', "h1", 3, 1, False), ('<div id="header" class="banner">*</div>', "h2", 4, 1, False),
    ('<footer>*</footer>', "p", 9, 2, False), ('<footer>*</footer>', "", 8, 1, False), ('<div class="footer bottom copyright">*</div>', "p", 7, 2, False),
    ('<aside>*</aside>', "p", 12, 3, False), ('<aside class="sidebar related"><ul>*</ul></aside>', "li", 5, 5, True), ('<div class="sidebar widget">*</div>', "p", 10, 3, False), ('<div class="related recommended more trending popular">*</div>', "p", 8, 3, True),
    ('<div class="cookie cookies consent gdpr notice">*</div>', "p", 15, 1, False), ('<div class="notice alert banner warning message popup modal">*</div>', "p", 10, 1, False), ('<div role="alert">*</div>', "p", 9, 1, False), ('<div class="newsletter subscribe signup promo">*</div>', "p", 9, 2, False),
    ('<div class="ad">*</div>', "", 8, 1, False), ('<div class="ads advert advertisement">*</div>', "p", 12, 2, False), ('<div class="sponsored sponsor promo">*</div>', "p", 14, 1, False), ('<aside class="ad">*</aside>', "", 10, 1, False),
    ('<form>*</form>', "p", 4, 2, False), ('<form class="search login">*</form>', "div", 3, 2, False), ('<div class="share social">*</div>', "p", 2, 3, True), ('<div class="tags meta byline author">*</div>', "p", 4, 1, False), ('<div class="pagination pager"><ul>*</ul></div>', "li", 1, 4, True),
    ('<section class="comments">*</section>', "p", 20, 4, False), ('<div id="comments" class="comment">*</div>', "p", 15, 3, False), ('<div class="reader comments responses replies discussion disqus">*</div>', "div", 18, 3, False), ('<section id="comments"><article class="comment">*</article></section>', "p", 16, 3, False), ('<ol class="comment-list reply"><li>*</li></ol>', "p", 14, 3, False),
]
BODY_TAGS = ["p", "p", "p", "p", "p", "p", "h2", "h3", "li", "blockquote", "div", "pre", "td", "figcaption", ""]


def built_pages(n: int, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages from the parts above; article blocks carry a mark that is taken off again."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def words(k: int) -> str:
        return " ".join("".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(max(1, k)))

    def part(frame: str, tag: str, size: int, count: int, linked: bool) -> str:
        inner = []
        for _ in range(int(rng.integers(1, count + 1))):
            text = words(int(rng.integers(1, 2 * size + 1))) + ("." if rng.random() < 0.5 else "")
            text = f"<a href='x'>{text}</a>" if linked else text
            inner.append(f"<{tag}>{text}</{tag}>" if tag else text)
        return frame.replace("*", "".join(inner))

    pages = []
    for _ in range(n):
        inner = [f"<h1>{words(int(rng.integers(2, 12)))}@@</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 9))):
            tag = BODY_TAGS[int(rng.integers(len(BODY_TAGS)))]
            size = int(rng.integers(1, 6)) if rng.random() < 0.25 else int(rng.integers(6, 90))
            text = words(size) + ("." if rng.random() < 0.7 else "") + "@@"
            text = f"<a href='x'>{text}</a>" if rng.random() < 0.04 else f"<b>{text}</b>" if rng.random() < 0.1 else text
            inner.append(f"<{tag}>{text}</{tag}>" if tag else f"<div>{text}</div>")
            if rng.random() < 0.1:
                inner.append(part(*OUTSIDE[int(rng.integers(10, len(OUTSIDE)))]))
        frame = ARTICLE_FRAMES[int(rng.integers(len(ARTICLE_FRAMES)))] if rng.random() < 0.6 else ARTICLE_FRAMES[0]
        before = [part(*OUTSIDE[int(rng.integers(len(OUTSIDE)))]) for _ in range(int(rng.integers(0, 4)))]
        after = [part(*OUTSIDE[int(rng.integers(len(OUTSIDE)))]) for _ in range(int(rng.integers(0, 4)))]
        page = "<html><body>" + "".join(before) + frame.replace("*", "".join(inner)) + "".join(after) + "</body></html>"
        blocks = blocks_of(page)
        labels = [ARTICLE if b.text.endswith("@@") else OTHER for b in blocks]
        for b in blocks:
            b.text = b.text.removesuffix("@@") or "x"
        pages.append((blocks, labels))
    return pages


#: Ancestors by which pages of the input label themselves: inside the first kind and none of the second is article.
MAIN_TAGS, BOILER_TAGS = {"article", "main"}, {"nav", "header", "footer", "aside", "form"}
BOILER_NAMES = {"ad", "ads", "advert", "advertisement", "sidebar", "comment", "comments", "cookie", "menu", "notice", "promo", "related", "share", "sponsored"}


def self_labelled(page: str) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page that has a main element, else None."""
    blocks = blocks_of(page)
    labels = [int(bool(MAIN_TAGS & b.tags) and not BOILER_TAGS & b.tags and not BOILER_NAMES & b.names) for b in blocks]
    return (blocks, labels) if any(labels) else None


def featured(labelled: tuple[list[Block], list[int]]) -> tuple[list[set[str]], list[int]]:
    blocks, labels = labelled
    return features_of(blocks), labels


def train(pages: DataFrame) -> BlockModel:
    """From built pages and a bounded sample, by hash of the id, of the input.

    Of a page of the sample, a run of at most ``MAX_RUN`` blocks counts, with
    the features that they have in the whole page; the hash says where it starts.
    """
    n = pages.agg(F.approx_count_distinct("page_id")).first()[0]
    draw = F.pmod(F.xxhash64(F.lit(31), "page_id"), F.lit(1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own := self_labelled(page):
                    feats, labels = featured(own)
                    lo = place % max(1, len(labels) - MAX_RUN + 1)
                    out.append(json.dumps([[sorted(f) for f in feats[lo : lo + MAX_RUN]], labels[lo : lo + MAX_RUN]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["run"])

    drawn = pages.where(F.col("html").isNotNull() & (draw < F.lit(min(1 << 32, int((1 << 32) * MAX_PAGES / max(1, n))))))
    drawn = drawn.groupBy("page_id").agg(F.min("html").alias("html"))  # of an id that repeats, one row
    rows = drawn.select("html", F.pmod(F.xxhash64(F.lit(37), "page_id"), F.lit(1 << 31)).alias("place")).mapInArrow(run, "run string").collect()
    own = [([set(f) for f in feats], labels) for feats, labels in (json.loads(r["run"]) for r in rows)]
    return fit([featured(x) for x in built_pages(700)] + own)


def main_text(pages: DataFrame, model: BlockModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row; null, empty and textless pages give an empty text.

    Pages are read whole, however long. Null ids and urls are kept, repeated rows
    repeat, an empty table gives no rows, and other columns are not read.
    """
    model = model or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [model.text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
