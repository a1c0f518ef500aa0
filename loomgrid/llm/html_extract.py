"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between the edges of block elements, with the
tags and the class, id and role words of their ancestors. Scripts, styles, templates, the head and comments give
none. Features of a block are its ancestors, its length, its share of linked text, its closing punctuation and
its place; a two-label CRF (main text or not) with features on labels and on label pairs is fitted by stochastic
gradient steps on the exact likelihood (forward-backward) and decoded by Viterbi.

Labelled pages: at most ``max_pages`` pages of the input, picked by hash of the id among those of at most
``max_chars`` characters, whose ``article`` or ``main`` element tells main text from the rest; and for each of them
layouts laid out anew: the same main text in other containers, between menus, headers, notices, adverts,
sidebars, forms, reader comments and footers that hold words of other blocks, so that the text alone doesn't tell.
Only the fitted weights go to the executors.

Defined results: a null or empty page has the empty text; nested, unclosed and stray tags are taken as they come
(an end tag without its start is ignored, a head ends at the first element that may not stand in it, and only unclosed
scripts, styles, titles, text areas and comments run to the page's end); the work on a page grows with its length, however deep its
elements are nested; null ids and URLs stay; repeated rows give repeated results; pages of any
length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.batches import sliced
from loomgrid.llm.common import lowest_hashes

#: Fixed values of HTML: elements that break lines, elements without an end tag, and elements whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = frozenset("script style template noscript title textarea svg math iframe object canvas audio video".split())
#: What a start tag closes if it is open, and what stops the search for it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-zA-Z]+")


#: Elements that may stand in the head; any other start tag ends it. Unclosed, only these elements run to the end of the page.
HEAD = frozenset("html head title meta link script style base noscript template".split())
TO_THE_END = frozenset("script style title textarea".split())
#: A start tag of a block closes a paragraph that is open above these.
KEEPS_P = frozenset("td th li div section article".split())


class Node:
    """A way from the page down to an element: tags and name words. Equal ways of a page are one node, so a node costs what its last step adds.

    ``fresh``: the features that this step adds to its parent's; ``nearest``: the tag of the closest block element.
    """

    __slots__ = ("parent", "step", "children", "fresh", "nearest", "score")

    def __init__(self, parent: Node | None, step: tuple[str, ...], fresh: list[str]):
        self.parent, self.step, self.children, self.fresh, self.score = parent, step, {}, fresh, None
        self.nearest = step[0] if step and step[0] in BLOCKS else parent.nearest if parent else ""

    def steps(self) -> list[tuple[str, ...]]:
        out, node = [], self
        while node.parent:
            out.append(node.step)
            node = node.parent
        return out

    def features(self) -> list[str]:
        out, node = [], self
        while node.parent:
            out += node.fresh
            node = node.parent
        return sorted(out)


class Block(NamedTuple):
    text: str
    node: Node
    linked: int  # characters inside links


class Opened:
    """The open elements, with the places of each tag, so that no step looks through all of them."""

    def __init__(self) -> None:
        self.nodes, self.places, self.held = [Node(None, (), [])], {}, {}

    def push(self, step: tuple[str, ...]) -> None:
        top, names = self.nodes[-1], [f"tag:{step[0]}", *dict.fromkeys(f"name:{w}" for w in step[1:])]
        node = top.children.get(step)
        if node is None:
            node = top.children[step] = Node(top, step, [f for f in names if not self.held.get(f)])
        for f in names:
            self.held[f] = self.held.get(f, 0) + 1
        self.places.setdefault(step[0], []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """Place of the innermost open element with one of the tags; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_after(self, tags: set[str], place: int) -> int:
        """Place of the outermost one beyond a place; 0 if there is none."""
        found = [p[at] for t in tags if (p := self.places.get(t)) and (at := bisect.bisect_right(p, place)) < len(p)]
        return min(found, default=0)

    def cut(self, place: int) -> bool:
        """Close all from a place on; whether a block element was among them."""
        block = False
        while len(self.nodes) > place:
            step = self.nodes.pop().step
            self.places[step[0]].pop()
            for f in (f"tag:{step[0]}", *dict.fromkeys(f"name:{w}" for w in step[1:])):
                self.held[f] -= 1
            block |= step[0] in BLOCKS
        return block


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    opened = Opened()
    held: list[str] = []
    linked = position = 0
    in_head, endless = False, set()

    def close_block(node: Node) -> None:
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, node, linked))
        held, linked = [], 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = entities.unescape(raw)
            held.append(raw)
            if opened.last("a"):
                linked += len(raw)

    while m := TAG.search(page, position):
        if not in_head:
            take(page[position : m.start()])
        position = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "head":
            in_head = not ends
            continue
        if name == "body" or not ends and name not in HEAD:
            in_head = False
        if ends:
            at = opened.last(name)
            top = opened.nodes[-1]
            if at:
                if opened.cut(at):
                    close_block(top)
            elif name == "p" or name in BLOCKS:
                close_block(top)
            continue
        if name in NO_TEXT:
            if not attributes.endswith("/") and name not in endless:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, position)
                if end:
                    position = end.end()
                elif name in TO_THE_END:
                    position = len(page)
                else:
                    endless.add(name)
            held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close_block(opened.nodes[-1])
            elif name in ("br", "wbr", "img", "input"):
                held.append(" " if name != "wbr" else "")
            continue
        if name in BLOCKS:
            close_block(opened.nodes[-1])
            at = opened.last("p")
            if at > opened.last(*KEEPS_P):
                opened.cut(at)
            if name in CLOSES:
                what, stops = CLOSES[name]
                at = opened.first_after(what, opened.last(*stops))
                if at:
                    opened.cut(at)
        if not attributes.endswith("/") or name in BLOCKS:
            words = [w.lower() for found in NAMES.findall(attributes) for w in WORD.findall(" ".join(found))] if "=" in attributes else []
            opened.push((name, *words))
    take(page[position:] if not in_head else "")
    close_block(opened.nodes[-1])
    return out


def own_features(blocks: list[Block]) -> list[list[str]]:
    """Features of the blocks beside those of their ancestors."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        text = b.text
        words = text.count(" ") + 1
        share = b.linked / len(text)
        more = [
            "bias",
            f"in:{b.node.nearest}",
            f"words:{min(8, words.bit_length())}",
            f"link:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.9 else 3}",
            f"end:{'.' if text[-1] in '.!?…»”' else text[-1] if text[-1] in ':|' else 'o'}",
            f"place:{min(4, 5 * i // n)}",
        ]
        if "©" in text:
            more.append("copyright")
        if "|" in text or "·" in text or "»" in text:
            more.append("separator")
        if i and blocks[i - 1].node is not b.node:
            more.append("new_parent")
        out.append(more)
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """All features of the blocks; only training lists those of ancestors, which ``Crf.label`` adds up along the nodes."""
    return [b.node.features() + own for b, own in zip(blocks, own_features(blocks), strict=True)]


class Crf:
    """Weights of features for the label main text, of label pairs, and of pairs where the parent changes."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.pairs = np.zeros((2, 2, 2))  # by new_parent

    def scores(self, rows: list[list[str]]) -> tuple[np.ndarray, list[int]]:
        get = self.weights.get
        return np.array([sum(get(f, 0.0) for f in r) for r in rows]), [int(r[-1] == "new_parent") for r in rows]

    def label(self, blocks: list[Block]) -> list[int]:
        """Labels of a page's blocks. A node's score is its parent's and that of what it adds."""
        get = self.weights.get
        scores, new = self.scores(own_features(blocks))
        for i, b in enumerate(blocks):
            above, node = [], b.node
            while node.parent and node.score is None:
                above.append(node)
                node = node.parent
            total = node.score or 0.0
            for node in reversed(above):
                total = node.score = total + sum(get(f, 0.0) for f in node.fresh)
            scores[i] += total
        return self._best(scores, new)

    def decode(self, rows: list[list[str]]) -> list[int]:
        return self._best(*self.scores(rows))

    def _best(self, scores: np.ndarray, new: list[int]) -> list[int]:
        pairs = self.pairs.tolist()
        best, back = [0.0, float(scores[0])], []
        for s, k in zip(scores[1:].tolist(), new[1:], strict=True):
            p = pairs[k]
            a0, b0, a1, b1 = best[0] + p[0][0], best[1] + p[1][0], best[0] + p[0][1], best[1] + p[1][1]
            back.append((int(b0 > a0), int(b1 > a1)))
            best = [max(a0, b0), max(a1, b1) + s]
        label = int(best[1] > best[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.4, decay: float = 1e-4, seed: int = 3) -> Crf:
        """Adagrad on the pages' log likelihoods."""
        rng = random.Random(seed)
        squares: dict[str, float] = {}
        pair_squares = np.full((2, 2, 2), 1e-6)
        for _ in range(epochs):
            rng.shuffle(pages)
            for rows, labels in pages:
                scores, new = self.scores(rows)
                marginal, pair_marginal = self._expect(scores, new)
                for r, gap in zip(rows, (np.array(labels) - marginal).tolist(), strict=True):
                    if abs(gap) > 1e-4:
                        for f in r:
                            g = gap - decay * self.weights.get(f, 0.0)
                            squares[f] = squares.get(f, 1.0) + g * g
                            self.weights[f] = self.weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
                for i in range(1, len(rows)):
                    pair_marginal[new[i], labels[i - 1], labels[i]] -= 1
                pair_squares += pair_marginal**2
                self.pairs -= 0.1 * pair_marginal / np.sqrt(pair_squares)
        return self

    def _expect(self, scores: np.ndarray, new: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of label 1 for each block, and expected label pairs by new_parent."""
        n = len(scores)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0, 1] = scores[0]
        for i in range(1, n):
            forward[i] = np.logaddexp(forward[i - 1, 0] + self.pairs[new[i], 0], forward[i - 1, 1] + self.pairs[new[i], 1])
            forward[i, 1] += scores[i]
        for i in range(n - 2, -1, -1):
            onward = backward[i + 1] + (0, scores[i + 1])
            backward[i] = np.logaddexp(self.pairs[new[i + 1], :, 0] + onward[0], self.pairs[new[i + 1], :, 1] + onward[1])
        total = np.logaddexp(*forward[-1])
        pair = np.zeros((2, 2, 2))
        for i in range(1, n):
            pair[new[i]] += np.exp(forward[i - 1][:, None] + self.pairs[new[i]] + np.array([0, scores[i]]) + backward[i] - total)
        return np.exp(forward[:, 1] + backward[:, 1] - total), pair


#: Names that mark what isn't main text wherever it stands.
MARKED = frozenset("ad ads advert advertisement banner comment comments cookie footer menu nav newsletter notice promo related share sidebar social sponsored".split())


def told(blocks: list[Block]) -> list[int] | None:
    """Labels that the page's own article or main element tells; None where it has none."""
    inside = [any(e[0] in ("article", "main") for e in b.node.steps()) for b in blocks]
    if not any(inside):
        return None
    outer = ("nav", "aside", "footer", "form")
    return [int(i and not any(e[0] in outer or MARKED.intersection(e[1:]) for e in b.node.steps())) for i, b in zip(inside, blocks, strict=True)]


#: Containers for laid-out pages: start tags of main text, then of each kind of other block with the element of its items.
MAIN = ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post-body entry">', '<section class="article-text">', '<div class="wrap"><div>', '<div class="story">', "<table><tr><td>", "<div>", '<main id="main"><article class="post">']
OTHER = {
    "before": [
        ('<nav><ul>', "li a"), ('<ul class="menu">', "li a"), ('<div class="navbar">', "a"), ("<header>", "p"), ('<header class="site-header">', "h1"), ('<div class="header">', "p"), ('<div id="header">', "div"),
        ('<div class="cookie-notice">', "p"), ('<div class="notice">', "p"), ('<div role="alert" class="banner">', "p"), ('<div class="ad">', "raw"), ('<div class="advert">', "p"), ('<div class="breadcrumb">', "a"), ('<form class="search">', "label"), ('<ul>', "li a"),
    ],
    "inside": [('<div class="ad">', "raw"), ('<aside>', "p"), ('<div class="advertisement">', "p"), ('<div class="related">', "li a"), ('<div class="share social">', "a"), ('<form class="newsletter">', "p"), ('<nav>', "a"), ('<div class="promo sponsored">', "p")],
    "after": [
        ('<aside>', "p"), ('<aside class="sidebar">', "li a"), ('<div class="sidebar">', "p"), ('<div id="sidebar">', "li"), ('<section id="comments">', "p"), ('<div class="comments">', "comment"), ('<ol class="commentlist">', "li"), ('<div class="comment">', "p"),
        ('<form>', "label"), ('<form class="login">', "p"), ('<footer>', "raw"), ('<footer class="site-footer">', "p"), ('<div class="footer">', "p"), ('<div id="footer">', "raw"), ('<div class="related">', "li a"), ('<div class="ad">', "p"), ('<div class="sponsored promo">', "raw"), ('<div class="newsletter">', "p"),
    ],
}


def lay_out(main: list[str], pool: list[str], rng: random.Random) -> tuple[str, list[str]]:
    """A page with ``main`` as its main text among other blocks made of texts of ``pool``; and its main blocks."""
    escape = entities.escape

    def closing(start: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", start)))

    def item(kind: str) -> str:
        text = rng.choice(pool)
        words = text.split()
        if kind in ("a", "li a", "label") or rng.random() < 0.3:
            at = rng.randrange(len(words))
            text = " ".join(words[at : at + rng.randint(1, 5)])
        if kind == "li a":
            return f'<li><a href="#">{escape(text)}</a></li>'
        if kind == "comment":
            return f'<div class="comment-body"><span class="author">{escape(text[:12])}</span><p>{escape(text)}</p></div>'
        if kind == "raw":
            return escape(text if rng.random() < 0.5 else f"© {text}")
        return f'<a href="#">{escape(text)}</a> ' if kind == "a" else f"<{kind}>{escape(text)}</{kind}>"

    def other(where: str, most: int) -> str:
        out = []
        for start, kind in rng.sample(OTHER[where], rng.randint(0 if where == "inside" else 1, most)):
            out.append(start + "".join(item(kind) for _ in range(1 if kind == "raw" else rng.randint(1, 6))) + closing(start))
        return "".join(out)

    start = rng.choice(MAIN)
    heading = rng.randint(1, 3)
    parts = [f"<h{heading}>{escape(main[0])}</h{heading}>", *(f"<p>{escape(t)}</p>" for t in main[1:])]
    if rng.random() < 0.3:
        parts = [p.replace("<p>", "<div>").replace("</p>", "</div>") for p in parts]
    if len(parts) > 2 and rng.random() < 0.4:
        parts.insert(rng.randrange(1, len(parts)), other("inside", 1))
    return "<html><body>" + other("before", 4) + start + "".join(parts) + closing(start) + other("after", 4) + "</body></html>", main


def training_pages(pages: list[str], layouts: int, rng: random.Random) -> list[tuple[list[list[str]], list[int]]]:
    out, mains, pool = [], [], []
    for page in pages:
        blocks = blocks_of(page)
        pool.extend(b.text for b in blocks)
        labels = told(blocks) if blocks else None
        if labels is not None:
            out.append((features(blocks), labels))
            mains.append([b.text for b, y in zip(blocks, labels, strict=True) if y])
    pool = pool or ["A line of text.", "Menu", "Read on"]
    mains = [m for m in mains if m] or [[t for t in pool if len(t.split()) >= 5][:6] or pool[:1]] * 20
    for main in mains:
        for _ in range(layouts):
            n = rng.randint(1, min(len(main), 12))
            at = rng.randrange(len(main) - n + 1)
            page, own = lay_out(main[at : at + n], pool, rng)
            blocks = blocks_of(page)
            labels, k = [], 0
            for b in blocks:  # the main blocks stand in the page in their order
                hit = k < len(own) and b.text == " ".join(own[k].split()) and not any(MARKED.intersection(e[1:]) or e[0] in ("aside", "nav", "form", "footer", "header") for e in b.node.steps())
                k += hit
                labels.append(int(hit))
            if k == len(own):
                out.append((features(blocks), labels))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 300, max_chars: int = 20_000, layouts: int = 4) -> Crf:
    sample = lowest_hashes(pages.where(F.length(html_col).between(1, max_chars)).select(id_col, html_col), F.col(id_col), max_pages, pages.count())
    found = sorted(r[1] for r in sample.collect())  # bounded by max_pages * max_chars
    return Crf().fit(training_pages(found, layouts, random.Random(1)))


def main_text(page: str | None, model: Crf) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, y in zip(blocks, model.label(blocks), strict=True) if y)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **training) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, id_col, html_col, **training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches, "html"):
            found = [main_text(t, shared.value) for t in texts]
            yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())})

    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
