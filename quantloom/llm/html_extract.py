"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by how they are laid out.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
CLOSES_P = set("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LANDMARKS = set("article aside body button dialog footer form head header main nav section select".split()) | RAW
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end when one of the named elements begins beside them.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}

# Each pattern takes what it matches for good (no backtracking), so a page is read once however broken it is.
#: What follows an element's name up to its end. A quote counts as one only behind an equals sign.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+(>|\Z)")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
NAMED = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass(slots=True, eq=False)
class Node:
    """An open element: its name, the element around it, the features that hold inside it and not already
    around it, and the words that say what it belongs to, its own or those of the nearest element with any."""

    tag: str
    parent: "Node | None"
    fresh: tuple[str, ...]
    near: tuple[str, ...]
    score: tuple[float, float] | None = None


@dataclass(slots=True)
class Block:
    """A leaf block: its text, the element it stands in, and how many of its letters stand in links."""

    text: str
    node: Node | None
    linked: int


class Open:
    """The open elements, outermost first. Where each kind of element and each feature is open is known without
    looking through them, so deep nesting costs nothing."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.holds: set[str] = set()

    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def node(self, tag: str, names: tuple[str, ...]) -> Node:
        """An element inside all that are open, not yet opened."""
        inside = dict.fromkeys([f"in={tag}", *(f"name={w}" for w in names)])
        near = names or ((tag,) if tag in LANDMARKS else self.nodes[-1].near if self.nodes else ())
        return Node(tag, self.top(), tuple(f for f in inside if f not in self.holds), near)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.holds.update(node.fresh)

    def last(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def cut(self, length: int) -> None:
        while len(self.nodes) > length:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            self.holds.difference_update(node.fresh)


def leaf_blocks(html: str) -> list[Block]:
    """Blocks in page order. Inline elements and ``<br>`` do not end a block, comments vanish, the content of
    scripts, styles and the like is a block of its own, unclosed elements end where HTML ends them, and stray
    end tags are passed over. Character references are decoded and white space is one space. What is left open
    at the end of the page, be it a tag, a comment or a quoted value, ends there and is no text."""
    blocks: list[Block] = []
    stack = Open()
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, stack.top(), linked))
            parts.clear()
        linked = 0

    def close(names: Iterable[str], stop: Iterable[str]) -> None:
        i = stack.last(names)
        if i > stack.last(stop):
            flush()
            stack.cut(i)

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text)

    at, size = 0, len(html)
    while at < size:
        sign = html.find("<", at)
        add(html[at : sign if sign >= 0 else size])
        if sign < 0:
            break
        name = NAME.match(html, sign + 1)
        if not name:
            kind = html[sign + 1 : sign + 2]
            if kind in ("!", "?", "/"):  # comments and the like
                start, end = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if html.startswith(x[0], sign)), ("<!", ">"))
                found = html.find(end, sign + len(start))
                at = found + len(end) if found >= 0 else size
            else:
                add("<")
                at = sign + 1
            continue
        rest = REST.match(html, name.end())
        at = rest.end()
        if not rest[1]:
            break
        tag = name[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                links = 0
            elif tag == "p" or tag not in INLINE and tag not in VOID:
                close((tag,), ("table",) if tag not in ("table", "body", "html") else ())
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 1
            continue
        if tag in INLINE:
            continue
        flush()
        links = 0
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "button"))
        if tag in ENDED_BY:
            close([t for t, by in ENDED_BY.items() if tag in by], ("ul", "ol", "dl", "table", "select", "article", "section", "div"))
        names = tuple(w for m in NAMED.finditer(rest[0]) for w in WORDS.findall((m[2] or m[3] or m[4] or "").lower()))
        node = stack.node(tag, names)
        if tag in RAW:
            end = _end_of(tag).search(html, at)
            inner = " ".join(unescape(html[at : end.start()]).split())
            if inner:
                blocks.append(Block(inner, node, 0))
            at = max(end.end(), at)
        elif tag not in VOID and not rest[0].endswith("/>"):
            stack.push(node)
    flush()
    return blocks


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?![^\s/>])[^>]*+(?:>|\Z)|\Z", re.I)


def own_features(block: Block) -> tuple[str, ...]:
    """Names of the features of a block by itself: its element, the nearest words that say what it belongs to,
    and the shape of its text."""
    tag = block.node.tag if block.node else "none"
    out = ["bias", f"tag={tag}"]
    out += sorted({f"near={w}" for w in block.node.near} if block.node else ())
    n = len(block.text)
    out.append("len=" + ("0" if n < 25 else "1" if n < 80 else "2" if n < 250 else "3"))
    share = block.linked / max(1, n)
    out.append("links=" + ("0" if share < 0.1 else "1" if share < 0.6 else "2"))
    if block.text[-1] in ".!?…。":
        out.append("ends=stop")
    if tag in HEADINGS:
        out.append("heading")
    return tuple(out)


def block_features(block: Block) -> list[str]:
    """All features of a block: its own, and the elements and class words around it."""
    out, node = list(own_features(block)), block.node
    while node:
        out += node.fresh
        node = node.parent
    return out


# Wrappers of the labelled training pages, by whether their content is main text.
MAIN_WRAPS = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><article class="post">{}</article></div>', '<section class="article body">{}</section>', '<div role="main"><section>{}</section></div>']
OTHER_BLOCKS = [
    "<nav><ul><li><a href=/>{}</a></li><li><a href=/x>{}</a></li></ul></nav>", "<header><h1>{}</h1><p>{}</p></header>", "<footer>{}</footer>", "<footer><p>{}</p><p>{}</p></footer>", "<aside><h2>{}</h2><p>{}</p></aside>",
    '<div class="ad">{}</div>', '<div class="ads banner advert sponsored promo">{}</div>', '<div class="sidebar widget related"><p>{}</p><p>{}</p></div>', "<form><p>{}</p><label>{}</label></form>", '<div class="cookie notice consent popup modal newsletter subscribe">{}</div>',
    '<div class="comments"><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></div>', '<section id="comments"><article class="comment reply"><p>{}</p></article></section>', '<div class="menu nav breadcrumb"><a href=/>{}</a></div>', '<div class="share social"><a href=/>{}</a></div>', "<script>{}</script>", "<style>{}</style>", "<noscript>{}</noscript>", "<div role=navigation><a href=/>{}</a></div>", "<select><option>{}<option>{}</select>", "<button>{}</button>", '<div class="footer copyright"><p>{}</p></div>', '<div id="header"><p>{}</p></div>',
]
SENTENCES = ["Short words here", "A plain sentence of some words ends here.", "One sentence runs on for a good while, with clauses and more words than most, so that it is rather long and even. It has another after it, too, that says little but says it at length, and then stops."]


def labelled_pages() -> list[tuple[str, list[int]]]:
    """Training pages made from the wrappers above with a label for each leaf block (1: main text)."""
    rng, pages = np.random.default_rng(7), []

    def fill(template: str) -> tuple[str, int]:
        n = template.count("{}")
        return template.format(*(SENTENCES[i] for i in rng.integers(0, 3, n))), n

    for wrap, inside in product(MAIN_WRAPS, range(6)):
        for _ in range(3):
            html, labels = "<html><head><title>Some title</title></head><body>", [0]
            picks = rng.choice(len(OTHER_BLOCKS), 7, replace=False)
            for i in picks[:3]:
                text, n = fill(OTHER_BLOCKS[i])
                html, labels = html + text, labels + [0] * n
            body, own = "", []
            for i, form in enumerate(["<h1>{}</h1>", "<p>{}</p>", "<p><b>{}<br><p>{}", "<ul><li>{}</li></ul>", "<p>{} <a href=/>{}</a></p>", "<blockquote>{}</blockquote>", "<h2>{}</h2><p>{}</p>", "<pre>{}</pre>", "<table><tr><td>{}<td>{}</table>", "<p><a href=/>{}</a></p>", "<figure><figcaption>{}</figcaption></figure>"]):
                text, n = fill(form)
                n = 1 if i == 4 else n
                body, own = body + text, own + [1] * n
                if i == 2 + inside:
                    text, n = fill(OTHER_BLOCKS[picks[3]])
                    body, own = body + text, own + [0] * n
            html, labels = html + wrap.format(body), labels + own
            for i in picks[4:]:
                text, n = fill(OTHER_BLOCKS[i])
                html, labels = html + text, labels + [0] * n
            pages.append((html + "</body></html>", labels))
    return pages


@dataclass(slots=True)
class Crf:
    """Two labels (0 other, 1 main): weights of each feature for each label, and of each label after each."""

    weights: dict[str, tuple[float, float]]
    moves: np.ndarray

    def around(self, node: Node | None) -> tuple[float, float]:
        """Weights of the features that hold inside an element, kept at each element."""
        way = []
        while node and node.score is None:
            way.append(node)
            node = node.parent
        score = node.score if node else (0.0, 0.0)
        for x in reversed(way):
            found = [self.weights[f] for f in x.fresh if f in self.weights]
            x.score = score = (score[0] + sum(w[0] for w in found), score[1] + sum(w[1] for w in found))
        return score

    def scores(self, blocks: list[Block]) -> np.ndarray:
        seen: dict[tuple[str, ...], tuple[float, float]] = {}
        out = np.zeros((len(blocks), 2))
        for i, b in enumerate(blocks):
            key = own_features(b)
            if key not in seen:
                found = [self.weights[f] for f in key if f in self.weights]
                seen[key] = (sum(w[0] for w in found), sum(w[1] for w in found))
            (x, y), (u, v) = seen[key], self.around(b.node)
            out[i] = x + u, y + v
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not blocks:
            return []
        emit, back = self.scores(blocks).tolist(), []
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = emit[0]
        for x, y in emit[1:]:
            a0, a1, b0, b1 = a + m00, b + m10, a + m01, b + m11
            back.append((0 if a0 >= a1 else 1, 0 if b0 > b1 else 1))
            a, b = max(a0, a1) + x, max(b0, b1) + y
        labels = [0 if a > b else 1]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train_crf(pages: list[tuple[str, list[int]]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with a small quadratic penalty, by gradient steps; expectations by forward-backward."""
    data, names = [], {}
    for html, labels in pages:
        blocks = leaf_blocks(html)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks")
        data.append(([[names.setdefault(f, len(names)) for f in block_features(b)] for b in blocks], np.array(labels)))
    w, m = np.zeros((len(names), 2)), np.zeros((2, 2))
    g2w, g2m = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
    for _ in range(rounds):
        gw, gm = -decay * w * len(data), -decay * m * len(data)
        for features, labels in data:
            emit = np.array([w[f].sum(0) for f in features])
            n = len(emit)
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = emit[0]
            for t in range(1, n):
                alpha[t] = emit[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + m, 0)
            for t in range(n - 2, -1, -1):
                beta[t] = np.logaddexp.reduce(m + emit[t + 1] + beta[t + 1], 1)
            z = np.logaddexp.reduce(alpha[-1])
            want = np.eye(2)[labels] - np.exp(alpha + beta - z)
            for f, d in zip(features, want, strict=True):
                gw[f] += d
            for t in range(1, n):
                gm -= np.exp(alpha[t - 1][:, None] + m + emit[t] + beta[t] - z)
                gm[labels[t - 1], labels[t]] += 1
        g2w += gw**2
        g2m += gm**2
        w += rate * gw / np.sqrt(g2w)
        m += rate * gm / np.sqrt(g2m)
    return Crf({k: (float(w[i, 0]), float(w[i, 1])) for k, i in names.items()}, m)


@lru_cache(maxsize=1)
def default_crf() -> Crf:
    return train_crf(labelled_pages(), rounds=60)


def main_text(html: str, model: Crf) -> str:
    """Texts of the blocks labelled as main text. The content of scripts, styles and the like may be markup or
    code, and is none whatever its label."""
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, keep in zip(blocks, model.decode(blocks), strict=True) if keep and not (b.node and b.node.tag in RAW))


def extract_main_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html): the texts of the blocks that the
    model takes for main text, in page order, one a line.

    A null or empty html, and a page with no main text, give the empty text. Long pages are read whole.
    Repeated rows are each extracted; an empty table yields no rows.
    """
    fitted = model or default_crf()

    @F.pandas_udf("string")
    def text_of(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in htmls:
            yield pd.Series([main_text(h, fitted) for h in part], dtype=object)

    return pages.select("page_id", "url", text_of(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
