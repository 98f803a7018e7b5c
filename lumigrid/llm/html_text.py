"""Main-text extraction from HTML by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: stretches of visible text between block-level tags, with the tags and class
words of their ancestors. Each block gets a label, main text or other, from features of its ancestors and its
text and of its neighbour's label, by Viterbi. Markup, comments, scripts and styles are never text.

The field is trained on labelled pages: `labelled_pages` builds them from varied templates (articles, menus,
headers, footers, sidebars, notices, adverts, forms, reader comments) with invented words, so that no word of
a page is a feature; own labelled pages can be given instead.

What an element's ancestors say is carried from tag to tag and summed once an element, so a page costs in
proportion to its length, however deep its tags lie.

Elements whose content a browser does not show as text (scripts, styles, templates, frames, fields of forms, and
`noscript`, which is for browsers without scripts) have no blocks; all others have, and the field decides on them.

Edge cases: null and empty pages have an empty text; very long and deeply nested pages are one row each; unclosed
and stray tags are read as browsers do in the usual cases; a page cut off in a tag loses that tag only; of
labellings of equal score (ties) other text is preferred; repeated rows get equal rows; an empty table gives an
empty result; the columns named in `keep` are kept, with null ids, and other columns are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/!?])[^>]*\Z|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements by their role in the HTML standard.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "select"}
#: Those whose content is text up to their end tag, whatever it holds.
UNPARSED = {"script", "style", "noscript", "textarea", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br"}
CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "nav", "header", "footer", "form", "blockquote", "pre", "main", "figure", "fieldset", "hr", "address"}
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"\bhidden\b|display:\s*none", re.I)
WORD = re.compile(r"[a-z]+")
#: Attribute of the main elements of labelled pages; no feature.
MARK = "data-main"
MAIN, OTHER = 1, 0


@dataclass(slots=True, eq=False)
class Node:
    """An element that blocks lie in: its tag, and the features that it adds to those of its ancestors."""

    parent: Node | None
    tag: str
    fresh: tuple[str, ...]
    in_article: bool
    marked: bool  #: has the attribute of labelled pages


@dataclass
class Block:
    """A leaf block: its text, the element that it lies in, and its link text."""

    text: str
    node: Node | None
    linked: int


def _classes(attributes: str) -> str:
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    words = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    hidden = " hidden" * bool(HIDDEN.search(attributes))
    return (words + hidden).lower().strip()


class _Stack:
    """The open elements, with the places of each tag and the features that are in force."""

    def __init__(self):
        self.open: list[tuple[str, Node | None, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  #: places of the elements that are not inline
        self.force: dict[str, int] = {}
        self.links = 0

    def node(self) -> Node | None:
        return self.open[-1][1] if self.open else None

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, attributes: str) -> None:
        parent, own = self.node(), ()
        node = parent
        if tag not in INLINE or tag == "label":
            own = tuple(dict.fromkeys([f"in={tag}", *(f"class={w}" for w in WORD.findall(_classes(attributes)))]))
            fresh = tuple(f for f in own if not self.force.get(f))
            for f in own:
                self.force[f] = self.force.get(f, 0) + 1
            node = Node(parent, tag, fresh, tag in ("article", "main") or (parent is not None and parent.in_article), MARK in attributes)
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node, own))
        self.links += tag == "a"

    def close(self, place: int) -> None:
        """Close the element at a place and all within it; none for a negative place."""
        while 0 <= place < len(self.open):
            tag, _, own = self.open.pop()
            self.places[tag].pop()
            for f in own:
                self.force[f] -= 1
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            self.links -= tag == "a"


@lru_cache(64)
def _raw_marks(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])" + rf"|<!--|-->|<{name}(?=[\s/>])" * (name == "script"), re.I)


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the end tag of the unparsed element whose content starts at `at` begins; the page's length if it has none.

    In a script, the end tag of a script that a comment opens is content.
    """
    first, state = None, 0  # outside a comment, in one, in a script in one
    while m := _raw_marks(name).search(page, at):
        at, mark = m.end(), m[0].lower()
        if mark == "<!--":
            if not state:
                state, at = 1, m.start() + 2  # its dashes may end it
        elif mark == "-->":
            state = 0
        elif mark[1] != "/":
            state = 2 if state else 0
        elif state < 2:
            return m.start()
        else:
            first, state = m.start() if first is None else first, 1
    return len(page) if first is None else first


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    page = page or ""
    at = 0
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = 0
    skip = None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, stack.node(), min(linked, len(text))))
            parts.clear()
        linked = 0

    while m := TOKEN.match(page, at):
        at, whole, name = m.end(), m[0], m[2]
        if name is None:
            if not skip and not (whole[0] == "<" and len(whole) > 1):
                parts.append(whole)
                linked += len(whole) * (stack.links > 0)
            continue
        name = name.lower()
        if name in UNPARSED and not m[1] and not m[3].endswith("/"):
            at = _raw_end(page, name, at)
        if skip:
            if m[1] and name == skip:
                skip = None
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            stack.close(stack.last(name))
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                flush()
                skip = name
            continue
        if name in CLOSES_P and stack.blocks and stack.open[stack.blocks[-1]][0] == "p":
            # An open inline element goes on in the next paragraph; here it needs no place.
            stack.close(stack.blocks[-1])
        if name in VOID:
            continue
        if name in ENDS:
            closing, within = ENDS[name]
            place = stack.last(*closing.split())
            # The outermost of those that end together, as a cell ends before its row.
            if place > (limit := stack.last(*within)):
                stack.close(min(p for t in closing.split() if stack.places.get(t) and (p := stack.places[t][-1]) > limit))
        stack.push(name, m[3])
    flush()
    return out


SIGNS = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|sign in|log in|share|privacy|advert|sponsored|newsletter|related|comment|repl(?:y|ies)|read more|tags?:|posted by", re.I)


def features(block: Block, number: int, count: int) -> list[str]:
    """Feature names of a block, without its words."""
    return [*_path_features(block.node), *_own_features(block, number, count)]


def _path_features(node: Node | None) -> list[str]:
    """Features of a block's ancestors: which tags it lies in, and their class words."""
    out: list[str] = []
    while node is not None:
        out += node.fresh
        node = node.parent
    return out


def _own_features(block: Block, number: int, count: int) -> list[str]:
    """The other features: tags near by, whether it lies in an article, and what its text is like."""
    text, node = block.text, block.node
    words = text.count(" ") + 1
    out = [f"up{depth}={n.tag}" for depth, n in enumerate((node, node and node.parent)) if n is not None]
    if node is None or not node.in_article:
        out.append("no article")
    out += [f"words={min(7, int(math.log2(words)))}", f"links={min(4, int(4 * block.linked / len(text)))}", f"stop={text[-1] in '.!?…'}", f"marks={min(3, text.count(',') + text.count('.'))}"]
    # Each sign once, so that a long text does not gather many.
    out += [f"sign={m}" for m in dict.fromkeys(m.lower() for m in SIGNS.findall(text))]
    if number == 0:
        out.append("first")
    if number == count - 1:
        out.append("last")
    out.append("bias")
    return out


@dataclass
class Field:
    """Weights (other, main) of the features, and of the transitions between labels."""

    weights: dict[str, tuple[float, float]]
    transition: list[list[float]]

    def _of_node(self, node: Node | None, sums: dict[int, tuple[float, float]]) -> tuple[float, float]:
        """Weights of an element and its ancestors; `sums` has those of the elements seen."""
        chain = []
        while node is not None and id(node) not in sums:
            chain.append(node)
            node = node.parent
        e0, e1 = (0.0, 0.0) if node is None else sums[id(node)]
        for n in reversed(chain):
            for name in n.fresh:
                if w := self.weights.get(name):
                    e0 += w[0]
                    e1 += w[1]
            sums[id(n)] = e0, e1
        return e0, e1

    def labels(self, blocks: list[Block]) -> list[int]:
        """The best labelling, by Viterbi."""
        back: list[tuple[int, int]] = []
        score = (0.0, 0.0)
        (oo, om), (mo, mm) = self.transition
        sums: dict[int, tuple[float, float]] = {}
        for k, block in enumerate(blocks):
            e0, e1 = self._of_node(block.node, sums)
            for name in _own_features(block, k, len(blocks)):
                if w := self.weights.get(name):
                    e0 += w[0]
                    e1 += w[1]
            if k:
                from0 = 0 if score[0] + oo >= score[1] + mo else 1
                from1 = 0 if score[0] + om >= score[1] + mm else 1
                back.append((from0, from1))
                score = (e0 + (score[1] + mo if from0 else score[0] + oo), e1 + (score[1] + mm if from1 else score[0] + om))
            else:
                score = (e0, e1)
        if not blocks:
            return []
        label = int(score[1] > score[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def labelled_pages(count: int = 500, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages from varied templates. Main text is marked by the attribute data-main, which is no feature."""
    random = np.random.RandomState(seed)
    spelling = Random(seed)

    def word() -> str:
        return "".join(spelling.choices("aeioustrnlmdé", k=spelling.randint(1, 9)))

    def text(n: int) -> str:
        out = " ".join(word() for _ in range(n))
        style = random.rand()
        if style < 0.15:
            out = out.upper().replace(" ", "!! ")
        elif style < 0.25:
            out = out.replace(" ", random.choice(["*** ", " | ", "### "]))
        if random.rand() < 0.75:
            out = out[:1].upper() + out[1:] + "."
        return out

    def size() -> int:
        return int(2 ** (random.rand() * 7)) + 1

    pick = lambda *xs: xs[random.randint(len(xs))]
    link = lambda n=2: f'<a href="/{word()}">{text(random.randint(1, n + 1))}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(random.randint(3, 8))) + "</ul>"

    def boilerplate() -> str:
        kind = random.randint(12)
        if kind == 0:
            return f"<nav{pick('', ' class=menu', ' id=topnav')}>{menu()}</nav>"
        if kind == 1:
            return f"<header{pick('', ' class=site-header')}><{pick('div', 'p', 'h1', 'span')}>{text(random.randint(1, 6))}</div>{pick('', menu())}</header>"
        if kind == 2:
            return f"<footer>{pick('&copy; ', '')}{text(size())}{pick('', ' &middot; ' + text(size()))}</footer>"
        if kind == 3:
            return f"<aside{pick('', ' class=sidebar')}>{pick('<h3>' + text(2) + '</h3>', '')}{pick(menu(), '<p>' + text(size()) + '</p>')}</aside>"
        if kind == 4:
            return f'<div class="{pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot")}">{pick("<p>", "")}{text(size())}</div>'
        if kind == 5:
            return f'<div class="{pick("cookie-notice", "cookie-banner", "notice", "consent", "popup", "modal", "newsletter", "alert", "gdpr")}">{pick("<p>", "")}{text(size())} <button>{text(1)}</button></div>'
        if kind == 6:
            return f"<form{pick('', ' class=search', ' class=login')}><label>{text(2)}</label><input name=q>{pick('', '<p>' + text(size()) + '</p>')}<button>{text(1)}</button></form>"
        if kind == 7:
            comments = "".join(f'<{pick("div", "li", "article")} class="comment"><{pick("p", "div")}>{text(size())}</p></{"div"}>' for _ in range(random.randint(1, 5)))
            return f'<{pick("section", "div")} {pick("class", "id")}="{pick("comments", "comment-list", "reader-comments", "responses", "discussion")}"><h3>{text(2)}</h3>{comments}</section></div>'
        if kind == 8:
            return f'<div class="{pick("related", "recommended", "share", "social", "breadcrumb", "breadcrumbs", "tags", "meta", "pagination", "author-bio", "sidebar", "widget", "menu", "topbar", "toolbar")}">{pick(menu(), link() + " " + link(), "<p>" + text(size()) + "</p>")}</div>'
        if kind == 9:
            return f"<script>var {word()} = '</p>';</script><style>p{{}}</style>"
        if kind == 10:
            return f'<div {pick("class", "id")}="{pick("header", "footer", "navbar", "nav", "navigation", "sidebar", "site-footer", "page-header")}">{pick(menu(), text(size()), "<p>" + text(size()) + "</p>")}</div>'
        return f"<!-- {word()} --><p class={pick('copyright', 'legal', 'disclaimer', 'footer-note')}>{text(size())}</p>"

    def piece() -> str:
        kind = random.randint(14)
        if kind == 0:
            return f"<{(h := pick('h2', 'h3', 'h4'))} data-main>{text(random.randint(1, 8))}</{h}>"
        if kind == 1:
            return "<ul>" + "".join(f"<li data-main>{text(size())}</li>" for _ in range(random.randint(2, 5))) + "</ul>"
        if kind == 2:
            return f"<blockquote data-main>{pick('<p>', '')}{text(size())}</blockquote>"
        if kind == 3:
            return f"<pre data-main>{text(size())}</pre>"
        if kind == 4:
            return f"<table><tr><td data-main>{text(2)}</td><td data-main>{text(3)}</td></tr></table>"
        if kind == 5:
            return f"<figure><img src=x><figcaption data-main>{text(size())}</figcaption></figure>"
        return f"<p data-main>{pick('', '<b>')}{text(size())}{pick('', ' ' + link(), '<br>' + text(size()))}{pick('</p>', '</p>', '')}"

    pages = []
    for _ in range(count):
        article = pick("<h1 data-main>" + text(random.randint(2, 9)) + "</h1>", "") + "".join(piece() + (boilerplate() if random.rand() < 0.08 else "") for _ in range(random.randint(1, 12)))
        shell = random.randint(6)
        kind = pick("content", "post", "entry-content", "article-body", "story", "main-content", "post-content", "article")
        if shell <= 2:
            article = f"<article{pick('', f' class={kind}')}>{article}</article>"
        elif shell == 3:
            article = f"<main>{pick('', '<article>')}{article}{pick('', '</article>')}</main>"
        elif shell == 4:
            article = f'<div {pick("class", "id")}="{kind}">{article}</div>'
        else:
            article = f"<section class={kind}>{article}</section>"
        before, after = ("".join(boilerplate() for _ in range(random.randint(0, 5))) for _ in range(2))
        page = f"<!DOCTYPE html><html><head><title data-head>{text(4)}</title></head><body>{pick('', '<div class=wrapper>')}{before}{article}{after}</body></html>"
        pages.append(_marked(page))
    return pages


def _marked(page: str) -> tuple[list[Block], list[int]]:
    """Blocks and labels of a page whose main elements carry the mark."""
    blocks = leaf_blocks(page)
    labels = []
    for b in blocks:
        # Boilerplate that an unclosed main element holds is still boilerplate.
        node = b.node
        while node is not None and not node.marked and node.tag in ("p", "label"):
            node = node.parent
        labels.append(MAIN if node is not None and node.marked else OTHER)
    return blocks, labels


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 80) -> Field:
    """A field of labelled pages: Adam on the conditional likelihood of the whole sequence of blocks."""
    names: dict[str, int] = {}
    codes, owner, y, first = [], [], [], []
    for blocks, labels in pages:
        for k, block in enumerate(blocks):
            first.append(k == 0)
            for name in features(block, k, len(blocks)):
                codes.append(names.setdefault(name, len(names)))
                owner.append(len(y))
            y.append(labels[k])
    n = len(y)
    if not n:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]])
    code, own, label, head = np.array(codes), np.array(owner), np.array(y), np.array(first)
    w, tr = np.zeros((len(names), 2)), np.zeros((2, 2))
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in (w, tr)]
    onehot = np.eye(2)[label]
    for step in range(1, rounds + 1):
        e = np.stack([np.bincount(own, w[code, k], n) for k in (0, 1)], axis=1)
        psi, go = np.exp(e - e.max(axis=1, keepdims=True)), np.exp(tr)
        alpha, beta = np.empty((n, 2)), np.ones((n, 2))
        for t in range(n):
            now = psi[t] if head[t] else (alpha[t - 1] @ go) * psi[t]
            alpha[t] = now / now.sum()
        for t in range(n - 2, -1, -1):
            if not head[t + 1]:
                now = go @ (psi[t + 1] * beta[t + 1])
                beta[t] = now / now.sum()
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        inner = np.flatnonzero(~head)
        joint = alpha[inner - 1][:, :, None] * go * (beta[inner] * psi[inner])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[inner - 1], label[inner]), 1)
        delta = (onehot - gamma) / len(pages)
        grads = [np.stack([np.bincount(code, delta[own, k], len(names)) for k in (0, 1)], axis=1) - 1e-3 * w, (seen - joint.sum(axis=0)) / len(pages) - 1e-3 * tr]
        for t, g, (m, v) in zip((w, tr), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            t += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Field({name: (float(w[i, 0]), float(w[i, 1])) for name, i in names.items()}, tr.tolist())


@lru_cache(1)
def default_field() -> Field:
    """The field of the generated pages, trained once a process."""
    return train(labelled_pages())


def main_text(page: str | None, field: Field) -> str:
    """The main text of a page: its main blocks joined by line ends."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, field.labels(blocks), strict=True) if label == MAIN)


def extract(pages: DataFrame, field: Field | None = None, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the kept columns, text, n_chars and n_blocks (of main text)."""
    spark = pages.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(field or default_field())
    own = pages.select(*[F.col(k) for k in keep], F.col(html_col).cast("string").alias("_html"))
    ddl = ", ".join(f"`{k}` {t}" for k, t in own.dtypes[:-1]) + ", text string, n_chars bigint, n_blocks bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            texts, counts = [], []
            for page in batch.column(len(keep)):
                blocks = leaf_blocks(page.as_py())
                main = [b.text for b, label in zip(blocks, model.labels(blocks), strict=True) if label == MAIN]
                texts.append("\n".join(main))
                counts.append(len(main))
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars", "n_blocks"])

    return own.mapInArrow(work, ddl)
