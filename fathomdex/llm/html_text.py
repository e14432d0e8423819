"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags. Each block has
features of its ancestors' tags, classes and roles and of its text; a two-label chain,
trained by maximum likelihood (forward-backward and Adam) on labelled pages, is decoded by
Viterbi, and the blocks labelled as content are the text. Besides names, features tell how
long a block and its neighbours are, how much of it is links, and how much of the page's
unlinked words its container holds, so that pages whose names say nothing are read too.

The labelled pages are made here: TRAIN_PAGES pages from a generator of common layouts with
made-up words, the label of each block known by construction; in a part of them neither
tags nor names tell content from the rest. Training takes a few seconds on the driver, is
the same every time, and doesn't depend on the input.

Pages are cut by one pass from left to right, in time that grows with their length. Quotes
count in a tag only after an equals sign; a tag with a quote that never closes ends at its
first `>`. An element that is skipped whole ends at its end tag; without one, scripts and
styles run to the page's end, and of the others (or of a self-closed one) only the tag goes.

Defined results: null or empty html, and pages without content, give empty text and 0.
Scripts, styles, templates, comments and the head never count. Character references are
decoded once. The whole page is read; nothing is cut off. Repeated rows give repeated rows;
an empty table gives none. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES = 700
STEPS = 120
PAGES_AT_ONCE = 128

_BLOCK = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "form fieldset legend label button select option blockquote pre figure figcaption address details summary hr dialog menu center".split()
)
_VOID = frozenset(("hr",))
#: Opening one of these ends an open one of the same kind.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("main article section nav aside header footer div h1 h2 h3 h4 h5 h6 ul ol dl table form fieldset blockquote pre figure address hr".split())
#: Elements that are skipped whole, and those that even run to the end of the page.
_RAW = frozenset("script style noscript template svg iframe object title textarea".split())
_TO_END = frozenset(("script", "style"))
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in _RAW}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tag: str
    names: tuple[str, ...]  # features of all ancestors
    linked: int  # characters inside links
    box: int = 0  # number of the element that holds the block's own


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...]
    number: int = 0


#: Elements of text, whose container is the element around them.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr ul ol dl tbody thead table blockquote pre figcaption".split())


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the `>` of the tag at this place is; the page's length if it has none."""
    k = at
    while (m := _STOP.search(page, k)) is not None:
        k = m.start()
        if page[k] == ">":
            return k
        before = k - 1
        while before > at and page[before].isspace():
            before -= 1
        if page[before] != "=":
            k += 1
        elif last[page[k]] > k:
            k = page.find(page[k], k + 1) + 1
        else:
            end = page.find(">", k)
            return len(page) if end < 0 else end
    return len(page)


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in order."""
    at, size = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'>"}
    endless: set[str] = set()  # skipped elements that have no end tag from here on
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        close = page.startswith("</", lt)
        name = _NAME.match(page, lt + 1 + close)
        if name is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif close or page.startswith(("<!", "<?"), lt):
                end = page.find("]]>", lt) + 2 if page.startswith("<![CDATA[", lt) else -1
                end = end if end > 1 else page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        if last[">"] < lt:
            return  # a tag that the page ends in
        end = _tag_end(page, name.end(), last)
        tag, attrs = name[0].lower(), page[name.end() : end]
        at = end + 1
        if close:
            yield "close", tag, ""
            continue
        if tag in _RAW:
            found = None if tag in endless or tag == "svg" and attrs.endswith("/") else _RAW_END[tag].search(page, at)
            if found:
                at = found.end()
            elif not attrs.endswith("/"):
                endless.add(tag)
                if tag in _TO_END:
                    return
            continue
        yield "open", tag, attrs


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, without empty ones."""
    out: list[Block] = []
    stack: list[_Open] = [_Open("", ())]
    parts: list[str] = []
    linked, in_link, hidden_head, boxes = 0, False, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                held = next((x for x in reversed(stack) if x.tag not in _TEXTUAL), stack[0])
                out.append(Block(text, stack[-1].tag, stack[-1].names, linked, held.number))
            parts.clear()
        linked = 0

    for kind, tag, attrs in _pieces(page):
        if kind == "text":
            if not hidden_head:
                parts.append(tag)
                linked += len(tag) if in_link else 0
            continue
        opens = kind == "open"
        if tag == "head":
            hidden_head = opens
        elif tag == "body":
            hidden_head = False
        if tag == "a":
            in_link = opens
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCK:
            flush()
            if not opens:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                continue
            closes = _CLOSES.get(tag, ("p",) if tag in _ENDS_P else ())
            if stack[-1].tag in closes:
                stack.pop()
                if tag == "tr" and stack[-1].tag == "tr":
                    stack.pop()
            if tag not in _VOID:
                boxes += 1
                stack.append(_Open(tag, tuple(dict.fromkeys(stack[-1].names + _names(tag, attrs))), boxes))
    flush()
    return out


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    if not attrs.strip():
        return (f"in:{tag}",)
    out = [f"in:{tag}"]
    for name, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "").lower()
        if name.lower() in ("hidden", "aria-hidden") and value != "false" or "display:none" in value.replace(" ", ""):
            out.append("hidden")
        elif name.lower() in ("class", "id", "role"):
            out += [f"name:{w}" for w in _WORD.findall(value)]
    return tuple(out)


_STARTS = re.compile(r"(©|\(c\)|copyright|all rights|share|subscribe|sign up|log in|read more|advertis|we use cookies|related|comments?\b|reply|posted|menu|search)", re.IGNORECASE)


def _length(words: int) -> int:
    return min(words, 64).bit_length()


def features(found: list[Block]) -> list[list[str]]:
    rows = []
    words = [b.text.count(" ") + 1 for b in found]
    links = [min(4, 4 * b.linked // max(1, len(b.text))) for b in found]
    held: dict[int, int] = {}
    for b, n, x in zip(found, words, links, strict=True):
        held[b.box] = held.get(b.box, 0) + (n if x < 2 else 0)
    every, most = max(1, sum(held.values())), max(held.values(), default=0)
    main = any("in:article" in b.names or "in:main" in b.names for b in found)
    for k, (b, n) in enumerate(zip(found, words, strict=True)):
        f = ["bias", f"tag:{b.tag}", f"words:{_length(n)}", f"links:{links[k]}"]
        f += b.names
        f.append(f"stop:{b.text[-1] in '.!?…:;'}")
        if n < 12 and (m := _STARTS.match(b.text)):
            f.append(f"starts:{m[1].lower()}")
        f.append(f"at:{'first' if k == 0 else 'last' if k == len(found) - 1 else 'inside'}")
        f.append(f"share:{min(4, 5 * held[b.box] // every)}:{held[b.box] == most}:{main}")
        f.append(f"length:{_length(n)}:{min(links[k], 2)}:{main}")
        for name, j in (("before", k - 1), ("after", k + 1)):
            f.append(f"{name}:{_length(words[j]) // 2}:{min(links[j], 2)}:{found[j].box == b.box}" if 0 <= j < len(found) else f"{name}:none")
        rows.append(f)
    return rows


# the labelled pages

_CONTENT_NAMES = ("content", "post", "entry-content", "article-body", "story", "post-content", "main-content", "article")
_SIDE_NAMES = {
    "nav": ("nav", "menu", "navbar", "main-menu", "breadcrumbs", "breadcrumb", "pagination", "topbar"),
    "header": ("header", "masthead", "site-header", "top", "banner", "logo"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal"),
    "aside": ("sidebar", "aside", "related", "widget", "recommended", "share", "social", "tags"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"),
    "notice": ("cookie", "cookie-notice", "notice", "consent", "popup", "modal", "alert", "gdpr", "newsletter"),
    "form": ("search", "login", "subscribe", "signup", "contact-form"),
    "comments": ("comments", "comment", "comment-list", "respond", "discussion", "replies", "disqus"),
}


class _Maker:
    """Pages in which a NUL before a text marks it as content."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain = self.r.random() < 0.3  # neither tags nor names tell content from the rest

    def words(self, least: int, most: int) -> str:
        r = self.r
        word = lambda: "".join(r.choice(("an", "er", "lo", "mi", "tu", "re", "sa", "ne", "ko", "vi", "de", "ou")) for _ in range(r.randint(1, 4)))
        return " ".join(word() for _ in range(r.randint(least, most)))

    def sentence(self, most: int = 14) -> str:
        return self.words(1, most).capitalize() + self.r.choice((".", ".", ".", "!", "?"))

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def links(self, least: int = 2, most: int = 8) -> str:
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(self.r.randint(least, most))]
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice((" ", " | ", "")).join(items)

    def box(self, kind: str, inner: str) -> str:
        r = self.r
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind)
        name = r.choice(_SIDE_NAMES[kind])
        if self.plain and r.random() < 0.5 and kind in ("nav", "header", "footer", "aside"):
            inner = inner if kind == "footer" and "&copy;" in inner or "<a " in inner else self.links()
            return f'<div class="{self.code()}">{inner}</div>'
        if semantic and r.random() < 0.5 and kind != "comments":
            return f"<{semantic}>{inner}</{semantic}>" if r.random() < 0.6 else f'<{semantic} class="{name}">{inner}</{semantic}>'
        tag = r.choice(("div", "div", "section", semantic or "div"))
        return f'<{tag} {r.choice(("class", "id"))}="{name}">{inner}</{tag}>'

    def side(self, kind: str, blank: bool = True) -> str:
        """blank: whether the names of a plain page may say nothing about it."""
        plain = self.plain
        self.plain = plain and blank
        out = self._side(kind)
        self.plain = plain
        return out

    def _side(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.box(kind, self.links() if r.random() < 0.9 else self.words(1, 5))
        if kind == "header":
            return self.box(kind, r.choice((self.words(1, 4), f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.sentence()}</p>", f'<a href="/">{self.words(1, 2)}</a>' + self.links())))
        if kind == "footer":
            return self.box(kind, r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"<p>&copy; {self.words(1, 4)}</p>" + self.links(), f"<p>{self.prose(2)}</p>")))
        if kind == "aside":
            return self.box(kind, f"<h3>{self.words(1, 4)}</h3>" * r.randint(0, 1) + r.choice((self.links(), f"<p>{self.prose(3)}</p>", self.prose(2))))
        if kind == "ad":
            return self.box(kind, r.choice((self.prose(3), f"<p>{self.prose(3)}</p>", f'<a href="/x">{self.words(2, 8)}</a>')))
        if kind == "notice":
            return self.box(kind, f"<p>{self.prose(3)}</p><button>{self.words(1, 2)}</button>" if r.random() < 0.6 else self.prose(2))
        if kind == "form":
            return f'<form action="/f"><label>{self.words(1, 3)}</label><p>{self.prose(2)}</p><button>{self.words(1, 2)}</button></form>' if r.random() < 0.6 else self.box(kind, f"<label>{self.words(1, 3)}</label><button>{self.words(1, 2)}</button>")
        each = "".join(r.choice((f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.prose(4)}</p></div>', f"<li><p>{self.prose(4)}</p></li>", f"<p>{self.prose(4)}</p>", f'<article class="comment"><p>{self.prose(3)}</p></article>')) for _ in range(r.randint(1, 5)))
        return self.box(kind, f"<h3>{self.words(1, 3)}</h3>" * r.randint(0, 1) + each)

    def content(self) -> str:
        r = self.r
        out = [f"<h1>\0{self.words(1, 9).capitalize()}</h1>"] if r.random() < 0.85 else []
        if not self.plain and r.random() < 0.2:  # next to nothing
            out = out[: r.randint(0, 1)] + [f"<p>\0{self.words(1, 3).capitalize()}.</p>" for _ in range(r.randint(1, 2))]
        for _ in range(r.randint(1, 14) if len(out) < 2 and not (out and "<p>" in out[0]) else 0):
            x = r.random()
            if x < 0.7:
                out.append(r.choice((f"<p>\0{self.prose()}</p>", f"<p>\0{self.prose()}", f"<p><b>\0{self.prose()}<br>", f"<div>\0{self.prose()}</div>")))
            elif x < 0.8:
                out.append(f"<h{r.randint(2, 4)}>\0{self.words(1, 7)}</h2>")
            elif x < 0.9:
                out.append("<ul>" + "".join(f"<li>\0{self.words(1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.95:
                out.append(f"<blockquote><p>\0{self.prose(3)}</p></blockquote>")
            else:
                out.append(f"<table><tr><td>\0{self.words(1, 4)}</td><td>\0{self.words(1, 4)}</td></tr></table>")
            if r.random() < 0.06:
                out.append(self.side(r.choice(("ad", "aside", "notice", "form"))))
        if self.plain:
            name = r.choice(("", "", ' class="{}"', ' id="{}"')).format(self.code())
            return r.choice((f"<div{name}>{''.join(out)}</div>", f"<div><div{name}>{''.join(out)}</div></div>", "".join(out), f"<section{name}>{''.join(out)}</section>"))
        tag = r.choice(("article", "article", "article", "main", "div"))
        name = f' class="{r.choice(_CONTENT_NAMES)}"' if tag == "div" or r.random() < 0.3 else ""
        if tag == "article" and out[:1] and out[0].startswith("<h1>") and r.random() < 0.1:
            out[0] = f"<header>{out[0]}</header>"
        return f"<{tag}{name}>{''.join(out)}</{tag}>"

    def code(self) -> str:
        """A name that says nothing."""
        return f"{self.r.choice('abcdxqz')}{self.r.randint(0, 99)}"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.08:  # no content at all
            kinds = r.sample(("nav", "header", "footer", "form", "notice", "comments", "aside", "ad"), r.randint(1, 3))
            return f"<html><body>{''.join(self.side(k, False) for k in kinds)}</body></html>"
        if self.plain and r.random() < 0.3:  # a bare text or bare paragraphs
            text = r.choice((f"\0{self.prose(9)}", "".join(f"<p>\0{self.prose()}</p>" for _ in range(r.randint(1, 6))), f"<h1>\0{self.words(1, 6)}</h1>" + "".join(f"<p>\0{self.prose()}" for _ in range(r.randint(1, 6)))))
            return r.choice((text, f"<html><body>{text}</body></html>", f"<div>{text}</div>"))
        before = [self.side(k) for k in ("notice", "header", "nav", "ad", "aside", "form") if r.random() < 0.45]
        after = [self.side(k) for k in ("form", "comments", "aside", "ad", "nav", "notice") if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        wrap = f'<div class="{r.choice(("wrapper", "page", "container", "site"))}">' if r.random() < 0.3 else ""
        end = self.side("footer") if r.random() < 0.85 else ""
        return f"<html><head><title>x</title></head><body>{wrap}{''.join(before)}{self.content()}{''.join(after)}{end}</body></html>"


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 7) -> list[tuple[list[Block], np.ndarray]]:
    out = []
    for k in range(n):
        found = blocks(_Maker(seed * 100_003 + k).page())
        label = np.array([b.text.startswith(("\0", "�")) for b in found], dtype=np.int64)
        for b in found:
            b.text = b.text.lstrip("\0�") or "x"
        out.append((found, label))
    return out


# the chain

@dataclass
class Model:
    index: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, pages: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (page, block, label), padded, and the number of blocks of each page."""
        n = np.array([len(p) for p in pages])
        e = np.zeros((len(pages), int(n.max(initial=0)), 2))
        known = self.index.get
        for i, p in enumerate(pages):
            for t, f in enumerate(p):
                e[i, t] = self.weight[[k for x in f if (k := known(x)) is not None]].sum(axis=0)
        return e, n


def _forward_backward(e: np.ndarray, n: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and summed marginals of neighbouring labels."""
    pages, length, _ = e.shape
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0]
    for t in range(1, length):
        a[:, t] = e[:, t] + np.logaddexp.reduce(a[:, t - 1, :, None] + step, axis=1)
    for t in range(length - 2, -1, -1):
        inside = (t + 1 < n)[:, None]
        b[:, t] = np.where(inside, np.logaddexp.reduce(step + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2), 0.0)
    z = np.logaddexp.reduce(a[np.arange(pages), n - 1], axis=1)
    live = np.arange(length) < n[:, None]
    single = np.exp(a + b - z[:, None, None]) * live[:, :, None]
    pair = np.exp(a[:, :-1, :, None] + step + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
    return single, pair.sum(axis=(0, 1))


def fit(pages: list[tuple[list[Block], np.ndarray]], steps: int = STEPS, penalty: float = 0.02) -> Model:
    pages = [(features(b), y) for b, y in pages if len(b)]
    index = {x: k for k, x in enumerate(sorted({x for p, _ in pages for f in p for x in f}))}
    model = Model(index, np.zeros((len(index), 2)))
    n = np.array([len(y) for _, y in pages])
    length = int(n.max())
    rows, cols = [], []
    truth = np.zeros((len(pages), length, 2))
    pair_truth = np.zeros((2, 2))
    for i, (p, y) in enumerate(pages):
        truth[i, np.arange(len(y)), y] = 1.0
        np.add.at(pair_truth, (y[:-1], y[1:]), 1.0)
        for t, f in enumerate(p):
            rows += [i * length + t] * len(f)
            cols += [index[x] for x in f]
    rows, cols = np.array(rows), np.array(cols)
    size = len(pages)
    m = [np.zeros_like(model.weight), np.zeros_like(model.step)]
    v = [np.zeros_like(model.weight), np.zeros_like(model.step)]
    for k in range(1, steps + 1):
        e = np.zeros((size * length, 2))
        for y in (0, 1):
            e[:, y] = np.bincount(rows, model.weight[cols, y], minlength=size * length)
        single, pair = _forward_backward(e.reshape(size, length, 2), n, model.step)
        off = (truth - single).reshape(-1, 2)
        grad = np.stack([np.bincount(cols, off[rows, y], minlength=len(index)) for y in (0, 1)], axis=1)
        for j, (x, g) in enumerate(((model.weight, grad / size - penalty * model.weight / 10), (model.step, (pair_truth - pair) / size))):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            x += 0.15 * (m[j] / (1 - 0.9**k)) / (np.sqrt(v[j] / (1 - 0.99**k)) + 1e-8)
    return model


def viterbi(e: np.ndarray, n: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labels of each page; what lies beyond a page's end is to be ignored."""
    pages, length, _ = e.shape
    best, back = e[:, 0].copy(), np.zeros((pages, length, 2), dtype=np.int8)
    end = best.copy()
    for t in range(1, length):
        way = best[:, :, None] + step
        back[:, t] = way.argmax(axis=1)
        best = way.max(axis=1) + e[:, t]
        end[t < n] = best[t < n]
    label = np.zeros((pages, length), dtype=np.int8)
    now = end.argmax(axis=1)
    each = np.arange(pages)
    for t in range(length - 1, -1, -1):
        label[:, t] = np.where(t < n, now, 0)
        now = np.where((t < n), back[each, t, now], now) if t else now
    return label


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages())


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    out: list[str] = []
    for k in range(0, len(pages), PAGES_AT_ONCE):
        cut = [blocks(p) if p else [] for p in pages[k : k + PAGES_AT_ONCE]]
        e, n = model.emissions([features(b) for b in cut])
        label = viterbi(e, n, model.step) if e.shape[1] else np.zeros((len(cut), 0))
        out += [" ".join(b.text for b, y in zip(found, label[i], strict=False) if y) for i, found in enumerate(cut)]
    return out


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """pages without html, with text and n_chars; columns of these names are replaced."""
    model = model or default_model()
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{html_col}`").alias(f"html of {'_'.join(rest)}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = main_texts(list(batch.iloc[:, -1]), model)
            yield batch.iloc[:, :-1].assign(text=texts, n_chars=np.array([len(t) for t in texts], dtype=np.int64))

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInPandas(run, f"{kinds}text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
