"""Main-text extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each with its tag path, class and id words and text. A bidirectional
LSTM in numpy reads the blocks' hashed vectors in page order and labels each main text or not, with the whole page as
context. It is trained here on pages made by a seeded generator, so no labelled pages are needed.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, mix64, prefix_hash, span_hash, utf8

#: A quote opens a value only right after an equals sign; elsewhere it is part of a name, as browsers read it.
VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|{VALUE})*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements whose content is no markup (it ends at the first closing tag, or with the page), of
#: which these two hold no text and a title none of the page's body; elements without content; elements inside a line.
RAW = frozenset("script style title textarea".split())
#: Fixed values of HTML: elements that show something else in place of their content, or nothing.
HIDDEN = frozenset("noscript template iframe svg object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded semantics".split())
#: Controls of forms hold no text of the page, wherever they stand.
CONTROLS = frozenset("button select option optgroup datalist".split())
#: Parts that are never main text, unless one holds a title or an article and so is the wrapper of a whole page.
PARTS = frozenset("form nav footer".split())
WRAPPED = frozenset("article main h1".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSABLE = CLOSED_BY_BLOCK.union(*SAME_KIND.values())
SCOPE = frozenset("ul ol dl table body div article section main aside nav".split())

PATH_DIM, WORD_DIM, PLAIN = 64, 32, 9
INPUT = PATH_DIM + WORD_DIM + PLAIN


class Element:
    """An open block element: what its path adds up to, the inline elements open directly in it, and the part of the page
    that it belongs to (a list holding whether that part wraps the page)."""

    __slots__ = ("inline", "name", "parent", "part", "vector", "words")

    def __init__(self, name: str, words: list[str], parent: Element | None, vector: np.ndarray, part: list[bool] | None):
        self.name, self.words, self.parent, self.vector, self.part, self.inline = name, words, parent, vector, part, {}


@dataclass
class Block:
    inside: Element
    text: str
    linked: int  # characters inside links


def _closings(page: str) -> dict[int, int]:
    """Where the hidden elements that are closed end, by the end of their opening tag."""
    out, open_, at = {}, {}, 0
    while m := TOKEN.search(page, at):
        at = m.end()
        name = (m[1] or "").lower()
        if name in RAW and page[m.start() + 1] != "/":
            at = _raw_end(page, name, at)
        elif name in HIDDEN and page[m.start() + 1] == "/":
            if open_.get(name):
                out[open_[name].pop()] = at
        elif name in HIDDEN and not m[2].rstrip().endswith("/"):
            open_.setdefault(name, []).append(at)
    return out


def _raw_end(page: str, name: str, at: int) -> int:
    close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    return close.end() if close else len(page)


class _Reader:
    """The open elements of a page. Every tag costs constant time but for the elements that it closes: names and words
    are counted, not searched for, and a path is the sum that its parent shares with it."""

    def __init__(self) -> None:
        self.stack = [Element("", [], None, np.zeros(PATH_DIM), None)]
        self.names: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.scopes: list[dict[str, list[int]]] = [{}]
        self.links = self.controls = 0

    def open(self, name: str, words: list[str]) -> None:
        parent = self.stack[-1]
        fresh = [w for w in dict.fromkeys(words) if not self.words.get(w)]
        vector = parent.vector
        if fresh:
            vector = vector.copy()
            for w in fresh:
                i, sign = _slot("path " + w, PATH_DIM)
                vector[i] += sign
        part = [False] if name in PARTS and parent.part is None else parent.part
        if part and name in WRAPPED:
            part[0] = True
        for w in words:
            self.words[w] = self.words.get(w, 0) + 1
        self.names[name] = self.names.get(name, 0) + 1
        if name in SCOPE:
            self.scopes.append({})
        elif name in CLOSABLE:
            self.scopes[-1].setdefault(name, []).append(len(self.stack))
        self.controls += name in CONTROLS
        self.stack.append(Element(name, words, parent, vector, part))

    def pop(self) -> str:
        e = self.stack.pop()
        self.links -= e.inline.get("a", 0)
        self.names[e.name] -= 1
        self.controls -= e.name in CONTROLS
        for w in e.words:
            self.words[w] -= 1
        if e.name in SCOPE:
            self.scopes.pop()
        elif e.name in CLOSABLE:
            self.scopes[-1][e.name].pop()
        return e.name

    def close(self, name: str) -> None:
        if self.names.get(name):
            while self.pop() != name:
                pass

    def make_way(self, name: str) -> None:
        """Close what an opening block closes by itself: a paragraph, or an element of its kind, in the same scope."""
        scope = self.scopes[-1]
        at = max((scope[n][-1] for n in CLOSED_BY_BLOCK | SAME_KIND.get(name, set()) if scope.get(n)), default=None)
        while at is not None and len(self.stack) > at:
            self.pop()

    def inline(self, name: str, step: int) -> None:
        counts = self.stack[-1].inline
        if step > 0 or counts.get(name):
            counts[name] = counts.get(name, 0) + step
            self.links += step * (name == "a")


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in page order; markup that doesn't close or nest is read as browsers roughly do. Scripts,
    styles, titles, forms and their controls, menus and footers marked as such give no block, nor does what stands in for
    a medium or for scripts and is not shown; a form (menu, footer) around a whole page is none."""
    out: list[Block] = []
    parts: list[str] = []
    r = _Reader()
    linked, at, end = 0, 0, len(page)
    closings: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text and not r.controls:
            out.append(Block(r.stack[-1], text, linked))
        parts.clear()
        linked = 0

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(page[at:stop])
            linked += (stop - at) if r.links else 0
        if not m:
            break
        at = m.end()
        if m[1] is None:
            if page.startswith("<![CDATA[", m.start()):
                parts.append(html.escape(page[m.start() + 9 : at].removesuffix("]]>")))
            continue
        name = m[1].lower()
        closing, empty = page[m.start() + 1] == "/", m[2].rstrip().endswith("/")
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                parts.append(" " if name == "br" else "")
            elif closing or not empty:
                r.inline(name, -1 if closing else 1)
            continue
        if closing:
            if name not in RAW and name not in HIDDEN:
                flush()
                r.close(name)
            continue
        if name in RAW:
            at = _raw_end(page, name, at)
            continue
        if name in HIDDEN:
            if not empty:
                # one that is never closed hides nothing
                closings = _closings(page) if closings is None else closings
                at = closings.get(at, at)
            continue
        flush()
        r.make_way(name)
        if name in VOID or empty:
            continue
        words = [name]
        for x in NAMES.findall(m[2]) if m[2] else ():
            words.extend("." + w for w in NAME_WORD.findall("".join(x).lower()))
        r.open(name, words)
    flush()
    return [b for b in out if b.inside.part is None or b.inside.part[0]]


@functools.lru_cache(1 << 16)
def _slot(feature: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(feature.encode("utf-8", "replace"))
    return h % dim, 1.0 if h & 0x80000000 else -1.0


@functools.lru_cache(1 << 14)
def _leaf_slots(name: str, above: str) -> tuple[tuple[int, float], tuple[int, float]]:
    return _slot("path leaf " + name, PATH_DIM), _slot(f"path pair {above} {name}", PATH_DIM)


def _path_vector(e: Element) -> np.ndarray:
    x = e.vector.copy()
    for i, sign in _leaf_slots(e.name, e.parent.name if e.parent else ""):
        x[i] += sign
    return x


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode() + b" ", np.uint8)
    stop = np.flatnonzero(raw == 32)
    start = np.r_[0, stop[:-1] + 1]
    return mix64(span_hash(prefix_hash(raw[:-1]), start, stop))


#: Words that page parts other than the main text are full of.
SIGNS = "© advertisement advertising sponsored cookie cookies privacy terms copyright reserved reserved. subscribe newsletter login log sign share tweet follow reply replies report comment comments responses respond ago ago: menu home next previous".split()


_PUNCTUATION = np.zeros(256, np.int64)
_PUNCTUATION[[ord(c) for c in ".,;!?"]] = 1


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page a row per block: hashed path, hashed words (scaled to length 1), plain numbers."""
    sizes = [len(p) for p in pages]
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), INPUT))
    if not flat:
        return [x for _ in pages]
    texts = [b.text.lower().encode("utf-8", "replace") + b" " for b in flat]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    stop = np.cumsum([len(t) for t in texts])
    # words lie between blanks, and blocks hold no other white space
    blank = np.flatnonzero(raw == 32)
    start = np.r_[0, blank[:-1] + 1]
    owner = np.searchsorted(stop, blank, side="right")
    signs, known = np.zeros(len(blank)), _word_hashes(SIGNS)
    for lo in range(0, len(blank), 1 << 17):
        part = slice(lo, lo + (1 << 17))
        base = start[part][0]
        h = mix64(span_hash(prefix_hash(raw[base : blank[part][-1]]), start[part] - base, blank[part] - base))
        signs[part] = np.isin(h, known)
        np.add.at(x, (owner[part], PATH_DIM + (h % U64(WORD_DIM)).astype(np.int64)), np.where(h >> U64(63), 1.0, -1.0))
    own = x[:, PATH_DIM : PATH_DIM + WORD_DIM]
    own /= np.maximum(np.sqrt((own * own).sum(axis=1, keepdims=True)), 1e-9)
    marks = np.r_[0, np.cumsum(_PUNCTUATION[raw])]
    begin = np.r_[0, stop[:-1]]
    chars = np.maximum(1, np.fromiter((len(b.text) for b in flat), np.int64, len(flat)))
    at = np.concatenate([np.arange(n) for n in sizes])
    n = np.repeat(sizes, sizes)
    x[:, :PATH_DIM] = [_path_vector(b.inside) for b in flat]
    x[:, -PLAIN:] = np.column_stack([
        np.log1p(chars) / 6, np.log1p(np.bincount(owner, minlength=len(flat))) / 4, np.minimum(1.0, np.fromiter((b.linked for b in flat), np.int64, len(flat)) / chars),
        at / n, (n - 1 - at) / n, (marks[stop] - marks[begin]) / chars * 10, np.fromiter((b.text[-1] in ".!?" for b in flat), bool, len(flat)), np.ones(len(flat)),
        3 * np.bincount(owner, signs, len(flat)) / np.bincount(owner, minlength=len(flat)),
    ])
    return np.split(x, np.cumsum(sizes)[:-1])


# --- the labeller ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Labeller:
    """Weights of both directions (input and recurrent to four gates) and of the output."""

    w: tuple[np.ndarray, np.ndarray]
    out: np.ndarray

    @property
    def hidden(self) -> int:
        return self.w[0].shape[1] // 4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: bool = False):
    """One direction over (time, page, input): hidden states, and what the way back needs."""
    t, n, _ = x.shape
    k = w.shape[1] // 4
    w_in, w_rec = w[:-k], w[-k:]
    a_in = x @ w_in
    h, c, hs, saved = np.zeros((n, k)), np.zeros((n, k)), np.zeros((t, n, k)), []
    for s in range(t):
        a = a_in[s] + h @ w_rec
        i, f, o, g = _sigmoid(a[:, :k]), _sigmoid(a[:, k : 2 * k] + 1), _sigmoid(a[:, 2 * k : 3 * k]), np.tanh(a[:, 3 * k :])
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        live = mask[s][:, None]
        if keep:
            saved.append((h, c, i, f, o, g, tc))
        c, h = np.where(live, c_new, c), np.where(live, o * tc, h)
        hs[s] = h
    return hs, saved


def _back(x: np.ndarray, mask: np.ndarray, w: np.ndarray, saved: list, d_hs: np.ndarray) -> np.ndarray:
    t, n, _ = x.shape
    k = w.shape[1] // 4
    w_rec = w[-k:]
    grad = np.zeros_like(w)
    dh, dc = np.zeros((n, k)), np.zeros((n, k))
    for s in range(t - 1, -1, -1):
        h, c, i, f, o, g, tc = saved[s]
        live = mask[s][:, None]
        dh = dh + d_hs[s]
        dh_l, dc_l = dh * live, dc * live
        dcn = dc_l + dh_l * o * (1 - tc * tc)
        da = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dh_l * tc * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
        grad[:-k] += x[s].T @ da
        grad[-k:] += h.T @ da
        dh = da @ w_rec.T + dh * ~live
        dc = dcn * f + dc * ~live
    return grad


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, seqs))
    x, mask = np.zeros((t, len(seqs), INPUT)), np.zeros((t, len(seqs)), bool)
    for k, s in enumerate(seqs):
        x[: len(s), k], mask[: len(s), k] = s, True
    return x, mask


def label(seqs: list[np.ndarray], m: Labeller) -> list[np.ndarray]:
    """The probability of main text for each block; pages of like length run side by side."""
    out: list[np.ndarray] = [np.zeros(0)] * len(seqs)
    order = sorted((k for k in range(len(seqs)) if len(seqs[k])), key=lambda k: len(seqs[k]))
    at = 0
    while at < len(order):
        part = order[at : at + 128]
        while len(part) > 1 and len(part) * len(seqs[part[-1]]) > 40_000:
            part = part[: len(part) // 2]
        at += len(part)
        x, mask = _padded([seqs[k] for k in part])
        f, _ = _run(x, mask, m.w[0])
        b, _ = _run(x[::-1], mask[::-1], m.w[1])
        p = _sigmoid(np.concatenate([f, b[::-1]], axis=2) @ m.out[:-1] + m.out[-1])
        for j, k in enumerate(part):
            out[k] = p[: len(seqs[k]), j]
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], hidden: int = 16, rounds: int = 12, seed: int = 5) -> Labeller:
    """Adam on the blocks' cross-entropy, back through time in both directions."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.15, (INPUT + hidden, 4 * hidden)) for _ in range(2)] + [rng.normal(0, 0.2, 2 * hidden + 1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for r in range(rounds):
        order = rng.permutation(len(pages))
        for at in range(0, len(order), 32):
            part = [pages[k] for k in order[at : at + 32]]
            x, mask = _padded([s for s, _ in part])
            y = np.zeros(mask.shape)
            for k, (s, t) in enumerate(part):
                y[: len(s), k] = t
            f, kept_f = _run(x, mask, params[0], keep=True)
            b, kept_b = _run(x[::-1], mask[::-1], params[1], keep=True)
            both = np.concatenate([f, b[::-1]], axis=2)
            d = (_sigmoid(both @ params[2][:-1] + params[2][-1]) - y) * mask / mask.sum()
            d_both = d[:, :, None] * params[2][:-1]
            grads = [
                _back(x, mask, params[0], kept_f, d_both[:, :, :hidden]), _back(x[::-1], mask[::-1], params[1], kept_b, d_both[::-1, :, hidden:]),
                np.append(np.einsum("tnk,tn->k", both, d), d.sum()),
            ]
            step += 1
            rate = 0.02 * (1 - 0.9 * r / rounds)
            for p, g, a, q in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                q += 0.01 * (g * g - q)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)
    return Labeller((params[0], params[1]), params[2])


# --- pages to learn from --------------------------------------------------------------------------------------------


class PageMaker:
    """Invented pages in many layouts, with the blocks that are main text known."""

    #: Usual names of page parts.
    BOILER = {
        "header": ["site header", "masthead", "top bar", "branding", "page header"], "nav": ["nav", "menu", "navbar", "main menu", "breadcrumb", "breadcrumbs", "pagination", "toc links"],
        "aside": ["sidebar", "widget", "related posts", "right column", "rail", "trending"], "ad": ["ad", "ads", "advert", "banner", "sponsored", "promo", "ad slot"],
        "notice": ["cookie notice", "consent", "gdpr", "alert", "popup modal", "notice", "newsletter signup", "paywall notice"], "footer": ["footer", "site footer", "copyright", "legal", "bottom bar"],
        "comments": ["comments", "comment list", "responses", "discussion", "reader comments", "disqus thread"], "share": ["share", "social links", "share buttons", "tags", "author bio"],
    }
    MAIN = ["content", "post", "entry content", "article body", "story", "main content", "post body", "text", "page content", "body copy"]
    SAYINGS = ["All rights reserved", "Sign in", "Subscribe", "Privacy policy", "Read more", "Home", "About us", "Contact", "Share this", "Accept all cookies", "Log in to comment", "Reply", "Advertisement", "Terms of use", "Follow us", "Next", "Previous", "Sponsored", "Print", "Tweet"]
    REPLIES = ["Comments", "3 comments", "Responses", "12 replies", "What readers say", "Leave a reply", "Discussion", "Reader comments"]
    #: The kinds of layout; each is a method.
    KINDS = ("classic", "divs", "wiki", "terms", "layout_table", "bare", "figures", "nested", "blog", "manual", "recipe", "forum")

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.nameless = self.r.random() < 0.4
        self.made: list[tuple[str, bool]] = []

    def word(self) -> str:
        r = self.r
        w = "".join(r.choice("bcdfghjklmnprstvwzaeiouaeiouéäöñ") for _ in range(r.randint(1, 9)))
        return w + r.choice(["", "", "", "", ",", ".", "***", "!!"]) if r.random() < 0.3 else w

    def words(self, lo: int, hi: int) -> str:
        n = self.r.randint(lo, hi)
        return " ".join(self.word() for _ in range(n))

    def sentence_text(self) -> str:
        r, out = self.r, []
        if r.random() < 0.04:  # what page parts say can stand in a text too
            return r.choice(self.SAYINGS) + "."
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 12])):
            out.append(self.words(1, 18).capitalize() + r.choice([".", ".", ".", "!", "?", ""]))
        text = r.choice([" ", "\n", "  "]).join(out)
        style = r.random()
        if style < 0.08:
            text = text.upper()
        elif style < 0.14:
            text = " | ".join(text.split())
        return text

    def names(self, options: list[str]) -> str:
        r = self.r
        n = r.choice(options)
        if self.nameless:
            return r.choice(["", "", f' class="{"".join(r.choice("abcdefxyz") for _ in range(r.randint(1, 4)))}-{r.randint(1, 99)}"'])
        kind = r.random()
        if kind < 0.45:
            return f' class="{n.replace(" ", r.choice(["-", " ", "_"]))}"'
        if kind < 0.65:
            return f' id="{n.replace(" ", "-")}"'
        return f' class="{n.replace(" ", "-")} {r.choice(["clearfix", "row", "col", "wrap", "inner", "block"])}"'

    def put(self, tag: str, text: str, main: bool, attrs: str = "", close: bool = True) -> str:
        self.made.append((text, main))
        body = text.replace("&", "&amp;").replace("<", "&lt;")
        r = self.r
        if main and r.random() < 0.3 and " " in body:
            a, b = body.split(" ", 1)
            body = f"<{(t := r.choice(['b', 'em', 'i', 'strong', 'a href=/x', 'span', 'b']))}>{a} {b}" + ("" if r.random() < 0.3 else f"</{t.split()[0]}>") if r.random() < 0.5 else f"<b>{a}</b> {b}"
        return f"<{tag}{attrs}>{body}" + (f"</{tag}>" if close else r.choice(["", "<br>"]))

    def links(self, tag: str = "ul") -> str:
        n = self.r.randint(2, 8)
        item = {"ul": "li", "ol": "li", "div": "div", "p": "p"}[tag]
        return f"<{tag}>" + "".join(f"<{item}>" + self._link() + f"</{item}>" for _ in range(n)) + f"</{tag}>"

    def _link(self) -> str:
        t = self.r.choice(self.SAYINGS) if self.r.random() < 0.3 else self.words(1, 4)
        self.made.append((t, False))
        return f'<a href="/{self.r.randint(0, 99)}">{t.replace("&", "&amp;")}</a>'

    def boiler(self, kind: str) -> str:
        r = self.r
        tag = {"header": r.choice(["header", "div"]), "nav": r.choice(["nav", "div", "nav"]), "aside": r.choice(["aside", "div"]), "footer": r.choice(["footer", "footer", "div"]), "comments": r.choice(["section", "div"])}.get(kind, "div")
        named = self.names(self.BOILER[kind]) if tag == "div" or r.random() < 0.5 else ""
        if kind == "nav":
            body = self.links(r.choice(["ul", "ul", "div"]))
        elif kind == "header":
            body = self.put(r.choice(["h1", "div", "p", "h2"]) if named or tag == "header" else "div", self.words(1, 5), False) + (self.links() if r.random() < 0.4 else "")
        elif kind == "aside":
            body = "".join(self.put("h3", self.words(1, 4), False) + (self.links() if r.random() < 0.6 else self.put("p", self.sentence_text(), False)) for _ in range(r.randint(1, 3)))
        elif kind == "comments":
            body = self.put("h3", r.choice(["Comments", "Responses", self.words(1, 3)]), False) + "".join(f'<div class="comment">{self.put("div", self.words(1, 2), False)}{self.put("p", self.sentence_text(), False)}</div>' for _ in range(r.randint(1, 5)))
        elif kind == "footer":
            text = r.choice([f"© {self.words(1, 3)}", f"{self.word()} · {self.sentence_text()}", self.sentence_text(), r.choice(self.SAYINGS)])
            self.made.append((text, False))
            body = text.replace("&", "&amp;").replace("©", "&copy;") + (self.links() if r.random() < 0.3 else "")
        elif kind == "notice" and r.random() < 0.4:
            tag, body = "form", self.put("label", r.choice(self.SAYINGS), False).replace("label", "p") + "<input name=q>" + self.put("button", r.choice(self.SAYINGS), False)
        else:
            text = self.sentence_text() if r.random() < 0.7 and not self.nameless else r.choice(self.SAYINGS)
            self.made.append((text, False))
            body = text.replace("&", "&amp;").replace("<", "&lt;") if r.random() < 0.5 else f"<p>{text.replace('&', '&amp;').replace('<', '&lt;')}</p>"
        return f"<{tag}{named}>{body}</{tag}>" + r.choice(["", "\n"])

    def article(self) -> str:
        r, out = self.r, []
        title = self.words(1, 9).capitalize()
        if r.random() < 0.85:
            out.append(self.put(r.choice(["h1", "h1", "h2"]), title, True))
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 10, 20])):
            x = r.random()
            if x < 0.76:
                out.append(self.put("p", self.sentence_text(), True, close=r.random() < 0.85))
            elif x < 0.84:
                out.append(self.put(r.choice(["h2", "h3"]), self.words(1, 6), True))
            elif x < 0.9:
                out.append("<ul>" + "".join(self.put("li", self.words(2, 12), True) for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.94:
                out.append(self.put(r.choice(["blockquote", "pre"]), self.sentence_text(), True))
            elif x < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(self.put("td", self.words(1, 3), True) for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(self.boiler(r.choice(["ad", "share", "ad", "aside", "notice", "comments"])))
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        named = self.names(self.MAIN) if tag in ("div", "section") or r.random() < 0.3 else ""
        return f"<{tag}{named}>" + r.choice(["", "\n"]).join(out) + f"</{tag}>"

    def prose(self, tag: str = "p", n: int = 0, attrs: str = "") -> str:
        return "".join(self.put(tag, self.sentence_text(), True, attrs) for _ in range(n or self.r.choice([1, 2, 3, 4, 6, 10])))

    def heading(self, *tags: str) -> str:
        return self.put(self.r.choice(tags or ("h1", "h1", "h2")), self.words(1, 9).capitalize(), True)

    def items(self, tag: str, item: str) -> str:
        return f"<{tag}>" + "".join(self.put(item, self.words(2, 14), True) for _ in range(self.r.randint(1, 7))) + f"</{tag}>"

    def remarks(self) -> str:
        """Comments of readers, known by their heading, names, times and links to reply only."""
        r = self.r
        item = r.choice(["div", "div", "li", "article", "p"])
        out = [self.put(r.choice(["h2", "h3", "h4", "div"]), r.choice(self.REPLIES), False)]
        for _ in range(r.randint(1, 6)):
            who = self.put(r.choice(["div", "b", "h5"]), f"{self.words(1, 2)} {r.choice(['', 'says:', f'{r.randint(2, 23)} hours ago', f'{r.randint(2, 9)} days ago'])}", False)
            text = self.put(r.choice(["div", "p"]), self.sentence_text(), False)
            more = self.put("a", r.choice(["Reply", "Report", "Like", "Reply Share"]), False, " href=#r") if r.random() < 0.6 else ""
            out.append(f"{who}{text}{more}" if item == "p" else f"<{item}>{who}{text}{more}</{item}>")
        return r.choice(["<div>{}</div>", "<section>{}</section>", "<div><div>{}</div></div>", "{}"]).format("".join(out))

    def divs(self) -> str:
        return f"<div>{self.heading('h1', 'h1', 'h2', 'div')}{self.prose('div')}</div>"

    def wiki(self) -> str:
        r, out = self.r, [self.prose(n=self.r.randint(1, 3))]
        for _ in range(r.randint(0, 3)):
            out.append(self.put(r.choice(["h2", "h3"]), self.words(1, 4), True) + r.choice([self.prose(n=r.randint(1, 4)), self.prose() + self.items("ul", "li"), self.prose("dd", 2)]))
        box = "<table>" + "".join("<tr>" + self.put("th", self.words(1, 2), True) + self.put("td", self.words(1, 4), True) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>" if r.random() < 0.4 else ""
        return f'<div{r.choice(["", " id=bodyContent", " class=parser-output"])}>{self.heading("h1")}<div>{box}{"".join(out)}</div></div>'

    def terms(self) -> str:
        pairs = "".join(self.put("dt", self.words(1, 4), True) + self.put("dd", self.sentence_text(), True, close=self.r.random() < 0.7) for _ in range(self.r.randint(2, 8)))
        return f"{self.heading()}{self.prose(n=1) if self.r.random() < 0.4 else ''}<dl>{pairs}</dl>"

    def layout_table(self) -> str:
        r = self.r
        menu = r.choice([self.links("ul"), self.links("p"), "<br>".join(self._link() for _ in range(r.randint(2, 6)))])
        text = self.heading("h1", "h2", "b") + (self.prose() if r.random() < 0.6 else self.loose())
        cells = [f"<td width=160>{menu}</td>", f"<td>{text}</td>"]
        foot = f"<tr><td colspan=2>{self.put('font', r.choice(['Copyright', 'All rights reserved', '© 2004']) + ' ' + self.words(1, 3), False)}</td></tr>"
        return f"<table><tr><td colspan=2>{self.put('b', self.words(1, 3), False)}</td></tr><tr>{''.join(cells if r.random() < 0.7 else cells[::-1])}</tr>{foot if r.random() < 0.6 else ''}</table>"

    def loose(self) -> str:
        texts = [self.sentence_text() for _ in range(self.r.randint(1, 5))]
        self.made.append((" ".join(texts), True))
        return self.r.choice(["<br>", "<br><br>", "<br />\n<br />"]).join(t.replace("&", "&amp;").replace("<", "&lt;") for t in texts)

    def bare(self) -> str:
        return self.heading("h1", "center", "h2") + self.r.choice(["{}", "<div>{}</div>", "<font size=2>{}</font>", "<blockquote>{}</blockquote>"]).format(self.loose())

    def figures(self) -> str:
        figure = lambda: f"<figure><img src=a.png>{self.put('figcaption', self.words(3, 14).capitalize(), True)}</figure>"
        return f"<div>{self.heading()}" + "".join(self.prose(n=self.r.randint(1, 3)) + (figure() if self.r.random() < 0.6 else "") for _ in range(3)) + "</div>"

    def nested(self) -> str:
        r = self.r
        body = "".join("<section>" * (k := r.randint(0, 2)) + f"<div>{self.put(r.choice(['p', 'div', 'p']), self.sentence_text(), True)}</div>" + "</section>" * k for _ in range(r.randint(2, 8)))
        return "<div>" * 3 + f"<div>{self.heading()}</div><div>{body}</div>" + "</div>" * 3

    def blog(self) -> str:
        r = self.r
        by = self.put(r.choice(["div", "p"]), f"{r.choice(['By', 'Posted by'])} {self.words(1, 2)}", True) if r.random() < 0.3 else ""
        return f"<div>{self.heading('h1', 'h2')}{by}<div>{self.prose()}{self.items('ul', 'li') if r.random() < 0.4 else ''}{self.prose('blockquote', 1) if r.random() < 0.3 else ''}</div></div>"

    def manual(self) -> str:
        r = self.r
        parts = [r.choice([self.prose(n=1), self.prose("pre", 1), self.items("ul", "li"), self.items("ol", "li"), self.put("h2", self.words(1, 5), True)]) for _ in range(r.randint(2, 9))]
        return f"<div>{self.heading('h1')}{''.join(parts)}</div>"

    def recipe(self) -> str:
        return f"<div>{self.heading()}{self.prose(n=1)}{self.put('h2', self.words(1, 2), True)}{self.items('ul', 'li')}{self.put('h2', self.words(1, 2), True)}{self.items('ol', 'li')}</div>"

    def forum(self) -> str:
        return f"<div>{self.heading('h1', 'h2')}<div>{self.prose(self.r.choice(['p', 'div']), self.r.randint(1, 4))}</div></div>{self.remarks()}"

    def classic(self) -> str:
        return self.article()

    def page(self, kinds: tuple[str, ...] = KINDS, strange: float = 0.0) -> tuple[str, list[tuple[str, bool]]]:
        r = self.r
        self.made = []
        # a third of the pages have the marked-up layout that names its parts
        kind = "classic" if "classic" in kinds and r.random() < 0.33 else r.choice(kinds)
        head = ""
        if r.random() < 0.9:
            head = f"<head><meta charset=utf-8><title>{self.words(1, 6).replace('&', '&amp;')}</title><style>p{{margin:0}}</style></head>"
        before = [self.boiler(k) for k in ("header", "nav", "notice", "ad", "nav") if r.random() < 0.5]
        body = getattr(self, kind)()
        if kind not in ("classic", "forum") and r.random() < 0.25:
            body += self.remarks()
        after = [self.boiler(k) for k in ("share", "ad", "comments", "aside", "notice", "footer") if r.random() < 0.45]
        whole = f"<div class=wrapper>{''.join(before)}<div>{body}</div>{''.join(after)}</div>" if r.random() < 0.3 else f"{''.join(before)}<!-- x -->{body}{''.join(after)}"
        return f"<!DOCTYPE html><html>{head}<body>{self.strange(whole) if r.random() < strange else whole}</body></html>", self.made

    def strange(self, body: str) -> str:
        """The page with elements of names never seen, from which the labeller learns to go by the text as well."""
        r = self.r
        new = {t: "".join(r.choice("abcdefghijk") for _ in range(3)) + "-x" for t in r.sample(["p", "div", "ul", "li", "ol", "dl", "dt", "dd", "table", "tr", "td", "section", "h1", "h2", "h3", "figure", "figcaption"], r.randint(2, 12))}
        return re.sub(r"(</?)([a-z0-9]+)(?=[ >])", lambda m: m[1] + new.get(m[2], m[2]), body)


def example(seed: int, kinds: tuple[str, ...] = PageMaker.KINDS, strange: float = 0.0) -> tuple[str, list[Block], np.ndarray]:
    """A page, its blocks and their labels, matched in order by text."""
    maker = PageMaker(seed)
    page, made = maker.page(kinds, strange)
    own, labels = blocks(page), []
    said = [(" ".join(html.unescape(t).split()), y) for t, y in made]
    by_text: dict[str, list[bool]] = {}
    for t, y in said:
        by_text.setdefault(t, []).append(y)
    for b in own:
        left = by_text.get(b.text)
        labels.append(float(left.pop(0)) if left else float(any(y for t, y in said if t and t in b.text)))
    return page, own, np.array(labels)


@functools.lru_cache(4)
def trained(pages: int = 1800, seed: int = 11, kinds: tuple[str, ...] = PageMaker.KINDS) -> Labeller:
    """The production labeller: fitted once in a session, on the driver, on generated pages, of which half have
    elements of strange names."""
    made = [example(seed * 100_000 + k, kinds, 0.5) for k in range(pages)]
    return train([(vectors([b])[0], y) for _, b, y in made if b])


# --- on tables ------------------------------------------------------------------------------------------------------


#: A page without a main block falls back on its densest run, if that outweighs this many characters.
DENSE = 80


def chosen(own: list[Block], p: np.ndarray) -> list[str]:
    """The texts of the main blocks; where the labeller finds none, those of the run of blocks with the most characters
    outside links, each block costing 40 characters and each linked character two."""
    if (p >= 0.5).any():
        return [b.text for b, q in zip(own, p) if q >= 0.5]
    best, span, total, start = DENSE, (0, 0), 0, 0
    for k, b in enumerate(own):
        if total <= 0:
            total, start = 0, k
        total += len(b.text) - 3 * b.linked - 40
        if total > best:
            best, span = total, (start, k + 1)
    return [b.text for b in own[slice(*span)]]


def main_text(page: str, m: Labeller) -> str:
    own = blocks(page)
    return "\n".join(chosen(own, label(vectors([own]), m)[0])) if own else ""


def extract(pages: DataFrame, m: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars: the main blocks, one a line. Null or empty html gives empty text; null ids and urls
    stay null; rows repeated whole are repeated; other columns are ignored."""
    m = m or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(2))
            for i in range(0, batch.num_rows, 256):
                j = min(i + 256, batch.num_rows)
                own = [blocks(raw[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")) for k in range(i, j)]
                scores = label(vectors(own), m)
                texts = ["\n".join(chosen(bs, p)) for bs, p in zip(own, scores)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
