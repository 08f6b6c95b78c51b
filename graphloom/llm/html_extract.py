"""HTML main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block's vector holds its tag path (tags with class and id words,
hashed), its words (hashed, as shares), its length, punctuation, share of link text and place, the same sums of the
container round it and of the one round that, and how heavy these are beside their siblings; a numpy bidirectional LSTM reads
the whole sequence and labels every block from its two states alone, so each decision sees the document on both sides. The
rules that label training pages are no part of the vectors. The text is the blocks that are labelled as content, in page order.

The model is trained when the job starts, on TRAIN_PAGES pages of at most TRAIN_BYTES each (distinct html, spread over
hosts: the only thing that is sampled, and bounded by these two). Their blocks are labelled by sectioning markup or, where
there is none, by the container that holds the page's prose; then each page's texts are laid out anew several times:
sections of other kinds put in, containers renamed, or named so that they tell nothing, tables as columns, end tags left
out. So the labeller has to learn what sections look like, not only what they are called. Same pages, same weights. Weights
have a fixed size and go to the tasks with the function.

Inputs: null html counts as empty, and a page without content blocks gives an empty text; markup may be unclosed or cut off
anywhere and nested at any depth; a page of any length is one sequence, in memory that grows with its blocks; equal and
repeated rows give equal results; extra columns are ignored, url may be null; an empty table gives an empty result; a table
without any page that fits the sample is judged by a model trained on made-up texts.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Pages and bytes of each that the sample has at most; sequences that a model learns from; passes over them; cells a side.
TRAIN_PAGES, TRAIN_BYTES, SEQUENCES, EPOCHS, HIDDEN = 96, 200_000, 4224, 8, 24
#: Words of a training page of which made-up sections consist; words that a block has at most for its share of CUES to count.
BAG_WORDS, CUE_WORDS = 5000, 40
#: Tags are hashed into the first TAG_DIMS places of the path, class and id words into the others.
TAG_DIMS, PATH_DIMS, WORD_DIMS = 32, 128, 32
SCALARS, CONTAINER_DIMS = 8, 16
#: The share of a page's prose that the container of its article holds at least, where markup does not name it.
MAIN_SHARE = 0.6

#: Comments and elements whose content is no text; tags, whose quotes count as such only behind "="; declarations; text.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|noembed|noframes)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that stay inside a line, that have no end tag, that end an open p, and that are no containers.
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 blockquote pre hr figure address fieldset".split())
FLOW = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address caption thead tbody tfoot tr option optgroup html body".split())
#: An opening tag -> the open elements that it ends, and those beyond which it ends none (None: any but p).
_CELLS, _ROWS = ("td", "th"), ("tr", "td", "th")
_ENDS: dict[str, tuple[tuple[str, ...], tuple[str, ...] | None]] = {
    "li": (("li",), None), "dt": (("dt", "dd"), None), "dd": (("dt", "dd"), None),
    "td": (_CELLS, ("table", "tr")), "th": (_CELLS, ("table", "tr")), "tr": (_ROWS, ("table",)),
    **{k: ((*_ROWS, "thead", "tbody", "tfoot", "caption"), ("table",)) for k in ("thead", "tbody", "tfoot")},
    "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)),
}
#: Elements that are no part of an article, and words in classes and ids that say so.
ASIDE_TAGS = frozenset("nav header footer aside form menu title select button option dialog textarea".split())
ASIDE_NAMES = frozenset("nav navbar menu header masthead footer aside sidebar ad ads advert advertisement promo sponsor sponsored banner cookie cookies consent notice alert popup comment comments reply replies breadcrumb breadcrumbs share social related newsletter subscribe login search form pagination widget".split())
HOME = frozenset(("article", "main"))
#: Words that menus, notices, forms and footers often say.
CUES = frozenset("home about contact login register search subscribe newsletter cookie cookies privacy terms policy accept reply share related advertisement sponsored comments comment copyright rights reserved menu follow email sign next previous more".split())
_CUE_LIST = sorted(CUES)
LEAVES = {"p": 0, "li": 1, "h1": 2, **dict.fromkeys(("h2", "h3", "h4", "h5", "h6"), 3), "td": 4, "th": 4, "dt": 5, "dd": 5, "blockquote": 0, "pre": 0, **dict.fromkeys(("div", "section", "article", "main", "body"), 6)}
DIMS = PATH_DIMS + WORD_DIMS + SCALARS + CONTAINER_DIMS + 8


class Block(NamedTuple):
    """A leaf block: its text with single spaces, the share of it in links, the hashed elements of its path as bits, whether
    the path has an article or main element and an element of another kind of section, its innermost element, and the
    container that is next to it."""

    text: str
    links: float
    path: int
    home: bool
    aside: bool
    leaf: int
    container: int


class Page(NamedTuple):
    """The blocks with text in page order, and each container's parent (containers are numbered as they open; 0: the page)."""

    blocks: list[Block]
    parents: list[int]


@lru_cache(maxsize=20_000)
def _element(tag: str, names: str) -> tuple[tuple[int, ...], bool, bool]:
    """(hash slots of the tag and its class and id words, whether it is an article, whether it is no part of one)."""
    given = names.lower().split()
    words = {part for name in given for part in (name, *re.split(r"[-_]", name))}
    slots = {zlib.crc32(tag.encode()) % TAG_DIMS, *(TAG_DIMS + zlib.crc32(b"." + w.encode()) % (PATH_DIMS - TAG_DIMS) for w in words)}
    return tuple(slots), tag in HOME or bool(words & HOME), tag in ASIDE_TAGS or bool(words & ASIDE_NAMES)


def blocks_of(page: str) -> Page:
    """The page's leaf blocks. What is known of the open elements is kept in counters, so a block costs the same at any depth."""
    out: list[Block] = []
    path: list[tuple] = []  # (tag, slots, home, aside, container before it)
    open_tags: Counter[str] = Counter()
    slots, mask, homes, asides, articles = [0] * PATH_DIMS, 0, 0, 0, 0
    parents, container = [0], 0
    text: list[str] = []
    linked, in_link = 0, 0

    def close() -> None:
        nonlocal linked
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            if said:
                out.append(Block(said, min(1.0, linked / len(said)), mask, homes > 0, asides > 0, LEAVES.get(path[-1][0], 7) if path else 6, container))
            text.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal mask, homes, asides, articles, container
        while len(path) > depth:
            name, own, home, aside, container = path.pop()
            open_tags[name] -= 1
            homes, asides, articles = homes - home, asides - aside, articles - (name == "article")
            for k in own:
                slots[k] -= 1
                if not slots[k]:
                    mask &= ~(1 << k)

    def end_implicitly(tag: str) -> None:
        ended, bounds = _ENDS[tag]
        if not any(open_tags[x] for x in ended):
            return
        depth = len(path)
        for i in range(len(path) - 1, -1, -1):
            name = path[i][0]
            if name in ended:
                depth = i
            elif name != "p" if bounds is None else name in bounds:
                break
        leave(depth)

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                text.append(raw)
                if in_link:
                    linked += len(raw)
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[2] else 1
            continue
        if m[2] or any(not x.isspace() for x in text):  # a link may hold whole blocks
            in_link = 0
        close()
        if tag in VOID:
            continue
        if m[2]:
            for i in range(len(path) - 1, -1, -1) if open_tags[tag] else ():
                if path[i][0] == tag:
                    leave(i)
                    break
        else:
            if path and path[-1][0] == "p" and tag in CLOSES_P:
                leave(len(path) - 1)
            if tag in _ENDS:
                end_implicitly(tag)
            names = " ".join(x for found in _NAMES.findall(m[4]) for x in found if x) if m[4] else ""
            own, home, aside = _element(tag, names)
            if tag == "header" and articles:  # an article's own head
                aside = False
            path.append((tag, own, home, aside, container))
            open_tags[tag] += 1
            homes, asides, articles = homes + home, asides + aside, articles + (tag == "article")
            for k in own:
                slots[k] += 1
                mask |= 1 << k
            if tag not in FLOW:
                parents.append(container)
                container = len(parents) - 1
    close()
    return Page(out, parents)


def _masses(page: Page, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per container its own blocks, words and linked words, and then words, linked words and blocks with all inside it."""
    at = np.array([b.container for b in page.blocks])
    n = len(page.parents)
    linked = words * np.array([b.links for b in page.blocks])
    own = np.stack([np.bincount(at, x, n) for x in (words, linked, np.ones(len(at)))])
    whole = own.copy()
    for c in range(n - 1, 0, -1):
        whole[:, page.parents[c]] += whole[:, c]
    return own, whole, at, np.array(page.parents)


def _main(page: Page, words: np.ndarray) -> tuple[int, np.ndarray]:
    """The deepest container with MAIN_SHARE of the page's prose outside other sections, and which containers lie in it."""
    n, parents = len(page.parents), page.parents
    prose = [w if w >= 5 and b.links < 0.3 and not b.aside else 0.0 for b, w in zip(page.blocks, words)]
    mass = np.bincount([b.container for b in page.blocks], prose, n)
    for c in range(n - 1, 0, -1):
        mass[parents[c]] += mass[c]
    main = int(np.flatnonzero(mass >= MAIN_SHARE * mass[0])[-1])  # those are one path, numbered downwards
    inside = np.zeros(n, bool)
    inside[main] = True
    for c in range(main + 1, n):
        inside[c] = inside[parents[c]]
    return main, inside


def _vectors(page: Page) -> np.ndarray:
    blocks = page.blocks
    n = len(blocks)
    out = np.zeros((n, DIMS), np.float32)
    if not n:
        return out
    raw = np.frombuffer(b"".join(b.path.to_bytes(PATH_DIMS // 8, "little") for b in blocks), np.uint8).reshape(n, -1)
    out[:, :PATH_DIMS] = np.unpackbits(raw, axis=1, bitorder="little")
    texts = [b.text.encode() for b in blocks]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    part, starts, ends, row = C.word_spans(np.frombuffer(b"".join(texts), np.uint8), off, 0, n)
    slot = (C.word_hashes(part, starts, ends) % np.uint64(WORD_DIMS)).astype(np.int64)
    counts = np.bincount(row * WORD_DIMS + slot, minlength=n * WORD_DIMS).reshape(-1, WORD_DIMS)
    words = counts.sum(1).astype(float)
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts
    del counts, slot, row  # a long page has many
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] /= np.maximum(words, 1)[:, None]
    k = PATH_DIMS + WORD_DIMS
    out[:, k], out[:, k + 1] = np.minimum(np.log1p(words) / 6, 1.5), words < 8
    out[:, k + 2], out[:, k + 3] = np.arange(n) / n, 1
    out[:, k + 4] = [b.links for b in blocks]
    out[:, k + 5] = [b.text[-1] in ".!?…:;,\"”»)" for b in blocks]
    out[:, k + 6] = ["©" in b.text for b in blocks]
    out[:, k + 7] = [min(1.0, 3 * sum(w.strip(".,:!?()").lower() in CUES for w in b.text.split()) / w) if w <= CUE_WORDS else 0 for b, w in zip(blocks, words)]
    k += SCALARS
    own, whole, at, parents = _masses(page, words)
    up = parents[at]
    total = max(words.sum(), 1)
    for j, (mass, where) in enumerate(((own, at), (whole, at), (whole, up))):
        out[:, k + 2 * j] = mass[0][where] / total
        out[:, k + 2 * j + 1] = mass[1][where] / np.maximum(mass[0][where], 1)
    out[:, k + 6] = np.minimum(np.log1p(own[2][at]) / 4, 1.5)
    out[:, k + 7] = np.minimum(np.log1p(own[0][at] / np.maximum(own[2][at], 1)) / 5, 1.5)
    out[:, k + 8], out[:, k + 9] = at == 0, up == 0
    for j, where in enumerate((at, up)):  # whether the block before and the one behind lie in the same
        same = where[1:] == where[:-1]
        out[1:, k + 10 + 2 * j], out[:-1, k + 11 + 2 * j] = same, same
    # words of the container, and of the one round it, to those of the heaviest part of what is next to it
    most = own[0].copy()
    np.maximum.at(most, parents[1:], whole[0][1:])
    beside = whole[0] / np.maximum(most[parents], 1)
    beside[0] = 1
    out[:, k + 14], out[:, k + 15] = beside[at], beside[up]
    k += CONTAINER_DIMS
    out[np.arange(n), k + np.array([b.leaf for b in blocks])] = 1
    return out


# ---- the labeller ----


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """A bidirectional LSTM with one logistic output per step. Padding comes after each sequence's end."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        h, w = HIDDEN, {}
        for d in ("f", "b"):
            w["x" + d] = r.normal(0, 0.1, (DIMS, 4 * h)).astype(np.float32)
            w["h" + d] = r.normal(0, 0.2, (h, 4 * h)).astype(np.float32)
            w["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        w["o"] = r.normal(0, 0.2, 2 * h).astype(np.float32)
        w["z"] = np.zeros(1, np.float32)
        self.w = w

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        n, steps, h = x.shape[0], x.shape[1], HIDDEN
        pre = x.reshape(n * steps, -1) @ self.w["x" + d]
        pre += self.w["c" + d]
        pre = pre.reshape(n, steps, 4 * h)
        s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.zeros((n, steps, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = pre[:, t] + s @ self.w["h" + d]
            gates, cand = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            m = mask[:, t, None]
            fresh = f * c + i * cand
            th = np.tanh(fresh)
            if keep:
                kept.append((t, s, c, i, f, o, cand, th, m))
            c = np.where(m, fresh, c)
            s = np.where(m, o * th, s)
            out[:, t] = s
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._run(x, mask, "f")
        b, _ = self._run(x, mask, "b")
        return np.concatenate([f, b], 2) @ self.w["o"] + self.w["z"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, g = HIDDEN, {k: np.zeros_like(v) for k, v in self.w.items()}
        f, kf = self._run(x, mask, "f", True)
        b, kb = self._run(x, mask, "b", True)
        both = np.concatenate([f, b], 2)
        d = np.where(mask, _sigmoid(both @ self.w["o"] + self.w["z"]) - y, 0) / max(mask.sum(), 1)
        d = d.astype(np.float32)
        g["o"], g["z"] = np.einsum("nt,nth->h", d, both), d.sum(keepdims=True)[0]
        back = d[:, :, None] * self.w["o"]
        for name, kept, outer in (("f", kf, back[:, :, :h]), ("b", kb, back[:, :, h:])):
            ds, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            for t, s0, c0, i, fg, o, cand, th, m in reversed(kept):
                ds = ds + outer[:, t]
                do = np.where(m, ds * th, 0)
                dfresh = np.where(m, dc + ds * o * (1 - th * th), 0)
                pre = np.concatenate([dfresh * cand * i * (1 - i), dfresh * c0 * fg * (1 - fg), do * o * (1 - o), dfresh * i * (1 - cand * cand)], 1)
                g["x" + name] += x[:, t].T @ pre
                g["h" + name] += s0.T @ pre
                g["c" + name] += pre.sum(0)
                ds = np.where(m, 0, ds) + pre @ self.w["h" + name].T
                dc = np.where(m, dfresh * fg, dc)
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        m, v, step = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2)), None, 0
        m, v = m
        for _ in range(epochs):
            # pages of like length share a step
            order = sorted(r.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][0]) // 8)
            groups = [order[lo : lo + 16] for lo in range(0, len(order), 16)]
            for k in r.permutation(len(groups)):
                x, mask, y = _padded([pages[i] for i in groups[k]])
                step += 1
                pace = rate * (1 - (step - 1) / (epochs * len(groups)))
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def _padded(pages: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(pages) == 1 and pages[0][1] is None:  # one page alone, however long, is not copied
        x = pages[0][0][None]
        return x, np.ones(x.shape[:2], bool), np.zeros(x.shape[:2], np.float32)
    steps = max(len(x) for x, _ in pages)
    x, mask, y = np.zeros((len(pages), steps, DIMS), np.float32), np.zeros((len(pages), steps), bool), np.zeros((len(pages), steps), np.float32)
    for i, (a, b) in enumerate(pages):
        x[i, : len(a)], mask[i, : len(a)] = a, True
        if b is not None:
            y[i, : len(a)] = b
    return x, mask, y


# ---- training pages ----

#: A mark for content while a page is laid out anew; a private character that no text has.
_MARK = "\ue000"
#: Kinds of sections, and how markup that tells names them.
_KINDS = {
    "menu": ("nav", "ul.menu", "div.nav", "div.navbar"), "header": ("header", "div.header", "div.masthead"), "sidebar": ("aside", "div.sidebar"),
    "ad": ("div.ad", "div.advert", "aside.promo", "div.sponsored"), "notice": ("div.cookie-notice", "div.notice", "div.alert", "section.consent"),
    "form": ("form", "div.newsletter", "form.search"), "footer": ("footer", "div.footer"), "comments": ("section.comments", "div.comments", "ol.comment-list"),
    "related": ("div.related", "section.related"), "share": ("div.share", "ul.social"), "crumbs": ("div.breadcrumb", "nav.breadcrumbs"),
}
_HOMES = ("article", "main", "main article", "div.main article", "article.post")
_PHRASES = ("Home", "About us", "Contact", "Log in", "Register", "Read more", "Subscribe", "Reply", "Share", "Next", "Previous", "Privacy policy", "Terms", "Menu", "Search", "Follow us")


def labelled(page: Page, repeated: frozenset[str] = frozenset()) -> np.ndarray:
    """1 for blocks of the article. By sectioning markup: in an article or main element if the page has one, and in no other
    kind of section. Without such an element: of what is left, the blocks in the deepest container with MAIN_SHARE of the
    prose, but for those in a part of it that is mostly links, mostly-link blocks, and `repeated` texts."""
    blocks = page.blocks
    home = any(b.home for b in blocks)
    y = np.array([not b.aside and (b.home or not home) for b in blocks], np.float32)
    if home or not y.any():
        return y
    words = np.array([len(b.text.split()) for b in blocks], float)
    links, parents = np.array([b.links for b in blocks]), page.parents
    main, inside = _main(page, words)
    _, whole, _, _ = _masses(page, words)
    linked = whole[1] / np.maximum(whole[0], 1) > 0.5
    for i, b in enumerate(blocks):
        c, off = b.container, False
        while c != main and inside[c]:
            off, c = off or bool(linked[c]), parents[c]
        y[i] = bool(y[i]) and inside[b.container] and not off and links[i] <= 0.5 and b.text not in repeated
    return y


class _Sheet:
    """How one page is laid out anew: what containers are called, and which end tags are left out."""

    def __init__(self, r: random.Random):
        self.r = r
        self.told = r.choice((1.0, 0.5, 0.0, 0.0))  # how often a container's name tells what it is
        self.lax = r.choice((0.0, 0.0, 0.5, 1.0))
        self.flat = r.choice(("p", "div"))
        self.bare = r.random() < 0.3  # sections of their own container only
        self.of_block = self.opaque(("div",)) if r.random() < 0.6 else "div"

    def opaque(self, tags: tuple[str, ...] = ("div", "div", "div", "section")) -> str:
        r = self.r
        name = r.choice((f"{r.choice('abcdefghkmstwx')}{r.randrange(99)}", f"css-{r.randrange(4096):x}", "box", "wrap inner", ""))
        return f"{r.choice(tags)}.{name}" if name else r.choice(tags)

    def wrap(self, kind: str, body: str) -> str:
        names = [kind] if self.r.random() < self.told else [self.opaque()]
        if self.r.random() < 0.3 and not self.bare:
            names.append(self.opaque())
        for name in reversed(names):
            tag, _, cls = name.partition(".")
            shut = "" if self.r.random() < self.lax * 0.15 else f"</{tag}>"
            body = (f'<{tag} class="{cls}">' if cls else f"<{tag}>") + body + shut
        return body

    def block(self, tag: str, body: str) -> str:
        if tag == "div" and "." in self.of_block:
            return f'<div class="{self.of_block.partition(".")[2]}">{body}</div>'
        return f"<{tag}>{body}" + ("" if tag in ("p", "li", "td") and self.r.random() < self.lax * 0.6 else f"</{tag}>")


def _section(kind: str, sheet: _Sheet, some, long, within: bool = False) -> str:
    """A section that is no part of the article; some(n) gives n words, long() a passage as articles have them. With
    `within`, it has no container of its own."""
    r, esc = sheet.r, entities.escape
    phrase = lambda: r.choice(_PHRASES) if r.random() < 0.4 else some(r.randint(1, 3))
    link = lambda t: f"<a href=/x>{esc(t)}</a>"
    if kind in ("menu", "share", "crumbs"):
        items = [phrase() for _ in range(r.randint(2, 10))]
        how = r.randrange(4)
        body = "".join(sheet.block("li", link(t)) for t in items) if how < 2 else r.choice((" | ", " &raquo; ", " ")).join(map(link, items)) if how == 2 else "".join(f"<div>{link(t)}</div>" for t in items)
        if how < 2 and r.random() < 0.7:
            body = f"<ul>{body}</ul>"
    elif kind == "header":
        body = sheet.block(r.choice(("h1", "h2", "div", "p")), link(some(r.randint(1, 4)))) + (sheet.block("p", esc(some(r.randint(3, 9)))) if r.random() < 0.5 else "")
    elif kind in ("sidebar", "related"):
        body = sheet.block(r.choice(("h2", "h3", "h4")), esc(phrase())) + "<ul>" + "".join(sheet.block("li", link(some(r.randint(2, 9)))) for _ in range(r.randint(2, 8))) + "</ul>"
        if r.random() < 0.3:
            body += sheet.block("p", esc(some(r.randint(4, 25))))
    elif kind == "ad":
        body = esc(some(r.randint(4, 40))) if r.random() < 0.6 else sheet.block("p", esc(some(r.randint(4, 30)))) + link(phrase())
        if r.random() < 0.3:
            body = "<span>Advertisement</span> " + body
    elif kind == "notice":
        body = sheet.block(r.choice(("p", "div")), esc(("We use cookies. " if r.random() < 0.4 else "") + some(r.randint(5, 30)))) + (f"<button>{esc(phrase())}</button>" if r.random() < 0.5 else link(phrase()))
    elif kind == "form":
        body = f"<label>{esc(phrase())}</label><input name=q><button>{esc(phrase())}</button>"
        if r.random() < 0.5:
            body = sheet.block("p", esc(some(r.randint(4, 16)))) + f"<form>{body}</form>"
    elif kind == "footer":
        body = sheet.block(r.choice(("p", "div")), ("&copy; " if r.random() < 0.8 else "") + esc(some(r.randint(2, 14)))) + (" | ".join(link(phrase()) for _ in range(r.randint(1, 5))) if r.random() < 0.5 else "")
        if r.random() < 0.4:
            body = "&copy; " + esc(some(r.randint(1, 3))) + " &middot; " + esc(some(r.randint(2, 8)))
    else:  # comments of readers
        body = sheet.block("h3", esc(r.choice(("Comments", "Replies", some(1)))))
        for _ in range(r.randint(1, 6)):
            who = sheet.block(r.choice(("p", "div", "h4")), link(some(r.randint(1, 2))) + (" 12:30" if r.random() < 0.5 else ""))
            said = sheet.block(r.choice(("p", "div")), esc(long() if r.random() < 0.1 else some(r.randint(2, 30))))
            body += sheet.wrap(r.choice(("div.comment", "li", "article.comment")), who + said + (link("Reply") if r.random() < 0.6 else ""))
    return body if within else sheet.wrap(r.choice(_KINDS[kind]), body)


def varied(page: Page, y: np.ndarray, r: random.Random) -> tuple[Page, np.ndarray]:
    """The page's own texts laid out anew, with labels that are known by construction."""
    inside = [b for b, k in zip(page.blocks, y) if k]
    # words of the page itself and, as it may be short, made-up ones
    bag = [w for b in page.blocks for w in b.text.split()][:BAG_WORDS] + ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(40)]
    sheet = _Sheet(r)

    def some(n: int) -> str:
        at = r.randrange(len(bag))
        t = " ".join(bag[at : at + n]) or bag[0]
        return t if n < 4 or r.random() < 0.3 else t.rstrip(".,") + "."

    def long() -> str:
        return r.choice(inside).text if inside else some(30)

    section = lambda kinds, within=False: _section(r.choice(kinds), sheet, some, long, within)
    own = []
    for i, b in enumerate(inside if inside and r.random() < 0.6 else [Block(some(r.randint(8, 80)), 0, 0, False, False, 0, 0) for _ in range(r.randint(2, 14))]):
        text = _MARK + entities.escape(b.text)
        if i == 0:
            tag = r.choice(("h1", "h1", "h2", sheet.flat)) if sheet.flat == "p" else r.choice(("h1", "div", "div"))
        else:
            tag = {2: "h2", 3: "h3", 1: "li"}.get(b.leaf) or r.choice((sheet.flat,) * 8 + ("h2", "li", "blockquote"))
        if r.random() < 0.2 and text.count(" ") > 9:  # a link of a few words
            first, second, rest = text.split(" ", 2)
            text = f"{first} <a href=y>{second}</a> {rest}"
        own.append(sheet.block(tag, f"<b>{text}</b>" if r.random() < 0.1 else text))
        if r.random() < 0.04:
            own.append(section(("ad", "related", "share", "notice")))
        if r.random() < 0.02:  # an article may say what menus and footers say
            own.append(sheet.block(sheet.flat, _MARK + " ".join(r.sample(_CUE_LIST, r.randint(1, 3))).capitalize() + "."))
    if r.random() < 0.25:  # a table of data
        own.append("<table>" + "".join("<tr>" + "".join(sheet.block("td", _MARK + entities.escape(some(r.randint(1, 4)))) for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
    main = "".join(own)
    columns = r.random() < 0.3  # of a table
    cell = columns and r.random() < 0.6  # whose cells are the containers
    for kind in () if cell else reversed(r.choice(_HOMES).split()):
        main = sheet.wrap(kind, main)
    before = [section(("menu", "menu", "header", "ad", "ad", "notice", "crumbs", "form", "sidebar"), cell) for _ in range(r.randint(0, 4))]
    after = [section(("footer", "footer", "comments", "comments", "related", "ad", "share", "form", "sidebar", "notice", "menu"), cell) for _ in range(r.randint(0, 4))]
    if columns:
        rows = [before[:1], [*before[1:3], main, *after[:1]], after[1:2]] if r.random() < 0.5 else [[*before[:3], main, *after[:2]]]
        table = "".join(sheet.block("tr", "".join(sheet.block("td", x) for x in row)) for row in rows if row)
        rest = [sheet.wrap(sheet.opaque(), x) if cell else x for x in (*before[3:], *after[2:])]
        body = f"<table>{table}" + ("" if not rest and r.random() < sheet.lax * 0.5 else "</table>") + "".join(rest)
    else:
        body = "".join([*before, main, *after])
    if r.random() < 0.3:
        body = sheet.wrap("div.page", body)
    laid = blocks_of(f"<html><head><title>{entities.escape(some(5))}</title></head><body>{body}")
    labels = np.array([_MARK in b.text for b in laid.blocks], np.float32)
    return Page([b._replace(text=b.text.replace(_MARK, "") or "-") for b in laid.blocks], laid.parents), labels


def train_labeller(pages: list[str], hosts: list[str | None] | None = None, copies: int | None = None) -> Labeller:
    """A labeller from a bounded list of pages; the same list gives the same weights. With hosts, a text that several pages
    of one host have counts as no content where markup does not tell."""
    r, data = random.Random(5), []
    parsed = [blocks_of(p) for p in pages]
    if copies is None:  # the fewer pages, the more often each is laid out anew
        copies = SEQUENCES // max(len(pages), 1) - 1
    seen: dict[str | None, Counter[str]] = {}
    for page, host in zip(parsed, hosts or ()):
        seen.setdefault(host, Counter()).update({b.text for b in page.blocks})
    for page, host in zip(parsed, hosts or [None] * len(parsed)):
        if page.blocks:
            y = labelled(page, frozenset(t for t, n in seen[host].items() if n > 1) if hosts and host else frozenset())
            data += [(page, y)] * (1 + copies // 8) + [varied(page, y, r) for _ in range(copies)]  # an eighth are pages as they are
    if not data:
        data = [varied(Page([], [0]), np.zeros(0), r) for _ in range(SEQUENCES // 4)]
    model = Labeller()
    model.train([(_vectors(page), y) for page, y in data if page.blocks])  # a page is one sequence, whatever its length
    return model


# ---- the operator ----


def _extract(batches: Iterator[pa.RecordBatch], model: Labeller) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [blocks_of(p) if p else Page([], [0]) for p in batch.column(2).to_pylist()]
        out = [""] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p.blocks), key=lambda i: len(pages[i].blocks))
        lo = 0
        while lo < len(order):
            hi = lo + 1  # as many pages as one step of 8192 blocks holds, padding included
            while hi < len(order) and hi - lo < 256 and len(pages[order[hi]].blocks) * (hi - lo + 1) <= 8192:
                hi += 1
            group = order[lo:hi]
            x, mask, _ = _padded([(_vectors(pages[i]), None) for i in group])
            content = model.scores(x, mask) > 0
            for k, i in enumerate(group):
                out[i] = " ".join(b.text for b, yes in zip(pages[i].blocks, content[k]) if yes)
            lo = hi
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def training_sample(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(html, host) of at most train_pages distinct pages: the first of each host by hash, then the second, and so on (a host
    has at most 16 slots); pages beyond train_bytes are left out of the sample."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]*:?//([^/?#]*)", 1)
    rows = pages.filter((F.octet_length("html") <= train_bytes) & (F.length("html") > 0)).select("html", host.alias("host"), F.xxhash64("html").alias("h"))
    distinct = rows.groupBy("h").agg(F.min("host").alias("host"))
    slots = distinct.groupBy("host", F.pmod("h", F.lit(16)).alias("slot")).agg(F.min("h").alias("h"))
    turn = F.row_number().over(Window.partitionBy("host").orderBy("slot"))  # 16 rows a host at most
    chosen = slots.select("h", "host", turn.alias("turn")).orderBy("turn", F.xxhash64("host"), "h").limit(train_pages).select("h")
    return rows.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min(F.struct("host", "html")).alias("p")).select("h", "p.html", "p.host")


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    sample = sorted(training_sample(pages, train_pages).collect(), key=lambda row: row["h"])
    model = train_labeller([row["html"] for row in sample], [row["host"] for row in sample])
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(lambda it: _extract(it, model), f"page_id {kinds['page_id']}, url string, text string, n_chars long")
