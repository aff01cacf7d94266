"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks (runs of text between block-level
tags), each with its tag path - tags, classes, ids and roles, hashed - its
hashed words and a few measures (length, share of linked text, ...).  A
bidirectional LSTM in numpy reads the whole sequence both ways and gives each
block a probability of belonging to the article; the page's text is the blocks
above one half, in order.

The labeller is trained here, on pages that ``sample_page`` makes up (articles
among menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, in many layouts); the number of pages is a parameter.  It runs once
on the driver in seconds; its weights, some hundred kB whatever the input, go
to the tasks with the function.

Defined results: null or empty html, or a page without a block above one half,
gives empty text; repeated pages are extracted one by one; an unfinished tag
at the end is text; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre search"
    " section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text of these is never shown.
_RAW = frozenset("script style template svg annotation annotation-xml".split())
#: A start tag closes an open element of the same set, up to the nearest container.
_IMPLIED = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_IMPLIED = {k: frozenset(v.split()) for k, v in _IMPLIED.items()}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

PATH_BUCKETS, PATH_DIM, WORD_BUCKETS, WORD_DIM, DENSE, HIDDEN = 4096, 16, 2048, 6, 8, 16


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path, text, linked):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order: path tokens, white-space-normalised text, share of linked text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links = 0, 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(t for _, tokens in stack_at[0] for t in tokens)
                out.append(Block(path, text, min(1.0, linked / len(text))))
        parts, linked = [], 0

    stack_at: list = [()]

    def add(raw: str) -> None:
        nonlocal linked
        if not parts:
            if not raw.strip():
                return
            stack_at[0] = tuple(stack)
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text)

    pos, skip = 0, 0
    n = len(page)
    while pos < n:
        m = _TAG.search(page, max(pos, skip))
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        skip = pos
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3].replace("&", "&amp;"))
            continue
        end, tag = m[1] or m[4], tag.lower()
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        block = tag in _BLOCK
        if end:
            if block:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                    break
                if not block and stack[i][0] in _BLOCK:
                    break
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = skip = stop.end() if stop else n
            continue
        if block:
            close()
            closing = _IMPLIED.get(tag, frozenset()) | ({"p"} if tag in _CLOSES_P else set())
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closing:
                        links -= sum(t == "a" for t, _ in stack[i:])
                        del stack[i:]
                        break
                    if stack[i][0] in ("div", "article", "section", "main", "table", "ul", "ol", "dl", "nav", "aside", "body", "form", "blockquote"):
                        break
        if tag in _VOID:
            continue
        attrs = m[3] if m[2] else m[6]
        stack.append((tag, (tag, *_tokens(attrs)) if attrs and attrs != "/" else (tag,)))
        links += tag == "a"
        if attrs and attrs.endswith("/") and not block:
            stack.pop()
            links -= tag == "a"
        if tag in ("title", "textarea"):
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            add(page[pos : stop.start() if stop else n])
            pos = skip = stop.start() if stop else n
    close()
    return out


@lru_cache(maxsize=20_000)
def _tokens(attrs: str) -> tuple[str, ...]:
    got = []
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        value = (a or b or c).lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            got.append("@hidden")
        elif name != "style":
            got += ("." + w for w in _WORD.findall(value))
    return tuple(dict.fromkeys(got))


@lru_cache(maxsize=50_000)
def _path_ids(path: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(sorted({zlib.crc32(t.encode()) % PATH_BUCKETS for t in path} | {zlib.crc32(("^" + t).encode()) % PATH_BUCKETS for t in path[-2:]}))


def features(bs: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path ids with row ends, word ids with row ends, dense measures."""
    paths, words, dense = [], [], np.zeros((len(bs), DENSE), np.float32)
    path_n, word_n = [], []
    for k, b in enumerate(bs):
        p = _path_ids(b.path)
        paths.extend(p)
        path_n.append(len(p))
        w = b.text.lower().encode("utf-8", "replace").split()
        words.extend(map(zlib.crc32, w))
        word_n.append(len(w))
        n = len(b.text)
        ends = b.text.count(". ") + b.text.count("? ") + b.text.count("! ") + (b.text[-1] in ".?!")
        dense[k] = (np.log1p(len(w)) / 5, np.log1p(n) / 8, b.linked, min(ends, 10) / 10, b.text[-1] in ".?!:\"”", k / max(1, len(bs) - 1), min(len(b.path), 12) / 12, b.text.count(",") / (1 + len(w)))
    return np.array(paths, np.int64), np.array(path_n), np.array(words, np.int64) % WORD_BUCKETS, np.array(word_n), dense


def _mean_rows(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(counts), table.shape[1]), np.float32)
    has = counts > 0
    if len(ids):
        starts = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
        sums[has] = np.add.reduceat(table[ids], starts, axis=0)
    return sums / np.maximum(1, counts)[:, None]


def _spread(table: np.ndarray, ids: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> None:
    """The gradient of ``_mean_rows``, added to ``table``."""
    used, at = np.unique(ids, return_inverse=True)
    part = np.zeros((len(used), len(rows)), np.float32)
    np.add.at(part, (at, np.repeat(np.arange(len(rows)), counts)), 1)
    table[used] += part @ (rows / np.maximum(1, counts)[:, None])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, a bidirectional LSTM and a logistic output."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + DENSE, HIDDEN
        g = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.w = {"path": g(PATH_BUCKETS, PATH_DIM), "word": g(WORD_BUCKETS, WORD_DIM), "out": g(2 * h + d), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.w |= {"x" + side: g(d, 4 * h), "h" + side: g(h, 4 * h), "c" + side: np.zeros(4 * h, np.float32)}
            self.w["c" + side][h : 2 * h] = 1  # remember at first

    def inputs(self, feats) -> np.ndarray:
        p, pn, w, wn, dense = feats
        return np.concatenate([_mean_rows(self.w["path"], p, pn), _mean_rows(self.w["word"], w, wn), dense], axis=1)

    def _pass(self, x, mask, side, keep):
        """x: time, batch, input -> hidden states; masked steps leave the state as it was."""
        h, (t_all, n, _) = HIDDEN, x.shape
        wx, wh, c0 = self.w["x" + side], self.w["h" + side], self.w["c" + side]
        z = x @ wx + c0
        hs, cs = np.zeros((t_all, n, h), np.float32), np.zeros((t_all, n, h), np.float32)
        gates = np.zeros((t_all, n, 4 * h), np.float32) if keep else None
        hp, cp = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(t_all) if side == "f" else range(t_all - 1, -1, -1):
            a = z[t] + hp @ wh
            s = _sigmoid(a[:, : 3 * h])
            i, f, o, u = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(a[:, 3 * h :])
            m = mask[t][:, None]
            cp = m * (f * cp + i * u) + (1 - m) * cp
            hp = m * (o * np.tanh(cp)) + (1 - m) * hp
            hs[t], cs[t] = hp, cp
            if keep:
                gates[t] = np.concatenate([i, f, o, u], axis=1)
        return hs, cs, gates

    def probabilities(self, x, mask) -> np.ndarray:
        f, b = self._pass(x, mask, "f", False)[0], self._pass(x, mask, "b", False)[0]
        return _sigmoid(np.concatenate([f, b, x], axis=2) @ self.w["out"] + self.w["bias"])

    def gradients(self, x, mask, y) -> tuple[dict, np.ndarray]:
        """Gradients of the mean cross entropy, and of the inputs."""
        h = HIDDEN
        states = {s: self._pass(x, mask, s, True) for s in "fb"}
        top = np.concatenate([states["f"][0], states["b"][0], x], axis=2)
        delta = (_sigmoid(top @ self.w["out"] + self.w["bias"]) - y) * mask / mask.sum()
        g = {"out": np.einsum("tn,tnk->k", delta, top), "bias": np.array([delta.sum()], np.float32)}
        back = delta[:, :, None] * self.w["out"]
        dx = back[:, :, 2 * h :].copy()
        for k, side in enumerate("fb"):
            hs, cs, gates = states[side]
            wx, wh = self.w["x" + side], self.w["h" + side]
            t_all, n, _ = x.shape
            dz = np.zeros((t_all, n, 4 * h), np.float32)
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            order = range(t_all - 1, -1, -1) if side == "f" else range(t_all)
            zero = np.zeros((n, h), np.float32)
            prev_h = np.concatenate([zero[None], hs[:-1]]) if side == "f" else np.concatenate([hs[1:], zero[None]])
            prev_c = np.concatenate([zero[None], cs[:-1]]) if side == "f" else np.concatenate([cs[1:], zero[None]])
            for t in order:
                m = mask[t][:, None]
                dh_all = dh + back[t][:, k * h : (k + 1) * h]
                i, f, o, u = (gates[t][:, j * h : (j + 1) * h] for j in range(4))
                th = np.tanh(cs[t])
                do, dct = dh_all * m * th, dc + dh_all * m * o * (1 - th * th)
                dcm = dct * m
                dz[t] = np.concatenate([dcm * u * i * (1 - i), dcm * prev_c[t] * f * (1 - f), do * o * (1 - o), dcm * i * (1 - u * u)], axis=1)
                dh = dz[t] @ wh.T + dh_all * (1 - m)
                dc = dcm * f + dct * (1 - m)
            flat = dz.reshape(-1, 4 * h)
            g["x" + side] = x.reshape(-1, x.shape[2]).T @ flat
            g["h" + side] = prev_h.reshape(-1, h).T @ flat
            g["c" + side] = dz.sum(axis=(0, 1))
            dx += dz @ wx.T
        return g, dx


def _padded(rows: list[np.ndarray]):
    t = max(map(len, rows))
    x = np.zeros((t, len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros((t, len(rows)), np.float32)
    for j, r in enumerate(rows):
        x[: len(r), j], mask[: len(r), j] = r, 1
    return x, mask


def train(pages: int = 800, epochs: int = 10, seed: int = 5) -> Labeller:
    """Fit the labeller to made-up pages (``pages`` bounds the sample)."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, main = sample_page(rng)
        bs = blocks(page)
        if bs:
            data.append((features(bs), np.array([b.text in main for b in bs], np.float32)))
    net = Labeller(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(data))
        for i in range(0, len(order), 32):
            part = [data[j] for j in order[i : i + 32]]
            x, mask = _padded([net.inputs(f) for f, _ in part])
            y = np.zeros_like(mask)
            for j, (_, t) in enumerate(part):
                y[: len(t), j] = t
            g, dx = net.gradients(x, mask, y)
            g |= {"path": np.zeros_like(net.w["path"]), "word": np.zeros_like(net.w["word"])}
            for j, ((p, pn, w, wn, _), _) in enumerate(part):
                d = dx[: len(pn), j]
                _spread(g["path"], p, pn, d[:, :PATH_DIM])
                _spread(g["word"], w, wn, d[:, PATH_DIM : PATH_DIM + WORD_DIM])
            step += 1
            for k, w in net.w.items():  # Adam
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


#: Names seen on each kind of element; fixed values.
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links pager pagination tabs toc skip".split(),
    "header": "header masthead site topbar logo branding banner head title tagline".split(),
    "footer": "footer foot bottom copyright legal colophon sitemap".split(),
    "aside": "sidebar aside widget related recommended trending popular rail teaser more sticky".split(),
    "notice": "cookie consent notice gdpr alert banner overlay modal popup newsletter subscribe paywall privacy toast".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner commercial adsense outbrain".split(),
    "form": "form search login signup contact input field register poll feedback".split(),
    "comments": "comments comment reply replies discussion respond responses thread disqus reader user".split(),
    "share": "share social buttons tags meta toolbar author byline actions".split(),
    "main": "content article post entry story body main text page prose blog single hentry copy".split(),
    "plain": "row col container wrap wrapper inner box block grid layout group unit section left right".split(),
}
CUES = {
    "nav": "home about contact menu news sports login start kontakt accueil inicio".split(),
    "footer": "copyright all rights reserved terms privacy impressum imprint ©".split(),
    "notice": "we use cookies accept consent subscribe newsletter cookies akzeptieren accepter aceptar".split(),
    "ad": "advertisement sponsored buy now offer sale anzeige publicité publicidad".split(),
    "form": "search send submit email password name your message".split(),
    "comments": "reply says wrote like report great thanks agree comment ago".split(),
    "share": "share tweet facebook tags posted by".split(),
}


def sample_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A made-up page and the texts of its article blocks."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    syllables = ["".join(chr(int(c)) for c in rng.integers(97, 123, int(rng.integers(1, 4)))) for _ in range(40)]
    main: set[str] = set()

    def word() -> str:
        return "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def sentence(lo: int, hi: int, cues=()) -> str:
        ws = [pick(cues) if cues and chance(0.3) else word() for _ in range(int(rng.integers(lo, hi)))]
        return " ".join(ws).capitalize() + ("." if chance(0.85) else "")

    def attrs(kind: str, p: float = 0.8) -> str:
        if not chance(p):
            return ""
        join = pick(["-", "_", " "])
        names = [pick(NAMES[kind])] + ([pick(NAMES["plain"])] if chance(0.4) else []) + ([word()] if chance(0.3) else [])
        rng.shuffle(names)
        return f' {pick(["class", "class", "id"])}="{join.join(names)}"'

    def keep(text: str) -> str:
        text = " ".join(text.split())
        main.add(text)
        if chance(0.15):
            a = text.split(" ")
            k = int(rng.integers(len(a)))
            t = pick(["b", "i", "em", "strong", "span", "code"])
            a[k] = f"<{t}>{a[k]}</{t}>"
            if chance(0.5):
                j = int(rng.integers(len(a)))
                if j != k:
                    a[j] = f'<a href="/{word()}">{a[j]}</a>'
            return " ".join(a)
        return text

    def listing(kind: str, lo=2, hi=8) -> str:
        items = "".join(f'<li{attrs(kind, 0.1)}><a href="/{word()}">{sentence(1, 4, CUES.get(kind, ()))}</a></li>' for _ in range(int(rng.integers(lo, hi))))
        return f"<{(t := pick(['ul', 'ol', 'ul']))}>{items}</{t}>"

    def prose(kind: str, lo=1, hi=4) -> str:
        return "".join(f"<p>{sentence(3, 30, CUES.get(kind, ()))}</p>" if chance(0.6) else f"<{(t := pick(['div', 'span', 'h3', 'h4', 'div']))}>{sentence(2, 20, CUES.get(kind, ()))}</{t}>" for _ in range(int(rng.integers(lo, hi))))

    def boiler(kind: str) -> str:
        tag = {"nav": ["nav", "div", "ul", "nav"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"], "aside": ["aside", "div", "section", "aside"], "notice": ["div", "section", "aside", "noscript", "dialog"], "ad": ["div", "aside", "section", "div"], "form": ["form"], "comments": ["section", "div", "ul", "aside"], "share": ["div", "ul", "p", "footer"]}[kind]
        tag = pick(tag)
        named = attrs(kind, 0.4 if tag in ("nav", "footer", "header", "aside", "form", "noscript") else 1.0)
        if kind in ("nav", "header") and chance(0.8):
            inner = (f"<{(t := pick(['h1', 'div', 'p', 'a', 'span']))}>{sentence(1, 5, CUES['nav'])}</{t}>" if kind == "header" else "") + (listing("nav") if chance(0.8) else prose(kind, 1, 2))
        elif kind == "form":
            inner = "".join(f"<label>{sentence(1, 4, CUES['form'])}</label><input type=text>" for _ in range(int(rng.integers(1, 4)))) + f"<{(t := pick(['button', 'textarea', 'legend', 'p']))}>{sentence(1, 6, CUES['form'])}</{t}>" + (f"<select><option>{word()}<option>{word()}</select>" if chance(0.3) else "")
        elif kind == "comments":
            inner = f"<h3>{sentence(1, 3, CUES[kind])}</h3>" + "".join(f"<{(t := pick(['div', 'li', 'article', 'p']))}{attrs('comments', 0.6)}>" + (f"<span>{word()}</span>" if chance(0.4) else "") + f"<p>{sentence(3, 45, CUES[kind])} {sentence(3, 30)}</p></{t}>" for _ in range(int(rng.integers(1, 6))))
        else:
            inner = listing(kind) if chance(0.35) else prose(kind)
            if kind == "footer" and chance(0.6):
                inner += f"&copy; {sentence(2, 8, CUES['footer'])}"
            if kind in ("ad", "notice", "footer") and chance(0.4):
                inner = sentence(3, 25, CUES[kind])
        if chance(0.15):
            named += pick([" hidden", ' style="display:none"']) if kind == "notice" else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    def article() -> str:
        parts = []
        broken = chance(0.3)
        if chance(0.85):
            t = pick(["h1", "h1", "h1", "h2"])
            parts.append(f"<{t}>{keep(sentence(2, 12))}</{t}>")
            if chance(0.2):
                parts[-1] = f"<header>{parts[-1]}</header>"
        for _ in range(int(rng.integers(1, 12))):
            kind = rng.random()
            cues = CUES[pick(list(CUES))] if chance(0.15) else ()  # articles use such words too
            text = sentence(2, 6, cues) if chance(0.15) else " ".join(sentence(3, 25, cues) for _ in range(int(rng.integers(1, 7))))
            if kind < 0.72:
                body = keep(text)
                if broken and chance(0.4):
                    parts.append(f"<p><b>{body}<br>" if chance(0.6) else f"<p>{body}")
                else:
                    parts.append(f"<p>{body}</p>")
            elif kind < 0.8:
                parts.append(f"<{(t := pick(['h2', 'h3', 'h4']))}>{keep(sentence(1, 8))}</{t}>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{keep(sentence(2, 18))}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{keep(text)}</p></blockquote>" if chance(0.6) else f"<pre>{keep(sentence(2, 15))}</pre>")
            elif kind < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{keep(sentence(1, 4))}<td>{keep(sentence(1, 4))}" for _ in range(2)) + "</table>")
            elif kind < 0.95:
                parts.append(f"<div{attrs('plain', 0.5)}>{keep(text)}</div>")
            else:
                parts.append(boiler(pick(["ad", "share", "aside", "notice", "form", "ad"])))
        if chance(0.15):
            parts.append(boiler(pick(["share", "comments", "footer", "nav"])))
        inner = "".join(parts)
        shape = rng.random()
        if shape < 0.5:
            return f"<article{attrs('main', 0.4)}>{inner}</article>"
        if shape < 0.7:
            return f"<main{attrs('main', 0.4)}>{inner}" + (boiler("comments") if chance(0.15) else "") + "</main>"
        if shape < 0.8:
            return f"<main><article>{inner}</article>" + (boiler(pick(["comments", "aside"])) if chance(0.3) else "") + "</main>"
        return f"<div{attrs('main', 1.0)}>{inner}</div>"

    before = [boiler(pick(["nav", "header", "header", "notice", "ad", "form", "nav"])) for _ in range(int(rng.integers(0, 5)))]
    after = [boiler(pick(["aside", "comments", "footer", "ad", "notice", "form", "nav", "footer"])) for _ in range(int(rng.integers(0, 5)))]
    body = "".join(before) + (article() if chance(0.97) else "") + "".join(after)
    if chance(0.35):
        body = f"<div{attrs('plain', 0.8)}>{body}</div>"
    title = f"<title>{sentence(2, 10)}</title>"
    return f"<!DOCTYPE html><html><head>{title}<style>p{{margin:0}}</style></head><body>{body}<script>var a=\"<p>x</p>\";</script></body></html>", main


@lru_cache(maxsize=2)
def labeller(pages: int = 800, epochs: int = 10, seed: int = 5) -> Labeller:
    return train(pages, epochs, seed)


def extract(pages: list[str | None], net: Labeller, steps: int = 20_000) -> list[str]:
    """Main text of each page; pages of like length run together, ``steps`` blocks at most (or one page)."""
    parsed = [blocks(p or "") for p in pages]
    out = ["" for _ in pages]
    order = sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * len(parsed[order[j]]) <= steps:
            j += 1
        part = order[i:j]
        x, mask = _padded([net.inputs(features(parsed[k])) for k in part])
        p = net.probabilities(x, mask)
        for col, k in enumerate(part):
            out[k] = "\n".join(b.text for t, b in enumerate(parsed[k]) if p[t, col] > 0.5)
        i = j
    return out


def _extract(batches, net: Labeller):
    for batch in batches:
        pages, start, held = batch["html"], 0, 0
        sizes = [len(x.as_py() or "") if x.is_valid else 0 for x in pages]
        for i, n in enumerate([*sizes, 0]):
            held += n
            if i == len(sizes) or held > 4_000_000:
                stop = min(i + 1, len(sizes))
                texts = extract(pages.slice(start, stop - start).to_pylist(), net)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])
                start, held = stop, 0


def main_text(pages: DataFrame, **training) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(partial(_extract, net=labeller(**training)), "page_id long, url string, text string, n_chars long")
