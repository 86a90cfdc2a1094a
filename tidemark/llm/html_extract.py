"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the text between two tags of block elements. Each leaf of that sequence is a vector of its hashed tag path
(names, classes, ids and roles of its open elements), of its hashed words, and of a few measures (length, share of linked text, place). A bidirectional
LSTM in numpy reads the whole sequence, so that a block's label depends on the whole page, and gives each block the probability of being main text.

The labeller is trained by train() on pages made up here, from a seed: articles under many layouts with menus, headers, footers, sidebars, notices, adverts,
forms and reader comments. Its weights lie in block_labeller.npz beside this file. Whole texts are kept: nothing is cut off or capped. A null or empty page
gives an empty text; rows are independent, so repeated rows and ids give repeated results. Broken markup is read as far as it goes: scripts, styles, text areas and
titles without an end run to the page's end, as in browsers; drawings and lists of options end at the next block at the latest; frames, templates and what stands in for
scripts are passed over only if they end. The texts of formulas and embedded objects count as text. White space is all that Unicode names so, no-break spaces included.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, HIDDEN = 96, 32, 16
WEIGHTS = Path(__file__).with_name("block_labeller.npz")

# quoted values without angle brackets end at the next > at the latest; other tags go through _end_of_tag
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^"'>]|"[^"<>]*"|'[^'<>]*')*+)>)?""", re.S)
_UNQUOTED = re.compile(r"""[^"'>]*""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe".split())
#: Of these, what is passed over only if it ends.
_IF_CLOSED = {"noscript", "template", "iframe"}
_BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Drawings and lists of options end with their element, or where a block shows that they were left open.
_IN_SELECT = {"option", "optgroup", "hr", "legend"}
_REGION = {"svg": re.compile(rf"<(/?)(svg)(?=[\s/>])|<()({'|'.join(sorted(_BLOCK))})(?=[\s/>])", re.I), "select": re.compile(rf"<(/?)(select)(?=[\s/>])|<(/?)({'|'.join(sorted(_BLOCK - _IN_SELECT))})(?=[\s/>])", re.I)}
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
#: Start tags that end an open element of these names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _end_of_tag(page: str, at: int, failed: set[int]) -> int:
    """Place of the > that ends a tag, not counting those in quotes; if all are in quotes, the next one; the page's end without one.

    failed: gets the opening quotes from which no such > was found, so that no stretch is read again and again.
    """
    start, seen = at, []
    while True:
        at = _UNQUOTED.match(page, at).end()
        if at < len(page) and page[at] == ">":
            return at
        close = -1 if at == len(page) or at in failed else page.find(page[at], at + 1)
        if close < 0:
            break
        seen.append(at)
        at = close + 1
    failed.update(seen)
    failed.add(at)
    end = page.find(">", start)
    return len(page) if end < 0 else end


def _end_of_region(page: str, name: str, at: int) -> int:
    """Where a drawing or a list of options that was opened before at ends."""
    depth = 1
    for m in _REGION[name].finditer(page, at):
        if m[2] is None:  # a block
            return m.start()
        end = page.find(">", m.end())
        end = len(page) if end < 0 else end
        if m[1] or name == "select":
            depth -= 1
        elif page[end - 1] != "/":
            depth += 1
        if not depth:
            return min(end + 1, len(page)) if m[1] else m.start()
    return len(page)


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, tag path, characters inside links) of each block, in page order. A path is a bit mask of the hashed tokens of the open elements."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int]] = []  # name, path down to it
    nested: list[int] = []  # places of the block elements in the stack
    opened: Counter = Counter()
    failed: set[int] = set()
    endless: set[str] = set()
    text: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((joined, stack[-1][1] if stack else 0, linked))
            text, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            piece = entities.unescape(raw) if "&" in raw else raw
            text.append(piece)
            if opened["a"]:
                linked += len(piece)

    def cut(k: int) -> None:
        """Close all elements from place k on."""
        while len(stack) > k:
            opened[stack.pop()[0]] -= 1
        while nested and nested[-1] >= k:
            nested.pop()

    while (m := _TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        name, closing, rest = m[2].lower(), bool(m[1]), m[3]
        if rest is None:
            end = _end_of_tag(page, at, failed)
            rest, at = page[at:end], min(end + 1, len(page))
        if name == "br":
            text.append(" ")
        if closing:
            if opened[name]:
                if name in _BLOCK:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                cut(k)
            elif name in _BLOCK:
                flush()
            continue
        if name in _RAW and not rest.endswith("/") and name not in endless:
            end = _RAW_END[name].search(page, at)
            if end is None and name in _IF_CLOSED:
                endless.add(name)  # nor is there an end further on
            else:
                at = end.end() if end else len(page)
            continue
        if name in _REGION and not rest.endswith("/"):
            at = _end_of_region(page, name, at)
            continue
        if name in _BLOCK:
            flush()
            if nested and (stack[nested[-1]][0] == "p" or stack[nested[-1]][0] in _ENDS.get(name, ())):
                cut(nested[-1])
        if name in _VOID or rest.endswith("/"):
            continue
        path = (stack[-1][1] if stack else 0) | 1 << _path_buckets[name]
        for a in _ATTRIBUTE.finditer(rest) if "=" in rest else ():
            for t in _TOKEN.findall((a[2] or a[3] or a[4] or "").lower()):
                path |= 1 << _path_buckets[f"{a[1].lower()}.{t}" if a[1].lower() == "role" else f".{t}"]
        if name in _BLOCK:
            nested.append(len(stack))
        stack.append((name, path))
        opened[name] += 1
    add(page[at:])
    flush()
    return out


class _Buckets(dict):
    """token -> hash modulo n; keeps up to 200,000 tokens."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, token: str) -> int:
        h = crc32(token.encode()) % self.n
        if len(self) < 200_000:
            self[token] = h
        return h


_path_buckets, _word_buckets = _Buckets(PATH_DIM), _Buckets(WORD_DIM)


def features(page: list[tuple[str, int, int]]) -> np.ndarray:
    """A row for each block."""
    rows = len(page)
    x = np.zeros((rows, PATH_DIM + WORD_DIM + 8), dtype=np.float32)
    total = sum(len(t) for t, *_ in page) or 1
    before = 0
    hashed: list[int] = []
    lengths = []
    measures = []
    bucket = _word_buckets.__getitem__
    for k, (text, _, linked) in enumerate(page):
        words = text.split(" ")
        hashed += map(bucket, words)
        lengths.append(len(words))
        n = len(text)
        measures.append((len(words), n, min(1, linked / n), n / total, before / total, k / rows, text[-1] in ".!?:;…»”\"", text.count(".") / (len(words) + 1)))
        before += n
    if rows:
        paths = b"".join(path.to_bytes(PATH_DIM // 8, "little") for _, path, _ in page)
        x[:, :PATH_DIM] = np.unpackbits(np.frombuffer(paths, dtype=np.uint8).reshape(rows, -1), axis=1, bitorder="little")
    count = np.array(lengths)
    got = np.bincount(np.repeat(np.arange(rows) * WORD_DIM, count) + np.array(hashed), minlength=rows * WORD_DIM).reshape(rows, WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = got / count[:, None]
    more = np.array(measures, dtype=float)
    more[:, 0], more[:, 1] = np.log1p(more[:, 0]) / 6, np.log1p(more[:, 1]) / 8
    x[:, PATH_DIM + WORD_DIM :] = more
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Forward and backward LSTM over blocks, and a logistic output."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 0) -> None:
        rng, d, h = np.random.default_rng(seed), PATH_DIM + WORD_DIM + 8, HIDDEN
        self.w = weights or {k: v.astype(np.float32) for k, v in {"xf": rng.normal(0, 0.15, (d, 4 * h)), "hf": rng.normal(0, 0.15, (h, 4 * h)), "bf": np.zeros(4 * h), "xb": rng.normal(0, 0.15, (d, 4 * h)), "hb": rng.normal(0, 0.15, (h, 4 * h)), "bb": np.zeros(4 * h), "o": rng.normal(0, 0.15, 2 * h), "c": np.zeros(1)}.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """x: steps, pages, features. Padded steps leave the state as it is (zero at the backward start)."""
        n, pages, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
        into = x @ self.w["x" + way] + self.w["b" + way]
        out, kept = np.zeros((n, pages, HIDDEN), dtype=np.float32), []
        for t in range(n) if way == "f" else range(n - 1, -1, -1):
            z = into[t] + h @ self.w["h" + way]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            s = np.tanh(c_new)
            kept.append((t, h, c, i, f, o, g, s, m))
            h, c = np.where(m, o * s, h), np.where(m, c_new, c)
            out[t] = h
        return out, kept

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["c"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        of, kf = self._run(x, mask, "f")
        ob, kb = self._run(x, mask, "b")
        both = np.concatenate([of, ob], axis=2)
        p = _sigmoid(both @ self.w["o"] + self.w["c"])
        n = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        d = (mask * (p - y) / n).astype(np.float32)
        g = {"o": np.einsum("tp,tph->h", d, both), "c": np.array([d.sum()], dtype=np.float32)}
        for way, kept, part in (("f", kf, slice(0, HIDDEN)), ("b", kb, slice(HIDDEN, 2 * HIDDEN))):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            gh = np.zeros_like(self.w["h" + way])
            dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            for t, h0, c0, i, f, o, gg, s, m in reversed(kept):
                dh_t = dh + d[t][:, None] * self.w["o"][part]
                dc_t = dc + dh_t * o * (1 - s * s)
                dz = np.concatenate([dc_t * gg * i * (1 - i), dc_t * c0 * f * (1 - f), dh_t * s * o * (1 - o), dc_t * i * (1 - gg * gg)], axis=1) * m
                dz_all[t] = dz
                gh += h0.T @ dz
                dh = np.where(m, dz @ self.w["h" + way].T, dh_t)
                dc = np.where(m, dc_t * f, dc)
            g["h" + way] = gh
            g["x" + way] = np.einsum("tpd,tpz->dz", x, dz_all, optimize=True)
            g["b" + way] = dz_all.sum(axis=(0, 1))
        return loss, g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(p) for p in pages)
    x = np.zeros((n, len(pages), PATH_DIM + WORD_DIM + 8), dtype=np.float32)
    mask = np.zeros((n, len(pages)), dtype=bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def main_texts(labeller: Labeller, pages: list[str | None], cell: int = 4096) -> list[str]:
    """The main text of each page. Pages of like length are read together, about cell blocks at a time."""
    cut = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = [k for k in sorted(range(len(cut)), key=lambda k: len(cut[k])) if cut[k]]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(cut[order[hi]]) <= cell:
            hi += 1
        some = order[lo:hi]
        p = labeller.predict(*_padded([features(cut[k]) for k in some]))
        for j, k in enumerate(some):
            out[k] = "\n".join(b[0] for b, q in zip(cut[k], p[:, j]) if q >= 0.5)
        lo = hi
    return out


# --- pages made up for training ---------------------------------------------------------------------------------------


def made_up_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page and the texts of its main blocks, in order."""
    alphabet = [list("aeiou"), list("aeiouäöü"), list("aeiouéèà"), list("аеиоу"), list("aeiouóíñ")][rng.integers(5)]
    consonants = list("bcdfghklmnprstvw") if alphabet[0] == "a" else list("бвгдклмнпрст")
    syllables = ["".join((rng.choice(consonants), rng.choice(alphabet), rng.choice(["", "", "n", "s", "r"]) if alphabet[0] == "a" else "")) for _ in range(60)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.integers(1, 4)))
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.integers(lo, hi + 1)))

    def sentence() -> str:
        return words(1, 14).capitalize() + pick(".", ".", ".", "!", "?", ",", "")

    def prose(lo: int = 1, hi: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.integers(lo, hi + 1)))

    main: list[str] = []

    def own(text: str) -> str:
        main.append(text)
        return text

    def links(n: int) -> str:
        style = rng.integers(3)
        items = [f'<a href="/{k}">{words(1, 3)}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if style == 0 else pick(" | ", " ", " · ").join(items) if style == 1 else "".join(f"<div>{i}</div>" for i in items)

    def boiler(kind: str) -> str:
        n = rng.integers(1, 8)
        if kind == "nav":
            return pick(f"<nav>{links(n)}</nav>", f'<div class="{pick("menu", "nav", "navbar", "navigation", "topnav")}">{links(n)}</div>', f'<ul id="menu">{"".join(f"<li><a href=#>{words(1, 2)}</a></li>" for _ in range(n))}</ul>')
        if kind == "header":
            return pick(f"<header><a href='/'>{words(1, 3)}</a><p>{words(2, 8)}</p></header>", f'<div class="{pick("header", "masthead", "site-header", "banner", "logo")}">{words(1, 6)}</div>', f"<header><h1>{words(1, 4)}</h1>{boiler('nav')}</header>")
        if kind == "footer":
            t = f"&copy; {words(1, 3)} {pick('', '&middot; ' + prose(1, 3), 'All rights reserved.')}"
            return pick(f"<footer>{t}</footer>", f'<div class="{pick("footer", "site-footer", "copyright", "bottom")}"><p>{t}</p>{links(n) if chance(0.5) else ""}</div>', f'<footer><p>{t}</p><p>{prose(1, 3)}</p></footer>')
        if kind == "ad":
            return f'<{(e := pick("div", "section", "aside", "ins", "p"))} {pick("class", "id")}="{pick("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "adsbygoogle", "banner-ad")}">{pick("", "<p>")}{prose(1, 3)}</{e}>'
        if kind == "side":
            body = pick(links(n), f"<h3>{words(1, 4)}</h3>{links(n)}", f"<h2>{words(1, 4)}</h2><p>{prose(1, 4)}</p>", f"<p>{prose(1, 3)}</p>")
            return pick(f"<aside>{body}</aside>", f'<div class="{pick("sidebar", "side", "widget", "related", "related-posts", "recommended", "more", "teaser")}">{body}</div>', f'<section id="{pick("sidebar", "related", "trending")}">{body}</section>')
        if kind == "notice":
            return f'<div {pick("class", "id")}="{pick("cookie", "cookie-notice", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer")}"{pick("", " role=dialog", " role=alert")}><p>{prose(1, 3)}</p>{pick("", f"<button>{words(1, 2)}</button>")}</div>'
        if kind == "form":
            return f'<form{pick("", " class=search", " id=login", " class=signup")}>{pick("", f"<p>{prose(1, 2)}</p>")}<label>{words(1, 3)}</label><input type=text>{pick("", f"<select><option>{words(1, 2)}</option></select>")}<button>{words(1, 2)}</button></form>'
        if kind == "comments":
            each = [pick(f'<div class="comment"><span class="author">{words(1, 2)}</span><p>{prose(1, 4)}</p></div>', f"<li><p>{words(1, 2)}</p><p>{prose(1, 4)}</p></li>", f'<article class="comment"><p>{prose(1, 4)}</p></article>') for _ in range(rng.integers(1, 6))]
            return f'<{(e := pick("div", "section", "ol"))} {pick("class", "id")}="{pick("comments", "comment-list", "commentlist", "responses", "discussion", "replies", "reader-comments")}">{pick("", f"<h2>{words(1, 3)}</h2>", f"<h3>{words(1, 3)}</h3>")}{"".join(each)}</{e}>'
        if kind == "share":
            return f'<div class="{pick("share", "social", "share-buttons", "tags", "breadcrumb", "breadcrumbs", "pagination", "pager")}">{links(n)}</div>'
        raise ValueError(kind)

    def block() -> str:
        r = rng.random()
        if r < 0.68:
            t = own(prose(1, rng.integers(1, 12)))
            if chance(0.1):
                return f"<p><b>{t}<br>"
            if chance(0.15):
                a, _, b = t.partition(" ")
                return f"<p>{a} <{(e := pick('b', 'i', 'em', 'strong', 'span'))}>{b}</{e}></p>" if b else f"<p>{a}</p>"
            if chance(0.1):
                a, _, b = t.partition(" ")
                return f'<p>{a} <a href="/x">{b}</a></p>' if b and chance(0.5) else f"<p>{t}</p>"
            return f"<p>{t}" + pick("</p>", "</p>", "</p>", "")
        if r < 0.78:
            e = pick("h2", "h3", "h2", "h4")
            return f"<{e}>{own(words(1, 8).capitalize())}</{e}>"
        if r < 0.85:
            return "<ul>" + "".join(f"<li>{own(prose(1, 2))}</li>" for _ in range(rng.integers(1, 5))) + "</ul>"
        if r < 0.9:
            return f"<blockquote>{pick('<p>', '')}{own(prose(1, 3))}</blockquote>"
        if r < 0.93:
            return f"<pre>{own(words(2, 12))}</pre>"
        if r < 0.96:
            return "<table>" + "".join(f"<tr><td>{own(words(1, 3))}</td><td>{own(words(1, 4))}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>"
        return f"<figure><img src=x><figcaption>{own(prose(1, 1))}</figcaption></figure>"

    parts = [f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"]
    for kind in ("notice", "header", "nav", "share", "ad", "form", "side"):
        if chance({"nav": 0.8, "header": 0.5, "ad": 0.4}.get(kind, 0.25)):
            parts.append(boiler(kind))
    shape = rng.integers(10)
    wrap = ["<article>", "<article>", "<article>", "<main>", "<main><article>", f'<div class="{pick("content", "article", "post", "entry", "story", "article-body", "post-content", "entry-content", "main", "text")}">', f'<div id="{pick("content", "main", "article", "story", "body")}">', '<section class="article">', '<div role="main">', "<div>"][shape]
    close = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", wrap)))
    parts.append(wrap)
    if chance(0.8):
        parts.append(pick(f"<h1>{(t := own(words(2, 12).capitalize()))}</h1>", f"<header><h1>{t}</h1></header>") if chance(0.9) else f"<h2>{own(words(2, 10))}</h2>")
    for k in range(rng.integers(1, 16)):
        parts.append(block())
        if chance(0.06):
            parts.append(boiler(pick("ad", "side", "share", "notice", "form")))
    if chance(0.15):
        parts.append(boiler("comments"))
    parts.append(close)
    for kind in ("share", "side", "comments", "form", "ad", "notice", "nav", "footer"):
        if chance({"footer": 0.9, "comments": 0.35}.get(kind, 0.2)):
            parts.append(boiler(kind))
    parts.append("</body></html>" if chance(0.9) else "")
    return "".join(parts), main


def labelled_page(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, list, list[str]]:
    page, main = made_up_page(rng)
    cut, y, at = blocks(page), [], 0
    for text, *_ in cut:
        hit = at < len(main) and text == " ".join(main[at].split())
        at += hit
        y.append(float(hit))
    return features(cut), np.array(y, dtype=np.float32), cut, main


def train(pages: int = 3000, epochs: int = 5, batch: int = 32, seed: int = 11) -> Labeller:
    """A labeller trained from scratch; the same seed gives the same weights."""
    rng = np.random.default_rng(seed)
    data = [d for d in (labelled_page(rng) for _ in range(pages)) if len(d[0])]
    net = Labeller(seed=seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    step = 0
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(data)), len(data) // batch):
            x, mask = _padded([data[k][0] for k in some])
            y = np.zeros(mask.shape, dtype=np.float32)
            for j, k in enumerate(some):
                y[: len(data[k][1]), j] = data[k][1]
            _, g = net.gradients(x, mask, y)
            step += 1
            rate = 0.006 * (0.5**epoch)
            for k in net.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def load() -> Labeller:
    with np.load(WEIGHTS) as f:
        return Labeller(dict(f))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of pages."""
    weights = load().w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller(weights)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                texts = main_texts(net, b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


QUERY = lambda spark, sf_dir: extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **train().w)
