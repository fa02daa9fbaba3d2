"""Main text of web pages by a recurrent block labeller.

A page is read once into leaf blocks: runs of text between block-level tags, each with its tag path.
A bidirectional long short-term memory network reads, for the whole sequence, the hashed tag path
(tags, classes, ids), the hashed words and a few measures of every block, and labels each block as
article or not. It is trained in numpy on pages from a page grammar (menus, headers, footers, sidebars,
notices, adverts, forms, comments around an article), so nothing of the given pages is learned.

Defined cases: null or blank html gives empty text; pages without blocks, too; markup that is wrongly nested or
unquoted is read as it comes; a tag whose quotes never close ends at its first >, and so do all tags after it; what
looks like a tag but never ends is text; an element whose content is passed over (a script, a drawing) and that is
not closed ends with the element around it; an unclosed comment goes to the page's end. Very long pages are read
whole, in time in proportion to their length; repeated rows are labelled each; an empty table gives no rows. Columns
other than id, url and html are not read.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import through

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
WORD = re.compile(r"\w+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img nobr ruby rt rp math mi mn mo mrow msup msub".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is no text of the page; in the latter only if they are closed.
RAW = frozenset("script style title textarea iframe noframes xmp".split())
SKIPPED = RAW | frozenset("select datalist template noscript svg object audio video canvas".split())
DEEPEST = 100  # elements nested deeper count as part of the one around
#: A start tag closes these open ones, up to the next container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

PATHS, WORDS = 4096, 4096
P_DIM, W_DIM, MEASURES, HID = 12, 6, 8, 16
X_DIM = 2 * P_DIM + W_DIM + MEASURES


def code(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


def names_of(attributes: str) -> list[str]:
    """Words in the class, id and role, each once."""
    found = [a or b or c for a, b, c in ATTRIBUTE.findall(attributes)] if "=" in attributes else []
    return list(dict.fromkeys(w.lower() for n in found for w in NAME_PART.findall(n)))


@lru_cache(maxsize=20_000)
def cached(tag: str, attributes: str) -> tuple[int, ...]:
    return (code("<" + tag, PATHS), *(code("." + w, PATHS) for w in names_of(attributes)))


def element(tag: str, attributes: str) -> tuple[int, ...]:
    """Hashes of the tag and of the words in its class, id and role."""
    return (cached if len(attributes) < 300 else cached.__wrapped__)(tag, attributes)


class Tags:
    """Reads the tags of a page from left to right; no part of it is scanned again and again."""

    def __init__(self, page: str):
        self.page, self.last, self.quoted, self.ends = page, page.rfind(">"), True, None

    def end_of(self, at: int) -> int:
        """Place of the > that ends the tag whose name ends at `at`; quotes may hold others."""
        if self.quoted:
            i = at
            while m := STOP.search(self.page, i):
                if m[0] == ">":
                    return m.start()
                i = self.page.find(m[0], m.end()) + 1
                if not i:
                    break
            self.quoted = False
        return self.page.find(">", at)

    def next_end(self, tag: str, at: int) -> int:
        """Place of the next end tag of that name, or the page's size."""
        if self.ends is None:
            self.ends = {}
            for m in END_TAG.finditer(self.page):
                self.ends.setdefault(m[1].lower(), []).append(m.start())
        own = self.ends.get(tag, [])
        i = bisect_left(own, at)
        return own[i] if i < len(own) else len(self.page)

    def after(self, tag: str, around: str | None, at: int) -> int | None:
        """Where to go on after the content of a SKIPPED element, or None if the content counts."""
        end, outer = self.next_end(tag, at), self.next_end(around, at) if around else len(self.page)
        if end < outer or end < len(self.page) and tag in RAW:
            close = self.page.find(">", end)
            return close + 1 if close >= 0 else len(self.page)
        return outer if tag in RAW else None


def blocks(page: str | None) -> list[tuple[str, tuple, float]]:
    """(text, path, share of the text in links) of each leaf block; path: the elements' hashes from the root."""
    out, stack, open_, text, linked, path = [], [], Counter(), [], 0, None
    links, at, page = 0, 0, page or ""
    tags = Tags(page)

    def flush():
        nonlocal text, linked, path
        if text:
            raw = "".join(text)
            words = html_lib.unescape(raw).split()
            if words:
                out.append((" ".join(words), path, linked / max(1, len(raw))))
        text, linked, path = [], 0, None

    def add(own):
        nonlocal path, linked
        if path is None and not own.isspace():
            path = tuple(e[1] for e in stack)
        text.append(own)
        linked += len(own) if links else 0

    def drop(k):
        for e in stack[k:]:
            open_[e[0]] -= 1
        del stack[k:]

    def drop_last(of, stops=()):
        """Closes the last open element of these and all within, if none of `stops` lies between."""
        if any(open_[x] for x in of):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stops:
                    return
                if stack[k][0] in of:
                    return drop(k)

    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            add(page[at:end])
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if at > tags.last:
            add(page[at:])
            break
        if page[at + 1] in "!?":
            at = page.find(">", at) + 1
            continue
        m = TAG.match(page, at)
        if not m:
            add("<")
            at += 1
            continue
        end = tags.end_of(m.end())
        tag, close, attributes, at = m[1].lower(), page[at + 1] == "/", page[m.end() : end], end + 1
        if tag in SKIPPED and not close:
            if not attributes.endswith("/"):
                to = tags.after(tag, stack[-1][0] if stack else None, at)
                at = at if to is None else to
            continue
        # an inline element that names itself as an advert or a notice is a block of its own
        if tag in INLINE and not (open_[tag] if close else tag in ("ins", "span") and not JUNK.isdisjoint(names_of(attributes))):
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                links = 0 if close else 1
            continue
        flush()
        links = 0
        if close:
            drop_last((tag,))
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            drop_last(CLOSES[tag], STOPS[tag])
        elif tag not in INLINE and stack and stack[-1][0] == "p":
            drop(len(stack) - 1)
        if tag == "p" and stack and stack[-1][0] == "p":
            drop(len(stack) - 1)
        if tag not in ("html", "body", "head") and not attributes.endswith("/") and len(stack) < DEEPEST:
            stack.append((tag, element(tag, attributes)))
            open_[tag] += 1
    flush()
    return out


def measures(text: str, linked: float, i: int, n: int) -> list[float]:
    size = len(text)
    return [np.log1p(size) / 5, linked, 10 * sum(map(text.count, ".,;!?")) / size, 5 * sum(map(text.count, "0123456789")) / size, i / n, (n - i) / n, np.log1p(n) / 5, float(text.endswith((".", "!", "?", ":", '"')))]


class Batch:
    """Blocks of some pages as flat index lists, and their places in a padded steps x pages grid."""

    def __init__(self, pages: list[list[tuple[str, tuple, float]]]):
        self.size = np.array([len(p) for p in pages], np.int64)
        steps = int(self.size.max(initial=0))
        self.grid = np.full((steps, len(pages)), -1, np.int64)
        paths, tails, words, numbers, self.n = [], [], [], [], 0
        for k, page in enumerate(pages):
            self.grid[: len(page), k] = np.arange(self.n, self.n + len(page))
            self.n += len(page)
            for i, (text, path, linked) in enumerate(page):
                paths.append([h for e in path for h in e] or [0])
                tails.append([h for e in path[-2:] for h in e] or [0])
                words.append([zlib.crc32(w.encode()) % WORDS for w in WORD.findall(text.lower())] or [0])
                numbers.append(measures(text, linked, i, len(page)))
        self.lists = []
        for of in (paths, tails, words):
            size = np.fromiter(map(len, of), np.int64, len(of))
            self.lists.append((np.fromiter((h for x in of for h in x), np.int64), np.cumsum(size) - size, size))
        self.numbers = np.array(numbers, np.float32).reshape(-1, MEASURES)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        e = lambda n, d: rng.normal(0, 0.3, (n, d)).astype(np.float32)
        self.p = {"path": e(PATHS, P_DIM), "tail": e(PATHS, P_DIM), "word": e(WORDS, W_DIM) * 0.1, "out": f(2 * HID), "skip": np.zeros(X_DIM, np.float32), "b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": f(X_DIM, 4 * HID), f"u{side}": f(HID, 4 * HID), f"c{side}": np.concatenate([np.zeros(HID), np.ones(HID), np.zeros(2 * HID)]).astype(np.float32)}

    def inputs(self, b: Batch) -> np.ndarray:
        means = [np.add.reduceat(self.p[k][ids], starts, axis=0) / size[:, None] for k, (ids, starts, size) in zip(("path", "tail", "word"), b.lists)]
        return np.concatenate([*means, b.numbers], axis=1).astype(np.float32)

    def side(self, x: np.ndarray, grid: np.ndarray, s: str, keep: list | None = None) -> np.ndarray:
        """States for each block. Gates: in, forget, out, new; empty places leave the state as it is."""
        g = np.concatenate([x @ self.p["w" + s] + self.p["c" + s], np.zeros((1, 4 * HID), np.float32)])
        h, c = np.zeros((grid.shape[1], HID), np.float32), np.zeros((grid.shape[1], HID), np.float32)
        out = np.zeros((len(x), HID), np.float32)
        for at in grid:
            a = g[at] + h @ self.p["u" + s]
            gates, new, there = sigmoid(a[:, : 3 * HID]), np.tanh(a[:, 3 * HID :]), (at >= 0)[:, None]
            i, f, o = gates[:, :HID], gates[:, HID : 2 * HID], gates[:, 2 * HID :]
            c2 = np.where(there, f * c + i * new, c)
            t = np.tanh(c2)
            h2 = np.where(there, o * t, h)
            if keep is not None:
                keep.append((h, c, i, f, o, new, t, there, at))
            h, c = h2, c2
            own = at >= 0
            out[at[own]] = h[own]
        return out

    def side_back(self, d: np.ndarray, x: np.ndarray, s: str, keep: list, g: dict) -> np.ndarray:
        dg = np.zeros((len(x), 4 * HID), np.float32)
        g["u" + s] = np.zeros_like(self.p["u" + s])
        dh, dc = np.zeros_like(keep[0][0]), np.zeros_like(keep[0][1])
        for h, c, i, f, o, new, t, there, at in reversed(keep):
            own = at >= 0
            dh[own] += d[at[own]]
            a = np.where(there, dh, 0)
            dcell = np.where(there, dc + a * o * (1 - t * t), 0)
            da = np.concatenate([dcell * new * i * (1 - i), dcell * c * f * (1 - f), a * t * o * (1 - o), dcell * i * (1 - new * new)], axis=1)
            g["u" + s] += h.T @ da
            dg[at[own]] = da[own]
            dh = np.where(there, da @ self.p["u" + s].T, dh)
            dc = np.where(there, dcell * f, dc)
        g["w" + s], g["c" + s] = x.T @ dg, dg.sum(axis=0)
        return dg @ self.p["w" + s].T

    def logits(self, b: Batch) -> np.ndarray:
        x = self.inputs(b)
        s = np.concatenate([self.side(x, b.grid, "f"), self.side(x, b.grid[::-1], "b")], axis=1)
        return s @ self.p["out"] + x @ self.p["skip"] + self.p["b"][0]

    def train(self, pages: list, labels: list[list[int]], passes: int = 8, rate: float = 0.01, seed: int = 2) -> None:
        rng, p = np.random.default_rng(seed), self.p
        m1, m2, n = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for turn in range(passes):
            order = rng.permutation(len(pages))
            for k in range(0, len(order), 32):
                take = sorted(order[k : k + 32], key=lambda i: len(pages[i]))
                b, y = Batch([pages[i] for i in take]), np.concatenate([labels[i] for i in take]).astype(np.float32)
                x, kf, kb = self.inputs(b), [], []
                s = np.concatenate([self.side(x, b.grid, "f", kf), self.side(x, b.grid[::-1], "b", kb)], axis=1)
                d = (sigmoid(s @ p["out"] + x @ p["skip"] + p["b"][0]) - y) / len(y)
                g = {"out": s.T @ d, "skip": x.T @ d, "b": np.array([d.sum()], np.float32)}
                ds = d[:, None] * p["out"]
                dx = d[:, None] * p["skip"] + self.side_back(ds[:, :HID], x, "f", kf, g) + self.side_back(ds[:, HID:], x, "b", kb, g)
                at = 0
                for name, (ids, _, size) in zip(("path", "tail", "word"), b.lists):
                    dim = p[name].shape[1]
                    g[name] = np.zeros_like(p[name])
                    np.add.at(g[name], ids, np.repeat(dx[:, at : at + dim] / size[:, None], size, axis=0))
                    at += dim
                n += 1
                now = rate * (1 - 0.95 * (turn + k / len(order)) / passes)
                for name, v in g.items():
                    m1[name] += 0.1 * (v - m1[name])
                    m2[name] += 0.01 * (v * v - m2[name])
                    p[name] -= now * (m1[name] / (1 - 0.9**n)) / (np.sqrt(m2[name] / (1 - 0.99**n)) + 1e-8)

    def texts(self, pages: list[str | None], most_blocks: int = 20_000) -> list[str]:
        """The article text of each page; pages of like length go through the network together."""
        found = [blocks(p) for p in pages]
        out, order = [""] * len(pages), sorted(range(len(pages)), key=lambda i: len(found[i]))
        at = 0
        while at < len(order):
            end, most = at, 0
            while end < len(order) and (end == at or max(most, len(found[order[end]])) * (end - at + 1) <= most_blocks):
                most, end = max(most, len(found[order[end]])), end + 1
            take = [i for i in order[at:end] if found[i]]
            at = end
            if take:
                keep = self.logits(Batch([found[i] for i in take])) >= 0
                k = 0
                for i in take:
                    out[i] = " ".join(b[0] for b, ok in zip(found[i], keep[k:]) if ok)
                    k += len(found[i])
        return out


#: Class names of adverts and notices within a line, and their words.
INLINE_JUNK = ("ad", "ads", "advert", "advertisement", "adsbygoogle", "sponsored", "sponsor", "promo", "banner", "newsletter", "subscribe", "paywall", "share", "social")
JUNK = frozenset(INLINE_JUNK)


class Grammar:
    """Pages to train on: an article among menus, notices and the like, in many layouts.

    Marks of the article's blocks: its text holds the character MARK, which is taken out again.
    """

    MARK = ""
    ARTICLE = ("article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div class="article"', 'div class="post"', 'td class="content"', 'div id="main"', 'div class="text"', 'div class="main-content"', 'article class="post entry"', 'div itemprop="articleBody" class="body"', 'div role="main"')
    AROUND = ("div", 'div class="container"', 'div id="page"', 'div class="wrapper"', 'div class="row"', 'section', 'div class="site"', 'div class="layout"')
    NAV = ("nav", 'div class="menu"', 'div id="nav"', 'ul class="nav"', 'div class="navbar"', 'nav class="main-nav"', 'div class="breadcrumbs"', 'div class="navigation"', 'div class="topbar"', 'nav role="navigation"', 'div class="pagination"', 'ul id="menu"', 'div class="tags"')
    HEAD = ("header", 'div class="header"', 'div id="header"', 'header class="site-header"', 'div class="masthead"', 'div class="logo"', 'div role="banner"')
    FOOT = ("footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"', 'div role="contentinfo"', 'div class="bottom"')
    SIDE = ("aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="widget"', 'div class="related"', 'div class="side"', 'div class="widget"', 'section class="recommended"', 'div class="popular"', 'div role="complementary"', 'div class="trending"', 'div class="more-stories"')
    AD = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="banner"', 'div class="promo"', 'div class="sponsored"', 'div id="ad-top"', 'div class="ad-slot"', 'aside class="ad"', 'section class="sponsor"', 'ins class="adsbygoogle"')
    NOTICE = ('div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div class="consent"', 'div class="alert"', 'div class="newsletter"', 'div class="popup"', 'div class="gdpr"', 'div class="modal"', 'div class="subscribe"', 'div class="paywall"', 'div class="share"', 'div class="social"')
    COMMENTS = ('div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div id="disqus_thread"', 'section class="comments-area"', 'div class="discussion"', 'div class="replies"')

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        letters = "aeiou", "bcdfghklmnprstvwzéüñ"
        syllables = ["".join(self.rng.choice(list(letters[k % 2])) for k in range(int(self.rng.integers(1, 4)))) for _ in range(60)]
        self.words = ["".join(self.rng.choice(syllables, int(self.rng.integers(1, 5)))) for _ in range(3000)]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, of):
        return of[int(self.rng.integers(0, len(of)))]

    def some(self, lo: int, hi: int) -> str:
        return " ".join(self.words[int(i)] for i in self.rng.integers(0, len(self.words), int(self.rng.integers(lo, hi))))

    def sentence(self, lo: int = 3, hi: int = 20) -> str:
        return self.some(lo, hi).capitalize() + self.pick((".", ".", ".", "!", "?", ""))

    def element(self, kind: str, inner: str) -> str:
        return f"<{kind}>{inner}</{kind.split()[0]}>"

    def links(self, lo: int = 2, hi: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.some(1, 4)}</a></li>' for i in range(int(self.rng.integers(lo, hi)))) + "</ul>"

    def passage(self, mark: str = "") -> str:
        text = " ".join(self.sentence() for _ in range(int(self.rng.integers(1, 8))))
        if self.chance(0.1):
            text = " ".join(w + self.pick(("%%%", "###", "$$$", "***", " |")) for w in text.split())
        elif self.chance(0.05):
            text = text.upper() + "!!"
        elif self.chance(0.05):
            text = self.some(1, 3)
        elif self.chance(0.08):
            text = " ".join(w for w in self.some(1, 6).split() for _ in range(int(self.rng.integers(3, 20))))
        if self.chance(0.15):
            text = text.replace(" ", " <b>", 1) + "</b>"
        if self.chance(0.1):
            text += f' <a href="/x">{self.some(1, 4)}</a>'
        if mark and self.chance(0.04):
            kind = self.pick(("ins", "span"))
            text += f' <{kind} class="{self.pick(INLINE_JUNK)}">{self.sentence(2, 8)}</{kind}> {mark}{self.sentence()}'
        return mark + text

    def article(self) -> str:
        m, out = self.MARK, []
        kind = self.pick(self.ARTICLE)
        if self.chance(0.8):
            head = f"<h1>{m}{self.sentence(2, 12)}</h1>"
            out.append(self.element(self.pick(("header", "div class=\"title\"")), head) if self.chance(0.15) else head)
        n = int(self.rng.integers(0, 14)) if self.chance(0.9) else int(self.rng.integers(14, 40))
        for _ in range(n):
            r = self.rng.random()
            if r < 0.62:
                out.append(f"<p>{self.passage(m)}</p>")
            elif r < 0.70:
                out.append(f"<p><b>{self.passage(m)}<br>")
            elif r < 0.78:
                out.append(f"<h{self.rng.integers(2, 5)}>{m}{self.some(1, 7)}</h2>")
            elif r < 0.84:
                out.append("<ul>" + "".join(f"<li>{m}{self.sentence()}</li>" for _ in range(int(self.rng.integers(1, 6)))) + "</ul>")
            elif r < 0.88:
                out.append(f"<blockquote>{'<p>' if self.chance(0.5) else ''}{self.passage(m)}</blockquote>")
            elif r < 0.91:
                out.append("<table><tr>" + "".join(f"<td>{m}{self.some(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif r < 0.93:
                out.append(f"<div>{self.passage(m)}</div>")
            else:
                out.append(self.junk(inside=True))
        text = "".join(out)
        return self.element(kind, text)

    def inner(self) -> str:
        r = self.rng.random()
        if r < 0.35:
            return self.sentence(3, 25)
        if r < 0.6:
            return f"<p>{self.passage()}</p>"
        if r < 0.8:
            return self.links()
        return f"<h3>{self.some(1, 5)}</h3>" + "".join(f"<p>{self.sentence()}</p>" for _ in range(int(self.rng.integers(1, 4))))

    def junk(self, inside: bool = False) -> str:
        r = self.rng.random()
        if inside:
            kind = self.AD if r < 0.5 else self.NOTICE if r < 0.8 else self.SIDE
            return self.element(self.pick(kind), self.inner())
        if r < 0.25:
            return self.element(self.pick(self.AD), self.inner())
        if r < 0.5:
            return self.element(self.pick(self.SIDE), self.inner() + (self.links() if self.chance(0.5) else ""))
        if r < 0.75:
            return self.element(self.pick(self.NOTICE), self.inner() + (f"<button>{self.some(1, 3)}</button>" if self.chance(0.6) else ""))
        if r < 0.9:
            return f'<form action="/s"><label>{self.some(1, 3)}</label><input type="text"><p>{self.sentence()}</p><button>{self.some(1, 2)}</button></form>'
        return self.element(self.pick(self.NAV), self.links())

    def comments(self) -> str:
        kind = self.pick(self.COMMENTS)
        one = self.pick(('div class="comment"', 'li class="comment"', 'article class="comment"', 'div class="comment-body"', 'div class="reply"'))
        own = "".join(self.element(one, f'<span class="author">{self.some(1, 3)}</span><p>{self.passage()}</p>') for _ in range(int(self.rng.integers(1, 7))))
        return self.element(kind, (f"<h3>{self.some(1, 4)}</h3>" if self.chance(0.7) else "") + own + (self.junk() if self.chance(0.2) else ""))

    def page(self) -> str:
        parts = []
        if self.chance(0.6):
            inner = self.some(1, 5) if self.chance(0.5) else f'<a href="/">{self.some(1, 3)}</a>' + (self.element(self.pick(self.NAV), self.links()) if self.chance(0.5) else "")
            parts.append(self.element(self.pick(self.HEAD), (f"<h1>{inner}</h1>" if self.chance(0.2) else f"<p>{inner}</p>") if self.chance(0.5) else inner))
        if self.chance(0.8):
            parts.append(self.element(self.pick(self.NAV), self.links()))
        parts += [self.junk() for _ in range(int(self.rng.integers(0, 3)))]
        parts.append(self.article())
        if self.chance(0.35):
            parts.append(self.comments())
        parts += [self.junk() for _ in range(int(self.rng.integers(0, 3)))]
        if self.chance(0.85):
            parts.append(self.element(self.pick(self.FOOT), (f"<p>&copy; {self.sentence()}</p>" if self.chance(0.4) else f"&copy; {self.some(1, 3)} &middot; {self.sentence(4, 20)}") + (self.links() if self.chance(0.3) else "")))
        body = "".join(parts)
        if self.chance(0.4):
            body = self.element(self.pick(self.AROUND), body)
        page = f"<!DOCTYPE html><html><head><title>{self.some(1, 5)}</title></head><body>{body}"
        return page if self.chance(0.1) else page + "</body></html>"

    def labelled(self) -> tuple[list, list[int]]:
        found = blocks(self.page())
        return [(t.replace(self.MARK, "") or "x", p, a) for t, p, a in found], [int(self.MARK in t) for t, _, _ in found]


@lru_cache(maxsize=2)
def trained(pages: int = 2500, seed: int = 5) -> Labeller:
    """The labeller after training on so many pages of the grammar (once a process)."""
    grammar, model = Grammar(seed), Labeller()
    own = [g for g in (grammar.labelled() for _ in range(pages)) if g[0]]
    model.train([p for p, _ in own], [y for _, y in own])
    return model


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    box = pages.sparkSession.sparkContext.broadcast(model or trained())
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches):
        import pyarrow as pa

        from quillon.llm.tokens import chunks

        for b in batches:
            html = b.column(2).to_pylist()
            text = [t for lo, hi in chunks([h or "" for h in html], 4_000_000) for t in box.value.texts(html[lo:hi])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return through(rows, run, f"page_id {kind['page_id']}, url {kind['url']}, text string").withColumn("n_chars", F.length("text").cast("long"))
