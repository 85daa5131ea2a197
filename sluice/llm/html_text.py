"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: stretches of text between block-level tags, each with its ancestors. Features are the
ancestors' tags, the words of their class, id and role, and measures of the text (length, share of link text, marks,
place). The field has two labels, main text and other, and is trained by maximum likelihood on labelled pages; Viterbi
gives each page its best sequence. The labelled pages come from templates in many layouts, with and without telling
tags and names, whose every block has a known label; callers can give their own instead.

Input cases: a null or empty page, and one without text, has the text '' of 0 characters; broken markup is read as far as it goes (an unclosed
paragraph ends at the next block, an unclosed comment or script takes the rest of the page); equal rows get equal results; other columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sluice.llm.common import ship

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?/][^>]*>", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements whose text is not shown, those without an end tag, and those that run on within a line.
HIDDEN = frozenset("script style noscript template head title textarea select option iframe svg object canvas audio video".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of the second kind ends where one of the first begins.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
HOLDERS = frozenset("body div article main section nav header footer aside ul ol table form blockquote figure td th dl".split())
HINTS = ("cookie", "subscribe", "copyright", "©", "all rights", "newsletter", "sign in", "log in", "advert", "sponsored", "privacy")


class Block:
    __slots__ = ("link", "path", "text")

    def __init__(self, text: str, link: int, path: tuple):
        self.text, self.link, self.path = text, link, path


def blocks_of(page: str) -> list[Block]:
    """The page's leaf blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    buf: list[str] = []
    linked = hidden = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if buf:
            text = " ".join(html_lib.unescape("".join(buf)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), tuple(stack)))
            buf.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal hidden, in_link
        for tag, _ in stack[k:]:
            hidden -= tag in HIDDEN
            in_link -= tag == "a"
        del stack[k:]

    at, end = 0, len(page)
    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not hidden:
            data = page[at : m.start()]
            buf.append(data)
            if in_link > 0:
                linked += len(data.strip())
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            buf.append(" ")
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] in HOLDERS:
                    break
            continue
        if tag not in INLINE:
            flush()
            ends = ENDS.get(tag, {"p"} if tag not in VOID else ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in HOLDERS:
                    break
            if tag == "body":
                for k, (open_tag, _) in enumerate(stack):
                    if open_tag == "head":
                        pop_to(k)
                        break
        if tag in VOID or m[0].endswith("/>"):
            continue
        names = " ".join(x for g in NAMES.findall(m[3]) for x in g if x) if m[3] else ""
        stack.append((tag, names))
        hidden += tag in HIDDEN
        in_link += tag == "a"
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            pop_to(len(stack) - 1)
    if at < end and not hidden:
        buf.append(page[at:])
    flush()
    return out


_PATHS: dict[tuple, tuple[str, ...]] = {}


def path_features(path: tuple) -> tuple[str, ...]:
    got = _PATHS.get(path)
    if got is None:
        out = set()
        for tag, names in path:
            out.add("in " + tag)
            for w in {p.lower() for p in PART.findall(names)}:
                if len(w) > 1:
                    out.add("name " + w.rstrip("s"))
        holder = next((t for t, _ in reversed(path) if t not in INLINE), "none")
        out.add("leaf " + holder)
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        got = _PATHS[path] = tuple(sorted(out))
    return got


def bucket(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    n = len(blocks)
    # whether the page marks its article, and where a block stands to it
    inside = [any(tag in ("article", "main") for tag, _ in b.path) for b in blocks]
    first, last = (inside.index(True), n - 1 - inside[::-1].index(True)) if any(inside) else (n, -1)
    for k, b in enumerate(blocks):
        t = b.text
        where = "unmarked" if last < 0 else "inside" if inside[k] else "before" if k < first else "after" if k > last else "between"
        words = t.count(" ") + 1
        low = t.lower()
        f = [*path_features(b.path), "bias", f"words {bucket(words, (2, 5, 10, 20, 40, 80))}", f"link {bucket(b.link / len(t), (0.01, 0.3, 0.6, 0.9))}", f"end {t[-1] if t[-1] in '.!?:,' else 'x'}", f"commas {bucket(t.count(','), (1, 3, 8))}", f"place {bucket(k / n, (0.1, 0.5, 0.9))}", "article " + where]
        f += ["hint " + h for h in HINTS if h in low]
        out.append(f)
    return out


class Field:
    """Weights of a two-label linear chain: w of each feature for label 1 over label 0, trans[from, to], and of the first label."""

    def __init__(self, w: dict[str, float], trans: np.ndarray, begin: np.ndarray):
        self.w, self.trans, self.begin = w, trans, begin

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi: the most likely labels."""
        if not feats:
            return []
        get = self.w.get
        (t00, t01), (t10, t11) = self.trans.tolist()
        s = sum(get(f, 0.0) for f in feats[0])
        a, b = self.begin[0], self.begin[1] + s
        back = []
        for fs in feats[1:]:
            s = 0.0
            for f in fs:
                s += get(f, 0.0)
            from0, from1 = a + t00 >= b + t10, a + t01 >= b + t11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + t00 if from0 else b + t10), (a + t01 if from1 else b + t11) + s
        y = [int(b > a)]
        for p in reversed(back):
            y.append(p[y[-1]])
        return y[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.15, ridge: float = 2e-3) -> Field:
    """Maximum likelihood by Adam on the whole set; expectations by forward-backward over all pages at once."""
    names = sorted({f for feats, _ in pages for fs in feats for f in fs})
    place = {f: i for i, f in enumerate(names)}
    longest = max(len(y) for _, y in pages)
    n = len(pages)
    rows, cols, cell = [], [], []
    gold = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for p, (feats, y) in enumerate(pages):
        gold[p, : len(y)] = y
        mask[p, : len(y)] = True
        for t, fs in enumerate(feats):
            rows += [len(cell)] * len(fs)
            cols += [place[f] for f in fs]
            cell.append((p, t))
    rows, cols, cell = np.array(rows), np.array(cols), np.array(cell)
    theta = np.zeros(len(names) + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:]
    for k in range(1, rounds + 1):
        w, trans, begin = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        emit = np.zeros((n, longest, 2))
        emit[cell[:, 0], cell[:, 1], 1] = np.bincount(rows, weights=w[cols], minlength=len(cell))
        alpha = np.empty((n, longest, 2))
        alpha[:, 0] = begin + emit[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        beta = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            e = emit[:, t + 1] + beta[:, t + 1]
            prev = np.logaddexp(trans[:, 0] + e[:, None, 0], trans[:, 1] + e[:, None, 1])
            beta[:, t] = np.where(mask[:, t + 1, None], prev, 0)
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
        g = np.zeros_like(theta)
        diff = (p1 - gold)[cell[:, 0], cell[:, 1]]
        g[:-6] = np.bincount(cols, weights=diff[rows], minlength=len(names))
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(alpha[:, :-1, a] + trans[a, b] + emit[:, 1:, b] + beta[:, 1:, b] - z[:, None])
                real = (gold[:, :-1] == a) & (gold[:, 1:] == b)
                g[len(names) + 2 * a + b] = (pair * both).sum() - (real & both).sum()
        g[-2:] = np.exp(alpha[:, 0] + beta[:, 0] - z[:, None]).sum(0) - np.bincount(gold[:, 0], minlength=2)
        g = g / n + ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta -= rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return Field(dict(zip(names, theta[:-6].tolist(), strict=True)), theta[-6:-2].reshape(2, 2), theta[-2:])


#: Names that pages give their parts.
MAIN_NAMES = ["article", "post-content", "entry-content", "content", "story-body", "article-body", "main-text", "post", "page-content", "blog-entry", "news-text", "body-copy"]
OTHER_NAMES = {
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "navigation", "toc", "pagination", "pager", "tabs", "skip-links"],
    "header": ["header", "masthead", "top-bar", "site-header", "banner", "branding", "logo", "page-header"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal", "colophon"],
    "aside": ["sidebar", "widget", "related", "related-posts", "recommended", "popular", "trending", "most-read", "side", "rail", "tags", "author-box", "share", "social", "share-buttons"],
    "notice": ["cookie", "cookie-notice", "consent", "gdpr", "notice", "popup", "modal", "alert", "paywall", "newsletter", "subscribe", "signup"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "sponsor"],
    "form": ["form", "search-form", "login", "contact-form", "search", "comment-form"],
    "comment": ["comments", "comment", "comment-list", "reply", "replies", "respond", "discussion", "disqus", "user-comments", "reviews"],
}
#: Articles speak of these things too.
LEGAL = ["All rights reserved.", "Released under the MIT License.", "Copyright 2021.", "The privacy of cookies.", "Licensed under the Apache License."]


def labelled_pages(n: int = 360, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(text, label) of each block]) from templates, the same on every call."""
    rng = random.Random(seed)
    syllables = "an be con da en fi ga ho in ja ka lo ma no or pa que ra si ta un ve wo xi yo zu ción eau sch th ing".split()

    def words(k: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k))

    def sentence(lo: int, hi: int) -> str:
        s = words(rng.randint(lo, hi)).capitalize()
        return (s.replace(" ", ", ", 1) if rng.random() < 0.5 else s) + rng.choice([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        return " ".join(sentence(4, 18) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    out = []
    for _ in range(n):
        gold: list[tuple[str, int]] = []

        def say(text: str, label: int, gold=gold) -> str:
            gold.append((text, label))
            return html_lib.escape(text)

        def open_close(tag: str, name: str | None, inner: str) -> str:
            attr = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
            return f"<{tag}{attr}>{inner}</{tag}>"

        def other(kind: str) -> str:
            tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, rng.choice(["div", "section", "aside"]))
            plain = rng.random()
            name = rng.choice(OTHER_NAMES[kind])
            if plain < 0.45 and tag not in ("div", "section"):
                name = None
            elif plain < 0.9 or tag in ("div", "section"):
                tag = rng.choice(["div", "div", "section", "p" if kind in ("ad", "notice", "footer") else "div"])
            inner = ""
            if kind in ("nav", "aside", "header") and rng.random() < 0.75:
                if rng.random() < 0.4:
                    inner += open_close(rng.choice(["h3", "div", "h2"]) if tag != "p" else "span", None, say(sentence(1, 4), 0)) if tag != "p" else ""
                inner += "<ul>" + "".join(f'<li><a href="/{i}">{say(words(rng.randint(1, 4)), 0)}</a></li>' for i in range(rng.randint(2, 8))) + "</ul>" if tag != "p" else f'<a href="#">{say(words(3), 0)}</a>'
            elif kind == "form":
                inner += f"<label>{say(words(2), 0)}</label><input name=q><button>{say(words(1), 0)}</button>"
            elif kind == "comment":
                inner += "".join(open_close(rng.choice(["li", "div"]), rng.choice(["comment", "reply", "comment-body"]), f"<p>{say(prose(), 0)}</p>") for _ in range(rng.randint(1, 4)))
            elif kind == "footer":
                inner += say(rng.choice(["© ", "Copyright ", ""]) + words(rng.randint(1, 3)) + ". " + sentence(2, 10), 0)
            elif kind == "notice":
                inner += say(rng.choice(["We use cookies. ", "Subscribe. ", ""]) + sentence(3, 16), 0)
            else:
                inner += say(prose() if rng.random() < 0.5 else sentence(2, 9), 0)
            return open_close(tag, name, inner)

        def main() -> str:
            parts = []
            if rng.random() < 0.8:
                parts.append(f"<h1>{say(sentence(2, 12), 1)}</h1>")
            for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
                r = rng.random()
                if r < 0.1:
                    parts.append(f"<p>{say(rng.choice(LEGAL) + ' ' + sentence(1, 9) * rng.randint(0, 1), 1)}</p>")
                elif r < 0.66:
                    parts.append(f"<p>{say(prose(), 1)}</p>")
                elif r < 0.72:
                    parts.append(f"<p><b>{say(prose(), 1)}<br>")
                elif r < 0.78:
                    parts.append(f"<h2>{say(sentence(1, 6), 1)}</h2>")
                elif r < 0.84:
                    parts.append(f"<blockquote>{say(prose(), 1)}</blockquote>")
                elif r < 0.9:
                    parts.append("<ul>" + "".join(f"<li>{say(sentence(2, 12), 1)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
                elif r < 0.93:
                    parts.append(f"<div>{say(prose(), 1)}</div>")
                elif r < 0.95:
                    parts.append(f"<pre>{say(sentence(3, 20), 1)}</pre>")
                else:
                    parts.append(other(rng.choice(["ad", "aside", "notice"])))
            return "".join(parts)

        top = [other(k) for k in rng.sample(["nav", "header", "notice", "ad", "form"], rng.randint(0, 4))]
        body = "".join(top)
        r = rng.random()
        inner = main()
        if r < 0.35:
            body += open_close("article", rng.choice([None, *MAIN_NAMES]), inner)
        elif r < 0.55:
            body += open_close("main", rng.choice([None, *MAIN_NAMES]), inner)
        elif r < 0.75:
            body += open_close("main" if rng.random() < 0.5 else "div", None, open_close("article", None, inner))
        else:
            body += open_close(rng.choice(["div", "section"]), rng.choice(MAIN_NAMES), inner)
        for k in rng.sample(["aside", "comment", "footer", "ad", "form", "notice", "nav"], rng.randint(0, 5)):
            body += other(k)
        if r < 0.75 and rng.random() < 0.3:
            # readers' remarks without any name
            body += open_close(rng.choice(["div", "section", "ol"]), None, "".join(open_close("li" if rng.random() < 0.4 else "div", None, f"<p>{say(prose(), 0)}</p>") for _ in range(rng.randint(1, 4))))
        out.append((f"<!DOCTYPE html><html><head><title>{words(4)}</title><script>var a='<p>';</script></head><body>{body}</body></html>", gold))
    return out


def training_set(pages: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of labelled pages; a block has the label of the text it holds."""
    out = []
    for page, gold in pages:
        blocks = blocks_of(page)
        known = {" ".join(t.split()): y for t, y in gold}
        labels = [known.get(b.text, 0) for b in blocks]
        if blocks:
            out.append((features(blocks), labels))
    return out


_FIELD: list[Field] = []


def default_field() -> Field:
    if not _FIELD:
        _FIELD.append(train(training_set(labelled_pages())))
    return _FIELD[0]


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    ship(pages.sparkSession)
    field = field or default_field()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h if isinstance(h, str) else "", field) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
