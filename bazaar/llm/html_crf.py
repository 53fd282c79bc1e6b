"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks (operator 1).

A page becomes the sequence of its leaf blocks, each with the tags, classes and roles of its ancestors and with what its text
looks like. The field is trained on labelled pages (``labelled_pages``: templates in which every block is known to be content
or not) and decoded by Viterbi; blocks labelled content are joined.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import chunks

# Elements of HTML. RAW ones end at their end tag or with the page; those of CLOSED go with what they hold if their
# end tag comes before the next of their name, else they are open elements like any other. UNSEEN ones are never shown, wherever
# they stand, and leave no gap: a title (the tags of its head may be left out) and the source of a formula.
RAW = "script|style"
CLOSED = "noscript|template|iframe|svg|object|select|textarea|button"
UNSEEN = "title|annotation|annotation-xml"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FORMULA = "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics"
INLINE = frozenset(FORMULA.split()) | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q s samp small span strike strong sub sup time tt u var ruby rt rp".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table div section article main aside nav header footer body form".split())
# What may stand in a head, which goes on over it; its end tag may be left out. (No group in it: re fails on those in possessive
# repeats.)
IN_HEAD = "|".join([
    r"\s+|<!--.*?(?:-->|\Z)|<(?:meta|link|base|basefont|bgsound)(?=[\s/>])[^>]*>",
    *[rf"<{n}(?=[\s/>])[^>]*>.*?(?:</{n}\s*>|\Z)" for n in RAW.split("|")],
    *[rf"<{n}(?=[\s/>])[^>]*>[^<]*+(?:<(?!/?(?:{n}|head|body)[\s/>])[^<]*+)*+</{n}\s*>" for n in ("title", "noscript", "template", "noframes")],
    r"<title(?=[\s/>])[^>]*>[^<]*+",
])
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<closed>{CLOSED})(?=[\s/>])[^>]*>[^<]*+(?:<(?!/?(?P=closed)[\s/>])[^<]*+)*+</(?P=closed)\s*>"
    rf"|<(?P<unseen>{UNSEEN})(?=[\s/>])[^>]*>[^<]*+(?:<(?!/?(?:(?P=unseen)|head|body)[\s/>])[^<]*+)*+</(?P=unseen)\s*>"
    r"|<title(?=[\s/>])[^>]*>[^<]*+"
    rf"|<(?P<head>head)(?=[\s/>])[^>]*>(?:{IN_HEAD})*+(?:</head\s*>)?"
    r"|<(?P<slash>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
CHUNK = 4_000_000

Block = tuple[tuple[str, ...], str, int]  # cues of the ancestors, raw text, characters inside links


def _cues(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            out += [f".{w}" for w in re.findall(r"[a-z]+", value) if len(w) > 1]
        if HIDDEN.search(attributes):
            out.append(".hidden")
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. Text belongs to the innermost open block element; inline elements do not cut it."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    text: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = "".join(text)
            if not whole.isspace():
                out.append((stack[-1][1] if stack else (), whole, linked))
            text.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] or m["closed"] or m["head"]:
                text.append(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            text.append("\n")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in INLINE:
            if tag == "a":
                in_link = not m["slash"]
        elif m["slash"]:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    in_link = False
                    break
        else:
            flush()
            closed = CLOSES.get(tag, {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closed or stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in HOLDS:
                    break
            own = _cues(tag, m["rest"])
            stack.append((tag, (stack[-1][1] if stack else ()) + own))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def clean(raw: str) -> str:
    """Character references decoded, white space turned into one blank, trimmed."""
    return " ".join(html.unescape(raw).split())


def structure(cues: tuple[str, ...]) -> list[str]:
    """Features of the ancestors: which there are, the innermost, and how deep."""
    last = next((c for c in reversed(cues) if c[0] != "."), "")
    return [f"has {c}" for c in set(cues)] + [f"leaf {last}", f"depth {min(6, sum(c[0] != '.' for c in cues))}"]


def look(raw: str, linked: int) -> tuple:
    """What a text looks like, in coarse steps."""
    n = max(1, len(raw))
    return (
        min(8, int(math.log2(n))), min(3, int(4 * linked / n)), raw.rstrip()[-1:] in tuple(".!?\"'…”»"), min(3, raw.count(",")),
        "©" in raw or "&copy" in raw or "(c)" in raw, min(3, raw.count("|") + raw.count("&middot;") + raw.count("·")), raw.count(" ") < 3,
    )


LOOK = ("size", "linked", "ends", "commas", "rights", "bars", "few")


class Field:
    """Weights of a two-label chain (1: content)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves.tolist()
        self._structure: dict[tuple, tuple[float, float]] = {}
        self._look: dict[tuple, tuple[float, float]] = {}

    def _sum(self, features: list[str]) -> tuple[float, float]:
        at = [self.names[f] for f in features if f in self.names]
        return tuple(self.weights[at].sum(0).tolist())

    def labels(self, page: list[Block]) -> list[int]:
        """The likeliest sequence of labels (Viterbi)."""
        back, best = [], (0.0, 0.0)
        for k, (cues, raw, linked) in enumerate(page):
            a = self._structure.get(cues)
            if a is None:
                if len(self._structure) > 50_000:
                    self._structure.clear()
                a = self._structure[cues] = self._sum(structure(cues))
            seen = look(raw, linked)
            b = self._look.get(seen)
            if b is None:
                b = self._look[seen] = self._sum([f"{n} {v}" for n, v in zip(LOOK, seen)])
            if k == 0:
                best = (a[0] + b[0], a[1] + b[1])
                continue
            m = self.moves
            from0 = 0 if best[0] + m[0][0] >= best[1] + m[1][0] else 1
            from1 = 0 if best[0] + m[0][1] > best[1] + m[1][1] else 1
            back.append((from0, from1))
            best = (best[from0] + m[from0][0] + a[0] + b[0], best[from1] + m[from1][1] + a[1] + b[1])
        if not page:
            return []
        label = [0 if best[0] >= best[1] else 1]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]

    def text(self, page: str) -> str:
        found = blocks(page)
        parts = [clean(raw) for (_, raw, _), y in zip(found, self.labels(found)) if y]
        return "\n".join(p for p in parts if p)


# How page templates of the wild name their parts.
CONTENT = ['<article>', '<article class="post">', '<main>', '<div id="content">', '<div class="entry-content">', '<section class="story-body">', '<div class="article-body" itemprop="articleBody">', '<div role="main">', '<main id="main-content"><article>', '<div class="post-content">', '<div class="page text">']
AROUND = {
    "menu": ['<nav>', '<ul class="menu">', '<div class="navbar">', '<div id="navigation" role="navigation">', '<div class="breadcrumbs">', '<nav class="main-nav">', '<div class="pagination">', '<div class="toc">', '<div class="tags">'],
    "head": ['<header>', '<div id="header">', '<div class="site-header masthead">', '<div role="banner">'],
    "foot": ['<footer>', '<div id="footer">', '<div class="site-footer">', '<div role="contentinfo">', '<div class="copyright">'],
    "side": ['<aside>', '<div class="sidebar">', '<div id="secondary" class="widget">', '<div class="related-posts">', '<div role="complementary">', '<div class="share social">', '<div class="recommended">', '<div class="author-bio">', '<section class="newsletter signup">'],
    "note": ['<div class="cookie-notice">', '<div id="gdpr-consent">', '<div class="alert banner">', '<div class="notice">', '<div class="modal popup">', '<div class="subscribe paywall">', '<div role="alert">', '<div role="dialog">'],
    "ad": ['<div class="ad">', '<div class="advert">', '<div id="ads" class="sponsored">', '<aside class="promo">', '<div class="ad-slot">', '<div class="advertisement">', '<section class="sponsor">', '<div class="banner-ad">'],
    "talk": ['<div id="comments">', '<section class="comments">', '<ol class="comment-list">', '<div class="disqus thread">', '<div class="responses">', '<div class="replies">', '<section class="discussion">', '<div class="user-reviews">'],
    "form": ['<form>', '<form class="search">', '<form id="login">', '<form class="contact-form">'],
}


def labelled_pages(n: int = 400, seed: int = 5) -> Iterator[tuple[str, set[str]]]:
    """Pages of many templates with the texts of their content blocks. Words are drawn at random: layout has to tell."""
    rng = random.Random(seed)
    count = 0

    def words(low: int, high: int, end: str = ".") -> str:
        nonlocal count
        count += 1
        letters = lambda: "".join(rng.choice("abdeilmnorstuéü") for _ in range(rng.randrange(1, 10)))
        text = [letters() + rng.choice(["", "", "", "", ","]) for _ in range(rng.randrange(low, high))]
        return f"{' '.join(text)} n{count}{end}"

    def close(opening: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opening)))

    def around(kind: str) -> str:
        opening = rng.choice(AROUND[kind])
        if kind == "menu":
            body = "<ul>" * (rng.random() < 0.7) + "".join(f'<li><a href="/x">{words(1, 3, "")}</a></li>' for _ in range(rng.randrange(2, 8)))
        elif kind == "foot":
            body = rng.choice(["&copy; ", "© ", "", "<p>"]) + words(2, 12) + rng.choice([" &middot; ", " | ", ""]) + words(2, 12)
        elif kind == "form":
            body = f'<label>{words(1, 4, "")}</label><input name="q"><p>{words(2, 15)}</p>'
        elif kind == "head":
            body = rng.choice([f"<h1>{words(1, 4, '')}</h1>", f"<p>{words(1, 6)}</p>", f"<a href='/'>{words(1, 3, '')}</a>"])
        else:
            body = "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "{}", "<h3>{}</h3>", "<li>{}</li>"]).format(words(1, rng.choice([5, 20, 80]))) for _ in range(rng.randrange(1, 5)))
        return opening + body + close(opening)

    for _ in range(n):
        wanted, body = set(), []
        opening = rng.choice(CONTENT)
        for k in range(rng.randrange(1, 14)):
            tag = "h1" if k == 0 and rng.random() < 0.8 else rng.choice(["p"] * 14 + ["h2", "h3", "li", "blockquote", "pre", "td", "figcaption", "div"])
            text = words(1, rng.choice([3, 8, 30, 90]), rng.choice([".", ".", "", "!"]))
            wanted.add(text)
            inner = text if rng.random() < 0.7 else re.sub(r"^(\S+)", r"<b>\1</b>", text)
            wrap = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}.get(tag, f"<{tag}>{{}}</{tag}>" if rng.random() < 0.8 else f"<{tag}>{{}}<br>")
            body.append(wrap.format(inner))
            if rng.random() < 0.12:
                body.append(around(rng.choice(["ad", "side", "note", "form"])))
        before = [around(k) for k in ("note", "head", "menu", "menu", "ad", "side") if rng.random() < 0.5]
        after = [around(k) for k in ("talk", "side", "ad", "form", "foot", "menu") if rng.random() < 0.5]
        yield f"<html><head><title>{words(2, 8)}</title></head><body>{''.join(before)}{opening}{''.join(body)}{close(opening)}{''.join(after)}", wanted


def fit(pages, rounds: int = 200, ridge: float = 1e-3) -> Field:
    """Maximum likelihood of the labels by Adam; forward and backward sums run over all pages side by side."""
    names: dict[str, int] = {}
    rows, labels, owner = [], [], []
    for p, (page, wanted) in enumerate(pages):
        for cues, raw, linked in blocks(page):
            features = structure(cues) + [f"{n} {v}" for n, v in zip(LOOK, look(raw, linked))]
            rows.append([names.setdefault(f, len(names)) for f in features])
            labels.append(int(clean(raw) in wanted))
            owner.append(p)
    owner = np.unique(np.array(owner), return_inverse=True)[1]
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    y = np.array(labels)
    size = np.bincount(owner)
    place = np.arange(len(y)) - np.repeat(np.cumsum(size) - size, size)
    n, most = len(size), size.max()
    mask = np.arange(most) < size[:, None]
    gold = np.zeros((n, most), int)
    gold[owner, place] = y
    pairs = mask[:, 1:]
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        e = np.zeros((n, most, 2))
        e[owner, place] = x @ w
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for t in range(1, most):
            f[:, t] = np.where(mask[:, t, None], e[:, t] + np.logaddexp.reduce(f[:, t - 1, :, None] + moves, axis=1), f[:, t - 1])
        for t in range(most - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(moves + (e[:, t + 1] + b[:, t + 1])[:, None], axis=2), 0)
        whole = np.logaddexp.reduce(f[:, -1], axis=1)
        single = np.exp(f + b - whole[:, None, None])
        double = np.exp(f[:, :-1, :, None] + moves + (e + b)[:, 1:, None, :] - whole[:, None, None, None]) * pairs[..., None, None]
        slope = x.T @ (np.eye(2)[y] - single[owner, place]) / n - ridge * w
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
        turn = (seen - double.sum((0, 1))) / n - ridge * moves
        for value, g, k in ((w, slope, 0), (moves, turn, 2)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.999 * state[k + 1] + 0.001 * g * g
            value += 0.05 * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.999**step)) + 1e-8)
    return Field(names, w, moves)


@lru_cache(1)
def trained() -> Field:
    return fit(labelled_pages())


def extract(pages: DataFrame, field: Field | None = None, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """The columns ``keep``, text, n_chars (code points) and n_blocks (leaf blocks of the page) of every page.

    A null or empty page has the empty text, as has a page without content. Repeated rows give a row each; null ids and urls
    stay null; further columns are ignored. A page of any length is read whole.
    """
    field = field or trained()
    names, weights, moves = field.names, field.weights, np.array(field.moves)

    def run(batches):
        own = Field(names, weights, moves)
        for batch in batches:
            source_ = batch["__html"].tolist()
            for first, last in chunks(np.array([len(t) + 1 for t in source_]), CHUNK):
                rows = []
                for page in source_[first:last]:
                    found = blocks(page)
                    parts = [clean(raw) for (_, raw, _), y in zip(found, own.labels(found)) if y]
                    rows.append(("\n".join(p for p in parts if p), len(found)))
                out = batch.iloc[first:last][list(keep)].copy()
                out["text"], out["n_blocks"] = [r[0] for r in rows], [r[1] for r in rows]
                yield out

    # Keys travel as strings: pandas would hold numbers with nulls among them as doubles.
    rows = pages.select(*[F.col(c).cast("string").alias(c) for c in keep], F.coalesce(F.col(source), F.lit("")).alias("__html"))
    found = rows.mapInPandas(run, ", ".join(f"{c} string" for c in keep) + ", text string, n_blocks int")
    return found.select(*[F.col(c).cast(pages.schema[c].dataType).alias(c) for c in keep], "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
