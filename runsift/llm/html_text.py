"""HTML extraction: gradient-boosted trees over DOM nodes with hierarchical decoding.

Each node (block elements and text runs) gets features of its subtree (text, link and tag
density), its attribute words and tag (as log odds learned from the training pages, of itself and
of the path above), its depth, place and siblings.  Boosted trees give the probability that a node
holds main text.  Decoding takes the most probable labelling of the whole tree in which nothing
below a dropped node is kept, so ancestor and descendant never contradict each other.

Training pages are generated here (see training_pages), with the marks of main text and of
menus, headers, footers, sidebars, notices, adverts, forms and comments; nothing is learned from
the pages that are extracted.

Defined results: null or empty html has an empty text; a page without main text too; null url
or page_id stay null; repeated rows give repeated results; other columns are kept.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Page, parse
from .wordbag import in_slices

ROUNDS, DEPTH, SHRINK, BINS, LEAST_ROWS = 60, 4, 0.2, 32, 20
TRAIN_PAGES = 2000
#: Attribute words that training saw less often than this have no log odds.
LEAST_SEEN = 4

CONTENT_NAMES = "content main article post entry story body text prose markdown post-content entry-content article-body main-content page-content story-body blog-post hentry".split()
SIDE_NAMES = {
    "nav": "nav menu navbar navigation main-nav site-nav breadcrumb breadcrumbs topnav dropdown tabs pagination pager toc".split(),
    "header": "header masthead site-header top-bar topbar branding logo banner hero-header".split(),
    "footer": "footer site-footer bottom copyright colophon legal credits page-footer".split(),
    "aside": "sidebar side aside widget related recommended trending popular tags rail promo-list author-box archive".split(),
    "notice": "cookie cookie-banner notice consent alert gdpr popup modal overlay message warning announcement paywall subscribe-notice".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsense ad-slot commercial".split(),
    "form": "form search search-form newsletter subscribe login signup contact-form".split(),
    "comments": "comments comment comment-list commentlist disqus responses replies discussion reader-comments feedback".split(),
    "share": "share social social-links sharing follow buttons toolbar meta".split(),
}


# ---------------------------------------------------------------- training pages


class Writer:
    """Writes a page and notes which text runs are main text; runs are marked by a private-use character."""

    MARK = "\ue000"

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghklmnprstvwzéñß") + self.r.choice("aeiouäô")) + self.r.choice(["", "n", "s", "r"]) for _ in range(40)]

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4))) for _ in range(max(1, n)))

    def sentence(self, n: int) -> str:
        return self.words(n).capitalize() + self.r.choice(".....!?")

    def prose(self, n: int) -> str:
        out = []
        while n > 0:
            k = min(n, self.r.randint(3, 22))
            out.append(self.sentence(k))
            n -= k
        return " ".join(out)

    def attrs(self, names: list[str], chance: float = 0.8) -> str:
        if self.r.random() > chance:
            return ""
        name = self.r.choice(names)
        if self.r.random() < 0.3:
            name += self.r.choice(["-1", "-wrapper", "-inner", "__box", " col", " clearfix", "-container"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int, prose: bool = False) -> str:
        made = [f'<a href="/{i}">{self.words(self.r.randint(1, 4))}</a>' for i in range(n)]
        if prose:
            return " ".join(made)
        if self.r.random() < 0.7:
            close = self.r.choice(["</li>", "</li>", ""])
            return "<ul>" + "".join(f"<li>{a}{close}" for a in made) + "</ul>"
        return self.r.choice([" | ", " ", "&middot;", "<br>"]).join(made)

    def main_blocks(self) -> str:
        r, m, out = self.r, self.MARK, []
        if r.random() < 0.8:
            out.append(f"<h1{self.attrs(['title', 'headline', 'entry-title'], 0.3)}>{m}{self.words(r.randint(1, 12))}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            kind, n = r.random(), r.choice([1, 3, 8, 15, 30, 60, 120, 300])
            text = self.prose(n)
            if r.random() < 0.25 and n > 3:
                text += f' <a href="/x">{self.words(2)}</a> {self.words(3)}'
            if kind < 0.55:
                shape = r.random()
                out.append(f"<p>{m}{text}</p>" if shape < 0.6 else f"<p>{m}{text}" if shape < 0.8 else f"<p><b>{m}{text}<br>")
            elif kind < 0.65:
                out.append(f"<h{r.randint(2, 4)}>{m}{self.words(r.randint(1, 8))}</h2>".replace("</h2>", "</h2></h3></h4>"))
            elif kind < 0.75:
                items = "".join(f"<li>{m}{self.prose(r.choice([2, 5, 12, 25]))}</li>" for _ in range(r.randint(2, 7)))
                out.append(r.choice([f"<ul>{items}</ul>", f"<ol>{items}</ol>"]))
            elif kind < 0.80:
                out.append(f"<blockquote>{m}{text}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{m}{text}</p></blockquote>")
            elif kind < 0.84:
                out.append("<table>" + "".join(f"<tr><td>{m}{self.words(2)}</td><td>{m}{self.words(3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif kind < 0.88:
                out.append(f"<figure><img src=x><figcaption>{m}{self.sentence(8)}</figcaption></figure>")
            elif kind < 0.92:
                out.append(f"<pre>{m}{text}</pre>")
            elif kind < 0.96:
                out.append(f"<div>{m}{text}</div>")
            else:
                out.append(f"<section{self.attrs(CONTENT_NAMES + ['section'], 0.4)}><h2>{m}{self.words(4)}</h2><p>{m}{text}</p></section>")
            if r.random() < 0.06:
                out.append(self.side(r.choice(["ad", "share", "aside", "form"])))
        return "".join(out)

    def side(self, kind: str) -> str:
        r = self.r
        tags = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"]}
        tag = r.choice(tags.get(kind, ["div", "div", "section", "aside"]))
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5
        open_ = f"<{tag}{'' if plain else self.attrs(SIDE_NAMES[kind], 1.0)}>"
        if kind == "nav":
            body = self.links(r.randint(2, 14))
        elif kind == "header":
            body = r.choice(["", f"<h1>{self.words(2)}</h1>", f"<p>{self.words(5)}</p>", f"<div>{self.words(3)}</div>"]) + r.choice(["", self.links(r.randint(1, 6))])
        elif kind == "footer":
            body = r.choice(["&copy; ", "<p>&copy; ", ""]) + self.words(r.randint(2, 5)) + r.choice([" &middot; ", " "]) + self.prose(r.choice([3, 10, 30])) + r.choice(["", self.links(r.randint(1, 8))])
        elif kind == "aside":
            body = r.choice(["", f"<h3>{self.words(2)}</h3>"]) + r.choice([self.links(r.randint(2, 10)), f"<p>{self.prose(r.choice([6, 20, 50]))}</p>", f"<p>{self.prose(10)}</p>" + self.links(3)])
        elif kind == "notice":
            text = self.prose(r.choice([4, 12, 30, 60]))
            body = r.choice([text, f"<p>{text}</p>"]) + r.choice(["", "<button>OK</button>", '<a href="/c">' + self.words(1) + "</a>"])
        elif kind == "ad":
            text = self.prose(r.choice([2, 6, 12, 30]))
            body = r.choice([text, f"<p>{text}</p>", f'<a href="/ad">{text}</a>', f"<h4>{self.words(3)}</h4><p>{text}</p>"])
        elif kind == "form":
            body = f"<label>{self.words(2)}</label><input name=q>" + r.choice(["", f"<p>{self.prose(8)}</p>", f"<p>{self.prose(20)}</p>"]) + "<button>Go</button>"
            if tag == "div":
                body = f"<form>{body}</form>"
        elif kind == "comments":
            tag_of_one = r.choice(["div", "div", "li", "div", "li", "article"])

            def one() -> str:
                who = r.choice(["", f"<b>{self.words(1)}</b> ", f"<h4>{self.words(2)}</h4>"])
                named = self.attrs(["comment", "reply", "comment-body", "response"], 0.8)
                return f"<{tag_of_one}{named}>{who}<p>{self.prose(r.choice([4, 12, 30, 70]))}</p></{tag_of_one}>"

            body = f"<h3>{self.words(2)}</h3>" + "".join(one() for _ in range(r.randint(1, 7)))
        else:
            body = self.links(r.randint(2, 6), True)
        return f"{open_}{body}</{tag}>"

    def page(self) -> str:
        r = self.r
        inner = self.main_blocks()
        if r.random() < 0.25:
            inner += self.side("comments")
        if r.random() < 0.15:
            inner = self.side(r.choice(["nav", "share", "ad", "header"])) + inner
        wrap = r.random()
        if wrap < 0.45:
            core = f"<article{self.attrs(CONTENT_NAMES, 0.4)}>{inner}</article>"
        elif wrap < 0.60:
            core = f"<main{self.attrs(CONTENT_NAMES, 0.4)}>{inner}</main>"
        elif wrap < 0.96:
            core = f"<div{self.attrs(CONTENT_NAMES, 0.85)}>{inner}</div>"
        else:
            core = inner
        if r.random() < 0.3:
            core = f"<{(t := r.choice(['main', 'div', 'section']))}{self.attrs(CONTENT_NAMES + ['wrapper', 'container', 'row', 'page'], 0.7)}>{core}{self.side('aside') if r.random() < 0.4 else ''}</{t}>"
        before = [self.side(k) for k, p in (("header", 0.55), ("nav", 0.75), ("notice", 0.3), ("ad", 0.4), ("form", 0.2), ("aside", 0.15)) if r.random() < p]
        after = [self.side(k) for k, p in (("share", 0.2), ("comments", 0.35), ("aside", 0.4), ("ad", 0.2), ("form", 0.2), ("notice", 0.15), ("footer", 0.8)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
            r.shuffle(after)
        body = "".join(before) + core + "".join(after)
        if r.random() < 0.3:
            body = f"<div{self.attrs(['wrapper', 'container', 'page', 'site', 'layout'], 0.9)}>{body}</div>"
        return f"<html><head><title>{self.words(4)}</title></head><body>{body}</body></html>"


# ---------------------------------------------------------------- features

MAIN_TAGS = frozenset(["article", "main"])
SIDE_TAGS = frozenset(["nav", "header", "footer", "aside", "form"])


@lru_cache(200_000)
def shape_of(text: str) -> tuple[int, int]:
    return text.count(" ") + 1, sum(map(text.count, ".,;!?"))


def raw_features(page: Page, tag_odds: dict, word_odds: dict) -> np.ndarray:
    """One row a node; see the names at the end."""
    n, parent = len(page.tag), page.parent
    chars, linked, words, marks = [0] * n, list(page.linked), [0] * n, [0] * n
    runs, tags, longest, kids = [0] * n, [0] * n, [0] * n, [0] * n
    start, total = [0] * n, 0
    for i in range(n):
        start[i] = total
        if page.tag[i] == "#text":
            chars[i] = longest[i] = len(page.text[i])
            words[i], marks[i] = shape_of(page.text[i])
            runs[i] = 1
            total += chars[i]
        else:
            tags[i] = 1
    same: dict[tuple[int, str], int] = {}
    index = [0] * n
    for i in range(1, n):
        p = parent[i]
        index[i] = kids[p]
        kids[p] += 1
        same[p, page.tag[i]] = same.get((p, page.tag[i]), 0) + 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        words[p] += words[i]
        marks[p] += marks[i]
        runs[p] += runs[i]
        tags[p] += tags[i]
        if longest[i] > longest[p]:
            longest[p] = longest[i]
    total = max(total, 1)
    out = np.zeros((n, 33))
    within, side, named, before = [0] * n, [0] * n, [0.0] * n, [0] * n
    last: dict[int, int] = {}
    depth, low, low_tag, high, attr, odds = [0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n):
        p, tag = parent[i], page.tag[i]
        known = [word_odds[w] for w in page.words[i] if w in word_odds]
        attr[i] = sum(known) / len(known) if known else 0.0
        odds[i] = tag_odds.get(tag, 0.0)
        if p >= 0:
            depth[i] = depth[p] + 1
            low[i], high[i], low_tag[i] = min(low[p], min(known, default=0.0)), max(high[p], attr[i]), min(low_tag[p], odds[i])
            within[i] = within[p] + (tag in MAIN_TAGS)
            side[i] = side[p] + (tag in SIDE_TAGS)
            named[i] = attr[i] or named[p]
            before[i] = last.get(p, 0)
            last[p] = i
        c = chars[i] or 1
        pc = chars[p] or 1 if p >= 0 else 1
        out[i] = (
            odds[i], attr[i], odds[p] if p >= 0 else 0, attr[p] if p >= 0 else 0, low[i], high[i], low_tag[i], depth[i],
            math.log1p(chars[i]), linked[i] / c, math.log1p(words[i]), marks[i] / (words[i] or 1), runs[i], chars[i] / (tags[i] + 1), longest[i], kids[i],
            chars[i] / total, start[i] / total, kids[p] if p >= 0 else 1, index[i] / (kids[p] or 1) if p >= 0 else 0, same.get((p, tag), 1),
            linked[p] / pc if p >= 0 else 0, chars[i] / pc, math.log1p(pc), (marks[p] / (words[p] or 1)) if p >= 0 else 0, math.log1p(total),
            within[i], side[i], named[i], odds[before[i]], math.log1p(chars[before[i]]) if before[i] else 0, tag in MAIN_TAGS, runs[p] if p >= 0 else 1,
        )
    return out


# ---------------------------------------------------------------- boosted trees


class Trees:
    """Gradient-boosted trees for the logistic loss, over binned features; complete binary trees of one depth."""

    def __init__(self, edges, feature, cut, leaf, bias):
        self.edges, self.feature, self.cut, self.leaf, self.bias = edges, feature, cut, leaf, bias

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)], 1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    model = Trees(edges, [], [], [], math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    b = model.binned(x).astype(np.int64)
    margin = np.full(len(y), model.bias)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p) + 1e-9
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local, best = at - first, np.full(width, 1e-6)
            for f in range(x.shape[1]):
                cell = local * (BINS + 1) + b[:, f]
                g, h, c = (np.bincount(cell, w, width * (BINS + 1)).reshape(width, BINS + 1).cumsum(1) for w in (grad, hess, None))
                gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(c < LEAST_ROWS) | (c[:, -1:] - c < LEAST_ROWS)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                feature[first : first + width][better], cut[first : first + width][better] = f, k[better]
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        at -= 2**DEPTH - 1
        g, h = np.bincount(at, grad, 2**DEPTH), np.bincount(at, hess, 2**DEPTH)
        leaf = SHRINK * g / (h + 1)
        margin += leaf[at]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


# ---------------------------------------------------------------- model


def marked(page: Page) -> list[bool]:
    """For each node of a training page whether its subtree has main text; takes the marks out."""
    main = [False] * len(page.tag)
    for i in range(len(page.tag) - 1, 0, -1):
        if Writer.MARK in page.text[i]:
            page.text[i] = page.text[i].replace(Writer.MARK, "")
            main[i] = True
        main[page.parent[i]] |= main[i]
    return main


def log_odds(pairs: list[tuple[str, bool]], least: int) -> dict[str, float]:
    seen: dict[str, list[int]] = {}
    for key, main in pairs:
        seen.setdefault(key, [0, 0])[main] += 1
    return {k: math.log((m + 1) / (o + 1)) for k, (o, m) in seen.items() if m + o >= least}


def decode(parent: list[int], margin: np.ndarray) -> list[bool]:
    """The most probable labels such that a kept node's parent is kept; the root is kept."""
    n = len(parent)
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    keep, drop = yes.tolist(), no.tolist()
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    out = [True] + [False] * (n - 1)
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] >= drop[i]
    return out


class Model:
    def __init__(self, trees: Trees, tag_odds: dict, word_odds: dict):
        self.trees, self.tag_odds, self.word_odds = trees, tag_odds, word_odds

    def texts(self, sources: list[str]) -> list[str]:
        """Main text of each page, its blocks joined by newlines."""
        out: list[str] = [""] * len(sources)
        for start, part in in_slices(sources, 2_000_000):
            pages = [parse(s) for s in part]
            margin = self.trees.margin(np.concatenate([raw_features(p, self.tag_odds, self.word_odds) for p in pages]))
            at = 0
            for i, p in enumerate(pages, start):
                kept = decode(p.parent, margin[at : at + len(p.tag)])
                at += len(p.tag)
                out[i] = "\n".join(t for t, k in zip(p.text, kept) if k and t)
        return out


def train(pages: int = TRAIN_PAGES, seed: int = 11) -> Model:
    made = [parse(Writer(seed * 100_000 + i).page()) for i in range(pages)]
    main = [marked(p) for p in made]
    tag_odds = log_odds([(t, m) for p, ms in zip(made, main) for t, m in zip(p.tag, ms)], 1)
    word_odds = log_odds([(w, m) for p, ms in zip(made, main) for ws, m in zip(p.words, ms) for w in ws], LEAST_SEEN)
    x = np.concatenate([raw_features(p, tag_odds, word_odds) for p in made])
    return Model(boost(x, np.concatenate(main).astype(float)), tag_odds, word_odds)


@lru_cache(1)
def trained() -> Model:
    return train()


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of column ``html`` in column ``out``."""
    model = trained()

    @F.pandas_udf("string")
    def main_text(sources: pd.Series) -> pd.Series:
        return pd.Series(model.texts(sources.tolist()), dtype=object)

    return pages.withColumn(out, main_text(F.col(html)))
