"""The page classifier of `html_text`, fitted on generated pages.

No labelled pages are given, so pages are made by rule, in many layouts and with
known content: with and without an <article>, with telling, misleading and
meaningless names, adverts inside the text, comments longer than it, hidden parts,
wrappers whose names mention their parts, and words of no language. A logistic
regression on the marks of blocks (`html_text.marks`, `own_marks`) and on the labels
of their neighbours gives both the weights and the capacities of the edges. It takes
some seconds on the driver, once a process.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

from . import html_text as H

#: Names that pages give to parts of each kind: what the generator draws from. Fixed values.
NAMES = {
    "content": "article content contents post entry main story body text article-body main-content prose post-content entry-content page-content".split(),
    "nav": "nav navbar navigation menu submenu main-menu top-nav breadcrumb breadcrumbs pagination pager toolbar skip-link site-nav".split(),
    "header": "header masthead site-header top page-header branding logo topbar".split(),
    "footer": "footer site-footer foot copyright legal disclaimer bottom contentinfo".split(),
    "sidebar": "sidebar side-bar side aside rail widget widgets related related-posts recommended recommendations teaser tagcloud right-rail complementary".split(),
    "ad": "ad ads advert advertisement ad-slot adsense banner promo promotion sponsor sponsored".split(),
    "notice": "cookie cookie-notice cookies consent gdpr-consent notice alert popup modal overlay paywall".split(),
    "form": "newsletter subscribe subscription signup login register search searchbox contact-form".split(),
    "share": "share sharing share-bar social social-links follow".split(),
    "comment": "comment comments comment-list reply replies respond disqus discussion reader-comments".split(),
}
WRAPPERS = "wrapper page container layout site row has-sidebar no-sidebar sidebar-right with-sidebar comments-open nav-open layout-sidebar no-ads outer has-cookie-bar".split()
#: Names of blocks of the text that look like those of other parts.
ODD = "share-price-note ad-hoc social-history footer-note related-work comment-on-method side-effects menu-of-the-day header-row promo-code-history lead intro note caption quote".split()


class Pages:
    """A source of (page, texts of its content blocks)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.vocabulary = ["".join(self.r.choice("bcdfghklmnprstvz") + self.r.choice("aeiouéü") for _ in range(self.r.randint(1, 4))) for _ in range(800)]

    def words(self, least: int, most: int) -> str:
        r = self.r
        return " ".join(r.choice(self.vocabulary) for _ in range(int(least * (most / least) ** r.random() + 0.5)))

    def sentences(self, least: int, most: int) -> str:
        got = self.words(least, most).split()
        out, k = [], 0
        while k < len(got):
            n = self.r.randint(3, 16)
            out.append(" ".join(got[k : k + n]).capitalize() + self.r.choice("....!?"))
            k += n
        return " ".join(out)

    def gibberish(self) -> str:
        return "".join(self.r.choice("bcdfghjkmnpqrstvwxz") for _ in range(self.r.randint(2, 7)))

    def attrs(self, kind: str, telling: float) -> str:
        r = self.r
        if r.random() < telling:
            name = r.choice(NAMES[kind])
            if r.random() < 0.2:
                name += r.choice((" ", "-", "_")) + self.gibberish()
        elif r.random() < 0.6:
            name = self.gibberish()
        else:
            return ""
        return f" {r.choice(('class', 'class', 'class', 'id'))}={r.choice(('{}', chr(34) + '{}' + chr(34)) if ' ' not in name else (chr(34) + '{}' + chr(34),)).format(name)}"

    def link(self, least: int = 1, most: int = 5) -> str:
        return f'<a href="/{self.gibberish()}">{self.words(least, most)}</a>'

    def links(self) -> str:
        items = [self.link() for _ in range(self.r.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.75 else " | ".join(items)

    def junk(self, kind: str, telling: float) -> str:
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "notice": "dialog"}.get(kind)
        if tag is None or r.random() < 0.5:
            tag = r.choice(("div", "div", "section"))
            attrs = self.attrs(kind, max(telling, 0.85))
        else:
            attrs = self.attrs(kind, telling)
        p = lambda *n: f"<p>{self.sentences(*n)}</p>"
        if kind == "nav":
            body = self.links()
        elif kind == "header":
            body = r.choice(("", self.link(1, 3))) + r.choice(("", f"<p>{self.words(3, 9)}</p>", p(3, 12), f"<h2>{self.words(1, 4)}</h2>")) + r.choice(("", self.links()))
        elif kind == "footer":
            body = f"<p>&copy; {r.randint(1995, 2030)} {self.sentences(2, 20)}</p>" if r.random() < 0.5 else "&copy; " + self.words(1, 4) + " &middot; " + self.sentences(2, 25) if r.random() < 0.6 else p(3, 25) + self.links()
        elif kind == "sidebar":
            body = r.choice(("", f"<h3>{self.words(1, 4)}</h3>")) + "".join(r.choice((self.links, lambda: p(3, 60), lambda: p(3, 30), lambda: f"<p>{self.link(4, 10)}</p>"))() for _ in range(r.randint(1, 4)))
        elif kind == "ad":
            body = r.choice((self.sentences(3, 25), p(3, 30), self.link(2, 8), p(3, 12) + self.link(1, 3)))
        elif kind == "notice":
            body = p(5, 40) + r.choice(("", self.link(1, 3), "<button>" + self.words(1, 2) + "</button>"))
        elif kind == "form":
            body = r.choice(("", p(3, 15))) + f"<label>{self.words(1, 3)}</label><input name=x>" + r.choice(("", f"<button>{self.words(1, 2)}</button>"))
        elif kind == "share":
            body = self.links() if r.random() < 0.6 else self.words(1, 3) + " " + self.link(1, 2)
        else:
            one = lambda: f"<{t}{self.attrs('comment', 0.6)}>" + r.choice(("", f"<h4>{self.words(1, 3)}</h4>", f"<b>{self.words(1, 2)}</b>")) + "".join(p(3, 60) for _ in range(r.randint(1, 3))) + r.choice(("", self.link(1, 1))) + f"</{t}>"
            t = r.choice(("div", "article", "li"))
            many = "".join(one() for _ in range(r.choice((1, 2, 4, 10))))
            body = r.choice(("", f"<h2>{self.words(1, 3)}</h2>")) + (f"<ol>{many}</ol>" if t == "li" else many)
            attrs = self.attrs("comment", max(telling, 0.9))
        if kind in ("notice", "form", "sidebar") and r.random() < 0.1:
            attrs += r.choice((" hidden", ' style="display:none"', ' aria-hidden="true"'))
        return f"<{tag}{attrs}>{body}</{tag}>"

    def text_block(self, want: list[str]) -> str:
        """A piece of the content, whose texts are added to `want`."""
        r = self.r
        x = r.random()
        odd = f' class="{r.choice(ODD)}"' if r.random() < 0.03 else ""

        def seen(s: str) -> str:
            want.append(s)
            return s

        if x < 0.66:
            t = seen(self.sentences(2, 130) if r.random() < 0.85 else self.words(1, 12))
            if r.random() < 0.25:
                w = t.split(" ")
                k = r.randrange(len(w))
                w[k] = f'<a href="x">{w[k]}</a>' if r.random() < 0.6 else f"<b>{w[k]}</b>"
                t = " ".join(w)
            return f"<p{odd}>{t}</p>" if r.random() < 0.85 else f"<div{odd}>{t}</div>"
        if x < 0.76:
            t = r.choice(("h2", "h3"))
            return f"<{t}{odd}>{seen(self.words(1, 8))}</{t}>"
        if x < 0.85:
            t = r.choice(("ul", "ol"))
            return f"<{t}{odd}>" + "".join(f"<li>{seen(self.words(1, 10) if r.random() < 0.5 else self.sentences(3, 30))}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>"
        if x < 0.9:
            return f"<blockquote{odd}><p>{seen(self.sentences(3, 40))}</p></blockquote>"
        if x < 0.94:
            return f"<figure><img src=x><figcaption>{seen(self.words(2, 10))}</figcaption></figure>"
        if x < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{seen(self.words(1, 4))}</td>" for _ in range(r.randint(2, 4))) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<pre>{seen(self.words(3, 30))}</pre>"

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        telling = r.choice((1.0, 0.8, 0.8, 0.3, 0.0))
        want: list[str] = []
        inside: list[str] = []
        if r.random() < 0.85:
            t = self.words(1, 12) + r.choice(("", "", ".", "?"))
            want.append(t)
            title = f"<h1>{t}</h1>"
            inside.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.choice((1, 2, 3, 5, 8, 13, 21))):
            inside.append(self.text_block(want))
            if r.random() < 0.15:
                inside.append(self.junk(r.choice(("ad", "ad", "share", "form")), max(telling, 0.9)))
        text = "".join(inside)
        x = r.random()
        if x < 0.35:
            core = f"<article{self.attrs('content', telling * 0.6)}>{text}</article>"
        elif x < 0.5:
            core = f"<main{self.attrs('content', telling * 0.6)}>{text}</main>"
        elif x < 0.9:
            core = f"<div{self.attrs('content', telling)}>{text}</div>"
        elif x < 0.95:
            core = f"<table><tr><td>{self.links()}</td><td>{text}</td></tr></table>"
        else:
            core = text
        above = [k for k in ("notice", "header", "nav", "ad") if r.random() < 0.5]
        below = [k for k in ("share", "sidebar", "form", "comment", "ad", "nav", "notice", "footer") if r.random() < 0.45]
        if r.random() < 0.1:
            above.append("sidebar")
        page = "".join(self.junk(k, telling) for k in above) + core + "".join(self.junk(k, telling) for k in below)
        for _ in range(r.choice((0, 0, 1, 2))):
            page = f'<div class="{r.choice(WRAPPERS)} {self.gibberish()}">{page}</div>' if r.random() < 0.9 else f'<form id="{self.gibberish()}">{page}</form>'
        return f"<!doctype html><html><head><title>{self.words(1, 5)}</title></head><body>{page}</body></html>", want


def labelled(page: str, want: list[str]) -> tuple[list[H.Block], list[H.Element], np.ndarray]:
    """Blocks, elements, and which blocks are content: `want` in order."""
    found, every = H.parse(page)
    truth, k = np.zeros(len(found), bool), 0
    for i, b in enumerate(found):
        if k < len(want) and b.text == want[k]:
            truth[i] = True
            k += 1
    if k < len(want):
        raise ValueError("a generated text was not read")
    return found, every, truth


def _all_marks(found: list[H.Block], every: list[H.Element]) -> list[list[str]]:
    total = every[0].words
    held: dict[int, frozenset[str]] = {}
    for e in every:
        above = held[id(e.up)] if e.up is not None else frozenset()
        held[id(e)] = above | set(H.marks(e, total))
    return [[*held[id(b.element)], *own] for b, own in zip(found, H.own_marks(found, total), strict=True)]


def regression(rows: list[list[str]], pairs: list[tuple[int, int, str]], truth: np.ndarray, least: int = 12, penalty: float = 1e-5, rounds: int = 250) -> H.Model:
    """Weights of the marks and capacities of the edges that occur `least` times: greatest penalised pseudo-likelihood, by Adam.

    Given the labels of its neighbours, a block's log odds of being content are its
    score and, for each edge, the capacity towards the neighbour's label.
    """
    count: dict[str, int] = {}
    for x in (*(x for r in rows for x in r), *(x for *_, x in pairs)):
        count[x] = count.get(x, 0) + 1
    known = {x: k for k, x in enumerate(sorted(x for x, n in count.items() if n >= least))}
    edge = sorted({x for *_, x in pairs if x in known})
    y = truth.astype(float)
    cells = [(i, known[x], 1.0) for i, r in enumerate(rows) for x in set(r) if x in known]
    for i, j, x in pairs:
        if x in known:
            cells += [(i, known[x], 2 * y[j] - 1), (j, known[x], 2 * y[i] - 1)]
    row, col, value = (np.array(x) for x in zip(*cells, strict=True))
    least_weight = np.full(len(known), -np.inf)
    least_weight[[known[x] for x in edge]] = 0.0  # the cut needs capacities
    w, m, v = (np.zeros(len(known)) for _ in range(3))
    for it in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col] * value, minlength=len(y))
        g = np.bincount(col, weights=((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y))[row] * value, minlength=len(known)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = np.maximum(w - 0.1 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-9), least_weight)
    kinds = set(edge)
    return H.Model({x: round(float(w[k]), 4) for x, k in known.items() if x not in kinds}, {x: round(float(w[known[x]]), 4) for x in edge})


def f1(found: list[list[bool]], truth: list[np.ndarray]) -> float:
    a, b = np.concatenate([np.array(x, bool) for x in found]), np.concatenate(truth)
    return 2 * float((a & b).sum()) / max(float(a.sum() + b.sum()), 1.0)


def fit(seed: int = 1, pages: int = 1200) -> H.Model:
    source = Pages(seed)
    rows, links, truth = [], [], []
    for _ in range(pages):
        found, every, y = labelled(*source.page())
        links += [(i + len(rows), j + len(rows), kind) for i, j, kind in H.pairs(found)]
        rows += _all_marks(found, every)
        truth.append(y)
    return regression(rows, links, np.concatenate(truth))


@lru_cache(1)
def fitted() -> H.Model:
    return fit()
