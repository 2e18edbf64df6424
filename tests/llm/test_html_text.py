import html
import itertools
import random
import re
import time

import numpy as np

from stratum.llm import html_text, page_model
from stratum.llm.html_text import Model, extract, max_flow, min_cut

MEDIUM = "/root/testdata/sf0.01"


def main_text(page):
    return html_text.main_text(page, page_model.fitted())


def cost(score, links, label):
    return sum(max(0, -s) if x else max(0, s) for s, x in zip(score, label, strict=True)) + sum(c for (i, j), c in links.items() if label[i] != label[j])


def test_min_cut_against_all_labellings():
    r = random.Random(1)
    for _ in range(300):
        n = r.randrange(1, 9)
        score = [r.uniform(-2, 2) for _ in range(n)]
        links = {(i, j): r.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
        best = min(cost(score, links, x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(score, links, min_cut(score, links)) - best) < 1e-4
        near = [{j if a == i else a: c for (a, j), c in links.items() if i in (a, j)} for i in range(n)]
        side = max_flow(dict(enumerate(score)), dict(enumerate(near)))
        assert abs(cost(score, links, [i in side for i in range(n)]) - best) < 1e-4


def test_articles_of_the_table(spark):
    """The pages of the table have one layout: this tests the scan on real text, the tests below the labelling."""
    df = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    got = {r.page_id: r for r in extract(df).collect()}
    good = 0
    for r in df.collect():
        body = r.html.split("<article>", 1)[1].split("</article>")[0] if "<article>" in r.html else ""
        want = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        good += got[r.page_id].text == "\n\n".join(x for x in want if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert good >= 0.98 * len(got), good


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="home page">
<header class="site-header"><a href="/">Logo</a><p>Welcome to the best site of all sites.</p></header>
<div id="cookie-notice"><p>We use cookies to make this long and winding site better for every visitor.</p></div>
<div class="main-nav"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>
<div class="content"><h1>A &amp; B</h1><p>First paragraph of a long story, with <b>bold
 text</b> and a <a href="x">link</a> inside it.<br>And a second line.
<p>Short one.<div class="ad">Buy now, this is the best offer you will ever see, dear reader.</div>
<p>Another paragraph which goes on for quite some time, so that it is content.&nbsp;Yes&#33;</p>
<form action="/s"><label>Email</label><input name=e><button>Go</button></form>
<script>if (1 < 2) document.write("<p>no</p>")</script></div>
<aside><p>Related stories that you may like to read because others have read them.</p></aside>
<section id="comments"><h2>Comments</h2><p>I do not agree with this article at all, it is wrong in every way.</p></section>
<footer><p>Copyright 2020 by the people who made this page. All rights reserved.</p></footer></body></html>"""


def test_parts_of_a_page():
    assert main_text(PAGE).split("\n\n") == [
        "A & B",
        "First paragraph of a long story, with bold text and a link inside it. And a second line.",
        "Short one.",
        "Another paragraph which goes on for quite some time, so that it is content. Yes!",
    ]


def test_wrappers_are_not_taken_for_their_parts():
    text = "<p>One sentence of the story, long enough to be read.</p><p>Another one follows it, as they do.</p><p>And a third.</p>"
    want = "One sentence of the story, long enough to be read.\n\nAnother one follows it, as they do.\n\nAnd a third."
    for page in (
        f'<body class="x"><div class="layout has-sidebar">{text}</div><div class="sidebar"><p>Not this one, of course.</p></div>',
        f'<form id="aspnetForm"><h1>Title</h1>{text}</form>',
        f'<div class="sidebar-right"><article class="post comments-open">{text}</article><div class="sidebar">Nor this.</div></div>',
        f'<div id="content"><div class="entry">{text}</div><ol class="comment-list"><li><article class="comment"><p>I liked this story, it was long enough.</p></article></ol></div>',
    ):
        assert main_text(page).removeprefix("Title\n\n") == want, page


def test_edges(spark):
    schema = "page_id long, url string, html string, text string"
    assert extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "", "x"), (None, "u", "just a few words.", "x"), (5, "u", "<article><p>cut in the mid", "x"), (6, "u", "<" * 20_000 + "<p \"" * 5_000, "x"), (7, "u", "<article>" + "<p>A line of the text, it is said.</p>" * 20_000, "x"), (8, "u", "<div>" * 3000 + "x", "x")]
    got = extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {g.page_id: g.text for g in got}
    assert by[1] == "" and by[2] == "" and by[5] == "cut in the mid" and by[7].count("\n\n") == 19_999
    assert html_text.edges([], Model()) == {} and html_text.main_text("<p>x</p>", Model()) == ""


def held_out(n=500):
    source = page_model.Pages(2024)
    pages = [source.page() for _ in range(n)]
    return [p for p, _ in pages], [page_model.labelled(*p)[2] for p in pages]


def test_the_cut_decides_labels():
    """Fails if the cut is replaced by the sign of the scores, or by a classifier fitted without edges."""
    model = page_model.fitted()
    pages, truth = held_out()
    found = [html_text.blocks(p, model) for p in pages]
    cut = [html_text.labels(b, model) for b in found]
    sign = [[x.score > 0 for x in b] for b in found]
    changed = sum(a != b for x, y in zip(cut, sign, strict=True) for a, b in zip(x, y, strict=True))
    exact = [sum(list(a) == list(b) for a, b in zip(x, truth, strict=True)) for x in (cut, sign)]
    assert page_model.f1(cut, truth) > 0.985 and page_model.f1(cut, truth) > page_model.f1(sign, truth) + 0.003
    assert changed > 50 and exact[0] > exact[1] + 20 and exact[0] > 0.85 * len(pages), (changed, exact)


def test_edges_pay_beside_a_classifier_without_them():
    source = page_model.Pages(1)
    rows, truth = [], []
    for _ in range(1200):
        found, every, y = page_model.labelled(*source.page())
        rows += page_model._all_marks(found, every)
        truth.append(y)
    alone = page_model.regression(rows, [], np.concatenate(truth))
    pages, truth = held_out()
    signs = [[x.score > 0 for x in html_text.blocks(p, alone)] for p in pages]
    cut = [html_text.labels(html_text.blocks(p, page_model.fitted()), page_model.fitted()) for p in pages]
    assert page_model.f1(cut, truth) > page_model.f1(signs, truth)


def test_pseudo_likelihood_gradient():
    """The fit ends where the slope of the penalised pseudo-likelihood is next to nothing, by finite differences."""
    r = random.Random(3)
    truth = np.array([k // 4 % 2 == 0 for k in range(80)])
    rows = [["bias", *(x for x in "ab" if r.random() < (0.7 if t else 0.4))] for t in truth]
    pairs = [(k, k + 1, "next") for k in range(79)]
    got = page_model.regression(rows, pairs, truth, least=1, penalty=0.01, rounds=3000)

    def loss(weight, edge):
        total = 0.0
        for i, x in enumerate(rows):
            z = sum(weight[m] for m in x) + sum(edge * (1 if truth[j] else -1) for a, b, _ in pairs for j in ((b,) if a == i else (a,) if b == i else ()))
            total += np.log1p(np.exp(-z if truth[i] else z)) / len(rows)
        return total + 0.005 * (sum(w * w for w in weight.values()) + edge * edge)

    base, e = dict(got.weight), got.edge["next"]
    assert e > 0.3
    for m in base:
        up, down = ({**base, m: base[m] + h} for h in (1e-3, -1e-3))
        assert abs(loss(up, e) - loss(down, e)) / 2e-3 < 2e-3, m
    assert abs(loss(base, e + 1e-3) - loss(base, e - 1e-3)) / 2e-3 < 2e-3


STORY = "<p>One sentence of the story, long enough to be read.</p><p>Another one follows it, as they do.</p><p>And a third.</p>"
LINES = ["One sentence of the story, long enough to be read.", "Another one follows it, as they do.", "And a third."]


def test_nothing_is_lost_after_odd_markup():
    for odd, text in (
        ('<svg class="i"/>', None),
        ("<p>A <svg><text>no</text></svg> b.</p>", "A b."),
        ("<p><video-player>Words of a custom element</video-player> are read.</p>", "Words of a custom element are read."),
        ("<p>It has <select-box>one</select-box> and <object-card>two</object-card> of them.</p>", "It has one and two of them."),
        ("<!-->", None),
        ("<!--->", None),
        ("<!-- a > b --!>", None),
        ("<button>", None),
        ("<canvas>", None),
        ("<noscript>", None),
        ("<select><option>never", None),
        ("<p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> stands for <object data=x>the number</object>.</p>", "The formula x=1 stands for the number."),
        ('<div class="share-price-note"><p>The price of the shares fell all through the year.</p></div>', "The price of the shares fell all through the year."),
        ("<script>var a = '</p>'; if (a < b) x()</script><style>p{}</style><iframe src=x>no</iframe>", None),
        ("<p>A word<br>and <wbr>ano<b>th</b>er &eacute;&#233;&amp;</p>", "A word and another éé&"),
    ):
        got = main_text(f"<body><article><h1>Title</h1>{STORY}{odd}{STORY}</article>").split("\n\n")
        assert got == ["Title", *LINES, *([text] if text else []), *LINES], (odd, got)
    assert main_text("<main><h1>T</h1><p>See <a>this long link text here</a>.</p></main>") == "T\n\nSee this long link text here."


def test_time_grows_with_the_page():
    """Deep, wide and broken pages: far from the square of their length."""
    for unit, end in (("<div>", "<p>x y z.</p></div>"), ('<p class="c{}">a b.', ""), ("<noscript><p>x", ""), ("</p><b>", ""), ("<li>x<div>", ""), ('<div class="k{}">x', "</h1>"), ("<p \"", "")):
        took = []
        for n in (3000, 12000):
            page = "".join(unit.replace("{}", str(i)) for i in range(n)) + end * n
            start = time.process_time()
            main_text(page)
            took.append(time.process_time() - start)
        assert took[1] < 10 * took[0] + 0.5, (unit, took)


def test_clashing_columns(spark):
    rows = [(1, "u", "<article><p>A line of text.</p></article>", "a", "b", 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, `a.b` string, n_chars int")).collect()
    assert [tuple(r) for r in got] == [(1, "u", "A line of text.", 15)]
