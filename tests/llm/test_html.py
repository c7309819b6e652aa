"""Main text of pages: hand-made pages, gradients, held-out layouts, damaged markup."""

from __future__ import annotations

import time

import numpy as np
import pytest

from sparkwell.llm import html_blocks, html_layouts, html_text

PAGE = """<!DOCTYPE html><html lang="en"><head><title>No &amp; no</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav><!-- no <p>no</p> -->
<div class="ad">Buy now, all this week.</div>
<article><h1>A &quot;title&quot;  of&nbsp;the page</h1><p>First <b>bold</b>er
 text &lt;here&gt;, with <a href='x>y'>a link</a> in it.<br>More of it<p>Second &amp paragraph, not closed.<div>And a third one that stands in a box of its own.</div></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with any of this, and I have read it twice.</p></div></section>
<footer>&copy; host.example &middot; All rights reserved.</footer></body></html>"""
TEXT = 'A "title" of the page\n\nFirst bolder text <here>, with a link in it. More of it\n\nSecond & paragraph, not closed.\n\nAnd a third one that stands in a box of its own.'

LAYOUTS = [
    ("<div id=header><a href=/>Site name</a></div><div class='sidebar'><h3>Popular</h3><ul><li><a href=1>One story</a></li><li><a href=2>Other story</a></li></ul></div><div class=post-content>{}</div><div id=footer>© 2020 Someone</div>", "div"),
    ("<header><h1>The Daily</h1></header><nav><a href=1>Home</a> | <a href=2>World</a></nav><main>{}</main><aside><h2>Related</h2><p>Another story that has much to say on all of this, at length.</p></aside><footer><p>All rights reserved.</p></footer>", "main"),
    ("<div class='cookie-notice'><p>We use cookies to make this site better for you.</p><button>Accept</button></div><div class=entry>{}<form class=newsletter><label>Your email</label><input><button>Subscribe</button></form></div><footer>Imprint</footer>", "entry"),
    ("<nav><ul><li><a href=1>Start</a><li><a href=2>Archive</a></ul></nav><article>{}</article><div id='comments' class='comment-list'><h3>2 comments</h3><div class=comment><p>What a fine piece of writing this is, thank you so much.</p></div><div class=comment><p>I have nothing to add but that I was here today.</p></div></div>", "article"),
]
BODY = ["Of ships and the sea", "There was a ship that went out on a fine day, and nobody on the shore knew when it would be back.", "The sea was calm for a week, which was strange at that time of the year, and the crew slept well.", "On the eighth day the wind came."]


@pytest.fixture(scope="module")
def model():
    return html_text.BlockLabeller.fit(html_layouts.labelled_pages([], html_text.LAYOUTS, 42))


def article(html, model):
    return "\n\n".join(t for t, s in html_text.label_blocks(html, model) if s >= 0.5)


def test_pages_by_hand(model):
    assert article(PAGE, model) == TEXT
    for layout, _ in LAYOUTS:
        html = f"<html><body>{layout.format('<h1>' + BODY[0] + '</h1>' + ''.join(f'<p>{x}</p>' for x in BODY[1:]))}</body></html>"
        assert article(html, model) == "\n\n".join(BODY), layout


def test_held_out_layouts(model):
    held = html_layouts.labelled_pages([], 400, 4242)
    scores = model.scores([b for b, _ in held])
    right = np.concatenate([(s >= 0.5) == np.array(y, bool) for s, (_, y) in zip(scores, held, strict=True)])
    assert right.mean() > 0.975  # layouts whose names tell nothing are among them


def test_gradient():
    rng = np.random.default_rng(0)
    model = html_text.BlockLabeller.start(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    sizes = np.array([4, 2, 3])
    x, y = rng.normal(size=(4, 3, html_text.FEATURES)), rng.integers(0, 2, (4, 3)).astype(float)
    _, grads = model.gradient(x, sizes, y)
    for k, g in grads.items():
        for place in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(4)]:
            was, step = model.p[k][place], 1e-6
            model.p[k][place] = was + step
            up, _ = model.gradient(x, sizes, y)
            model.p[k][place] = was - step
            down, _ = model.gradient(x, sizes, y)
            model.p[k][place] = was
            assert (up - down) / (2 * step) == pytest.approx(g[place], rel=1e-4, abs=1e-8)


def test_windows_do_not_matter(model, monkeypatch):
    pages = [b for b, _ in html_layouts.labelled_pages([], 30, 9)] + [[]]
    whole = model.scores(pages)
    monkeypatch.setattr(html_text, "CELLS", 7)
    for a, b in zip(whole, model.scores(pages), strict=True):
        assert np.allclose(a, b, atol=1e-5)
    # a page's scores do not depend on the pages beside it
    assert np.allclose(model.scores([pages[3]])[0], whole[3], atol=1e-5)


def test_word_bins():
    texts = ["One two two", "", "two  Ünë", "x" * 1000, "one"]
    bins = html_text._word_bins(texts)
    assert (bins[1] == 0).all() and np.allclose(bins[4][bins[4] > 0], 0.5 * np.log1p(1)) and (bins[0] >= bins[4]).all()
    for k, text in enumerate(texts):
        assert np.allclose(html_text._word_bins([text])[0], bins[k])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("plain &lt; text", ["plain < text"]),
        ("a < b <p>c", ["a < b", "c"]),
        ("<p>a<!-- x", ["a"]),
        ("<p>a<!-->b<!---->c", ["abc"]),
        ("<p>a<p title='>", ["a"]),
        ("<P>a</P><DIV>b", ["a", "b"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("<p>a<script>x</p></scripty></SCRIPT >b</p>", ["ab"]),
        ("<textarea>x</textarea><select><option>x</select><noscript><p>x</noscript>y", ["y"]),
        ("<p title=\"a>b\" class='c'>d</p>", ["d"]),
        ("<p a='>b <q>c", ["b c"]),
        ("&amp;lt; &#233;&#xe9; &am", ["&lt; éé &am"]),
        ("</p></div>x<?php y ?>z<!x>w", ["xzw"]),
        ("a<hr>b<br>c<wbr>d<span> e</span>", ["a", "b cd e"]),
    ],
)
def test_blocks(html, want):
    assert [b.text for b in html_blocks.blocks(html)] == want


@pytest.mark.parametrize("unit", ["<a '>' ", "<a \"'>", "<div>", "<!--", "<", "<p ", "</", "<b>x", "&amp", "<li><ul>", "</li>", "<p a=b c", "<script>", "<svg><p>"])
def test_blocks_in_linear_time(unit):
    began = time.perf_counter()
    html_blocks.blocks(unit * ((1 << 20) // len(unit)) + '"')
    assert time.perf_counter() - began < 15


def test_attributes():
    bits = html_blocks.element_bits
    assert bits("div", ' class="site-footer"') & html_blocks.bit(".footer") == html_blocks.bit(".footer")
    assert bits("div", " id=siteFooter role='x y'") & html_blocks.bit(".footer") == html_blocks.bit(".footer")
    assert bits("p", ' style="display: none"') == bits("p", " hidden") == bits("p", ' aria-hidden="true"') != bits("p", ' aria-hidden="false"')
    assert bits("p", "") == bits("p", " onclick='class=\"ad\"'")


def test_extracted(spark, model):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 200_000 + "</p>"), (4, "x", "<nav><a href=1>Only</a></nav>"), (None, None, None)]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = sorted((tuple(r) for r in html_text.extract_text(pages, model).collect()), key=str)
    by = {g[:2]: g[2:] for g in got}
    assert by[1, "u"] == (TEXT, len(TEXT)) and len(got) == len(rows)
    assert by[2, None] == by[None, "v"] == by[4, "x"] == by[None, None] == ("", 0)
    assert by[3, "w"] == (("word " * 200_000).strip(), 999_999)
    assert html_text.extract_text(pages.limit(0), model).count() == 0


def test_learned_from_a_table(spark):
    pages = spark.createDataFrame([(i, "u", PAGE) for i in range(3)], "page_id long, url string, html string")
    model = html_text.fit_labeller(pages, layouts=40, epochs=1)
    again = html_text.fit_labeller(pages.repartition(3), layouts=40, epochs=1)
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)
    assert html_text.fit_labeller(pages.limit(0), layouts=40, epochs=1).p["wf"].shape == (html_text.FEATURES, 4 * html_text.HIDDEN)
