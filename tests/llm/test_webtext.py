"""The block labeller: its reader by hand, its derivatives by differences, its texts against the marked bodies of pages it was not trained on."""

import html
import math
import re

import numpy as np
import pytest

from gleaner.llm import webtext
from gleaner.llm.queries import queries

DATA = "/root/testdata/sf0.01"
LAYOUT = """<html><body><header><div class="logo">My site</div><nav><a href=x>Home</a> <a href=y>About</a></nav></header>
<div class="cookie-banner">We use cookies. <button>Accept</button></div><main><article class="post"><h1>A title</h1><p>First words &amp; more, <b>bo</b>ld
 and &lt;tags&gt;.</p><script>var x = "<p>no</p>";</script><ul><li>One<li>Two</ul><!-- <p>hidden</p> --><p>Last<br>words</article>
<section id="comments"><h3>Comments</h3><div class="comment">I read it all and liked it.</div><form><label>Name</label><button>Send</button></form></section></main>
<aside class="sidebar"><ul><li><a href=1>Other one</a><li><a href=2>Other two</a></ul></aside><footer>&copy; the site</footer>"""


def marked(page):
    found = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", found))).split())


@pytest.fixture(scope="module")
def net(spark):
    return webtext.fit(spark.read.parquet(f"{DATA}/pages.parquet"), most=120)


def test_query_against_marked_bodies(spark):
    got = queries()["op13_webtext"](spark, DATA)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r for r in got.collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        want = marked(r["html"])
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_pages_and_layouts_not_trained_on(spark, net):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 1000 AND page_id < 1400").collect()]
    assert sum(a == marked(p) for a, p in zip(webtext.extract(pages, net), pages, strict=True)) >= 0.99 * len(pages)
    assert webtext.extract([LAYOUT], net) == ["A title First words & more, bold and <tags>. One Two Last words"]
    rng = np.random.default_rng(77)
    body, rest = [[b.text for p in pages for b in webtext.blocks(p) if ("article" in b.path) == kind] for kind in (True, False)]
    made = [webtext.made_page(rng, body, rest) for _ in range(200)]
    right = [k == bool(y) for kept, (_, labels) in zip(webtext.label([p for p, _ in made], net), made, strict=True) for k, y in zip(kept, labels, strict=True)]
    assert np.mean(right) > 0.97


def plain_probability(net, page):
    p = [x.astype(float) for x in net.params]
    vector = lambda table, tokens, scale: sum(table[webtext.bucket(t)] for t in tokens) * scale(len(tokens))
    x = []
    for b in page:
        words = set(b.text.lower().split())
        x.append(np.concatenate([vector(p[0], b.tokens(), lambda n: 1 / math.sqrt(n)), vector(p[1], words, lambda n: 1 / (n + 3))]))

    def run(rows, w, u, b):
        h, c, out = np.zeros(webtext.HIDDEN), np.zeros(webtext.HIDDEN), []
        for row in rows:
            z = row @ w + h @ u + b
            i, f, o, g = np.split(z, 4)
            s = lambda v: 1 / (1 + np.exp(-v))
            c = s(f) * c + s(i) * np.tanh(g)
            h = s(o) * np.tanh(c)
            out.append(h)
        return out

    forth, back = run(x, *p[2:5]), run(x[::-1], *p[5:8])[::-1]
    return [1 / (1 + math.exp(-(np.concatenate([a, b]) @ p[8] + p[9][0]))) for a, b in zip(forth, back, strict=True)]


def small_pages(rng, n=5):
    return sorted((webtext.made_page(rng, ["alpha beta", "gamma", "delta alpha"], ["home", "about us"])[0] for _ in range(n)), key=len, reverse=True)


def test_network_reads_each_page_in_both_directions():
    rng = np.random.default_rng(3)
    net, pages = webtext.Network.new(rng, float), small_pages(rng)
    want = [q for p in pages for q in plain_probability(net, p)]
    assert net.probabilities(webtext.Pages.of(pages)) == pytest.approx(want, abs=1e-9)
    assert len(webtext.label([[], *pages, []], net)) == len(pages) + 2


def test_slopes_are_the_loss_functions_derivatives():
    rng = np.random.default_rng(4)
    net, pages = webtext.Network.new(rng, float), webtext.Pages.of(small_pages(rng))
    y = rng.integers(0, 2, int(pages.lengths.sum())).astype(float)
    _, grads = net.slopes(pages, y)
    for param, grad in zip(net.params, grads, strict=True):
        flat = param.reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(grad.reshape(-1)) > 1e-6), 6):
            old, ends = flat[i], []
            for h in (1e-5, -1e-5):
                flat[i] = old + h
                ends.append(net.slopes(pages, y)[0])
            flat[i] = old
            assert grad.reshape(-1)[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-8)


def test_reader():
    read = lambda page: [(".".join(b.path), b.text) for b in webtext.blocks(page)]
    assert read("just text") == [("", "just text")]
    assert read("<p>a<p>b</div>c") == [("p", "a"), ("p", "b"), ("p", "c")]
    assert read("<div class='x-Y z' id=q><a href='>'>l</a> m</div>") == [("div..x..y..z..q", "l m")]
    assert read("<ul><li>a<ul><li>b</ul><li>c</ul>") == [("ul.li", "a"), ("ul.li.ul.li", "b"), ("ul.li", "c")]
    assert read("<table><tr><td>a<td>b<tr><td>c</table>d") == [("table.tr.td", "a"), ("table.tr.td", "b"), ("table.tr.td", "c"), ("", "d")]
    assert read("a < b &amp;amp; c<!-- x --><!doctype y><style>p{}</style ><SCRIPT>if (a < b) '</p>'</SCRIPT>d\n\t e") == [("", "a < b &amp; cd e")]
    assert read("x<script>never ends") == [("", "x")] and read("x<!-- never ends") == [("", "x")] and read("x<p y") == [("", "x")]
    assert read('<a title="open>b</a><p>c') == [("", "b"), ("p", "c")]
    assert [(b.text, b.linked) for b in webtext.blocks("<li><a href=1>two</a> more</li>")] == [("two more", 3)]


def test_long_and_broken_pages_take_time_in_proportion(net):
    assert webtext.extract(["<a \"" * 50_000 + ">"], net) == [""] and len(webtext.blocks("<!--" * 100_000)) == 0
    assert webtext.blocks("<" * 200_000)[0].text == "<" * 200_000
    assert len(webtext.blocks("<script>" * 20_000)) == 0 and len(webtext.blocks("<div>" * 3000 + "x")) == 1
    page = "<html><body><nav><a>home</a></nav><article>" + "<p>" + "alpha beta " * 5 + "</p>"
    whole = page + ("<p>" + "word " * 30 + "</p>") * 20_000 + "</article><footer>end</footer>"
    got = webtext.extract([whole], net)[0]
    assert got.startswith("alpha beta") and got.count("word") == 600_000 and not got.endswith("end")


def test_defined_cases(spark, net):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (3, "u", "<html></html>", "x"), (4, "u", LAYOUT, None), (4, "u", LAYOUT, None), (5, "u", "no markup at all in this page", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = webtext.main_text(df, net)
    assert got.columns == ["page_id", "url", "text"]
    got = got.collect()
    assert len(got) == 6 and got[3] == got[4] and got[3]["text"].startswith("A title First") and [r["text"] for r in got[:3]] == ["", "", ""]
    assert got[5]["text"] == "no markup at all in this page"
    none = df.limit(0)
    assert webtext.fit(none) is None and webtext.main_text(none, None).count() == 0
    assert webtext.fit(df.filter("page_id < 4")) is None or webtext.extract([None], None) == [""]
