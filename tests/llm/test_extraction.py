import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import types as T

from paperloom.llm import extraction as E
from paperloom.llm.markup import Leaf, leaves


@pytest.fixture(scope="module")
def model(spark):
    return E.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


class Article(HTMLParser):
    """Blocks of the article element of the given tables' pages, by the standard library."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks.append("") if tag in ("p", "h1", "article") else self.handle_data(" ") if tag == "br" else None

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks += [""] if tag in ("p", "h1") else []

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def plain(page):
    return "\n".join(t for t in (" ".join(b.split()) for b in Article(page).blocks) if t)


def test_query_gives_the_articles_of_all_pages(spark):
    """Most of these pages are not among those learned from."""
    at = "/root/testdata/sf0.1"
    pages = {r.page_id: r for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    found = E.op12_html_extraction(spark, at)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    rows = found.collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    wrong = [r.page_id for r in rows if r.text != plain(pages[r.page_id].html)]
    assert len(wrong) <= len(rows) // 500
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


LAYOUTS = [
    (
        """<html><head><title>T</title><style>p{}</style></head><body><div class="top-bar"><a href="/">My Site</a></div><div id="menu"><a href=a>Home</a> <a href=b>About</a></div>
        <div class="row"><div class="col content-area"><h1>A title of the story</h1><p>First paragraph of the story,   which is long &amp; goes on. It goes on and on.</p><p>Second&nbsp;paragraph.
        <div class="ad-slot">Buy our product now!</div><p>Third paragraph has a <a href=x>link</a> in it.</p></div><div class="col sidebar"><h3>Related</h3><ul><li><a href=1>Other story</a></li></ul></div></div>
        <div id="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with the author of this story at all. It is wrong.</p></div></div><div class="footer">&copy; 2020 Some Corp</div></body></html>""",
        ["A title of the story", "First paragraph of the story, which is long & goes on. It goes on and on.", "Second paragraph.", "Third paragraph has a link in it."],
    ),
    (
        """<body><header class=site><nav><a href=/>Home</a></nav></header><div class=cookie-notice>We use cookies</div><main><h1>Title</h1><p>Text one is here. And more of it.<p>Text two is longer than one.
        <script>document.write("<p>no text</p>")</script><ul><li>The first point of it all</li><li>The second point of it all</li></ul><form><label>Mail</label><button>Go</button></form></main>
        <section class=comments><h3>Comments</h3><p>Nice text, I liked reading it. Thank you so much for writing.</p></section><aside><p>Some unrelated teaser text that is long.</p></aside><footer>All rights reserved</footer>""",
        ["Title", "Text one is here. And more of it.", "Text two is longer than one.", "The first point of it all", "The second point of it all"],
    ),
    (
        """<div id=page><ul class=nav><li><a href=/>Start</a><li><a href=/k>Kontakt</a></ul><div class="post"><h2>Über die Berge</h2><p>Wir gingen früh los. Der Weg war steil.</p><blockquote>Es war kalt &#8212; sehr kalt.</blockquote>
        <!-- <p>nie</p> --></div><div class="newsletter-signup"><p>Newsletter</p><p>Abonnieren</p></div><div class="copyright">Alle Rechte vorbehalten</div></div>""",
        ["Über die Berge", "Wir gingen früh los. Der Weg war steil.", "Es war kalt — sehr kalt."],
    ),
]


@pytest.mark.parametrize("page,expected", LAYOUTS)
def test_layouts_that_no_page_of_the_tables_has(model, page, expected):
    blocks = leaves(page)
    assert E.main_text(blocks, model.probabilities([blocks], E.Reader())[0]).split("\n") == expected


def test_most_blocks_of_new_layouts_are_right(model, spark):
    """Pages that were not learned from, dressed with another seed."""
    texts = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id >= 1000").limit(120).collect()]
    cases = E.examples(texts, seed=99)
    found = model.probabilities([p for p, _ in cases], E.Reader())
    assert np.mean([(q >= 0.5) == y for (_, labels), f in zip(cases, found, strict=True) for q, y in zip(f, labels, strict=True)]) > 0.99


def test_leaves_of_broken_pages():
    texts = lambda page: [x.text for x in leaves(page)]
    assert texts("") == [] and texts("   ") == [] and texts("<") == ["<"] and texts("a < b &lt; c") == ["a < b < c"]
    assert texts("<p><b>one<br>two<p>three</i></div>four") == ["one two", "three", "four"]
    assert texts("a<!-- b") == ["a"] and texts("a<script>b") == ["a"] and texts('a<div class="x>b') == ["a", "b"] and texts("a<!-->b") == ["ab"]
    assert texts('<a title="x>y">z</a>') == ["z"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert [x.path for x in leaves("<ul><li>a<ul><li>c</ul><li>d</ul>")] == [("ul", "li"), ("ul", "li", "ul", "li"), ("ul", "li")]
    assert leaves('<DIV CLASS="Comment-List adSlot"><A href=x>go</a> on') == [Leaf(("div", ".comment", ".list", ".ad", ".slot"), "go on", 2)]
    assert texts("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after") == ["deep", "after"]
    assert texts("<title>a &amp; b</title><textarea><p>c</textarea>") == ["a & b", "<p>c"]


def test_states_equal_single_steps(model):
    """Batches and long pages against one page, one block and one gate at a time."""
    rng = np.random.default_rng(3)
    words = "home menu Text. prose goes on, and on © 2024 reply".split()
    pages = [[Leaf(("body", "div", f".c{rng.integers(5)}", "p"), " ".join(rng.choice(words, rng.integers(1, 9))), 0) for _ in range(n)] for n in (1, 5, 5, 17, 60)] + [[]]
    logistic = lambda x: 1 / (1 + np.exp(-x))

    def single(page):
        x = model.inputs(E.Reader().rows(page, 0, len(page)))
        out = np.zeros((len(page), 2 * E.HIDDEN))
        for d, order in ((0, range(len(page))), (1, reversed(range(len(page))))):
            h, c = np.zeros(E.HIDDEN), np.zeros(E.HIDDEN)
            for t in order:
                z = x[t] @ model.p["x"][d] + h @ model.p["h"][d] + model.p["bias"][d, 0]
                i, f, o, g = (z[k * E.HIDDEN : (k + 1) * E.HIDDEN] for k in range(4))
                c = logistic(f) * c + logistic(i) * np.tanh(g)
                h = logistic(o) * np.tanh(c)
                out[t, d * E.HIDDEN : (d + 1) * E.HIDDEN] = h
        return logistic(np.concatenate([out, x], 1) @ model.p["out"] + model.p["last"])

    for page, found in zip(pages, model.probabilities(pages, E.Reader()), strict=True):
        assert len(found) == len(page)
        if page:
            assert np.allclose(found, single(page), atol=1e-4)
    whole, steps = model.probabilities([pages[4]], E.Reader())[0], E.STEPS
    try:
        E.STEPS = 7
        assert np.allclose(model.probabilities([pages[4]], E.Reader())[0], whole, atol=1e-4)
    finally:
        E.STEPS = steps


def test_gradients_equal_differences():
    model, rng = E.Labeller(dtype=np.float64), np.random.default_rng(1)
    model.p["words"] += rng.standard_normal(model.p["words"].shape) * 0.1
    pages = [[Leaf(("div", f".k{k}", "p"), f"word{k} and more", k) for k in range(n)] for n in (3, 5)]
    rows, y = [E.Reader().rows(p, 0, len(p)) for p in pages], [np.array([1, 0, 1]), np.array([0, 0, 1, 1, 0])]
    _, g = model.gradients(rows, y)
    for name, at in (("x", (0, 3, 5)), ("x", (1, 20, 70)), ("h", (0, 2, 9)), ("h", (1, 4, 50)), ("bias", (1, 0, 33)), ("out", (4,)), ("out", (25,)), ("last", (0,)), ("paths", (E.bucket(".k1"), 2)), ("words", (E.bucket("and"), 1))):
        ends = []
        for step in (1e-5, -1e-5):
            model.p[name][at] += step
            ends.append(model.gradients(rows, y)[0])
            model.p[name][at] -= step
        assert g[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-9)


def test_defined_results(spark, model):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    article = "<article><p>" + "</p><p>".join(f"Sentence {k} of a long story." for k in range(9000)) + "</p></article>"
    rows = [(1, "u", None, "clash"), (2, None, "", "clash"), (None, "u", LAYOUTS[1][0], "clash"), (3, "u", article, "clash"), (3, "u", article, "clash"), (4, "u", "<nav><a href=x>Home</a></nav>", "clash")]
    found = E.extract(spark.createDataFrame(rows, schema), model).collect()
    by = {r.page_id: r.text for r in found}
    assert len(found) == 6 and by[1] == by[2] == by[4] == "" and by[None].startswith("Title\n")
    assert by[3] == "\n".join(re.findall("<p>(.*?)</p>", article))
    empty = spark.createDataFrame([], schema)
    assert E.sample(empty) == [] and E.extract(empty, E.train([])).collect() == []
