import html
import re

import odd
import pytest
from pyspark.sql import functions as F
from riskframe.llm import boosting, htmltext as H


@pytest.fixture(scope="module")
def trees(spark, data):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    named = pages.select("html", F.regexp_extract("url", "/([0-9]+)(?:[/.?#]|$)", 1).cast("long").alias("doc_id"))
    return H.learn(named, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), fit_pages=120)


def test_sampled_pages_are_fitted_on_whole(spark, monkeypatch):
    monkeypatch.setattr(H, "FIT_CHARS", 1000)
    monkeypatch.setattr(H, "fit", lambda rows: rows)
    page = lambda n: f"<html><body><p>{'x ' * n}</p></body></html>"
    rows = [(1, page(100), "short"), (2, page(2000), "too long a page"), (3, page(90), "y " * 2000), (4, page(80), None), (5, page(70), "z")]
    pages = spark.createDataFrame([(i, h) for i, h, _ in rows], "doc_id long, html string")
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    assert H.learn(pages, docs) == [(page(100), "short"), (page(80), ""), (page(70), "z")]


def test_boosted_trees_learn_a_rule():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0) == (y[2000:] == 1)).mean() > 0.97
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2))).shape == (1,)


def test_pages_that_were_not_fitted_on(spark, data, trees):
    """The article's own markup is the measure; the trees never see that it is one."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r in H.extract_pages(pages.withColumn("source", F.col("html")), trees).collect():
        article = re.search(r"<article>(.*)</article>", r.source, re.S)[1]
        want = html.unescape(re.sub(r"<(?:/?p|/?h1|br)>", " ", article.replace("<b>", "").replace("</b>", "")))
        assert r.text == " ".join(want.split()) and r.n_chars == len(r.text)


LAYOUTS = {
    "comments": ('<div id="header"><a href="/">Home</a></div><div class="content">{}</div><div id="comments"><p>I do not agree, said the reader, at length, with this. No.</p><p>Nice!</p></div><div class="footer">Copyright</div>'),
    "sidebar": ('<header class="masthead"><a>Site</a></header><main>{}</main><aside class="sidebar"><h3>Related</h3><ul><li><a>x y</a></li><li><a>z</a></li></ul></aside>'),
    "notice": ('<div class="cookie-notice">We use cookies, accept them please.</div><section class="post">{}</section><form class="newsletter"><p>Subscribe to our letter, every week.</p><input name=q></form>'),
    "plain": ('<nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="article-body">{}</div><div class="ad">Buy this now, it is cheap.</div><script>var a = "<p>no</p>";</script><footer>&copy; 2020</footer>'),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_other_layouts(trees, name):
    inner = "<h1>A head &amp; line</h1><p>The first paragraph is <b>bold</b> and long enough, with commas, and stops. It goes on.<br>And on.<p>A second\n\n one, unclosed, that says more, and still more. Yes.</p><!-- <p>no</p> -->"
    want = "A head & line The first paragraph is bold and long enough, with commas, and stops. It goes on. And on. A second one, unclosed, that says more, and still more. Yes."
    assert H.extract([f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{LAYOUTS[name].format(inner)}</body></html>"], trees) == [want]


def test_decoding_contradicts_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(i)) for i in range(1, n)]
        score, text = rng.normal(size=n) * 2, rng.random(n) < 0.8
        whole = np.where(text, score, 0)

        def worth(choice):
            return sum(w if c == 1 else -w if c == 0 else abs(w) - 0.5 for w, c in zip(whole, choice))

        def fits(choice):
            return all(choice[p] == 2 or choice[p] == c for p, c in zip(parent[1:], choice[1:]))

        from itertools import product

        best = max(worth(c) for c in product((0, 1, 2), repeat=n) if fits(c))
        got = H.decode(parent, score, text)
        as_kept = max(worth(c) for c in product((0, 1, 2), repeat=n) if fits(c) and all((x == 1 or (x == 2 and s > 0)) == bool(g) for x, s, g in zip(c, score, got)))
        assert as_kept == pytest.approx(best)


@pytest.mark.parametrize("source", ["", "<", "<p", "<!--", "</p></div>", "<script>", "<a><b><p>x</a>", "text &lt; &#x41; &bogus; <br/>", "<ul><li>a<li>b<ul><li>c</ul></ul>", "<svg><p>x</svg>y", "<table><tr><td>a<td>b<tr><td>c</table>", "<div " * 50])
def test_broken_pages(trees, source):
    page = H.Page(source)
    assert all(p < i for i, p in enumerate(page.parent)) and len(H.features(page)) == len(page.tag)
    assert isinstance(H.extract([source], trees)[0], str)


def test_odd_rows(spark, trees):
    pages = odd.docs(spark).withColumnsRenamed({"doc_id": "page_id", "text": "html"})
    got = H.extract_pages(pages, trees).collect()
    assert len(got) == len(odd.ROWS) and all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3, 4))
    assert H.extract_pages(odd.none(spark), trees, html="text").count() == 0


def test_text_within_the_article_is_kept_and_unclosed_elements_cost_little():
    import time

    page = H.Page("<html><body><p>The area is <math><mi>x</mi><mo>+</mo><mn>2</mn></math> and <button>B</button> next <object data='a'>fallback</object> words <noscript>shown</noscript> end</p><select><option>one</option></select></body></html>")
    assert [t for _, t in page.blocks()] == ["The area is x+2 and B next fallback words shown end"]
    for tag in ("select", "textarea", "template", "iframe"):
        start = time.perf_counter()
        assert H.Page(f"<p>a</p><{tag}>" * 20_000).blocks()[0][1] == "a"
        assert time.perf_counter() - start < 1.5
