import html as h
import re

import numpy as np
import pytest

from quillspar.llm import html, pagemaker

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return pagemaker.train()


def article_text(page):
    """The main text of the given tables' pages, by their one known layout."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", body[1] if body else "")
    blocks = [" ".join(h.unescape(re.sub(r"<(?:/?\w[^>]*)?(?:>|$)", " ", p)).split()) for p in parts]
    return "\n\n".join(b for b in blocks if b)


def test_whole_table(spark):
    want = {r.page_id: article_text(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = html.op3_main_text(spark, SF)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert {r.page_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)


def test_made_pages_not_trained_on(model):
    maker, right = pagemaker.Maker(321), 0
    for _ in range(300):
        page, y = pagemaker.labelled_nodes(maker.page())
        want = "\n\n".join(run for node, run, _ in page.runs if y[node] and not page.tags[node].startswith("#"))
        right += html.main_text(page, model.predict(page.features())) == want
    assert right >= 240


PAGE = """<html><head><title>t</title></head><body><nav class=menu><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav>
<div id="cookie-notice"><p>We use cookies here.</p></div><main><article><h1>A&nbsp;title &amp; more</h1><p>First   paragraph with
enough words to be a paragraph, it says.<p>Second one, unclosed, with <a href=q>a link</a> inside it and words.<script>no()</script>
<ul><li>One item of the list.</li><li>Another item of it.</li></ul><p>Last paragraph of the text, which ends here.</p></article></main>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I like it very much, thanks for it.</p></div></section>
<aside class="sidebar"><p>Read this too.</p></aside><form><p>Search</p><input></form><footer><p>&copy; somebody</p></footer></body></html>"""


def test_page_parts(model):
    page = html.Page(PAGE)
    text = html.main_text(page, model.predict(page.features()))
    assert text.split("\n\n") == ["A title & more", "First paragraph with enough words to be a paragraph, it says.", "Second one, unclosed, with a link inside it and words.", "One item of the list.", "Another item of it.", "Last paragraph of the text, which ends here."]


ARTICLE = "".join(f"<p>Paragraph number {k} says enough words to be taken for one, and then it ends.</p>" for k in range(4))
PARAGRAPHS = "\n\n".join(f"Paragraph number {k} says enough words to be taken for one, and then it ends." for k in range(4))


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><body>{}",
    "<title>x</title><article>{}</article>",
    "<html><head><title>x</title><body><svg width=1 /><main>{}</main>",
    "<html><body><math/><div class=content>{}</div></body></html>",
    "<body><nav><a href=foo'bar>one</a> <a href=x>two</a></nav><article>{}</article><footer>it's old</footer>",
    "<body><article data-x=\"a>b\" data-y='c>d' data-z=e\"f>{}</article></body>",
    "<body><div style='display:none' class=cookie-banner><p>We use cookies.</p></div><article aria-hidden=true>{}</article></body>",
])
def test_layouts(model, page):
    page = html.Page(page.format(ARTICLE))
    assert html.main_text(page, model.predict(page.features())) == PARAGRAPHS


def test_markup_is_read_by_the_rules():
    runs = lambda x: [run for _, run, _ in html.Page(x).runs]
    assert runs("<html><head><title>x</title><body><p>hello") == ["hello"]
    assert runs("<svg width=1 /><p>after") == ["after"] and runs("<svg width=1/><p>in it</p></svg><p>after") == ["after"]
    assert runs("<p><a href=foo'bar>a</a> b <a href=it's>c</a> d") == ["a b c d"]
    assert runs('<p title="a>b" x = \'c>d\'>e') == ["e"] and runs("<p hidden>shown later") == ["shown later"]


def test_decode_has_no_contradiction():
    parents = [-1, 0, 1, 1, 0]
    keep = html.decode(parents, np.array([3.0, -2.0, 1.0, -4.0, 2.0]), np.ones(5))
    assert keep.tolist() == [True, False, False, False, True]
    keep = html.decode(parents, np.array([3.0, -2.0, 9.0, -4.0, 2.0]), np.ones(5))
    assert keep.tolist() == [True, True, True, False, True]


def test_edges(spark, model):
    deep = "<div>" * 3000 + "<p>deep down it is</p>"
    rows = [(1, None), (2, ""), (3, "<"), (4, "<!-- x"), (5, deep), (None, PAGE), (6, "<p " * 5000), (7, PAGE), (7, PAGE), (8, "<script>never closed"), (9, "<article><p>cut &am")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, html string, text string")
    out = html.extract_main(df, model, "page_id")
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.id: r.text for r in got}
    assert by[1] == by[2] == by[8] == "" and by[None] == by[7] and by[9] in ("cut &am", "")
    assert html.extract_main(df.limit(0), model, "page_id").count() == 0


def test_trees_learn():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 5))
    y = (x[:, 0] > 0) ^ (x[:, 3] > 0.5)
    m = html.BoostedTrees(trees=30).fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_deep_pages():
    """Elements deeper than any cap keep their names, ancestors and dropped parts."""
    page = html.Page("<div>" * 600 + "<article class=comment><object><p>secret</p><p>more of it</p></object><p>seen</p></article><p>after</p>" + "</div>" * 600 + "<p>outside</p>")
    assert [run for _, run, _ in page.runs] == ["seen", "after", "outside"]
    above = [page.tags[page.parents[node]] for node, _, _ in page.runs]
    assert above == ["article", "div", "#page"]
    assert max(page.depths) == html.MAX_DEPTH
    assert len(html.Page("<li><ul>" + "<x>" * 50_000 + "<li></li></y>" * 50_000).tags) == 100_003  # in time that grows with the page alone
