"""Page elements on pages written for them: nested containers, open paragraphs, entities, broken markup; and listings with rules of each kind."""

import datetime

import pytest
from pyspark.sql import functions as F

from winnowry.functions.markup import Nodes
from winnowry.operators import landed, pages

LONG, MORE = "word " * 120, "more " * 130


def texts(spark, *html, **how):
    rows = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    return [r.body for r in pages.page_text(rows, **how).orderBy("page_id").collect()]


def told(html, without=frozenset()):
    tree = Nodes(without)
    tree.read(html)
    return list(zip(tree.tags, tree.lasts, tree.texts, strict=True))


def test_nested_containers(spark):
    got = texts(
        spark,
        f'<div class="article-body"><div class="ad">Buy</div><p>{LONG}</p></div>',
        f'<div class="x article-body y"><div>{LONG}</div><div>{MORE}<div>inner</div> end</div></div><div>after</div>',
        f"<article><nav><nav>a</nav>b</nav><p>{LONG}</p><article>in it</article>tail</article>no",
        f"<article>short</article><div itemprop='articleBody'><section><div>{LONG}</div></section></div>",
        f'<div class="contents">{MORE}</div><div class="main content">{LONG}</div>',
        f"<main><header>gone<div>too</div></header>{LONG}</main>",
    )
    assert got[0] == "Buy " + LONG.strip()
    assert got[1] == " ".join([LONG.strip(), MORE.strip(), "inner", "end"])
    assert got[2] == " ".join([LONG.strip(), "in it", "tail"])
    assert got[3] == got[4] == got[5] == LONG.strip()


def test_paragraphs_that_are_not_closed(spark):
    a, b, c = "a" * 60, "b" * 55, "c" * 51
    got = texts(
        spark,
        f"<p>{a}<p>{b}<div>x</div><p>tiny</p><p>{c}",
        f"<p><b>{a}<br>{b}<p>{c}",
        f"<ul><li>{a}<li><p>{b}</ul><p>{c}",
        f"<p>{a}<!-- {b} --><script>var t='</p>';</script>{c}</p>",
        "<p>" + "d" * 20 + " <i>" + "e" * 15 + "</i> " + "f" * 20 + "</p>",
    )
    assert got == [f"{a} {b} {c}", f"{a}{b} {c}", f"{b} {c}", a + c, "d" * 20 + "e" * 15 + "f" * 20]


def test_entities_caps_and_descriptions(spark):
    described = '<meta content="told &amp; true" name="description">' + "<p>short</p>"
    got = texts(spark, "<p>" + "caf&eacute; &lt;b&gt; &#8364;5&nbsp;x &bogus; " * 3 + "</p>", f"<article>{'y ' * 4000}</article>", described, "<meta name='description'>", "", None, "<![if broken", "<p>" + "p" * 60 + "</p><![bad [ x")
    assert got[0] == ("café <b> €5\xa0x &bogus; " * 3).strip()
    assert (len(got[1]), got[2:6]) == (5000, ["told & true", "", "", None])
    assert got[6] in ("", "<![if broken") and got[7] == "p" * 60


def test_boilerplate_goes(spark):
    assert texts(spark, f"<article>{LONG} Share this article with all. End</article>") == [LONG.strip() + "  End"]


def test_tree():
    assert told("<table><tr><td>1<td>2<tr><td>3</table>x") == [("table", 8, None), ("tr", 5, None), ("td", 3, None), ("#text", 3, "1"), ("td", 5, None), ("#text", 5, "2"), ("tr", 8, None), ("td", 8, None), ("#text", 8, "3"), ("#text", 9, "x")]
    assert told("<p>a</div>b</p></p><br/>c") == [("p", 2, None), ("#text", 1, "a"), ("#text", 2, "b"), ("br", 3, None), ("#text", 4, "c")]
    assert told("<nav>a<p>b</nav>c", frozenset(["nav"])) == [("#text", 0, "c")]
    assert len(told("<b>" * 3000 + "x")) == 3001


def test_unknown_selectors():
    for bad in ("div p", "", "div[", "a:first-child"):
        with pytest.raises(ValueError):
            pages.matching(bad)


@pytest.mark.parametrize(("html", "summary", "body"), [
    ("<div class='abstract'>short one</div>", "given", "short one"),
    (f"<div class='abstract'>short</div><section id='abstract'><p>{LONG}</p></section>", "given", LONG.strip()),
    ("<p class='my-abstract-x'>one</p><div class='the abstracts'>two</div>", "given", "one"),
    ("<div class='abstract'>short</div><meta name='description' content=''>", "given", "given"),
    ("<p>nothing</p>", "given", "given"),
    (f"<div class='abstract'>{LONG}</div>", "s" * 400, "s" * 400),
    (None, None, ""),
])
def test_preprints(spark, html, summary, body):
    assert pages.preprint_text(spark.createDataFrame([(html, summary)], "html string, summary string")).first().body == body


def test_listing_rules(spark):
    html = """<nav><a href="/menu">Menu</a></nav>
      <div class="card big" data-kind="x"><h3>First <b>story</b></h3><a href="/one">read</a><time datetime="2024-05-01">May</time><p class="sum">%s</p></div>
      <div class="card"><h3>Second</h3><a href="https://other.org/two">read</a><time>03/05/2024</time></div>
      <div class="card"><h3></h3><a href="/untitled">read</a></div><div class="card"><h3>No link</h3></div>
      <div class="card"><h3>Not wanted</h3><a href="/ad/x">read</a></div>
      <a data-testid="internal-link" href="/three"> Third </a>""" % ("s" * 600)
    rows = spark.createDataFrame([(7, "src", html), (8, "src", None)], "page_id long, source string, html string")
    cards = pages.Listing(articles="div.card", prefix="https://site.org", title="h3", date="time", summary="p.sum", wanted=lambda u: ~u.contains("/ad/"))
    got = pages.listed(rows, cards, landed.instant).orderBy("pos").collect()
    day = datetime.datetime(2024, 5, 1)
    assert [(r.page_id, r.source, r.url, r.title, r.published_at, r.summary) for r in got] == [(7, "src", "https://site.org/one", "Firststory", day, "s" * 500), (7, "src", "https://other.org/two", "Second", None, None)]
    dated = pages.Listing(articles="div.card", title="h3", date="time", date_format="dd/MM/yyyy")
    assert [r.published_at for r in pages.listed(rows, dated, landed.instant).orderBy("pos").limit(2).collect()] == [None, datetime.datetime(2024, 5, 3)]
    links = pages.Listing(articles="a[data-testid='internal-link']", prefix="https://site.org")
    assert [(r.url, r.title) for r in pages.listed(rows, links, landed.instant).collect()] == [("https://site.org/three", "Third")]


def test_body_or_summary(spark):
    items = spark.createDataFrame([(1, "a", "sum", "paper"), (2, "b", "sum", "news"), (3, "c", "s" * 1300, "news"), (4, "d", None, "paper")], "id long, url_key string, summary string, content_type string")
    found = spark.createDataFrame([("a", "x" * 600), ("b", "x" * 600), ("d", None)], "url_key string, body string")
    got = {r.id: (len(r.body), r.outcome, r.enough) for r in pages.body_or_summary(items, found).collect()}
    assert got == {1: (600, "success", True), 2: (600, "insufficient", False), 3: (1300, "failed", True), 4: (0, "failed", False)}


def test_each_page_is_parsed_once(spark):
    plan = pages.page_text(spark.createDataFrame([(1, "x")], "page_id long, html string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, "<p>x", "kept")], "page_id long, html string, other string")
    assert pages.page_text(rows).columns == ["page_id", "html", "other", "body"] and pages.page_text(rows.where(F.lit(False))).count() == 0


def test_references_that_no_semicolon_ends_are_text(spark):
    body = "des&&&amp zu &copy &lt;b&gt; &notit; &#38; &amp;amp; &#65 " * 20
    read = body.replace("&lt;", "<").replace("&gt;", ">").replace("&#38;", "&").replace("&amp;amp;", "&amp;").strip()
    assert texts(spark, f"<article>{body}</article>") == [read]
