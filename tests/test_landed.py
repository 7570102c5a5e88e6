"""Feeds of each kind, and the mixer with and without overflow, on rows written for them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from winnowry import registry
from winnowry.operators import corpus, landed, origins, responses, triage

DAY = datetime.datetime(2024, 5, 1, 10, 0)
RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>All</title><link>http://all</link>
<item><title> One &amp; more </title><link>http://one</link><pubDate>Wed, 01 May 2024 10:00:00 +0000</pubDate><description>&lt;b&gt;Some&lt;/b&gt; text</description><category>x</category><category>y</category><author>Ann</author></item>
<item><title></title><link>http://untitled</link></item><item><title>No link</title></item>
<item><title>Two</title><link>http://two</link><description></description><summary>told</summary></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>All</title><link href="http://all"/>
<entry><title>Three</title><link rel="self" href="http://self"/><link rel="alternate" href="http://three"/><updated>2024-05-01T10:00:00Z</updated><published>not a date</published><summary>sum</summary><content>whole</content><author><name>Bo</name></author><author><name>Cy</name></author><category term="z"/></entry>
<entry><title>Four</title><link rel="enclosure" href="http://four"/><content>whole</content></entry></feed>"""
RDF = """<rdf:RDF><channel><title>All</title></channel><item><title>Five</title><link>http://five</link></item></rdf:RDF>"""


def test_feeds(spark):
    payloads = [("rss", RSS), ("atom", ATOM), ("rdf", RDF), ("one", "<item><title>Six</title><link>http://six</link></item>"), ("empty", "<rss><channel></channel></rss>"), ("broken", "<rss><channel><item>"), ("null", None), ("long", f"<rss><channel><item><title>L</title><link>http://l</link><description>{'w ' * 3000}</description></item></channel></rss>")]
    got = {r.url: r for r in landed.feed_items(spark.createDataFrame(payloads, "feed string, payload string")).collect()}
    assert sorted(got) == ["http://five", "http://four", "http://l", "http://one", "http://six", "http://three", "http://two"]
    one = got["http://one"]
    assert (one.feed, one.pos, one.title, one.summary, one.published_at, one.authors, one.categories) == ("rss", 0, "One & more", "Some text", DAY, ["Ann"], ["x", "y"])
    assert (got["http://two"].summary, got["http://two"].pos, got["http://two"].published_at) == ("told", 3, None)
    three = got["http://three"]
    assert (three.summary, three.published_at, three.authors, three.categories) == ("sum", DAY, ["Bo", "Cy"], ["z"])
    assert (got["http://four"].summary, got["http://five"].authors, len(got["http://l"].summary)) == ("whole", [], 2000)


def mixed(rows, most, cap, others, least, overflow):
    """The mixer as a walk. rows: (pos, archetype, score) in order."""
    study = [r for r in rows if (r[1] or "STUDY_STAT") == "STUDY_STAT"]
    rest, picked, counts, n, s = [r for r in rows if r not in study], [], {}, 0, 0
    for r in rest:
        if len(picked) >= most:
            break
        if counts.get(r[1], 0) < others:
            picked.append(r)
            counts[r[1]] = counts.get(r[1], 0) + 1
            n += 1
            if n >= least and study and s < cap and len(picked) < most:
                picked.append(study.pop(0))
                s += 1
    while len(picked) < most and study and (s < cap or overflow):
        picked.append(study.pop(0))
        s += 1
    return [r[0] for r in sorted(picked, key=lambda r: -r[2])]


@pytest.mark.parametrize("overflow", [True, False])
def test_mixer_is_the_walk(spark, overflow):
    pick = random.Random(overflow)
    runs = {k: [(i, pick.choice([None, "STUDY_STAT", "STUDY_STAT", "A", "B"]), pick.randint(0, 4)) for i in range(pick.randint(0, 12))] for k in range(150)}
    df = spark.createDataFrame([(k, *r) for k, rows in runs.items() for r in rows], "run_id long, pos long, archetype string, score int")
    for most, cap, others, least in ((5, 2, 2, 1), (4, 1, 3, 2), (3, 0, 1, 1)):
        got = {}
        for r in triage.interleaved(df, most, cap, others, least, overflow=overflow).orderBy("run_id", "rank").collect():
            got.setdefault(r.run_id, []).append(r.pos)
        assert got == {k: w for k, rows in runs.items() if (w := mixed(rows, most, cap, others, least, overflow))}


def test_corpus_file(spark, tmp_path):
    for name, text, want in (("a", "Headline,x\n One ,1\n,2\n\"Two, \"\"quoted\"\"\",3\ntitle,4\n", ["One", 'Two, "quoted"', "title"]), ("b", "Plain\n\nSecond\n", ["Plain", "Second"]), ("c", "", [])):
        (tmp_path / f"{name}.csv").write_text(text)
        assert [r.headline for r in corpus.from_csv(spark, f"file://{tmp_path}/{name}.csv").collect()] == want
    assert corpus.from_csv(spark, f"file://{tmp_path}/none.csv").count() == 0


def test_sources(spark):
    known = spark.createDataFrame([(1, "a", "A", 2.0, True, ["Tea"]), (2, "b", "B", 1.0, False, None), (3, "a", "C", 1.0, True, [])], "pos int, source_name string, tier string, weight double, enabled boolean, keywords array<string>")
    more = origins.added(known, spark.createDataFrame([(4, "c")], "pos int, source_name string"))
    assert [(r.pos, r.tier, r.weight, r.enabled, r.keywords) for r in more.where("pos = 4").collect()] == [(4, "B", 1.0, True, None)]
    assert sorted(r.pos for r in origins.listed(more).collect()) == [1, 3, 4] and [r.pos for r in origins.listed(more, False, "B").orderBy("pos").collect()] == [2, 4]
    assert sorted(r.pos for r in origins.removed(more, ["a", "none"]).collect()) == [2, 3, 4]
    items = spark.createDataFrame([(1, "a", "green TEA"), (2, "a", "coffee"), (3, "b", "tea"), (4, "c", "x"), (5, "d", "tea")], "item_id long, source_name string, title string")
    assert sorted(r.item_id for r in origins.wanted(items, more.where("pos <> 3")).collect()) == [1, 4]
    assert sorted(r.item_id for r in origins.wanted(items, more).collect()) == [1, 2, 4]


def test_latest_outputs_are_all_or_those_asked_for(spark):
    outputs = spark.createDataFrame([(i, i % 2, f"r{i}", DAY - datetime.timedelta(days=i)) for i in range(30)], "output_id long, item_id long, run_id string, created_at timestamp")
    items = spark.createDataFrame([(0, "s", "u", "t", DAY)], "item_id long, source_name string, url string, title string, published_at timestamp")
    feedback = spark.createDataFrame([(2, 25, 1, None, DAY), (1, 25, 3, 4, DAY), (3, 0, 5, 6, DAY)], "feedback_id long, output_id long, likes long, shares long, recorded_at timestamp")
    got = responses.latest_outputs(outputs, items, feedback).collect()
    assert [r.output_id for r in got] == list(range(30)) and [f.feedback_id for f in got[25].feedback] == [1, 2] and not got[1].feedback
    few = responses.latest_outputs(outputs, items, feedback, F.lit(DAY).cast("timestamp"), days=7, limit=5).collect()
    assert [(r.output_id, len(r.feedback)) for r in few] == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert registry.queries()["j05_latest_outputs"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
