"""Rules on texts written for them: each gate meets what it is for, and what is just beside."""

import pytest
from pyspark.sql import functions as F

from winnowry.functions import rules
from winnowry.operators import elements, gates, pages, triage


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "reason"), [("It failed to show benefit", "null_result"), ("Not better than placebo", "null_result"), ("Governance of procurement", "admin"), ("Governance alone", None), ("Event registration is open", "promo"), ("40 people joined the walk", "local program"), ("A plain finding", None), ("", None), (None, None)])
def test_hard_rejects(spark, text, reason):
    assert one(spark, text, triage.hard_reject("t")) == reason


@pytest.mark.parametrize(("text", "name", "found"), [
    ("1.5 % and 20%", "percentages", ["1.5", "20"]),
    ("3 times more, 2.5-fold", "times", ["3", "2.5-fold"]),
    ("among 1,200 adults, n = 35", "sample_sizes", ["1,200", "35"]),
    ("aged 50 - 70", "ages", ["50 - 70"]),
    ("after 8 weeks; 3 months of study; daily for 2 weeks", "time_windows", ["8", "2", "3", "2"]),
    ("Knee pain, knee and DNA", "body_parts", ["dna", "knee"]),
    ("the FDA and the World Health Organization", "authorities", ["fda", "world health organization"]),
    ("", "foods", []),
])
def test_elements(spark, text, name, found):
    assert one(spark, text, elements.extracted("t")[name]) == found


@pytest.mark.parametrize(("text", "patterns", "found"), [("The board approves it", "ADMIN_LANGUAGE", "board approves"), ("Hyrox again", "LIFESTYLE", "hyrox"), ("Mosques in Leeds", "TOO_SPECIFIC", "mosques in leeds"), ("Be aware", "VAGUE", "be aware"), ("Nothing here", "VAGUE", None)])
def test_detectors(spark, text, patterns, found):
    from winnowry.functions import rules

    assert one(spark, text, gates.detected("t", getattr(rules, patterns))) == found


@pytest.mark.parametrize(("text", "made"), [("Guardian Health: study finds x", "Study finds x"), ("[BBC] new thing!", "New thing."), ("plain", "Plain"), ("Wait....", "Wait.")])
def test_headlines(spark, text, made):
    assert one(spark, text, elements.clean_headline("t")) == made


def test_slides_and_captions(spark):
    assert one(spark, "Research - less is more... now!", elements.clean_slide("t")) == "LESS IS MORE, NOW"
    df = spark.createDataFrame([("hi #tag", "src", "http://x")], "c string, source_name string, url string")
    assert df.select(elements.clean_caption(F.col("c")).alias("x")).first().x == "hi\n\nSource: src - http://x"


def test_page_text(spark):
    long = "word " * 120
    rows = [(1, f"<nav>no</nav><article><p>{long}</p></article>"), (2, f"<article>short</article><main>{long}</main>"), (3, "<p>" + "p" * 60 + "</p><p>tiny</p>"), (4, '<meta name="description" content="told">'), (5, ""), (6, None)]
    got = {r.page_id: r.body for r in pages.page_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert (got[1], got[2], got[3], got[4], got[5], got[6]) == (long.strip(), long.strip(), "p" * 60, "told", "", None)


def test_sample_takes_each_tier_and_fills(spark):
    rows = [(i, "A" if i < 3 else "B" if i < 50 else "C", 1.0) for i in range(100)]
    got = triage.tier_sample(spark.createDataFrame(rows, "item_id long, tier string, weight double"), 20, {"A": 0.5, "B": 0.3, "C": 0.2}).collect()
    n = {t: sum(r.tier == t for r in got) for t in "ABC"}
    assert (len(got), n["A"]) == (20, 3) and n["B"] >= 6 and n["C"] >= 4


def test_arrays_and_gates_are_those_of_their_patterns(spark):
    """The quick ways - words of the text, parts that a match needs - find what the plain patterns find."""
    import random
    import re

    draw = random.Random(3)
    words = [*"study meta-analysis analysis meta blood pressure heart rate gut bacteria immune system brain fog olive oil oils nuts nutss eggs egg runs running runed who world health organization centers for disease control".split(), "blood  pressure", "12%", "3 years", "5 weeks later", "over 9 days", "2.5 times more", "4 x higher", "3.5-fold", "n = 1,200 adults", "among 30", "aged 50-70", "daily for 6 weeks", "equivalent to eating a lot of it.", "same as", "like smoking it", "compared to a control", "vs. others", "no significant", "may not help", "failed to show", "objectives", "stakeholders", "local authority", "tickets on sale", "20 people joined", "community program launches", "local club offers", "Sleep,", "x_who", "whole"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 9))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", triage.hard_reject("t").alias("reject"), *[c.alias(n) for n, c in elements.extracted("t").items()]).collect()
    for r in got:
        low = (texts[r.i] or "").lower()
        plain = {n: [m[1] for p in ps for m in re.finditer(p, low, re.ASCII)] for n, ps in rules.ELEMENTS.items()}
        plain = {n: sorted(set(v)) if n in rules.DISTINCT else v for n, v in plain.items()}
        plain["times"] += [x + "-fold" for x in plain.pop("folds")]
        if texts[r.i] is not None:
            assert {n: r[n] for n in plain} == plain, low
        hit = lambda found: any(re.search(p, low, re.ASCII) for _, p in found)  # noqa: E731, B023
        admin = sum(bool(re.search(p, low, re.ASCII)) for _, p in rules.ADMIN) >= 2
        assert r.reject == ("null_result" if hit(rules.NULL_RESULT) else "admin" if admin else "promo" if hit(rules.PROMO) else "local program" if hit(rules.LOCAL) else None), low
