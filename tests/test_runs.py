"""Whole runs against loops over items: repeats, novelty and selection in order, and every row with exactly one fate."""

import math

from pyspark.sql import functions as F

from winnowry import registry
from winnowry.operators import elements, gates, runs, triage
from winnowry.plans import runs as plans
from winnowry.plans.columns import told
from winnowry.sources.fixtures import view

DIR = "/root/testdata/sf0.001"


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0


def key(url):
    return url.strip().lower().rstrip("/")


def test_second_run(spark):
    items, spine = view(spark, DIR, "fx_items"), view(spark, DIR, "fx_spine")
    v = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    told_ = told(spine).withColumn("actionable", F.lit(True))
    alone = items.join(told_.drop("pos", "url", "source_name"), "item_id").select(
        "item_id", "pos", "url", "content_type", "clarity", "relevant", F.length("body_text").alias("chars"), triage.truism().alias("truism"), gates.narrative_fault(told_).alias("quality"), triage.headline_fault("hook").alias("headline"), elements.archetype(F.col("category")).alias("archetype"))
    rows = sorted(alone.collect(), key=lambda r: r.pos)
    seen = {key(r.url) for r in rows if r.item_id % 5 == 0}
    past = [x for i, x in v.items() if i % 5 == 0]
    want, left, kept = {}, [], []
    for r in rows:
        if r.item_id % 5 == 0:
            continue
        if r.chars < (600 if r.content_type == "paper" else 1200):
            want[r.item_id] = "content"
        elif r.truism:
            want[r.item_id] = "pre_filter"
        elif key(r.url) in seen:
            want[r.item_id] = "repeats"
        else:
            seen.add(key(r.url))
            x = v.get(r.item_id)
            if not r.relevant:
                want[r.item_id] = "narrative"
            elif r.quality:
                want[r.item_id] = "narrative_quality"
            elif r.item_id % 13 == 0:
                want[r.item_id] = "compression"
            elif r.headline:
                want[r.item_id] = "headline_quality"
            elif x and any(cosine(x, y) >= 0.3 for y in past + kept):
                want[r.item_id] = "novelty"
            else:
                kept += [x] if x else []
                left.append(r)
    counts, ranks = {}, {}
    for r in sorted(left, key=lambda r: (r.archetype not in ("SIMPLE_HABIT", "WARNING_RISK", "IF_THEN"), -r.clarity)):
        if len(ranks) < 5 and counts.get(r.archetype, 0) < 5:
            counts[r.archetype] = counts.get(r.archetype, 0) + 1
            ranks[r.item_id] = len(ranks) + 1
        else:
            want[r.item_id] = "selection"
    got = plans.second(spark, DIR, items, spine)
    fates = {r.item_id: r for r in got.select("item_id", "fault.stage", "rank").collect()}
    assert {i: r.stage for i, r in fates.items() if r.stage} == want
    assert {i: r["rank"] for i, r in fates.items() if r["rank"]} == ranks and len(ranks) == 5
    assert {"content", "repeats", "narrative_quality", "compression", "headline_quality"} <= set(want.values())
    steps = registry.queries()["a02_funnel_second"](spark, DIR).orderBy("step").collect()
    assert steps[0].entered == len(fates) and steps[-1].passed == 5
    assert all(a.passed == b.entered for a, b in zip(steps, steps[1:], strict=False))


def row(i, title, chars=1300, url=None, kind="news", **other):
    return {"item_id": i, "pos": i, "url": url or f"u{i}", "title": title, "body_text": "x" * chars, "content_type": kind, "credibility_tier": "A"} | other


def test_third_run_stage_by_stage(spark):
    good = "STUDY FINDS 40% LOWER RISK COMPARED TO A CONTROL GROUP"
    items = [row(1, good), row(2, good, url="u1"), row(3, good, 10), row(4, good, 700, kind="paper"), row(5, "It failed to show benefit"), row(6, "nothing here"), row(7, good), row(8, good), row(9, good), row(10, good), row(11, "Drink tea daily to reduce pain in the knee within 9 days")]
    spines = [(1, True, None, 9, good), (2, True, None, 9, good), (3, True, None, 9, good), (4, True, None, 10, good), (5, True, None, 9, good), (6, True, None, 9, good), (7, False, "off topic", 9, good), (9, True, None, 6, good), (10, True, None, 7, "too short"), (11, True, None, 7, "DRINK TEA DAILY AND REDUCE PAIN IN 9 DAYS")]
    df = spark.createDataFrame(items)
    got = runs.third_run(df, spark.createDataFrame(spines, "item_id long, relevant boolean, rejection_reason string, clarity int, hook string"), spark.createDataFrame([(11, 0.1), (4, 0.9)], "item_id long, sim double"), studies=1)
    fates = {r.item_id: (r.stage, r.reason, r["rank"]) for r in got.select("item_id", "fault.stage", "fault.reason", "rank").collect()}
    assert fates[2] == ("address", "repeated", None) and fates[3] == ("content", "insufficient", None) and fates[5][:2] == ("hard_reject", "null_result")
    assert fates[6] == ("category", "weak", None) and fates[7] == ("narrative", "off topic", None) and fates[8] == ("narrative", "extraction_failed", None)
    assert fates[9] == ("slide", "clarity:6", None) and fates[10] == ("slide", "invalid", None) and fates[11] == ("score", "too_low", None)
    assert fates[4] == (None, None, 1) and fates[1] == ("selection", "not_selected", None)
    assert [(r.tier, r.n) for r in runs.tiers(got).collect()] == [("A", 1)]
    assert [r.reason for r in runs.examples(got, 3).collect()] == ["repeated", "insufficient", "null_result"]
    assert sum(r.n for r in runs.histogram(got).collect()) == 10


def test_runs_of_nothing(spark):
    none = spark.createDataFrame([row(1, "x")]).where("item_id < 0")
    got = runs.third_run(none, spark.createDataFrame([], "item_id long, relevant boolean, rejection_reason string, clarity int, hook string"), spark.createDataFrame([], "item_id long, sim double"))
    assert got.count() == 0 and [(r.entered, r.passed) for r in runs.funnel(got, runs.THIRD_STAGES).collect()] == [(0, 0)] * 8


def test_no_text_is_shuffled_by_the_combined_filter(spark):
    evidence = spark.createDataFrame([], "item_id long, number string, population string, time string, comparison string")
    assert "body_text" not in runs.generic_filter(spark.createDataFrame([row(1, "x")]), evidence).columns


def test_no_text_is_shuffled_by_the_third_run(spark):
    read = runs.read_texts(spark.createDataFrame([row(1, "It failed to show benefit"), row(2, "It failed to show benefit", 10)]))
    assert "body_text" not in read.columns and [(r.told, r.category) for r in read.orderBy("item_id").collect()] == [("3|hard_reject|null_result", "NONE"), ("2|content|insufficient", "NONE")]


def test_lists_of_patterns_are_one_pass(spark):
    assert "regexp_count" not in str(triage.truism()) and str(triage.truism()).count("rlike(") == 3
    df = spark.createDataFrame([("Regular exercise is good for you", "nothing"), ("Regular exercise is good for you", "fell by 12%"), ("Regular exercise is good for you", None), ("A walk", "nothing")], "title string, body_text string")
    assert [r[0] for r in df.select(triage.truism()).collect()] == ["truism", None, None, None]
