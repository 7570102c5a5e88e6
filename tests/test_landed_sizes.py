"""What is landed is read and written once, and in parts."""

import glob
import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from winnowry import registry
from winnowry.operators import landed, lexical, pages
from winnowry.sources import tables

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_corpus_is_written_in_several_files(spark):
    before = set(glob.glob(tables.shared_dir(spark).removeprefix("file:") + "/winners-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = registry.queries()["s08_corpus"](spark, DIR)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (path,) = set(glob.glob(tables.shared_dir(spark).removeprefix("file:") + "/winners-*")) - before
    assert len(glob.glob(path + "/*.csv")) > 1
    assert got.where("headline = 'Headline'").count() == 0 and got.where("headline = 'Title'").first().n == 1


def test_texts_of_tf_cosine_are_read_once(spark):
    assert "regexp_extract_all" not in plan(registry.queries()["p29_tf_cosine"](spark, DIR))


def test_words_of_tf_cosine_are_shuffled_by_block(spark):
    """A word goes once from each block of ids to its weight, not once from each text, and texts are not shuffled by word or by id."""
    got = registry.queries()["p29_tf_cosine"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    keys = {line.split("hashpartitioning(")[1].split("#")[0] for line in got.splitlines() if "hashpartitioning(" in line}
    assert keys == {"block"}


def test_next_cosine_by_loops(spark, monkeypatch):
    monkeypatch.setattr(lexical, "IDS", 4)
    pick = random.Random(2)
    words = ["the", "of", *(f"w{i}" for i in range(30)), "é"]
    rows = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(1, 12)))) for i in (-5, -4, -3, 0, 1, 2, 3, 4, 5, 7, 8, 8, 9, 12, 13, 1 << 60, (1 << 60) + 1)]
    rows += [(14, ""), (15, "of"), (None, "w1 w1 rare"), (None, "w1 w2"), (10, None), (20, "only"), (21, "the")]
    got = lexical.next_cosine(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("doc_id", F.split("text", " ").alias("tokens")).withColumn("tokens", F.array_remove("tokens", "")), len(rows)).collect()
    bags = defaultdict(Counter)
    for i, t in rows:
        bags[i].update((t or "").split())
    df = Counter(w for b in bags.values() for w in b)
    weigh = lambda b: {w: n * math.log(len(rows) / df[w]) for w, n in b.items()}
    want = {}
    for i in bags:
        if i is not None and bags[i] and bags.get(i + 1):
            a, b = weigh(bags[i]), weigh(bags[i + 1])
            both = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
            want[i] = sum(x * b.get(w, 0) for w, x in a.items()) / both if both else 0.0
    assert sorted(r.doc_id for r in got) == sorted(want) and all(abs(r.sim - want[r.doc_id]) < 1e-9 for r in got)
    assert lexical.next_cosine(spark.createDataFrame([], "doc_id long, tokens array<string>"), 0).count() == 0


def test_feeds_are_made_once(spark):
    assert plan(registry.queries()["s01_feed_items"](spark, DIR)).count("collect_list(") == 1


def test_articles_are_read_once(spark):
    xml = "<Article><Journal><Title>J</Title></Journal><Abstract><AbstractText>A</AbstractText></Abstract><ArticleIdList><ArticleId IdType=\"doi\">10.1/2</ArticleId></ArticleIdList></Article>"
    got = landed.articles(spark.createDataFrame([(1, xml), (2, None)], "i long, payload string"))
    assert plan(got).count("xmltostructs") + plan(got).count("from_xml") == 1
    assert [tuple(r) for r in got.orderBy("i").collect()] == [(1, "A", "J", None, "10.1/2"), (2, None, None, None, None)]


def test_dates_are_tried_where_their_shape_is_there(spark):
    told = ["2024-01-02T03:04:05Z", "2024-01-02t03:04:05", "Tue, 02 Jan 2024 03:04:05 +0000", "02 Jan 2024 03:04:05 GMT", "2024-01-02", "soon", "", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(told)], "i int, x string").select("i", landed.instant(F.col("x")).cast("string").alias("at"))
    assert [r["at"] for r in got.orderBy("i").collect()] == ["2024-01-02 03:04:05"] * 4 + ["2024-01-02 00:00:00", None, None, None]
    assert str(landed.instant(F.col("x"))).count(" THEN try_to_timestamp(") == str(landed.instant(F.col("x"))).count("rlike(") == len(landed.DATES)


def test_short_pages_are_parsed_together():
    sizes = pa.array([100] * 5000 + [2 * pages.BYTES, 3 * pages.BYTES, None, 5])
    found = pages.stretches_of(sizes)
    assert found[0] == (0, 5001) and [n for _, n in found] == [5001, 1, 2] and pages.stretches_of(pa.array([], pa.int32())) == []
