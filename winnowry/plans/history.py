"""Queries on history, set operations, response gates and periods, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowry.operators import corpus, gates, triage
from winnowry.plans.queries import query
from winnowry.streaming import jobs


@query("g20_precheck", "select item_id, case when not relevant then 'not_relevant' when clarity < 7 then 'clarity_too_low:' || clarity end as reason from fx_spine", ("fx_spine",))
def _(spark, d, spine):
    return spine.select("item_id", gates.slide_precheck().alias("reason"))


@query("g18_compression", "select item_id, coalesce(length(trim(title)) >= 30 and regexp_matches(title, '[0-9]') and not regexp_matches(trim(title), '^[A-Z][a-z]+:'), false) as valid from fx_items", ("fx_items",))
def _(spark, d, items):
    t = F.trim("title")
    return items.select("item_id", F.coalesce((F.length(t) >= 30) & F.col("title").rlike("[0-9]") & ~t.rlike("^[A-Z][a-z]+:"), F.lit(False)).alias("valid"))


@query("a12_novelty_stats", "select count(*) as n, count(published_at) as dated from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.agg(F.count(F.lit(1)).alias("n"), F.count("published_at").alias("dated"))


@query("u01_concatenate", "select item_id, source_name from fx_items where content_type = 'paper' union all select item_id, null from fx_items where content_type <> 'policy'", ("fx_items",))
def _(spark, d, items):
    papers = items.where("content_type = 'paper'").select("item_id", "source_name")
    return papers.unionByName(items.where("content_type <> 'policy'").select("item_id"), allowMissingColumns=True)


@query("w03_id_first_wins", "select item_id, min(output_id) as output_id from fx_outputs group by 1", ("fx_outputs",))
def _(spark, d, outputs):
    return outputs.groupBy("item_id").agg(F.min("output_id").alias("output_id"))


@query("w11_recent_outputs", "select output_id, created_at from fx_outputs where status_code = 'R' order by created_at desc, output_id limit 50", ("fx_outputs",))
def _(spark, d, outputs):
    return outputs.where("status_code = 'R'").select("output_id", "created_at").orderBy(F.desc("created_at"), "output_id").limit(50)


@query("w12_recent_headlines", "select o.output_id, i.title from fx_outputs o join fx_items i using (item_id) where created_at >= timestamp '1998-06-01'", ("fx_items", "fx_outputs"))
def _(spark, d, items, outputs):
    return outputs.where("created_at >= timestamp '1998-06-01'").join(items, "item_id").select("output_id", "title")


@query("t02_period_funnel", "select time_bucket(interval 12 hours, ts, timestamp '1970-01-01') as start, event_type, count(*) as n, count_if(value >= 50)::bigint as high from events group by 1, 2")
def _(spark, d):
    return jobs.period_funnel(spark.read.parquet(f"{d}/events.parquet"))


def points(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("a07_clusters")
def _(spark, d):
    """k-means in k = 8 groups, of ten starts the cheapest: each cluster's size."""
    return corpus.clustered(points(spark, d)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("a09_clusters_of_corpus")
def _(spark, d):
    """The clusters of a07 with their sizes and first three members."""
    return corpus.summary(corpus.clustered(points(spark, d)))


@query("a09_cluster_summary", "select label, count(*) as n, array_to_string(list(vec_id order by vec_id)[1:3], ',') as first_three from embeddings group by 1")
def _(spark, d):
    members = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return corpus.summary(members).select(F.col("cluster").alias("label"), "n", F.col("examples").alias("first_three"))
