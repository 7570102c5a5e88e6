"""Queries of similarity and greedy novelty. Walks in order have no SQL; tests hold them against a loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowry.functions import text
from winnowry.operators import lexical, similar, triage
from winnowry.plans.queries import COSINE, query
from winnowry.sources import tables

#: Vectors of the test tables are less alike than those of real texts, so thresholds are lower here.
NEAR = 0.3


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


CENTROIDS = "ce as (select label, list(m order by i) as e from (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) r(i) where vec_id % 5 = 0 group by 1, 2) group by 1)"


@query("j09_corpus_argmax", f"with best as ({COSINE}), {CENTROIDS}, s as (select v.vec_id as id, ce.label as cluster, round(list_cosine_similarity(list_transform(v.embedding, lambda x: x::double), ce.e), 9) as cluster_sim from embeddings v, ce where v.vec_id % 5 <> 0), r as (select *, row_number() over (partition by id order by cluster_sim desc, cluster) as k from s) select id, best_id, sim, cluster::bigint as cluster, cluster_sim from best join r using (id) where k = 1")
def _(spark, d):
    v = vectors(spark, d)
    corpus, rows = v.where("id % 5 = 0"), v.where("id % 5 <> 0").select("id", "v")
    means = corpus.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centroids = means.groupBy(F.col("label").cast("long").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    nearest = triage.cosine_best(rows, corpus.select("id", "v"))
    cluster = triage.cosine_best(rows, centroids).select("id", F.col("best_id").alias("cluster"), F.col("sim").alias("cluster_sim"))
    return nearest.join(cluster, "id").select("id", "best_id", "sim", "cluster", "cluster_sim")


@query("j10_greedy_near")
def _(spark, d):
    v = vectors(spark, d).select("id", "v")
    return similar.without_near(v.where("id % 5 <> 0"), v.where("id % 5 = 0"), NEAR)


@query("j11_url_then_near", views=("fx_items",))
def _(spark, d, items):
    """Items whose address is new, first of each, that a walk keeps; those without a vector stay."""
    past = items.where("item_id % 5 = 0").select(text.url_key("url").alias("key"))
    fresh = items.where("item_id % 5 <> 0").withColumn("key", text.url_key("url")).join(past, "key", "left_anti")
    first = triage.first_wins(fresh, F.col("key")).select(F.col("item_id").alias("id"))
    v = vectors(spark, d).select("id", "v")
    return similar.without_near(first.join(v, "id", "left"), v.where("id % 5 = 0"), NEAR)


@query("j12_run_novelty")
def _(spark, d):
    v = vectors(spark, d).select("id", "v")
    return similar.novelty(v.where("id % 5 <> 0"), v.where("id % 5 = 0"), NEAR)


def lexical_sql(rows: str, history: str) -> str:
    """CTEs that end in lex (id, sim, best_id): texts of the same words are compared once."""
    bag = r"array_to_string(list_sort(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')), ' ')"
    return f"""ra as (select item_id as id, {bag} as k from fx_items where {rows}), rb as (select min(item_id) as id, {bag} as k from fx_items where {history} group by 2),
a as (select k, x, count(*) as c from (select k, unnest(string_split(k, ' ')) as x from (select distinct k from ra where k <> '')) group by all), b as (select id, x, count(*) as c from (select id, unnest(string_split(k, ' ')) as x from rb where k <> '') group by all),
na as (select k, count(*) as s, sqrt(sum(c * c)) as n from a group by 1), nb as (select id, count(*) as s, sqrt(sum(c * c)) as n from b group by 1), p as (select a.k, b.id as other, count(*) as c, sum(a.c * b.c) as d from a join b using (x) group by all),
s as (select p.k, other, floor((c::double / (na.s + nb.s - c) + d / (na.n * nb.n)) / 2 * 1e9 + 0.5) / 1e9 as sim from p join na on na.k = p.k join nb on nb.id = p.other),
best_of as (select k, sim, other from (select *, row_number() over (partition by k order by sim desc, other) as i from s) where i = 1), lex as (select ra.id, sim, other as best_id from ra join best_of using (k))"""


@query("j08_lexical_novelty", f", {lexical_sql('item_id % 4 <> 0', 'item_id % 4 = 0')} select id, sim, best_id from lex", ("fx_items",))
def _(spark, d, items):
    """Every item is a candidate or history, as in j06."""
    keyed = items.select(F.col("item_id").alias("id"), text.tokens("title").alias("tokens"))
    return lexical.lexical_best(keyed.where("id % 4 <> 0"), keyed.where("id % 4 = 0"))


@query("j13_by_method", f""", best as ({COSINE}), {lexical_sql("item_id % 5 <> 0 and (item_id % 7 = 0 or item_id not in (select vec_id from embeddings where vec_id is not null))", 'item_id % 5 = 0')}
select i.item_id as id, case when best.id is not null then 'cosine' when lex.id is null then 'none' else 'lexical' end as method, coalesce(best.sim, lex.sim, 0) as sim from fx_items i left join (select * from best where id % 7 <> 0) best on best.id = i.item_id left join lex on lex.id = i.item_id where i.item_id % 5 <> 0""", ("fx_items",))
def _(spark, d, items):
    """All items: those with a vector, less a seventh whose vector is missing, meet the history by it, the others by their words."""
    rows = items.select(F.col("item_id").alias("id"), text.tokens("title").alias("tokens")).join(vectors(spark, d).select("id", "v"), "id", "left")
    rows = rows.withColumn("v", F.when((F.col("id") % 7 != 0) | (F.col("id") % 5 == 0), F.col("v")))
    return similar.by_method(rows.where("id % 5 <> 0"), vectors(spark, d).where("id % 5 = 0").select("id", "v").join(rows.select("id", "tokens"), "id", "full").where("id % 5 = 0"))


@query("p29_tf_cosine", r"""with w as (select doc_id, x, count(*) as c from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as x from documents) group by all), i as (select x, ln((select count(*) from documents)::double / count(*)) as f from w group by 1),
n as (select doc_id, sqrt(sum((c * f) * (c * f))) as n from w join i using (x) group by 1), p as (select a.doc_id, sum(a.c * b.c * f * f) as dot from w a join w b on b.doc_id = a.doc_id + 1 and a.x = b.x join i on i.x = a.x group by 1)
select a.doc_id, round(coalesce(dot / nullif(a.n * b.n, 0), 0), 6) as sim from n a join n b on b.doc_id = a.doc_id + 1 left join p on p.doc_id = a.doc_id""")
def _(spark, d):
    """Of each text and the next, by words weighted with the logarithm of texts over texts that have the word."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    # what a written table was made of needs no shuffle files any more
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return lexical.next_cosine(docs.select("doc_id", text.tokens("text").alias("tokens")), docs.count()).select("doc_id", F.round("sim", 6).alias("sim"))
