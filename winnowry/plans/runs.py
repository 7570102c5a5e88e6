"""Queries over whole runs: per item, funnel, reasons, examples, tiers and what was selected, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowry.functions import rules, text
from winnowry.operators import runs, triage
from winnowry.plans.columns import EVIDENCE, evident, quoted, sql_one_of, sql_strip, told
from winnowry.plans.queries import BEST, CATEGORY, COSINE, REJECT, query, sql_cards, sql_count, sql_hits
from winnowry.sources.fixtures import ctes

VIEWS = ("fx_items", "fx_spine", "fx_export")
SLIDE = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({sql_strip('upper(own)', rules.SLIDE_PREFIXES)}, '!', ''), '\\.{{2,}}|…', ',', 'g'), ',\\s*,', ',', 'g'), '\\s+,', ',', 'g'), '\\s+', ' ', 'g'))"
VALID = f"(length(slide) >= 30 and upper(slide) = slide and (regexp_matches(slide, '[0-9]') or {sql_one_of('slide', rules.SLIDE_COMPARISONS)} or {sql_one_of('slide', rules.SLIDE_TIMES)}) and not contains(left(slide, 30), ':'))"
LIKE = f"case when sim is null then 50 else least(greatest(trunc(least(greatest((sim - 0.6) * 250, 0), 100) - least(10 * {sql_count('slide', rules.NEWSWORDS)}, 30))::int, 0), 100) end"
STUDIES = ", ".join(map(quoted, rules.STUDY_CATEGORIES))
RUN = ctes(*VIEWS).rstrip() + f""", whole as (select * replace (title || ' ' || body_text as title), title as own from fx_items), c0 as (select *, {sql_cards()} from whole), c1 as (select *, {BEST} as best from c0),
s1 as (select item_id, pos, own, url, body_text, content_type, {REJECT} as reject, {CATEGORY} as category, case when best < 30 then 0 else best end as category_score, row_number() over (partition by url order by pos) as place from c1),
best_of as ({COSINE}), s2 as (select s1.*, {SLIDE} as slide, relevant, clarity, credibility_tier, best_of.sim from s1 join fx_spine using (item_id) join (select item_id, credibility_tier from fx_export) using (item_id) left join best_of on best_of.id = item_id),
s3 as (select *, {LIKE} as likeness, 0.45::double * {LIKE} + 0.35::double * category_score + 0.20::double * clarity * 10 as final_score from s2),
s4 as (select *, case when place > 1 then 1 when length(body_text) < case when content_type = 'paper' then 600 else 1200 end then 2 when reject is not null then 3 when category_score < 40 and category = 'NONE' then 4 when not relevant then 5 when clarity < 7 or not {VALID} then 6 when not (coalesce(sim >= 0.78, false) or final_score >= 50) then 7 end as broke from s3),
s5 as (select *, case broke when 1 then 'repeated' when 2 then 'insufficient' when 3 then reject when 4 then 'weak' when 5 then 'not_relevant' when 6 then case when clarity < 7 then 'clarity:' || clarity else 'invalid' end when 7 then 'too_low' end as why from s4),
p1 as (select item_id, final_score, pos, category in ({STUDIES}) as study, row_number() over (partition by category in ({STUDIES}) order by final_score desc, pos) as i from s5 where broke is null), p2 as (select item_id, row_number() over (order by final_score desc, pos)::int as rank from p1 where not study or i <= 2),
run as (select s5.* exclude (broke, why), case when broke is null and coalesce(rank, 9) > 5 then 8 else broke end as step, case when broke is null and coalesce(rank, 9) > 5 then 'not_selected' else why end as reason, case when rank <= 5 then rank end as rank from s5 left join p2 using (item_id)),
names as (select unnest(range(1, 9))::int as step, unnest({runs.THIRD_STAGES}) as stage) """


def third(spark, d, items, spine, export):
    """The third run over all items; similarity is that of their vectors to a fifth of them, where they have one."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sims = triage.cosine_best(v.where("id % 5 <> 0"), v.where("id % 5 = 0")).select(F.col("id").alias("item_id"), "sim")
    tier = export.select("item_id", "credibility_tier")
    return runs.third_run(runs.read_texts(items).join(tier, "item_id"), spine.withColumn("rejection_reason", F.lit(None).cast("string")), sims)


@query("run_third", RUN + "select item_id, step, stage, reason, rank from run left join names using (step)", VIEWS)
def _(spark, d, *views):
    return third(spark, d, *views).select("item_id", "fault.step", "fault.stage", "fault.reason", "rank")


@query("a02_funnel", RUN + "select n.step, stage, count_if(coalesce(r.step, 9) >= n.step)::bigint as entered, count_if(coalesce(r.step, 9) > n.step)::bigint as passed from names n, run r group by 1, 2", VIEWS)
def _(spark, d, *views):
    return runs.funnel(third(spark, d, *views), runs.THIRD_STAGES)


@query("a03_reasons", RUN + "select stage, split_part(reason, ':', 1) as reason, count(*) as n from run join names using (step) group by all", VIEWS)
def _(spark, d, *views):
    return runs.histogram(third(spark, d, *views))


@query("a03_examples", RUN + "select step, stage, reason, left(own, 100) as title, pos from run join names using (step) order by step, pos limit 10", VIEWS)
def _(spark, d, *views):
    return runs.examples(third(spark, d, *views))


@query("a03_accepted", RUN + "select rank, item_id, left(own, 100) as title, left(slide, 80) as headline, category, clarity, credibility_tier as tier, round(final_score, 6) as final_score from run where rank is not null", VIEWS)
def _(spark, d, *views):
    rows = third(spark, d, *views).where("rank is not null")
    return rows.select("rank", "item_id", F.left("title", F.lit(100)).alias("title"), F.left("slide", F.lit(80)).alias("headline"), "category", "clarity", F.col("credibility_tier").alias("tier"), F.round("final_score", 6).alias("final_score"))


@query("a03_tiers", RUN + "select credibility_tier as tier, count(*) as n from run where rank is not null group by 1", VIEWS)
def _(spark, d, *views):
    return runs.tiers(third(spark, d, *views))


def second(spark, d, items, spine):
    """The second run over all items but those of a fifth of the ids, whose addresses and vectors are the past."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    past = items.where("item_id % 5 = 0").select(text.url_key("url").alias("url_key"))
    headlines = spine.where("item_id % 13 <> 0").select("item_id", F.col("hook").alias("headline"))
    return runs.second_run(items.where("item_id % 5 <> 0"), told(spine).withColumn("actionable", F.lit(True)), headlines, past, v.where("id % 5 <> 0"), v.where("id % 5 = 0"), alike=0.3)


@query("run_second", views=("fx_items", "fx_spine"))
def _(spark, d, *views):
    return second(spark, d, *views).select("item_id", "fault.step", "fault.stage", "fault.reason", "rank")


@query("a02_funnel_second", views=("fx_items", "fx_spine"))
def _(spark, d, *views):
    return runs.funnel(second(spark, d, *views), runs.SECOND_STAGES)


COMBINED = f""", {EVIDENCE}, f as (select i.item_id, i.pos, i.title, (number is not null)::int + (population is not null)::int + (time is not null)::int + (comparison is not null)::int as kinds,
 case when length(body_text) < case when content_type = 'paper' then 600 else 1200 end then 1 when {sql_hits('i.title', rules.TRUISMS)} > 0 and {sql_count('i.title', rules.DIFFERENTIATORS)} + {sql_count('body_text', rules.DIFFERENTIATORS)} = 0 then 2 when kinds < 2 then 3 else 0 end as broke, length(body_text) as chars from fx_items i join e using (item_id)) """


@query("a04_gate_statistics", COMBINED + "select count(*) as pre_ai_total, count_if(broke not in (1, 2))::bigint as pre_ai_passed, count_if(broke = 1)::bigint as pre_ai_rejected_insufficient, count_if(broke = 2)::bigint as pre_ai_rejected_truism, count_if(broke in (0, 3))::bigint as post_ai_total, count_if(broke = 0)::bigint as post_ai_passed, count_if(broke = 3)::bigint as post_ai_rejected from f", ("fx_items", "fx_spine"))
def _(spark, d, items, spine):
    return runs.filter_statistics(runs.generic_filter(items, evident(spine)))


@query("g28_generic_filter", COMBINED + "select item_id, case when broke = 0 then null when broke = 3 then 'post_ai' else 'pre_ai' end as stage, case broke when 1 then 'insufficient_content:' || chars when 2 then 'generic_truism' when 3 then 'differentiators:' || kinds end as reason from f", ("fx_items", "fx_spine"))
def _(spark, d, items, spine):
    return runs.generic_filter(items, evident(spine)).select("item_id", "fault.stage", "fault.reason")
