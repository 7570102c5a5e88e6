"""The triage queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnowry.functions import rules, text
from winnowry.operators import triage
from winnowry.sources.fixtures import ctes, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers fn(spark, sf_dir, *views as DataFrames)."""

    def put(fn):
        QUERIES[name] = partial(run, fn, views)
        if sql:
            ORACLES[name] = sql if not views or sql.startswith("with ") else ctes(*views).rstrip() + (sql if sql.startswith(",") else " " + sql)
        return fn

    return put


def run(fn, views: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn(spark, sf_dir, *[view(spark, sf_dir, v) for v in views])


def rlike(col: str, p: str) -> str:
    return "regexp_matches({}, '{}')".format(col, p.replace("'", "''"))


def sql_first(col: str, found: list[tuple[str, str]]) -> str:
    return "coalesce(" + ", ".join(f"case when {rlike(f'lower({col})', p)} then '{n}' end" for n, p in found) + ")"


def sql_hits(col: str, found: list[tuple[str, str]]) -> str:
    return "(" + " + ".join(f"{rlike(f'lower({col})', p)}::int" for _, p in found) + ")"


def sql_count(col: str, found: list[tuple[str, str]]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(lower({col}), '{p}'))" for _, p in found) + ")"


KEY = "regexp_replace(lower(trim(url)), '/+$', '')"
REJECT = f"coalesce({sql_first('title', rules.NULL_RESULT)}, case when {sql_hits('title', rules.ADMIN)} >= 2 then 'admin' end, {sql_first('title', rules.PROMO)}, {sql_first('title', rules.LOCAL)})"


def sql_cards() -> str:
    flag = {n: rlike("lower(title)", p) for n, p in rules.FLAGS.items()}
    flag["symptom|body"] = f"({flag['symptom']} or {flag['body']})"
    return ", ".join("(" + " + ".join(f"(case when {flag[f]} then {n} else 0 end)" for f, n in points.items()) + f") as s{i}, concat_ws(',', " + ", ".join(f"case when {flag[f]} then '{f}' end" for f in points) + f") as r{i}" for i, (_, points) in enumerate(rules.SCORECARDS))


NAMES = [n for n, _ in rules.SCORECARDS]
BEST = "greatest(" + ", ".join(f"s{i}" for i in range(len(NAMES))) + ")"
CATEGORY = "case when best < 30 then 'NONE' " + " ".join(f"when s{i} = best then '{n}'" for i, n in enumerate(NAMES)) + " end"
REASONS = "case when best < 30 then '' " + " ".join(f"when s{i} = best then r{i}" for i in range(len(NAMES))) + " end"
TOTAL = " + ".join(f"s{i}" for i in range(len(NAMES)))
SCORED = f"{ctes('fx_items')}, c0 as (select *, {sql_cards()} from fx_items), c1 as (select *, {BEST} as best from c0), scored as (select *, {CATEGORY} as category, case when best < 30 then 0 else best end as category_score, case when best < 30 then 0.0 else best::double / ({TOTAL}) end as confidence, {REASONS} as reasons from c1) "


@query("p01_content_hash", "select item_id, sha256(lower(trim(url)) || '|' || lower(trim(title))) as content_hash from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", text.content_hash("url", "title").alias("content_hash"))


@query("p02_url_key", f"select item_id, {KEY} as url_key from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", text.url_key("url").alias("url_key"))


@query("p03_tier_tag", "select item_id, case when source_name in ('Source 0','Source 1','Source 2') then 'A' when source_name in ('Source 3','Source 4','Source 5') then 'B' else 'C' end as tier, case when source_name in ('Source 0','Source 1','Source 2') then 3.0 when source_name in ('Source 3','Source 4','Source 5') then 2.0 else 1.0 end::double as weight from fx_items", ("fx_items",))
def _(spark, d, items):
    sources = spark.createDataFrame([(f"Source {i}", "ABC"[i // 3], 3.0 - i // 3) for i in range(8)], "source_name string, tier string, weight double")
    return items.join(F.broadcast(sources), "source_name", "left").select("item_id", F.coalesce("tier", F.lit("C")).alias("tier"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


@query("p17_headline_key", r"select item_id, trim(regexp_replace(regexp_replace(regexp_replace(upper(title), '\.\.+|…', '...', 'g'), '[^\p{L}\p{N}_\s.\-]', '', 'g'), '\s+', ' ', 'g')) as headline_key from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", text.headline_key("title").alias("headline_key"))


@query("p22_flags", "select item_id, " + ", ".join(f"{rlike('lower(title)', p)} as has_{n}" for n, p in rules.FLAGS.items()) + " from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", *[F.lower("title").rlike(p).alias(f"has_{n}") for n, p in rules.FLAGS.items()])


@query("p23_category", SCORED + "select item_id, category, category_score, confidence, reasons from scored", ("fx_items",))
def _(spark, d, items):
    return triage.categorised(items).select("item_id", "category", "category_score", "confidence", "reasons")


@query("p24_analysis", SCORED + f"select item_id, {REJECT} as reject, case when {REJECT} is null then category end as category from scored", ("fx_items",))
def _(spark, d, items):
    found = triage.categorised(items).withColumn("reject", triage.hard_reject("title"))
    return found.select("item_id", "reject", F.when(F.col("reject").isNull(), F.col("category")).alias("category"))


@query("p25_differentiators", "select item_id, array_to_string(list_concat(" + ", ".join(f"regexp_extract_all(lower(title), '{p}')" for _, p in rules.DIFFERENTIATORS) + ")[1:10], '|') as found from fx_items", ("fx_items",))
def _(spark, d, items):
    every = F.flatten(F.array(*[F.regexp_extract_all(F.lower("title"), F.lit(p), F.lit(0)) for _, p in rules.DIFFERENTIATORS]))
    return items.select("item_id", F.array_join(F.slice(every, 1, 10), "|").alias("found"))


@query("p26_newswords", f"select item_id, {sql_count('title', rules.NEWSWORDS)}::int as n from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", text.count_matches("title", rules.NEWSWORDS).alias("n"))


@query("p28_jaccard", r"with t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w from documents) select a.doc_id, case when len(a.w) = 0 or len(b.w) = 0 then 0.0 else len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) end as sim from t a join t b on b.doc_id = a.doc_id + 1")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.tokens("text").alias("w"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return docs.join(after, "doc_id").select("doc_id", text.jaccard("w", "v").alias("sim"))


@query("g01_freshness", "select item_id from fx_items where published_at is null or published_at >= timestamp '1998-01-01' - interval 48 hour", ("fx_items",))
def _(spark, d, items):
    return triage.fresh(items, "1998-01-01 00:00:00", 48).select("item_id")


@query("g05_body_length", "select item_id, case when length(body_text) < case when content_type = 'paper' then 600 else 1200 end then 'too short' end as reason from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", triage.short_body().alias("reason"))


@query("g06_body_length3", "select item_id, length(body_text) >= case content_type when 'paper' then 600 when 'press_release' then 800 else 1200 end as enough from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", (F.length("body_text") >= F.when(F.col("content_type") == "paper", 600).when(F.col("content_type") == "press_release", 800).otherwise(1200)).alias("enough"))


@query("g07_truism", f"select item_id, case when {sql_hits('title', rules.TRUISMS)} > 0 and {sql_count('title', rules.DIFFERENTIATORS)} + {sql_count('body_text', rules.DIFFERENTIATORS)} = 0 then 'truism' end as reason from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", triage.truism().alias("reason"))


@query("g12_banned_words", "select item_id, (" + " + ".join(f"contains(lower(title), '{w}')::int" for w in rules.BANNED) + ") >= 2 as banned from fx_items", ("fx_items",))
def _(spark, d, items):
    words = F.array(*[F.lit(w) for w in rules.BANNED])
    return items.select("item_id", (F.size(F.filter(words, lambda w: F.contains(F.lower("title"), w))) >= 2).alias("banned"))


@query("g13_hard_reject", f"select item_id, {REJECT} as reason from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", triage.hard_reject("title").alias("reason"))


@query("g17_headline", "select item_id, case when title is null or trim(title) = '' then 'empty' when length(trim(title)) < 30 then 'short' when length(trim(title)) > 300 then 'long' when not regexp_matches(trim(title), '[0-9]') then 'no digit' when regexp_matches(trim(title), '^[A-Z][A-Za-z ]*:') then 'prefix' when contains(title, '!') then 'exclaim' end as reason from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", triage.headline_fault().alias("reason"))


@query("g25_category_floor", SCORED + "select item_id, category_score from scored where category_score >= 40 or category <> 'NONE'", ("fx_items",))
def _(spark, d, items):
    return triage.categorised(items).where("category_score >= 40 or category <> 'NONE'").select("item_id", "category_score")


@query("j01_get_or_create", f", h as (select distinct {KEY} as k from fx_items where item_id % 3 = 0), n as (select item_id, {KEY} as k, row_number() over (partition by {KEY} order by pos) as r from fx_items) select item_id, r = 1 and k not in (select k from h) as created from n", ("fx_items",))
def _(spark, d, items):
    keyed = items.withColumn("k", text.url_key("url"))
    known = keyed.where("item_id % 3 = 0").select("k").distinct().withColumn("old", F.lit(True))
    return triage.ranked(keyed, ["k"], ["pos"]).join(known, "k", "left").select("item_id", ((F.col("rank") == 1) & F.col("old").isNull()).alias("created"))


@query("j02_unevaluated", "select item_id from fx_items where item_id not in (select item_id from fx_outputs where status_code = 'R') order by item_id limit 100", ("fx_items", "fx_outputs"))
def _(spark, d, items, outputs):
    return items.join(outputs.where("status_code = 'R'"), "item_id", "left_anti").select("item_id").orderBy("item_id").limit(100)


@query("j03_top_evaluated", "select i.item_id, output_id, virality_score from fx_items i join fx_outputs o using (item_id) where virality_score >= 40 and published_at >= timestamp '1995-01-01' order by virality_score desc, output_id limit 10", ("fx_items", "fx_outputs"))
def _(spark, d, items, outputs):
    return items.join(outputs, "item_id").where("virality_score >= 40 and published_at >= timestamp '1995-01-01'").select("item_id", "output_id", "virality_score").orderBy(F.desc("virality_score"), "output_id").limit(10)


@query("j04_used_urls", "select distinct url from fx_items join fx_outputs using (item_id) where created_at >= timestamp '1998-06-01'", ("fx_items", "fx_outputs"))
def _(spark, d, items, outputs):
    return items.join(outputs.where("created_at >= timestamp '1998-06-01'"), "item_id", "left_semi").select("url").distinct()


@query("j06_history_urls", f"select item_id from fx_items where item_id % 4 <> 0 and {KEY} not in (select {KEY} from fx_items where item_id % 4 = 0)", ("fx_items",))
def _(spark, d, items):
    keyed = items.withColumn("k", text.url_key("url"))
    return keyed.where("item_id % 4 <> 0").join(keyed.where("item_id % 4 = 0").select("k"), "k", "left_anti").select("item_id")


COSINE = "with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), s as (select c.vec_id as id, h.vec_id as best_id, round(list_cosine_similarity(c.e, h.e), 9) as sim from v c join v h on c.vec_id % 5 <> 0 and h.vec_id % 5 = 0), r as (select *, row_number() over (partition by id order by sim desc, best_id) as k from s) select id, sim, best_id from r where k = 1"


@query("j07_vector_novelty", COSINE)
def _(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return triage.cosine_best(v.where("id % 5 <> 0"), v.where("id % 5 = 0"))


@query("p31_novelty_penalty", f"with best as ({COSINE}) select id, sim < 0.86 as novel, case when sim >= 0.8 * 0.86 then greatest(0, trunc((id % 100) * (1 - 0.3 * least(1.0, (sim - 0.8 * 0.86) / (0.2 * 0.86)))))::int else (id % 100)::int end as new_score from best")
def _(spark, d):
    s, t = QUERIES["j07_vector_novelty"](spark, d).withColumn("score", (F.col("id") % 100).cast("int")), 0.86
    cut = 1 - 0.3 * F.least(F.lit(1.0), (F.col("sim") - 0.8 * t) / (0.2 * t))
    return s.select("id", (F.col("sim") < t).alias("novel"), F.when(F.col("sim") >= 0.8 * t, F.greatest(F.lit(0), (F.col("score") * cut).cast("int"))).otherwise(F.col("score")).alias("new_score"))


@query("a01_table_counts", "select 'items' as name, count(*) as n from fx_items union all select 'outputs', count(*) from fx_outputs union all select 'returned', count_if(status_code = 'R')::bigint from fx_outputs", ("fx_items", "fx_outputs"))
def _(spark, d, items, outputs):
    one = lambda df, name, agg: df.agg(agg.alias("n")).select(F.lit(name).alias("name"), "n")
    return one(items, "items", F.count(F.lit(1))).union(one(outputs, "outputs", F.count(F.lit(1)))).union(one(outputs, "returned", F.count_if(F.col("status_code") == "R")))


GATES = f"g as (select item_id, source_name, coalesce(case when length(body_text) < case when content_type = 'paper' then 600 else 1200 end then 'length:too short' end, 'reject:' || {REJECT}) as reason from fx_items)"


def gated(items: DataFrame) -> DataFrame:
    return items.select("item_id", "source_name", F.coalesce(F.concat(F.lit("length:"), triage.short_body()), F.concat(F.lit("reject:"), triage.hard_reject("title"))).alias("reason"))


@query("a06_templates", " union all ".join(f"select '{n}' as template, count_if({rlike('lower(title)', p)})::bigint as n from fx_items" for n, p in rules.TEMPLATES), ("fx_items",))
def _(spark, d, items):
    one = items.agg(*[F.count_if(F.lower("title").rlike(p)).alias(n) for n, p in rules.TEMPLATES])
    return one.unpivot([], [n for n, _ in rules.TEMPLATES], "template", "n")


@query("a08_centroid", "select d::int as d, avg(x::double) as mean from (select unnest(range(len(embedding))) as d, unnest(embedding) as x from embeddings) group by 1")
def _(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("mean"))


@query("a10_archetypes", "select run_id, archetype, count(*) as n from fx_candidates group by all", ("fx_candidates",))
def _(spark, d, c):
    return c.groupBy("run_id", "archetype").agg(F.count(F.lit(1)).alias("n"))


@query("w01_url_first_wins", f"select item_id from (select item_id, row_number() over (partition by {KEY} order by pos) as r from fx_items) where r = 1", ("fx_items",))
def _(spark, d, items):
    return triage.first_wins(items, text.url_key("url")).select("item_id")


@query("w02_raw_url_first_wins", "select item_id from (select item_id, row_number() over (partition by url order by pos) as r from fx_items) where r = 1", ("fx_items",))
def _(spark, d, items):
    return triage.first_wins(items, F.col("url")).select("item_id")


@query("w05_priority_order", "select run_id, pos, row_number() over (partition by run_id order by archetype <> 'SIMPLE_HABIT', clarity desc, pos)::int as rank from fx_candidates", ("fx_candidates",))
def _(spark, d, c):
    return triage.ranked(c, ["run_id"], [F.col("archetype") != "SIMPLE_HABIT", F.desc("clarity"), "pos"]).select("run_id", "pos", "rank")


@query("w06_diverse_walk", ", r as (select *, row_number() over (partition by run_id, archetype order by clarity desc, pos) as i from fx_candidates), p as (select *, row_number() over (partition by run_id order by clarity desc, pos)::int as rank from r where i <= 2) select run_id, pos, rank from p where rank <= 5", ("fx_candidates",))
def _(spark, d, c):
    return triage.capped(c, ["run_id"], [F.desc("clarity"), "pos"], F.col("archetype"), 2, 5).select("run_id", "pos", "rank")


@query("w07_mixer", ", a as (select *, archetype = 'STUDY_STAT' as study, row_number() over (partition by run_id, archetype order by pos) as o from fx_candidates), b as (select *, not study and o <= 2 as walks from a), c as (select *, sum(walks::int) over (partition by run_id order by pos) as k, sum(study::int) over (partition by run_id order by pos) as j from b), e as (select *, case when walks or j <= 2 then 0 else 1 end as s1, case when walks then k when j <= 2 then j else j end as s2, case when walks then 0 else 1 end as s3 from c where walks or study), f as (select *, row_number() over (partition by run_id order by s1, s2, s3, pos) as pick from e) select run_id, pos, row_number() over (partition by run_id order by score desc, pick)::int as rank from f where pick <= 5", ("fx_candidates",))
def _(spark, d, c):
    return triage.interleaved(c, 5).select("run_id", "pos", "rank")


@query("w07_mixer_strict", ", a as (select *, archetype = 'STUDY_STAT' as study, row_number() over (partition by run_id, archetype order by pos) as o from fx_candidates), b as (select *, not study and o <= 2 as walks from a), c as (select *, sum(walks::int) over (partition by run_id order by pos) as k, sum(study::int) over (partition by run_id order by pos) as j from b), e as (select *, case when walks or j <= 2 then 0 else 1 end as s1, case when walks then k when j <= 2 then j else j end as s2, case when walks then 0 else 1 end as s3 from c where walks or (study and j <= 2)), f as (select *, row_number() over (partition by run_id order by s1, s2, s3, pos) as pick from e) select run_id, pos, row_number() over (partition by run_id order by score desc, pick)::int as rank from f where pick <= 5", ("fx_candidates",))
def _(spark, d, c):
    """Without overflow a run may put out fewer rows."""
    return triage.interleaved(c, 5, overflow=False).select("run_id", "pos", "rank")


@query("w08_study_cap", ", r as (select *, row_number() over (partition by run_id, archetype = 'STUDY_STAT' order by score desc, pos) as i from fx_candidates), p as (select *, row_number() over (partition by run_id order by score desc, pos)::int as rank from r where archetype <> 'STUDY_STAT' or i <= 2) select run_id, pos, rank from p where rank <= 5", ("fx_candidates",))
def _(spark, d, c):
    study = F.when(F.col("archetype") == "STUDY_STAT", F.lit(True))
    return triage.capped(c, ["run_id"], [F.desc("score"), "pos"], study, 2, 5).select("run_id", "pos", "rank")


@query("w10_top_scores", "select pos, score from fx_candidates order by score desc, pos limit 20", ("fx_candidates",))
def _(spark, d, c):
    return c.select("pos", "score").orderBy(F.desc("score"), "pos").limit(20)


@query("w13_bounded_batch", "select run_id, pos from (select run_id, pos, row_number() over (partition by run_id order by pos) as r from fx_candidates where score >= 30) where r <= 5", ("fx_candidates",))
def _(spark, d, c):
    return triage.ranked(c.where("score >= 30"), ["run_id"], ["pos"]).where("rank <= 5").select("run_id", "pos")


@query("w14_examples", f", {GATES}, r as (select *, row_number() over (partition by reason order by item_id) as k from g where reason is not null) select reason, item_id from r where k <= 10", ("fx_items",))
def _(spark, d, items):
    return triage.ranked(gated(items).where("reason is not null"), ["reason"], ["item_id"]).where("rank <= 10").select("reason", "item_id")


@query("u02_difference", "select item_id from fx_items where not exists (select 1 from fx_outputs o where o.item_id = fx_items.item_id and virality_score > 45)", ("fx_items", "fx_outputs"))
def _(spark, d, items, outputs):
    return items.join(outputs.where("virality_score > 45"), "item_id", "left_anti").select("item_id")


@query("s19_rejected_feedback", "select feedback_id from fx_feedback f where not exists (select 1 from fx_outputs o where o.output_id = f.output_id)", ("fx_outputs", "fx_feedback"))
def _(spark, d, outputs, feedback):
    return feedback.join(outputs, "output_id", "left_anti").select("feedback_id")


@query("t04_feedback_rollup", "select output_id, count(*) as n, sum(likes)::bigint as likes from fx_feedback group by 1", ("fx_feedback",))
def _(spark, d, feedback):
    return feedback.groupBy("output_id").agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"))


@query("flagship_triage", SCORED + f", u as (select *, row_number() over (partition by {KEY} order by pos) as r from scored), p as (select item_id, category, category_score, row_number() over (partition by category in ('{rules.STUDY_CATEGORIES[0]}', '{rules.STUDY_CATEGORIES[1]}') order by category_score desc, pos) as i, pos from u where r = 1 and length(body_text) >= case when content_type = 'paper' then 600 else 1200 end and {REJECT} is null and category <> 'NONE') select item_id, category, category_score, row_number() over (order by category_score desc, pos)::int as rank from p where category not in ('{rules.STUDY_CATEGORIES[0]}', '{rules.STUDY_CATEGORIES[1]}') or i <= 2 order by rank limit 5", ("fx_items",))
def flagship(spark, d, items):
    kept = triage.first_wins(items, text.url_key("url")).where(triage.short_body().isNull() & triage.hard_reject("title").isNull())
    scored = triage.categorised(kept).where("category <> 'NONE'")
    study = F.when(F.col("category").isin(*rules.STUDY_CATEGORIES), F.lit(True))
    scored = scored.withColumn("_study", study)
    top = triage.ranked(scored.where("_study"), ["_study"], [F.desc("category_score"), "pos"], "_i").where("_i <= 2").drop("_i")
    best = scored.where("_study is null").unionByName(top).orderBy(F.desc("category_score"), "pos").limit(5)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("category_score"), "pos"))).select("item_id", "category", "category_score", "rank")

