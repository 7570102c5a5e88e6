"""Queries of elements, normalisers and gates, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from winnowry.functions import rules, text
from winnowry.operators import elements, gates, triage
from winnowry.plans.queries import KEY, query


def quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def sql_match(col: str, patterns: list[str], group: int = 0) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({col}, {quoted(p)}, {group}), '')" for p in patterns) + ", null)"


def sql_one_of(col: str, found: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({col}, {quoted(w)})" for w in found) + ")"


def sql_strip(col: str, patterns: list[str]) -> str:
    for p in patterns:
        col = f"regexp_replace({col}, {quoted(p)}, '', 'g')"
    return col


WHOLE = "lower(title || ' ' || body_text)"
ARRAYS = {n: "list_concat(" + ", ".join(f"regexp_extract_all({WHOLE}, {quoted(p)}, 1)" for p in ps) + ", [])" for n, ps in rules.ELEMENTS.items()}
ARRAYS = {n: f"list_sort(list_distinct({a}))" if n in rules.DISTINCT else a for n, a in ARRAYS.items()}
FOLDS = ARRAYS.pop("folds")
ARRAYS["times"] = f"list_concat({ARRAYS['times']}, list_transform({FOLDS}, lambda x: x || '-fold'))"


@query("p21_elements", "select item_id, " + ", ".join(f"array_to_string({a}, '|') as {n}" for n, a in ARRAYS.items()) + " from fx_items", ("fx_items",))
def _(spark, d, items):
    whole = text.worded(items.select("item_id", F.concat_ws(" ", "title", "body_text").alias("whole")), "whole")
    return whole.select("item_id", *[F.array_join(c, "|").alias(n) for n, c in elements.extracted("whole", F.col("_low"), F.col("_words")).items()])


@query("p22_properties", "select item_id, " + ", ".join(f"{' or '.join(f'len({ARRAYS[a]}) > 0' for a in found)} as {name}" for name, found in {"has_numbers": ("percentages", "years", "times", "sample_sizes"), "has_time_window": ("time_windows", "years"), "has_comparison": ("equivalents", "versus"), "has_authority": ("authorities",), "has_body_part": ("body_parts",), "has_action": ("verbs", "foods")}.items()) + " from fx_items", ("fx_items",))
def _(spark, d, items):
    items = text.worded(items.select("item_id", F.concat_ws(" ", "title", "body_text").alias("whole")), "whole")
    has = lambda *flags: reduce(lambda a, b: a | b, [triage.said(F.col("_low"), f, rules.FLAGS[f]) for f in flags])
    return items.select("item_id", has("percent", "years", "multiplier", "sample").alias("has_numbers"), has("window", "years").alias("has_time_window"), has("comparison").alias("has_comparison"), has("authority").alias("has_authority"), has("body").alias("has_body_part"), has("verb", "food").alias("has_action"))


def sql_cases(arms: list[tuple[str, str]], rest: str) -> str:
    return "case " + " ".join(f"when {c} then {quoted(v)}" for c, v in arms) + f" else {rest} end"


@query("p04_type_by_source", f"select item_id, case when content_type <> 'news' then content_type else {sql_cases([(sql_one_of('lower(source_name)', w), n) for n, w in rules.TYPES_BY_SOURCE], quoted('news'))} end as kind from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", elements.type_by_source().alias("kind"))


@query("p05_type_by_address", f"select page_id, {sql_cases([(sql_one_of('lower(url)', w), n) for n, w in rules.TYPES_BY_ADDRESS], quoted('news'))} as kind from pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", elements.type_by_address("url").alias("kind"))


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query("p06_route", f"select item_id, case when contains(lower(url), 'pubmed') then 'paper' when {sql_one_of('lower(url)', rules.PREPRINTS)} then 'preprint' when {sql_one_of(f'lower({HOST})', rules.SKIPPED_DOMAINS)} then 'skip' else 'news' end as way from (select item_id, case item_id % 4 when 0 then replace(url, 'example.org', 'nature.com') when 1 then replace(url, 'example.org', 'biorxiv.org') when 2 then replace(url, 'example.org', 'pubmed.org') else url end as url from fx_items)", ("fx_items",))
def _(spark, d, items):
    moved = items.withColumn("url", F.expr("case item_id % 4 when 0 then replace(url, 'example.org', 'nature.com') when 1 then replace(url, 'example.org', 'biorxiv.org') when 2 then replace(url, 'example.org', 'pubmed.org') else url end"))
    return moved.select("item_id", elements.route().alias("way"))


@query("p07_numeric_id", "select item_id, case item_id % 3 when 0 then cast(item_id as varchar) when 1 then cast(item_id as varchar) end as number from fx_items", ("fx_items",))
def _(spark, d, items):
    urls = items.select("item_id", F.expr("case item_id % 3 when 0 then concat('https://pubmed.ncbi.nlm.nih.gov/', item_id, '/') when 1 then concat('https://x.org/?term=', item_id, '[uid]') else url end").alias("url"))
    return urls.select("item_id", elements.numeric_id().alias("number"))


ABSTRACT = "title || case item_id % 5 when 0 then ' A randomised trial of ' || item_id || ' patients' when 1 then ' A systematic review' when 2 then ' A cohort of 1,200 women' when 3 then ' case-control' else '' end"


@query("p08_study_type", f"select item_id, {sql_cases([(sql_one_of('lower(t)', w), n) for n, w in rules.STUDY_TYPES], 'null')} as kind from (select item_id, {ABSTRACT} as t from fx_items)", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", F.expr(ABSTRACT).alias("t")).select("item_id", elements.study_type("t").alias("kind"))


@query("p09_sample_size", f"select item_id, {sql_match('lower(t)', [rules.SAMPLE_SIZE], 1)} as size from (select item_id, {ABSTRACT} as t from fx_items)", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", F.expr(ABSTRACT).alias("t")).select("item_id", elements.sample_size("t").alias("size"))


@query("p15_evaluation_text", "select item_id, left('Title: ' || title || chr(10) || chr(10) || case when content_type = 'paper' then 'Abstract: ' else 'Article: ' end || body_text || case when published_at is null then '' else chr(10) || chr(10) || 'Date: ' || strftime(published_at, '%Y-%m-%d') end, 6000) as asked from fx_items", ("fx_items",))
def _(spark, d, items):
    body = F.concat(F.when(F.col("content_type") == "paper", "Abstract: ").otherwise("Article: "), F.col("body_text"))
    date = F.concat(F.lit("Date: "), F.date_format("published_at", "yyyy-MM-dd"))
    return items.select("item_id", F.left(F.concat_ws("\n\n", F.concat(F.lit("Title: "), F.col("title")), body, date), F.lit(6000)).alias("asked"))


@query("p16_requests", "select item_id, stage, stage || ' for ' || hook || '; numbers: ' || case when number = '' then '(none)' else number end || '; action: ' || coalesce(action, '(none)') as request from fx_spine, (select unnest(['compression', 'slide', 'caption', 'headline', 'image']) as stage)", ("fx_spine",))
def _(spark, d, spine):
    stages = F.explode(F.array(*[F.lit(s) for s in ("compression", "slide", "caption", "headline", "image")])).alias("stage")
    made = spine.select("*", stages)
    return made.select("item_id", "stage", F.concat("stage", F.lit(" for "), "hook", F.lit("; numbers: "), F.coalesce(F.nullif(F.col("number"), F.lit("")), F.lit("(none)")), F.lit("; action: "), F.coalesce("action", F.lit("(none)"))).alias("request"))


RAW = "case item_id % 5 when 0 then 'Guardian Health: ' || lower(title) when 1 then '[Site] ' || title || '...' when 2 then 'RESEARCH - ' || title || '!!' when 3 then 'According to researchers, ' || title else title || ' .. , and more' end"


@query("p18_clean_headline", f"select item_id, regexp_replace(replace(case when regexp_matches(t, '^[a-z]') then upper(left(t, 1)) || substr(t, 2) else t end, '!', '.'), '\\.{{2,}}', '.', 'g') as headline from (select item_id, trim({sql_strip('trim(r)', rules.HEADLINE_PREFIXES)}) as t from (select item_id, {RAW} as r from fx_items))", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", F.expr(RAW).alias("r")).select("item_id", elements.clean_headline("r").alias("headline"))


@query("p19_clean_slide", f"select item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({sql_strip('upper(r)', rules.SLIDE_PREFIXES)}, '!', ''), '\\.{{2,}}|…', ',', 'g'), ',\\s*,', ',', 'g'), '\\s+,', ',', 'g'), '\\s+', ' ', 'g')) as slide from (select item_id, {RAW} as r from fx_items)", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", F.expr(RAW).alias("r")).select("item_id", elements.clean_slide("r").alias("slide"))


CAPTION = "title || ' #health #tips' || case when item_id % 2 = 0 then chr(10) || chr(10) || chr(10) || chr(10) || 'Source: us' else '' end"


@query("p20_clean_caption", f"select item_id, trim(regexp_replace(case when contains(lower(t), 'source:') then t else rtrim(t) || chr(10) || chr(10) || 'Source: ' || source_name || ' - ' || url end, '\\n{{3,}}', chr(10) || chr(10), 'g')) as caption from (select *, regexp_replace({CAPTION}, '#\\w+\\s*', '', 'g') as t from fx_items)", ("fx_items",))
def _(spark, d, items):
    return items.withColumn("c", F.expr(CAPTION)).select("item_id", elements.clean_caption(F.col("c")).alias("caption"))


@query("p27_cosine", "select a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)), 9) as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(after, "vec_id").select("vec_id", F.round(elements.cosine(F.col("v"), F.col("w")), 9).alias("sim"))


SIM = "(item_id % 100) / 100.0"


@query("p30_likeness", f"select item_id, least(greatest(trunc(least(greatest(({SIM}::double - 0.6) * 250, 0), 100) - least(10 * (item_id % 5), 30))::int, 0), 100)::int as score from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", elements.likeness((F.col("item_id") % 100) / F.lit(100.0), F.col("item_id") % 5).alias("score"))


@query("p32_final_score", "select item_id, 0.45::double * (item_id % 101) + 0.35::double * (item_id % 91) + 0.20::double * clarity * 10 as score from fx_spine", ("fx_spine",))
def _(spark, d, spine):
    return spine.select("item_id", elements.final_score(F.col("item_id") % 101, F.col("item_id") % 91, F.col("clarity")).alias("score"))


@query("p33_archetype", "select item_id, " + sql_cases([(f"category = '{k}'", v) for k, v in rules.ARCHETYPES.items()], "'STUDY_STAT'") + " as archetype, coalesce(length(action) > 0, false) as actionable, category in ('" + "', '".join(rules.ACTIONABLE) + "') as actionable_kind from fx_spine", ("fx_spine",))
def _(spark, d, spine):
    return spine.select("item_id", elements.archetype(F.col("category")).alias("archetype"), F.coalesce(F.length("action") > 0, F.lit(False)).alias("actionable"), F.col("category").isin(*rules.ACTIONABLE).alias("actionable_kind"))


@query("p34_legacy_rows", "select item_id, relevant, hook as finding, nullif(number, '') as numbers, " + sql_cases([(f"category = '{k}'", v) for k, v in rules.ARCHETYPES.items()], "'STUDY_STAT'") + " as archetype, clarity * 10 as score from fx_spine", ("fx_spine",))
def _(spark, d, spine):
    return spine.select("item_id", "relevant", F.col("hook").alias("finding"), F.nullif("number", F.lit("")).alias("numbers"), elements.archetype(F.col("category")).alias("archetype"), (F.col("clarity") * 10).alias("score"))


@query("p36_repaired_json", "select event_id, coalesce(nullif(regexp_extract(response, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1), ''), nullif(regexp_extract(response, '(?s)\\{.*\\}'), ''), response) as body from fx_responses", ("fx_responses",))
def _(spark, d, responses):
    return responses.select("event_id", elements.repaired("response").alias("body"))


@query("p39_preview", "select item_id, left(title, 40) as title, left(body_text, 100) as body from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", F.left("title", F.lit(40)).alias("title"), F.left("body_text", F.lit(100)).alias("body"))


@query("p40_plain_items", f"select item_id, {KEY} as url_key, coalesce(case when item_id % 3 = 0 then null else left(body_text, 200) end, '') as body from fx_items", ("fx_items",))
def _(spark, d, items):
    summary = F.when(F.col("item_id") % 3 != 0, F.left("body_text", F.lit(200)))
    return items.select("item_id", text.url_key("url").alias("url_key"), F.coalesce(summary, F.lit("")).alias("body"))


TOLD = "title || case item_id % 11 when 0 then ' Council approves budget cut' when 1 then ' Gen Z spending on boutique gym' when 2 then ' Recalled: batch number X9 of food' when 3 then ' You should demand more, stay informed' else '' end"
for code, name, patterns in (("g08", "admin", rules.ADMIN_LANGUAGE), ("g09", "lifestyle", rules.LIFESTYLE), ("g10", "too_specific", rules.TOO_SPECIFIC), ("g11", "vague", rules.VAGUE)):

    @query(f"{code}_{name}", f"select item_id, {sql_match(f'lower({TOLD})', patterns)} as found from fx_items", ("fx_items",))
    def _(spark, d, items, patterns=patterns):
        return items.withColumn("told", F.expr(TOLD)).select("item_id", gates.detected("told", patterns).alias("found"))


KIND = sql_cases([(f"category = '{k}'", v) for k, v in rules.ARCHETYPES.items()], "'STUDY_STAT'")
NARRATIVE = f"""coalesce(case when clarity < 7 then 'clarity_too_low:' || clarity end, case when emotional_hook = 'none' then 'no_emotional_hook' end, case when {KIND} = 'STUDY_STAT' and number = '' then 'study_without_numbers' end, case when length(why) < 10 then 'no_consequence' end,
 'admin:' || {sql_match('lower(hook)', rules.ADMIN_LANGUAGE)}, 'lifestyle:' || {sql_match('lower(hook)', rules.LIFESTYLE)}, case when not coalesce(length(action) > 0, false) then 'not_actionable' end, case when {KIND} = 'NEWS_POLICY' then 'no_controversy' end, 'too_specific:' || {sql_match('lower(hook)', rules.TOO_SPECIFIC)}, 'vague:' || {sql_match('lower(hook)', rules.VAGUE)})"""


def told(spine):
    numbers = F.when(F.col("number") == "", F.array().cast("array<string>")).otherwise(F.array("number"))
    return spine.withColumn("numbers", numbers).withColumn("actionable", F.coalesce(F.length("action") > 0, F.lit(False)))


@query("g14_narrative", f"select item_id, {NARRATIVE} as reason from fx_spine", ("fx_spine",))
def _(spark, d, spine):
    s = told(spine)
    return s.select("item_id", gates.narrative_fault(s).alias("reason"))


@query("g15_spine", "select item_id, case when not relevant then 'not_relevant' when clarity < 7 then 'clarity_too_low:' || clarity when emotional_hook = 'none' then 'no_emotional_hook' when category in ('STUDY_SHOCK_COMPARISON', 'PARENT_CHILD_BIO') and number = '' then category || '_without_numbers' when length(why) < 10 then 'no_consequence' end as reason from fx_spine", ("fx_spine",))
def _(spark, d, spine):
    return told(spine).select("item_id", gates.spine_fault().alias("reason"))


@query("g16_least_text", "select doc_id from documents where length(text) >= 200")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where(F.length("text") >= 200).select("doc_id")


@query("g02_category_filter", "select item_id from fx_items where contains(lower(content_type), 'press') or contains(lower(source_name), 'source 3')", ("fx_items",))
def _(spark, d, items):
    terms, categories = ("press", "source 3"), F.array("content_type", "source_name")
    return items.where(F.exists(categories, lambda c: elements.one_of(F.lower(c), terms))).select("item_id")


@query("g03_title_keywords", "select item_id from fx_items where contains(lower(title), 'study') or contains(lower(title), 'sleep')", ("fx_items",))
def _(spark, d, items):
    return items.where(elements.one_of(F.lower("title"), ("study", "sleep"))).select("item_id")


@query("g19_slide_valid", f"select item_id, length(t) >= 30 and upper(t) = t and (regexp_matches(t, '[0-9]') or {sql_one_of('t', rules.SLIDE_COMPARISONS)} or {sql_one_of('t', rules.SLIDE_TIMES)}) and not contains(left(t, 30), ':') as valid from (select item_id, case when item_id % 4 = 0 then title when item_id % 4 = 1 then 'NOTE: ' || upper(title) else upper(title) end as t from fx_items)", ("fx_items",))
def _(spark, d, items):
    shown = items.select("item_id", F.expr("case when item_id % 4 = 0 then title when item_id % 4 = 1 then concat('NOTE: ', upper(title)) else upper(title) end").alias("t"))
    return shown.select("item_id", gates.slide_valid("t").alias("valid"))


EVIDENCE = f"""e as (select item_id, hook, case when number <> '' then number else {sql_match('lower(hook)', rules.FOUND_NUMBER)} end as number, case when length(population) > 3 then population when item_id % 10 = 1 then 'n=' || item_id end as population, case when length(time_window) > 3 then time_window else {sql_match('lower(hook)', rules.FOUND_TIME, 1)} end as time, {sql_match('lower(hook)', rules.FOUND_COMPARISON, 1)} as comparison from fx_spine) """


def evident(spine):
    s = told(spine).withColumn("sample", F.when(F.col("item_id") % 10 == 1, F.col("item_id").cast("string")).otherwise(""))
    return s.select("item_id", *[c.alias(n) for n, c in gates.evidence("hook", "numbers", "population", "sample", "time_window").items()])


@query("g21_evidence", ", " + EVIDENCE + "select item_id, number, population, time, comparison, (number is not null)::int + (population is not null)::int + (time is not null)::int + (comparison is not null)::int >= 2 as passed from e", ("fx_spine",))
def _(spark, d, spine):
    kinds = ("number", "population", "time", "comparison")
    return evident(spine).withColumn("passed", sum(F.col(k).isNotNull().cast("int") for k in kinds) >= 2)


@query("p38_evidence_summary", ", " + EVIDENCE + "select item_id, coalesce(nullif(concat_ws(' | ', 'number: ' || number, 'population: ' || population, 'time: ' || time, 'comparison: ' || comparison), ''), 'none') as summary from e", ("fx_spine",))
def _(spark, d, spine):
    return evident(spine).select("item_id", gates.differentiator_summary({k: F.col(k) for k in ("number", "population", "time", "comparison")}).alias("summary"))


@query("g23_headline_evidence", "select item_id, number <> '' or population <> '' or time_window <> '' as may, (number <> '' and contains(lower(hook), number)) or (population <> '' and contains(lower(hook), population)) or (time_window <> '' and contains(lower(hook), time_window)) or regexp_matches(hook, '[0-9]') as shares from fx_spine", ("fx_spine",))
def _(spark, d, spine):
    s = told(spine).withColumn("population", F.nullif("population", F.lit(""))).withColumn("time_window", F.nullif("time_window", F.lit("")))
    may = (F.size("numbers") > 0) | F.col("population").isNotNull() | F.col("time_window").isNotNull()
    return s.select("item_id", may.alias("may"), gates.shares_evidence("hook", "numbers", "population", "time_window").alias("shares"))


@query("g26_final_threshold", f"select item_id, {SIM}::double >= 0.78 or item_id % 101 >= 50 as passes, {SIM}::double >= 0.78 or item_id % 101 >= 60 as own from fx_items", ("fx_items",))
def _(spark, d, items):
    sim, score = (F.col("item_id") % 100) / F.lit(100.0), F.col("item_id") % 101
    return items.select("item_id", ((sim >= 0.78) | (score >= 50)).alias("passes"), ((sim >= 0.78) | (score >= 60)).alias("own"))


@query("g27_relevant_spines", "select item_id, case when not coalesce(relevant, false) then 'extraction_failed' end as reason from fx_spine", ("fx_spine",))
def _(spark, d, spine):
    return spine.select("item_id", F.when(~F.coalesce("relevant", F.lit(False)), "extraction_failed").alias("reason"))


@query("g28_combined_filter", f", g as (select item_id, split_part({NARRATIVE}, ':', 1) as reason from fx_spine), r as (select *, row_number() over (partition by reason order by item_id) as k from g) select coalesce(reason, 'passed') as reason, count(*) as n, string_agg(case when k <= 10 then cast(item_id as varchar) end, ',' order by item_id) as examples from r group by 1", ("fx_spine",))
def _(spark, d, spine):
    s = told(spine)
    marked = s.select("item_id", F.split_part(gates.narrative_fault(s), F.lit(":"), F.lit(1)).alias("reason"))
    ranked = triage.ranked(marked, ["reason"], ["item_id"])
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.col("item_id"))))
    return ranked.groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.array_join(first, ",").alias("examples"))


@query("g29_usable", "select item_id, coalesce(length(c) > 20, false) as caption, c is not null as slide from (select item_id, case when item_id % 3 = 0 then null when item_id % 3 = 1 then left(title, 20) else title end as c from fx_items)", ("fx_items",))
def _(spark, d, items):
    c = F.when(F.col("item_id") % 3 == 1, F.left("title", F.lit(20))).when(F.col("item_id") % 3 == 2, F.col("title"))
    return items.select("item_id", F.coalesce(F.length(c) > 20, F.lit(False)).alias("caption"), c.isNotNull().alias("slide"))


