"""Queries that write: exports, facts, ledgers and caches, each read back from where it was written, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowry.operators import exports, triage
from winnowry.plans.queries import query
from winnowry.sources import tables

AS_OF = "timestamp '1998-09-01'"
NOW = "1998-09-01T00:00:00+00:00"
ISO = "coalesce(strftime({}, '%Y-%m-%dT%H:%M:%S') || '+00:00', '')"
BLANKS = ", ".join(f"'' as {c}" for c in exports.FEEDBACK_COLUMNS)


def lists(rows):
    """The rows with their lists, which the view holds as one text each."""
    split = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))
    return rows.select("*", *[split(f"{a}_text").alias(b) for a, b in (("numbers", "numbers"), ("layout", "layout_notes"), ("highlight", "highlight_words"), ("reasons", "reasons"))])


def through(spark, df, name, parts):
    """``df`` appended batch by batch to a new table, the first batch twice, and read back."""
    path = tables.scratch(spark, name)
    for batch, part in (parts[0], *parts):
        tables.append(part, path, batch)
    return tables.appended(spark, path, df.schema).drop(tables.BATCH)


def halves(df, key="item_id"):
    """Two batches, all rows between them."""
    return [("first", df.where(F.col(key) % 2 == 0)), ("second", df.where(F.col(key) % 2 != 0))]


def exported(spark, rows, layout, name):
    rows = lists(rows)
    made = layout(rows, F.expr(AS_OF))
    return through(spark, made, name, [(batch, layout(part, F.expr(AS_OF))) for batch, part in halves(rows)])


HEAD = f"'{NOW}' as run_timestamp_utc, source_name, url as source_url, {ISO.format('published_at')} as published_at"


@query("s13_export_rows", f"select {HEAD}, credibility_tier, content_type, image_headline, caption, category as primitive, likeness as viral_likeness_score, category_score as primitive_score, round_even(final_score, 2)::double as final_score, hook, coalesce(action, '') as action, coalesce(outcome, '') as outcome, replace(numbers_text, '|', ', ') as numbers, coalesce(time_window, '') as time_window, coalesce(who, '') as who_it_applies_to, clarity as standalone_clarity, tone, emotional_hook, support_level, 'NEW' as status, {BLANKS} from fx_export", ("fx_export",))
def _(spark, d, rows):
    return exported(spark, rows, exports.third, "third")


@query("s14_export_rows_second", f"select {HEAD}, credibility_tier, content_type, hook, coalesce(who, '') as who_it_applies_to, coalesce(time_window, '') as time_window, replace(numbers_text, '|', ', ') as key_numbers, coalesce(mechanism, '') as mechanism_or_why, why as real_world_consequence, image_headline, archetype, clarity as standalone_clarity_score, emotional_hook, support_level, coalesce(image_suggestion, '') as image_suggestion, replace(layout_text, '|', ' | ') as layout_notes, replace(highlight_text, '|', ', ') as highlight_words, 'NEW' as status, {BLANKS} from fx_export", ("fx_export",))
def _(spark, d, rows):
    return exported(spark, rows, exports.second, "second")


FIRST = f"select '{NOW}' as run_timestamp_utc, coalesce(archetype, '') as archetype, source_name, url as source_url, {ISO.format('published_at')} as published_at, coalesce(nullif(finding, ''), nullif(claim, ''), '') as extracted_claim, coalesce(virality_score, 0) as virality_score, coalesce(round_even(confidence, 2)::double, 0) as confidence, image_headline, coalesce(image_suggestion, '') as image_suggestion, replace(reasons_text, '|', ' • ') as why_it_will_work, 'NEW' as status, coalesce(who, '') as population, coalesce(time_window, '') as time_window, coalesce(study_type, '') as study_type, replace(numbers_text, '|', ', ') as must_include_numbers, {BLANKS} from fx_export"


@query("s15_export_rows_first", FIRST, ("fx_export",))
def _(spark, d, rows):
    return exported(spark, rows.withColumnRenamed("who", "population"), exports.first, "first")


CSV_ROWS = ", o as (select pos as output_id, item_id + item_id % 2 as item_id, run_id, coalesce(published_at, timestamp '1998-08-30') as created_at, coalesce(archetype, 'NONE') as archetype, image_headline, image_suggestion, virality_score, confidence, nullif(finding, '') as extracted_claim from fx_export)"


@query("s16_csv_rows", f"{CSV_ROWS} select output_id as id, run_id, {ISO.format('o.created_at')} as created_at, o.archetype, o.image_headline as headline, nullif(coalesce(o.image_suggestion, ''), '') as image_suggestion, coalesce(o.virality_score, 0) as virality_score, coalesce(round_even(o.confidence, 2)::double, 0) as confidence, nullif(coalesce(extracted_claim, ''), '') as extracted_claim, nullif(coalesce(i.source_name, ''), '') as source_name, nullif(coalesce(i.url, ''), '') as source_url, 'NEW' as status from o left join fx_items i using (item_id) where o.created_at >= {AS_OF} - interval 7 day", ("fx_export", "fx_items"))
def _(spark, d, rows, items):
    """Outputs of seven days, newest first, as CSV; read back, empty cells are null."""
    outputs = rows.select(F.col("pos").alias("output_id"), (F.col("item_id") + F.col("item_id") % 2).alias("item_id"), "run_id", F.coalesce("published_at", F.expr("timestamp '1998-08-30'")).alias("created_at"), F.coalesce("archetype", F.lit("NONE")).alias("archetype"), F.col("image_headline").alias("headline"), "image_suggestion", "virality_score", "confidence", F.nullif("finding", F.lit("")).alias("extracted_claim"), F.lit("NEW").alias("status"))
    made = exports.csv_rows(outputs.where(F.col("created_at") >= F.expr(f"{AS_OF} - interval 7 days")), items)
    path = tables.scratch(spark, "csv")
    tables.write_csv(made, path, [F.desc("created_at"), "id"])
    return tables.read_csv(spark, path, made.schema)


@query("s17_last_rows", f"select * exclude (item_id) from (select item_id, {FIRST.removeprefix('select ')}) order by item_id desc limit 50", ("fx_export",))
def _(spark, d, rows):
    """The fifty last rows of an exported table; cells that a short row lacks are empty."""
    made = exports.first(lists(rows.withColumnRenamed("who", "population")), F.expr(AS_OF), keep=("item_id",))
    short = made.select("item_id", *[F.nullif(c, F.lit("")).alias(c) if c in exports.FEEDBACK_COLUMNS else c for c in exports.FIRST])
    back = through(spark, short, "last", halves(short))
    return exports.last_rows(back, [F.desc("item_id")]).drop("item_id")


@query("s10_corpus_snapshot", "select distinct title as headline, trim(regexp_replace(regexp_replace(regexp_replace(upper(title), '\\.\\.+|…', '...', 'g'), '[^\\p{L}\\p{N}_\\s.\\-]', '', 'g'), '\\s+', ' ', 'g')) as normalized, substr(sha256(title), 1, 32) as headline_hash, timestamp '1998-09-01' as cached_at from fx_items", ("fx_items",))
def _(spark, d, items):
    """The corpus as the second version of a snapshot whose first had half of it."""
    corpus = exports.reference_headlines(items.select(F.col("title").alias("headline")), F.expr(AS_OF))
    path = tables.scratch(spark, "corpus")
    tables.replace(corpus.where("headline_hash < '8'"), path)
    tables.replace(corpus, path)
    return tables.current(spark, path, corpus.schema)


FEEDBACK = "select feedback_id, output_id, likes::bigint as likes, shares, case when feedback_id % 3 = 0 then null else feedback_id % 50 end as saves, case when feedback_id % 4 = 0 then 'seen ' || feedback_id end as notes, recorded_at from fx_feedback"


@query("s18_feedback_view", f", f as ({FEEDBACK}) select o.output_id, arg_max(likes, (recorded_at, feedback_id)) filter (likes is not null) as feedback_likes, arg_max(shares, (recorded_at, feedback_id)) filter (shares is not null) as feedback_shares, arg_max(saves, (recorded_at, feedback_id)) filter (saves is not null) as feedback_saves, arg_max(notes, (recorded_at, feedback_id)) filter (notes is not null) as feedback_notes, case when count(feedback_id) > 0 then 'FEEDBACK' else min(status_code) end as status from fx_outputs o left join f using (output_id) group by 1", ("fx_outputs", "fx_feedback"))
def _(spark, d, outputs, feedback):
    """Feedback appended in two batches, one of them twice, and the outputs' present state."""
    told = feedback.select("feedback_id", "output_id", "likes", "shares", F.when(F.col("feedback_id") % 3 != 0, F.col("feedback_id") % 50).alias("saves"), F.when(F.col("feedback_id") % 4 == 0, F.concat(F.lit("seen "), "feedback_id")).alias("notes"), "recorded_at")
    held = through(spark, told, "feedback", halves(told, "feedback_id"))
    now = outputs.groupBy("output_id").agg(F.min("status_code").alias("status"))
    return exports.with_feedback(now, held)


RUNS = "select user_id as run_id, ts as event_at, event_id as seq, case when event_type in ('purchase', 'error') then case event_type when 'purchase' then 'SUCCESS' else 'FAILED' end else 'RUNNING' end as status, (event_id % 100)::int as items_fetched, (event_id % 50)::int as items_evaluated, (event_id % 6)::int as items_output, case when event_type = 'error' then 'stopped at ' || event_id end as error_message from events"


@query("s20_run_ledger", f"with e as ({RUNS}) select run_id, min(event_at) as started_at, max(event_at) filter (status <> 'RUNNING') as completed_at, coalesce(arg_max(status, (event_at, seq)) filter (status <> 'RUNNING'), 'RUNNING') as status, coalesce(arg_max(items_fetched, (event_at, seq)) filter (status <> 'RUNNING'), 0) as items_fetched, coalesce(arg_max(items_evaluated, (event_at, seq)) filter (status <> 'RUNNING'), 0) as items_evaluated, coalesce(arg_max(items_output, (event_at, seq)) filter (status <> 'RUNNING'), 0) as items_output, arg_max(coalesce(error_message, ''), (event_at, seq)) filter (status <> 'RUNNING') as error_message from e group by 1")
def _(spark, d):
    """Start and end events of runs, appended, and each run's state."""
    status = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING")
    counter = lambda n, c: (F.col("event_id") % n).cast("int").alias(c)
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("ts").alias("event_at"), F.col("event_id").alias("seq"), status.alias("status"), counter(100, "items_fetched"), counter(50, "items_evaluated"), counter(6, "items_output"), F.when(F.col("event_type") == "error", F.concat(F.lit("stopped at "), "event_id")).otherwise("").alias("error_message"))
    return exports.ledger(through(spark, events, "runs", halves(events, "seq")))


@query("s21_cluster_cache", "with c as (select label as cluster_id, list(m order by i) as c, max(n) as n from (select label, i, avg(embedding[i]::double) as m, count(*) as n from embeddings, range(1, 65) r(i) group by 1, 2) group by 1) select e.vec_id::varchar as headline, len(e.embedding)::int as dims, e.label as cluster_id, c.n as headline_count, round(list_sum(c.c), 6) as centroid_sum from embeddings e join c on e.label = c.cluster_id")
def _(spark, d):
    """Vectors and clusters attached to a cached corpus, which is rewritten from itself, and the clusters counted anew."""
    found = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("headline"), F.col("embedding").alias("vector"), F.col("label").alias("cluster_id"))
    path = tables.scratch(spark, "winners")
    bare = found.select("headline", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("int").alias("cluster_id"))
    tables.replace(bare, path)
    tables.replace(exports.with_vectors(tables.current(spark, path, bare.schema), found), path, bare.schema)
    corpus = tables.current(spark, path, bare.schema)
    counted = exports.clusters(corpus).select(F.col("cluster_id").alias("_c"), "headline_count", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("centroid_sum"))
    return corpus.join(counted, F.col("cluster_id") == F.col("_c")).select("headline", F.size("vector").alias("dims"), "cluster_id", "headline_count", "centroid_sum")


@query("s24_facts", "select 'output' as kind, run_id || '-' || pos as output_id, item_id, image_headline as told, archetype, clarity as virality_score, layout_text as listed, source_name || '|' || url || '|' || coalesce(who, '') || '|' || support_level || '|' || credibility_tier as source from fx_export where relevant union all select 'evaluation', null, item_id, coalesce(nullif(finding, ''), claim), archetype, virality_score, reasons_text, coalesce(relevance_reason, '') from fx_export", ("fx_export",))
def _(spark, d, rows):
    """Evaluations of all items and outputs of relevant ones, appended to their tables."""
    rows = lists(rows)
    facts = exports.output_facts(rows.where("relevant"))
    evaluated = exports.evaluation_facts(rows)
    outputs = through(spark, facts, "outputs", halves(facts))
    evaluations = through(spark, evaluated, "evaluations", halves(evaluated))
    source = F.concat_ws("|", "sources.source_name", "sources.url", F.coalesce("sources.population", F.lit("")), "sources.support_level", "sources.credibility_tier")
    a = outputs.select(F.lit("output").alias("kind"), "output_id", "item_id", F.col("headline").alias("told"), "archetype", "virality_score", F.array_join("layout_notes", "|").alias("listed"), source.alias("source"))
    return a.unionByName(evaluations.select(F.lit("evaluation").alias("kind"), F.lit(None).cast("string").alias("output_id"), "item_id", F.col("extracted_claim").alias("told"), F.col("suggested_archetype").alias("archetype"), "virality_score", F.array_join("why_it_will_work", "|").alias("listed"), F.coalesce("relevance_reason", F.lit("")).alias("source")))


@query("j14_append_recent", "select vec_id, vec_id % 5 <> 0 as fresh, len(embedding)::int as dims from embeddings")
def _(spark, d):
    """Keys and vectors of a run appended to those of the past."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", (F.col("vec_id") % 5 != 0).alias("fresh"))
    return through(spark, v, "recent", [("past", v.where("not fresh")), ("run", v.where("fresh"))]).select("vec_id", "fresh", F.size("embedding").alias("dims"))


@query("j15_attach_vector", "select vec_id, array_to_string(list_transform(embedding, lambda x: floor(1000 * x::double * case when vec_id % 3 = 0 then 2 else 1 end)::bigint::varchar), ',') as vector from embeddings")
def _(spark, d):
    """The vectors of a third of the items attached anew, the last of two for each; items rewritten as the next version."""
    items = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    path = tables.scratch(spark, "items")
    tables.replace(items, path)
    held = tables.current(spark, path, items.schema)
    told = held.where("item_id % 3 = 0").select("item_id", F.transform("vector", lambda x: 2 * x).alias("vector"), F.lit(2).alias("seq"))
    tables.replace(exports.attached(held, told.unionByName(held.where("item_id % 3 = 0").withColumn("seq", F.lit(1)))), path)
    return tables.current(spark, path, items.schema).select(F.col("item_id").alias("vec_id"), F.array_join(F.transform("vector", lambda x: F.floor(1000 * x).cast("string")), ",").alias("vector"))
