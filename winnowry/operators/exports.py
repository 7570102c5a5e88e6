"""Rows as they are exported, and the facts of runs: evaluations, outputs, feedback, ledgers, reference headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.functions.text import headline_key
from winnowry.operators.triage import ranked

# The columns of the three layouts, in their order.
FEEDBACK_COLUMNS = ("feedback_likes", "feedback_shares", "feedback_saves", "feedback_notes")
THIRD = ("run_timestamp_utc", "source_name", "source_url", "published_at", "credibility_tier", "content_type", "image_headline", "caption", "primitive", "viral_likeness_score", "primitive_score", "final_score", "hook", "action", "outcome", "numbers", "time_window", "who_it_applies_to", "standalone_clarity", "tone", "emotional_hook", "support_level", "status", *FEEDBACK_COLUMNS)
SECOND = ("run_timestamp_utc", "source_name", "source_url", "published_at", "credibility_tier", "content_type", "hook", "who_it_applies_to", "time_window", "key_numbers", "mechanism_or_why", "real_world_consequence", "image_headline", "archetype", "standalone_clarity_score", "emotional_hook", "support_level", "image_suggestion", "layout_notes", "highlight_words", "status", *FEEDBACK_COLUMNS)
FIRST = ("run_timestamp_utc", "archetype", "source_name", "source_url", "published_at", "extracted_claim", "virality_score", "confidence", "image_headline", "image_suggestion", "why_it_will_work", "status", "population", "time_window", "study_type", "must_include_numbers", *FEEDBACK_COLUMNS)
CSV = ("id", "run_id", "created_at", "archetype", "headline", "image_suggestion", "virality_score", "confidence", "extracted_claim", "source_name", "source_url", "status")


def iso(at: Column) -> Column:
    """As ISO 8601 in UTC; "" without a date."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit(""))


def blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def joined(name: str, glue: str) -> Column:
    return F.coalesce(F.array_join(name, glue), F.lit(""))


def layout(rows: DataFrame, names: tuple[str, ...], made: dict[str, Column], as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns to keep and the layout's: made ones, and those that all layouts share."""
    shared = {"run_timestamp_utc": iso(as_of), "source_name": blank("source_name"), "source_url": F.col("url"), "published_at": iso(F.col("published_at")), "status": F.lit("NEW")} | {c: F.lit("") for c in FEEDBACK_COLUMNS}
    return rows.select(*keep, *[(shared | made).get(n, F.col(n) if n in rows.columns else F.lit("")).alias(n) for n in names])


def third(rows: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """27 columns of items with their narrative, headline, caption and scores."""
    made = {n: blank(n) for n in ("action", "outcome", "time_window")} | {"who_it_applies_to": blank("who"), "primitive": F.col("category"), "viral_likeness_score": F.col("likeness"), "primitive_score": F.col("category_score"), "final_score": F.bround("final_score", 2).cast("double"), "numbers": joined("numbers", ", "), "standalone_clarity": F.col("clarity")}
    return layout(rows, THIRD, made, as_of, keep)


def second(rows: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """25 columns of items with their narrative and compressed story."""
    made = {"who_it_applies_to": blank("who"), "time_window": blank("time_window"), "key_numbers": joined("numbers", ", "), "mechanism_or_why": blank("mechanism"), "real_world_consequence": blank("why"), "standalone_clarity_score": F.col("clarity"), "image_suggestion": blank("image_suggestion"), "layout_notes": joined("layout_notes", " | "), "highlight_words": joined("highlight_words", ", ")}
    return layout(rows, SECOND, made, as_of, keep)


def first(rows: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """20 columns of items with their evaluation; empty strings count as missing."""
    claim = F.coalesce(F.nullif("finding", F.lit("")), F.nullif("claim", F.lit("")), F.lit(""))
    made = {n: blank(n) for n in ("archetype", "population", "time_window", "study_type", "image_headline", "image_suggestion")} | {"extracted_claim": claim, "virality_score": F.coalesce("virality_score", F.lit(0)), "confidence": F.coalesce(F.bround("confidence", 2).cast("double"), F.lit(0.0)), "why_it_will_work": joined("reasons", " • "), "must_include_numbers": joined("numbers", ", ")}
    return layout(rows, FIRST, made, as_of, keep)


def csv_rows(outputs: DataFrame, items: DataFrame) -> DataFrame:
    """Outputs with their items' source and address; "" and 0 where something is missing."""
    held = items.select(F.col("item_id").alias("_item"), F.col("source_name").alias("_source"), F.col("url").alias("_url"))
    made = {"id": F.col("output_id"), "created_at": iso(F.col("created_at")), "image_suggestion": blank("image_suggestion"), "virality_score": F.coalesce("virality_score", F.lit(0)), "confidence": F.coalesce(F.bround("confidence", 2).cast("double"), F.lit(0.0)), "extracted_claim": blank("extracted_claim"), "source_name": blank("_source"), "source_url": blank("_url")}
    return outputs.join(held, F.col("item_id") == F.col("_item"), "left").select(*[made.get(n, F.col(n) if n not in made else None).alias(n) for n in CSV])


def last_rows(exported: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """The n last rows, most recent first; missing cells are ""."""
    return exported.orderBy(*order).limit(n).na.fill("")


def output_facts(picked: DataFrame) -> DataFrame:
    """Outputs as they are stored: ids of run and place, lists, and what is known of the source as one struct."""
    source = F.struct("source_name", "url", "title", F.col("who").alias("population"), "time_window", "emotional_hook", "support_level", "credibility_tier")
    return picked.select(F.concat_ws("-", "run_id", F.col("pos").cast("string")).alias("output_id"), "run_id", "item_id", F.col("image_headline").alias("headline"), "archetype", "image_suggestion", "layout_notes", "highlight_words", F.col("hook").alias("extracted_claim"), F.col("clarity").alias("virality_score"), F.lit(0.8).alias("confidence"), F.array("why").alias("why_it_will_work"), source.alias("sources"), F.lit("NEW").alias("status"))


def evaluation_facts(evaluated: DataFrame) -> DataFrame:
    """Evaluations as they are stored."""
    return evaluated.select("item_id", "relevant", "relevance_reason", "virality_score", "confidence", F.col("archetype").alias("suggested_archetype"), F.coalesce(F.nullif("finding", F.lit("")), "claim").alias("extracted_claim"), F.col("reasons").alias("why_it_will_work"), F.col("numbers").alias("must_include_numbers"))


def with_feedback(outputs: DataFrame, feedback: DataFrame, metrics: tuple[str, ...] = ("likes", "shares", "saves", "notes")) -> DataFrame:
    """Outputs with the latest value of each metric that was told, and the status FEEDBACK where any feedback came; absent metrics leave earlier values."""
    at = F.struct("recorded_at", "feedback_id")
    found = feedback.groupBy(F.col("output_id").alias("_of")).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), at)).alias(f"feedback_{m}") for m in metrics])
    return outputs.join(found, F.col("output_id") == F.col("_of"), "left").withColumn("status", F.when(F.col("_of").isNotNull(), "FEEDBACK").otherwise(F.col("status"))).drop("_of")


def ledger(events: DataFrame) -> DataFrame:
    """State of each run from its events (run_id, event_at, seq, status, and counters that only the completion tells): RUNNING until it is completed."""
    end = F.when(F.col("status") != "RUNNING", F.struct("event_at", "seq"))
    counters = ("items_fetched", "items_evaluated", "items_output")
    done = [F.coalesce(F.max_by(c, end), F.lit(0)).alias(c) for c in counters]
    return events.groupBy("run_id").agg(F.min("event_at").alias("started_at"), F.max(F.when(F.col("status") != "RUNNING", F.col("event_at"))).alias("completed_at"), F.coalesce(F.max_by("status", end), F.lit("RUNNING")).alias("status"), *done, F.max_by("error_message", end).alias("error_message"))


def reference_headlines(corpus: DataFrame, cached_at: Column) -> DataFrame:
    """Each headline once, with its normal form and the first 32 digits of its hash."""
    return corpus.select("headline").distinct().select("headline", headline_key("headline").alias("normalized"), F.substring(F.sha2("headline", 256), 1, 32).alias("headline_hash"), cached_at.alias("cached_at"))


def with_vectors(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """Corpus rows with the vector and the cluster found for their headline; those without keep what they have. vectors: (headline, vector, cluster_id), one a headline."""
    new = vectors.select(F.col("headline").alias("_h"), F.col("vector").alias("_v"), F.col("cluster_id").alias("_c"))
    joined_ = corpus.join(new, F.col("headline") == F.col("_h"), "left")
    return joined_.withColumn("vector", F.coalesce("_v", "vector")).withColumn("cluster_id", F.coalesce("_c", "cluster_id")).drop("_h", "_v", "_c")


def clusters(corpus: DataFrame) -> DataFrame:
    """(cluster_id, centroid, headline_count) of the rows that have a vector; means by place."""
    known = corpus.where("vector is not null and cluster_id is not null")
    means = known.select("cluster_id", F.posexplode("vector").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("headline_count"))


def attached(items: DataFrame, vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """Items with the new vector of their id, or their own. vectors: (key, vector); the last of an id by ``seq`` where there are several."""
    last = ranked(vectors, [key], [F.desc("seq")]).where("rank = 1").select(F.col(key).alias("_of"), F.col("vector").alias("_new"))
    return items.join(last, F.col(key) == F.col("_of"), "left").withColumn("vector", F.coalesce("_new", "vector")).drop("_of", "_new")
