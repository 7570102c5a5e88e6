"""Landed model responses as rows: repaired, read and held to what each field may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the fields of an evaluation and of a narrative may say.
ARCHETYPES = ("NEWS_POLICY", "STUDY_STAT", "WARNING_RISK", "SIMPLE_HABIT", "IF_THEN", "COUNTERINTUITIVE", "HUMAN_INTEREST")
STUDY_TYPES = ("RCT", "observational", "meta_analysis", "review", "policy", "news", "other")
CATEGORIES = ("STUDY_SHOCK_COMPARISON", "SIMPLE_HACK_PAIN_RELIEF", "FOOD_SYMPTOM_BENEFIT", "PARENT_CHILD_BIO", "AUTHORITY_CLASSIFICATION", "CULTURE_CONTROVERSY", "TIME_REVERSAL", "BODY_PART_SPECIFIC", "NONE")
TONES = ("shock", "awe", "concern", "warmth", "humor")
HOOKS = ("fear", "hope", "surprise", "validation", "curiosity", "outrage", "none")
SUPPORT = ("strong", "moderate", "emerging", "preliminary")

EVALUATION = "relevant boolean, rejection_reason string, reason string, study_type string, population string, sample_size string, time_window string, primary_outcome string, most_surprising_finding string, extracted_claim string, must_include_numbers array<string>, suggested_archetype string, virality_score string, confidence string, why_it_will_work array<string>, _bad string"
NARRATIVE = "relevant boolean, rejection_reason string, primitive string, hook string, action string, outcome string, numbers array<string>, time_window string, who_it_applies_to string, mechanism_clause string, why_it_matters string, standalone_clarity int, tone string, emotional_hook string, support_level string, extraction_notes string, _bad string"
#: Narrative fields without which a response does not count.
REQUIRED = ("relevant", "primitive", "hook", "mechanism_clause", "why_it_matters", "standalone_clarity", "tone", "emotional_hook", "support_level")


def candidates(text: Column) -> list[Column]:
    """Where the JSON may be: all of the response, a fenced block, from the first brace to the last."""
    part = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    return [text, part(r"(?s)```(?:json)?\s*(.*?)\s*```", 1), part(r"(?s)\{.*\}", 0)]


def read(text: Column, schema: str) -> Column:
    """The first candidate that is a JSON object, as a struct; null if none is."""
    tried = []
    for c in candidates(text):
        value = F.from_json(c, schema, {"columnNameOfCorruptRecord": "_bad"})
        tried.append(F.when(F.ltrim(c).startswith("{") & value["_bad"].isNull(), value))
    return F.coalesce(*tried)


def told(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def evaluations(responses: DataFrame, response: str = "response") -> DataFrame:
    """The rows with evaluation, a struct of all its fields.

    What can't be read is not relevant, for json_parse_error. Rows that are not relevant keep their reason alone. Unknown archetypes count as
    STUDY_STAT and unknown study types as other; scores are cut to whole numbers from 0 to 100, confidence to 0 to 1; the claim falls back on the finding.
    """
    r = F.col("_read")
    relevant = F.coalesce(r["relevant"], F.lit(False))
    reason = F.coalesce(told(r["rejection_reason"]), r["reason"], F.lit("No reason provided"))
    only = lambda c: F.when(relevant, c)
    known = lambda c, values, rest: F.when(told(c).isNull(), c).when(c.isin(*values), c).otherwise(rest)
    number = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    score, confidence = r["virality_score"].try_cast("double"), r["confidence"].try_cast("double")
    lists = lambda c: F.when(relevant, F.coalesce(c, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    fields = {
        "relevant": relevant,
        "reason": F.when(r.isNull(), "Failed to parse response").when(relevant & (reason == "No reason provided"), "Content is relevant").otherwise(reason),
        "rejection_reason": F.when(r.isNull(), "json_parse_error").when(~relevant, reason),
        "study_type": only(known(r["study_type"], STUDY_TYPES, "other")),
        **{c: only(r[c]) for c in ("population", "sample_size", "time_window", "primary_outcome", "most_surprising_finding")},
        "extracted_claim": only(F.coalesce(told(r["extracted_claim"]), r["most_surprising_finding"])),
        "must_include_numbers": lists(r["must_include_numbers"]),
        "suggested_archetype": only(known(r["suggested_archetype"], ARCHETYPES, "STUDY_STAT")),
        "virality_score": only(F.when(score.isNotNull(), number(score.cast("int"), 0, 100))),
        "confidence": only(F.when(confidence.isNotNull(), number(confidence, 0.0, 1.0))),
        "why_it_will_work": lists(r["why_it_will_work"]),
    }
    return responses.withColumn("_read", read(F.col(response), EVALUATION)).withColumn("evaluation", F.struct(*[c.alias(n) for n, c in fields.items()])).drop("_read")


def enough_evidence(evaluation: str = "evaluation") -> Column:
    """Two of four: numbers, a population and a time window of more than three characters, a sample size."""
    e = F.col(evaluation)
    held = [F.size(e["must_include_numbers"]) > 0, F.length(e["population"]) > 3, F.length(e["time_window"]) > 3, F.length(e["sample_size"]) > 0]
    return sum(F.coalesce(h, F.lit(False)).cast("int") for h in held) >= 2


def promising(rows: DataFrame, least: int = 40, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Relevant rows of at least that score, best first."""
    score = F.col("evaluation.virality_score")
    return rows.where(F.col("evaluation.relevant") & (score >= least)).orderBy(F.desc("evaluation.virality_score"), *order)


def narratives(responses: DataFrame, response: str = "response") -> tuple[DataFrame, DataFrame]:
    """Accepted rows with spine, and rejected ones with fault: unreadable, or the first field that is missing or out of range."""
    s = F.col("spine")
    allowed = {"primitive": CATEGORIES, "tone": TONES, "emotional_hook": HOOKS, "support_level": SUPPORT}
    missing = [F.when(s[c].isNull(), f"missing:{c}") for c in REQUIRED]
    wrong = [F.when(~s[c].isin(*values), F.concat(F.lit(f"{c}:"), s[c])) for c, values in allowed.items()]
    clarity = F.when(~s["standalone_clarity"].between(0, 10), F.concat(F.lit("standalone_clarity:"), s["standalone_clarity"].cast("string")))
    whole = s.dropFields("_bad").withField("numbers", F.coalesce(s["numbers"], F.array().cast("array<string>"))).withField("extraction_notes", F.coalesce(s["extraction_notes"], F.lit("")))
    marked = responses.withColumn("spine", read(F.col(response), NARRATIVE)).withColumn("fault", F.coalesce(F.when(s.isNull(), "unreadable"), *missing, *wrong, clarity))
    return marked.where("fault is null").withColumn("spine", whole).drop("fault"), marked.where("fault is not null").drop("spine")


def latest_outputs(outputs: DataFrame, items: DataFrame, feedback: DataFrame, as_of: Column | None = None, days: int = 7, limit: int | None = None) -> DataFrame:
    """Outputs, newest first, with their source and their feedback as a list, oldest first: all of them, or those of ``days`` before ``as_of``, or the first ``limit``.

    Feedback is gathered by output before it meets them; where only some outputs are asked for, only theirs is.
    """
    held, wanted = outputs, feedback
    if as_of is not None:
        held = held.where(F.col("created_at") >= as_of - F.expr(f"interval {days} days"))
    if limit is not None:
        held = held.orderBy(F.desc("created_at"), "output_id").limit(limit)
        wanted = feedback.join(F.broadcast(held.select("output_id")), "output_id", "left_semi")
    source = items.select(F.col("item_id").alias("_item"), F.struct(F.col("source_name").alias("name"), "url", "title", "published_at").alias("source"))
    told_ = wanted.groupBy(F.col("output_id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("recorded_at", "feedback_id", "likes", "shares"))).alias("feedback"))
    joined = held.join(source, F.col("item_id") == F.col("_item"), "left").join(told_, F.col("output_id") == F.col("_of"), "left")
    return joined.drop("_item", "_of").withColumn("feedback", F.coalesce("feedback", F.array())).orderBy(F.desc("created_at"), "output_id")
