"""Whole runs: ordered stages, each of which gives the first reason to reject, over one table of items.

Stages that a row can be judged by alone are one expression, so any number of them is one scan. Stages over
several rows - repeats, novelty, selection - name the ids that they drop. Every row keeps its ``fault`` (step, stage, reason), null while it
is in the run; funnel, histogram, examples, tiers and what was accepted are read from that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowry.functions import rules, text
from winnowry.functions.text import count_matches
from winnowry.operators import elements, gates, similar, triage
from winnowry.sources.tables import cut

FAULT = "struct<step: int, stage: string, reason: string>"


@dataclass(frozen=True)
class Stage:
    """A stage's name and its reason to reject a row; null where the row passes."""

    name: str
    reason: Column


def entered(items: DataFrame) -> DataFrame:
    """All items at the start of a run."""
    return items.withColumn("fault", F.lit(None).cast(FAULT))


def fault(step: int, name: str, reason: Column) -> Column:
    """The fault as one text, which is null where the reason is; so a reason is worked out once."""
    return F.concat(F.lit(f"{step}|{name}|"), reason)


def marked(rows: DataFrame, told: Column) -> DataFrame:
    """Rows still in the run get the fault that is told."""
    parts = rows.withColumn("_parts", F.when(F.col("fault").isNull(), F.split(told, r"\|", 3)))
    new = F.when(F.col("_parts").isNotNull(), F.struct(F.get("_parts", F.lit(0)).cast("int").alias("step"), F.get("_parts", F.lit(1)).alias("stage"), F.get("_parts", F.lit(2)).alias("reason")))
    return parts.withColumn("fault", F.coalesce("fault", new)).drop("_parts")


def judged(rows: DataFrame, stages: list[Stage], first: int) -> DataFrame:
    """Rows still in the run get the first stage's fault; steps count from ``first``."""
    return marked(rows, F.coalesce(*[fault(first + i, s.name, s.reason) for i, s in enumerate(stages)]))


def dropped(rows: DataFrame, gone: DataFrame, step: int, name: str, key: str = "item_id") -> DataFrame:
    """Rows of the ids in ``gone`` (key, reason), one row an id, leave the run."""
    told = gone.select(F.col(key).alias("_gone"), F.col("reason").alias("_reason"))
    joined = rows.join(told, F.col(key) == F.col("_gone"), "left")
    return marked(joined, fault(step, name, F.col("_reason"))).drop("_gone", "_reason")


def inside(rows: DataFrame) -> DataFrame:
    return rows.where("fault is null")


def funnel(rows: DataFrame, names: list[str]) -> DataFrame:
    """(step, stage, entered, passed) of each stage, in one pass."""
    step = F.coalesce("fault.step", F.lit(len(names) + 1))
    one = rows.agg(*[F.count_if(step >= i).alias(f"n{i}") for i in range(1, len(names) + 2)])
    stages = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"n{i}").alias("entered"), F.col(f"n{i + 1}").alias("passed")) for i, n in enumerate(names, 1)]
    return one.select(F.inline(F.array(*stages)))


def histogram(rows: DataFrame) -> DataFrame:
    """(stage, reason, n): what stands before a colon counts as the reason."""
    return rows.where("fault is not null").groupBy("fault.stage", F.split_part("fault.reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def examples(rows: DataFrame, k: int = 10) -> DataFrame:
    """The first k rejections, by step and then in the order of items."""
    return rows.where("fault is not null").select("fault.step", "fault.stage", "fault.reason", F.left("title", F.lit(100)).alias("title"), "pos").orderBy("step", "pos").limit(k)


def tiers(rows: DataFrame, tier: str = "credibility_tier") -> DataFrame:
    """(tier, n) of the selected."""
    return rows.where("rank is not null").groupBy(F.col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def selected(rows: DataFrame, picked: DataFrame, step: int) -> DataFrame:
    """Adds rank, the place of the picked ids; the rest leave at the last stage. picked: (item_id, rank), as few as a run puts out."""
    out = rows.join(F.broadcast(picked.select(F.col("item_id").alias("_picked"), "rank")), F.col("item_id") == F.col("_picked"), "left").drop("_picked")
    out = marked(out, fault(step, "selection", F.when(F.col("rank").isNull(), F.lit("not_selected"))))
    return out.withColumn("rank", F.when(F.col("fault").isNull(), F.col("rank")))


def numbered(top: DataFrame, order: list) -> DataFrame:
    """Ranks of a few rows."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


THIRD_STAGES = ["address", "content", "hard_reject", "category", "narrative", "slide", "score", "selection"]


def read_texts(items: DataFrame, least_category: int = 40) -> DataFrame:
    """Items of a third run, without their bodies, with category, category_score and told, the first fault that the text alone shows.

    Texts are judged where they are read, so none is shuffled. A text under its least length leaves the run before it is analysed: its category is NONE.
    """
    rows = items.withColumn("_short", text.once(triage.short_body().isNotNull()))
    rows = rows.withColumn("_full", text.once(F.when(~F.col("_short"), F.concat_ws(" ", "title", "body_text"))))
    rows = triage.categorised(rows, "_full", ("_low", "_held"))
    told = F.coalesce(
        fault(2, "content", F.when(F.col("_short"), F.lit("insufficient"))),
        fault(3, "hard_reject", triage.hard_reject("_full", F.col("_low"), F.col("_held"))),
        fault(4, "category", F.when((F.col("category_score") < least_category) & (F.col("category") == "NONE"), F.lit("weak"))),
    )
    return rows.withColumn("told", text.once(told)).drop("body_text", "confidence", "reasons", "_short", "_full", "_low", "_held")


def third_run(items: DataFrame, spines: DataFrame, similarities: DataFrame, most: int = 5, clarity: int = 7, alike: float = 0.78, least_final: float = 50, least_category: int = 40, studies: int = 2) -> DataFrame:
    """Items, without their bodies, with category, fault and rank, and slide and final_score from the narrative on.

    items: (item_id, pos, url, title, body_text, content_type, ...), or what ``read_texts`` made of them; spines: (item_id, relevant, rejection_reason, clarity, hook), one an item at most; similarities:
    (item_id, sim) to the reference corpus, null or missing without one. Equal scores go by pos. In one shuffle by address and one by id, items are judged by all stages in a row.
    """
    rows = entered(items if "told" in items.columns else read_texts(items, least_category))
    rows = triage.ranked(rows, ["url"], ["pos"], "_place")
    rows = rows.withColumn("told", F.coalesce(fault(1, "address", F.when(F.col("_place") > 1, F.lit("repeated"))), "told"))
    told = spines.select(F.col("item_id").alias("_id"), "relevant", "rejection_reason", "clarity", "hook")
    rows = rows.join(told, F.col("item_id") == F.col("_id"), "left").drop("_id")
    rows = rows.withColumn("slide", text.once(F.when(F.col("told").isNull(), elements.clean_slide("hook"))))
    rows = rows.join(similarities.select(F.col("item_id").alias("_id"), "sim"), F.col("item_id") == F.col("_id"), "left").drop("_id")
    like = elements.likeness(F.col("sim"), count_matches("slide", rules.NEWSWORDS))
    rows = rows.withColumn("likeness", like).withColumn("final_score", elements.final_score(F.col("likeness"), F.col("category_score"), F.col("clarity")))
    found = F.coalesce((F.col("sim") >= alike) | (F.col("final_score") >= least_final), F.col("final_score") >= least_final, F.lit(False))
    rows = judged(marked(rows, F.col("told")), [
        Stage("narrative", F.when(F.col("relevant").isNull(), F.lit("extraction_failed")).when(~F.col("relevant"), F.coalesce("rejection_reason", F.lit("not_relevant")))),
        Stage("slide", F.when(F.col("clarity") < clarity, F.concat(F.lit("clarity:"), F.col("clarity").cast("string"))).when(~gates.slide_valid("slide"), F.lit("invalid"))),
        Stage("score", F.when(~found, F.lit("too_low"))),
    ], 5).drop("_place", "told")
    rows, order = cut(rows, "run"), [F.desc("final_score"), "pos"]
    study = F.col("category").isin(*rules.STUDY_CATEGORIES)
    top = inside(rows).where(~study).orderBy(*order).limit(most).unionByName(inside(rows).where(study).orderBy(*order).limit(studies))
    return selected(rows, numbered(top.orderBy(*order).limit(most), order), 8)


SECOND_STAGES = ["content", "pre_filter", "repeats", "narrative", "narrative_quality", "compression", "headline_quality", "novelty", "selection"]


def second_run(items: DataFrame, spines: DataFrame, headlines: DataFrame, past_urls: DataFrame, vectors: DataFrame, past_vectors: DataFrame, alike: float = 0.85, most: int = 5, each: int = 5) -> DataFrame:
    """Items, without their bodies, with fault and rank.

    items as in the third run; spines: (item_id, relevant, clarity, emotional_hook, category, numbers, why, hook, ...), headlines: (item_id, headline), both one an
    item at most; past_urls: (url_key) of earlier runs; vectors: (id, v) of the items' findings, past_vectors: (id, v) of earlier ones. Novelty goes in the order of ids, which is the
    order of pos here. The selection takes actionable archetypes first, then the clearest, ``each`` of an archetype.
    """
    rows = cut(judged(entered(items), [Stage("content", F.when(triage.short_body().isNotNull(), F.lit("insufficient"))), Stage("pre_filter", triage.truism())], 1).drop("body_text"), "run")
    keyed = inside(rows).withColumn("url_key", text.url_key("url"))
    fresh = keyed.join(past_urls.select("url_key"), "url_key", "left_anti")
    kept = triage.first_wins(fresh, F.col("url_key")).select("item_id")
    rows = dropped(rows, inside(rows).join(kept, "item_id", "left_anti").select("item_id", F.lit("duplicate").alias("reason")), 3, "repeats")
    own = [c for c in spines.columns if c == "item_id" or c not in items.columns]
    rows = rows.join(spines.select(*own), "item_id", "left").join(headlines, "item_id", "left")
    kind = elements.archetype(F.col("category"))
    rows = cut(judged(rows.withColumn("archetype", kind), [
        Stage("narrative", F.when(F.col("relevant").isNull() | ~F.col("relevant"), F.lit("extraction_failed"))),
        Stage("narrative_quality", gates.narrative_fault(rows)),
        Stage("compression", F.when(F.col("headline").isNull(), F.lit("generation_failed"))),
        Stage("headline_quality", triage.headline_fault("headline")),
    ], 4), "run")
    held = inside(rows).select(F.col("item_id").alias("id")).join(vectors, "id", "left")
    told = similar.novelty(held, past_vectors, alike).where("not novel").select(F.col("id").alias("item_id"), F.concat(F.lit("too_similar:"), F.round("sim", 2).cast("string")).alias("reason"))
    rows = cut(dropped(rows, told, 8, "novelty"), "run")
    order = [F.when(F.col("archetype").isin("SIMPLE_HABIT", "WARNING_RISK", "IF_THEN"), 0).otherwise(1), F.desc("clarity"), F.col("pos")]
    top = triage.ranked(inside(rows), ["archetype"], order, "_in").where(F.col("_in") <= each).orderBy(*order).limit(most)
    return selected(rows, numbered(top, order), 9)


def generic_filter(items: DataFrame, evidence: DataFrame, least: int = 2) -> DataFrame:
    """Items, without their bodies, with fault: the filter before evaluation - length, then truisms without anything specific - and the one after it, of fewer than ``least`` kinds of evidence.

    evidence: (item_id, number, population, time, comparison), of the items that were evaluated.
    """
    kinds = ("number", "population", "time", "comparison")
    told = evidence.select(F.col("item_id").alias("_id"), sum(F.col(k).isNotNull().cast("int") for k in kinds).alias("kinds"), gates.differentiator_summary({k: F.col(k) for k in kinds}).alias("differentiators"))
    short = F.concat(F.lit("insufficient_content:"), F.length("body_text").cast("string"))
    before = F.coalesce(F.when(triage.short_body().isNotNull(), short), F.when(triage.truism().isNotNull(), F.lit("generic_truism")))
    rows = judged(entered(items), [Stage("pre_ai", before)], 1).drop("body_text")  # texts are judged where they are read and not shuffled
    rows = rows.join(told, F.col("item_id") == F.col("_id"), "left").drop("_id")
    return judged(rows, [Stage("post_ai", F.when(F.col("kinds") < least, F.concat(F.lit("differentiators:"), F.col("kinds").cast("string"))))], 2)


def filter_statistics(rows: DataFrame) -> DataFrame:
    """One row of counts of the combined filter."""
    at = lambda step, reason=None: (F.col("fault.step") == step) & (F.col("fault.reason").startswith(reason) if reason else F.lit(True))
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    evaluated = F.coalesce(F.col("fault.step") == 2, F.col("kinds").isNotNull() & F.col("fault").isNull())
    return rows.agg(F.count(F.lit(1)).alias("pre_ai_total"), n(F.coalesce(F.col("fault.step") != 1, F.lit(True)), "pre_ai_passed"), n(at(1, "insufficient"), "pre_ai_rejected_insufficient"), n(at(1, "generic_truism"), "pre_ai_rejected_truism"), n(evaluated, "post_ai_total"), n(evaluated & F.col("fault").isNull(), "post_ai_passed"), n(at(2), "post_ai_rejected"))
