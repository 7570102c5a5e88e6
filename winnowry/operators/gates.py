"""Gates on narratives, headlines and evaluations; each gives the first reason to reject, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.functions import rules
from winnowry.functions.text import matches_any
from winnowry.operators.elements import archetype, first_match, one_of


def detected(text: str, patterns: list[str]) -> Column:
    """What the text says of the kind of the patterns, in lower case; null if nothing."""
    return F.when(matches_any(F.lower(text), patterns), first_match(F.lower(text), patterns))


def spine_fault(least_clarity: int = 7) -> Column:
    """Of a narrative: relevance, clarity, hook, numbers of studies, consequence, in this order."""
    return F.coalesce(
        F.when(~F.col("relevant"), F.lit("not_relevant")),
        F.when(F.col("clarity") < least_clarity, F.concat(F.lit("clarity_too_low:"), F.col("clarity").cast("string"))),
        F.when(F.col("emotional_hook") == "none", F.lit("no_emotional_hook")),
        F.when(F.col("category").isin("STUDY_SHOCK_COMPARISON", "PARENT_CHILD_BIO") & (F.size("numbers") == 0), F.concat(F.col("category"), F.lit("_without_numbers"))),
        F.when(F.col("why").isNull() | (F.length("why") < 10), F.lit("no_consequence")),
    )


def narrative_fault(df: DataFrame, least_clarity: int = 7, least_relevance: int = 6, need_hook: bool = True) -> Column:
    """Twelve checks in order. Columns that ``df`` lacks (lay_relevance, actionable, lesson, controversy) count as 10, true, none and "none"."""
    given = lambda name, default: F.coalesce(F.col(name), default) if name in df.columns else default
    kind = archetype(F.col("category"))
    found = lambda name, patterns: F.concat(F.lit(f"{name}:"), detected("hook", patterns))
    return F.coalesce(
        F.when(F.col("clarity") < least_clarity, F.concat(F.lit("clarity_too_low:"), F.col("clarity").cast("string"))),
        F.when(given("lay_relevance", F.lit(10)) < least_relevance, F.lit("not_for_lay_readers")),
        F.when(F.lit(need_hook) & (F.col("emotional_hook") == "none"), F.lit("no_emotional_hook")),
        F.when((kind == "STUDY_STAT") & (F.size("numbers") == 0), F.lit("study_without_numbers")),
        F.when(F.col("why").isNull() | (F.length("why") < 10), F.lit("no_consequence")),
        found("admin", rules.ADMIN_LANGUAGE),
        found("lifestyle", rules.LIFESTYLE),
        F.when(~given("actionable", F.lit(True)), F.lit("not_actionable")),
        F.when((kind == "HUMAN_INTEREST") & (given("lesson", F.lit("")) == ""), F.lit("no_lesson")),
        F.when((kind == "NEWS_POLICY") & given("controversy", F.lit("none")).isin("none", "low"), F.lit("no_controversy")),
        found("too_specific", rules.TOO_SPECIFIC),
        found("vague", rules.VAGUE),
    )


def slide_precheck(least_clarity: int = 7) -> Column:
    """Before a slide is written: the narrative is relevant and clear enough."""
    return F.coalesce(F.when(~F.coalesce("relevant", F.lit(False)), F.lit("not_relevant")), F.when(F.col("clarity") < least_clarity, F.concat(F.lit("clarity_too_low:"), F.col("clarity").cast("string"))))


def slide_valid(headline: str) -> Column:
    """Thirty characters, capitals, a number or a word of comparison or time, no colon near the beginning."""
    h = F.col(headline)
    telling = h.rlike("[0-9]") | one_of(h, rules.SLIDE_COMPARISONS) | one_of(h, rules.SLIDE_TIMES)
    return F.coalesce((F.length(h) >= 30) & (F.upper(h) == h) & telling & ~F.contains(F.left(h, F.lit(30)), F.lit(":")), F.lit(False))


def evidence(finding: str, numbers: str, population: str, sample: str, window: str) -> dict[str, Column]:
    """Value of each kind of differentiator from the fields or, failing that, from the finding; null where there is none."""
    low = F.lower(finding)
    return {
        "number": F.when(F.size(numbers) > 0, F.array_join(F.slice(numbers, 1, 3), ", ")).otherwise(first_match(low, rules.FOUND_NUMBER)),
        "population": F.when(F.length(population) > 3, F.col(population)).when(F.col(sample) != "", F.concat(F.lit("n="), F.col(sample))),
        "time": F.when(F.length(window) > 3, F.col(window)).otherwise(first_match(low, rules.FOUND_TIME, 1)),
        "comparison": first_match(low, rules.FOUND_COMPARISON, 1),
    }


def differentiator_summary(found: dict[str, Column]) -> Column:
    """"number: ... | population: ...", or none."""
    return F.coalesce(F.nullif(F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), c) for n, c in found.items()]), F.lit("")), F.lit("none"))


def shares_evidence(headline: str, numbers: str, population: str, window: str) -> Column:
    """The headline has a number, the population, or the time window of the evaluation, or any digit."""
    low = F.lower(headline)
    held = F.exists(numbers, lambda n: F.contains(low, F.lower(n)))
    return F.coalesce(held, F.lit(False)) | F.coalesce(F.contains(low, F.lower(population)), F.lit(False)) | F.coalesce(F.contains(low, F.lower(window)), F.lit(False)) | low.rlike("[0-9]")
