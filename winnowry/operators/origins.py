"""The dimension of sources: (pos, source_name, tier, weight, enabled, keywords). A change gives a new table; names may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowry.operators.triage import ranked


def added(sources: DataFrame, new: DataFrame) -> DataFrame:
    """With further sources after those that are there; tier B, weight 1 and enabled where they say nothing."""
    for c, value in (("tier", "B"), ("weight", 1.0), ("enabled", True)):
        new = new.withColumn(c, F.coalesce(c, F.lit(value)) if c in new.columns else F.lit(value))
    return sources.unionByName(new, allowMissingColumns=True)


def removed(sources: DataFrame, names: list[str]) -> DataFrame:
    """Without the first source of each of the names."""
    gone = ranked(sources.where(F.col("source_name").isin(names)), ["source_name"], ["pos"]).where("rank = 1").select("source_name", "pos")
    return sources.join(gone, ["source_name", "pos"], "left_anti")


def listed(sources: DataFrame, enabled_only: bool = True, tier: str | None = None) -> DataFrame:
    if tier is not None:
        sources = sources.where(F.col("tier") == tier)
    return sources.where("enabled") if enabled_only else sources


def wanted(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items of enabled sources whose title holds any of the source's keywords, in either case; a source without keywords takes all."""
    held = listed(sources).groupBy("source_name").agg(F.flatten(F.collect_list(F.coalesce("keywords", F.array().cast("array<string>")))).alias("_words"), F.bool_or(F.coalesce(F.size("keywords"), F.lit(0)) <= 0).alias("_all"))
    told = items.join(held, "source_name")
    return told.where(F.col("_all") | F.exists("_words", lambda w: F.contains(F.lower("title"), F.lower(w)))).select(*items.columns)
