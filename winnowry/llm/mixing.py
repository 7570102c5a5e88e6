"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target over its size gives every document of it the same expected number
of copies. The whole part is allocated for certain; for the rest, documents are ranked
by their random odds over their inclusion odds, and the first that fill the remaining
words are taken once more. Random numbers are hashes of the document's id and text, so
reruns agree.

Defined results: a null or empty text has size 0 and is never needed (taken 0); null
sources are one source, last in order; repeated rows are documents of their own, ranked
side by side (equal rows are interchangeable); an empty table gives an empty result;
other columns are carried along, but for ``text`` and those with a name of the result's, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnowry.llm.staging import staged

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Cells of the ranking, by which its prefix sums are taken, in a step of 1 of its logarithm. Only one cell of a source is ever sorted, about a row in 4 * CELLS.
CELLS = 1024


def words(text: str = "text") -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*cols: str) -> Column:
    """In (0, 1), from the first 52 bits of a hash."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size): shares of the total by weight, none above
    ``most`` times its size, the excess reshared. One row a source; the level at which
    shares stop is found in closed form from running sums over sources by cap over weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", most * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("weight"))
    rise = Window.orderBy("_level", F.col("source").asc_nulls_last())
    s = s.withColumn("_below", F.coalesce(F.sum("_cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing)))
    whole = rise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_budget", F.least(share * F.sum("source_size").over(whole), F.sum("_cap").over(whole)))
    # the first source whose cap is not reached sets the level
    level = F.when(F.col("_below") + F.col("_level") * F.col("_rest") >= F.col("_budget"), (F.col("_budget") - F.col("_below")) / F.col("_rest"))
    s = s.withColumn("_water", F.coalesce(F.first(level, ignorenulls=True).over(whole), F.lit(0.0)))
    return s.select("source", "source_size", "weight", F.least(F.col("_cap"), F.col("weight") * F.col("_water")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) without the text, with size, source_size, target, copies and taken, which replace columns of these names; others stay."""
    made = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in docs.columns if c.lower() not in ("text", "doc_id", "source", *made)]
    names = {f"_own{i}": c for i, c in enumerate(own)}
    base = staged(docs.select("doc_id", "source", *[F.col(f"`{c}`").alias(n) for n, c in names.items()], words().alias("size"), uniform("doc_id", "text").alias("_u")), "mix")  # texts are read once
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    share_of = targets(by_source, weights, share, most)
    share_of = share_of.withColumn("_copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    share_of = share_of.withColumn("_whole", F.floor(F.col("_copies") + 1e-12)).withColumn("_part", F.greatest(F.col("_copies") - F.col("_whole"), F.lit(0.0)))
    share_of = share_of.withColumn("_need", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0)))
    share_of = share_of.select(F.col("source").alias("_source"), "source_size", "target", "_whole", "_part", "_need")
    ranked = base.join(share_of, F.col("source").eqNullSafe(F.col("_source")))
    # random odds over inclusion odds; cells are even steps of its logarithm, which is logistic whatever the inclusion
    odds, inclusion = F.col("_u") / (1 - F.col("_u")), F.col("_part") / (1 - F.col("_part"))
    ranked = ranked.withColumn("_rank", F.when(F.col("_part") > 0, odds / inclusion).otherwise(odds)).withColumn("_cell", F.floor(F.log("_rank") * CELLS))
    cells = ranked.groupBy("_source", "_cell").agg(F.sum("size").alias("_words"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_words").over(Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(cells.select(F.col("_source").alias("_s"), F.col("_cell").alias("_c"), "_before", "_words"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    inside = F.col("_before") + F.col("_words") <= F.col("_need")
    beyond = F.col("_before") >= F.col("_need")
    clear = ranked.where(inside | beyond).withColumn("_extra", (inside & (F.col("size") > 0)).cast("int"))
    edge = ranked.where(~(inside | beyond))
    running = F.coalesce(F.sum("size").over(Window.partitionBy("_source").orderBy("_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("_extra", ((F.col("_before") + running + F.col("size") / 2 <= F.col("_need")) & (F.col("size") > 0)).cast("int"))
    out = clear.unionByName(edge).withColumn("copies", F.when(F.col("size") > 0, F.col("_whole") + F.col("_extra")).otherwise(0).cast("long"))
    back = ["doc_id", "source", *[F.col(n).alias(c) for n, c in names.items()]]
    return out.select(*back, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, (('0x' || substr(md5(coalesce(cast(doc_id as varchar), '~') || '|' || coalesce(text, '~')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight, 2.0 * source_size::double as cap from s0),
s2 as (select *, cap / weight as level, coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as below,
 sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as rest, least(1.5 * sum(source_size) over (), sum(cap) over ())::double as budget from s1),
w as (select coalesce(arg_min((budget - below) / rest, level), 0) as water from s2 where below + level * rest >= budget),
s3 as (select source, source_size, least(cap, weight * water) as target, case when source_size > 0 then least(cap, weight * water) / source_size else 0 end as copies from s2, w),
s4 as (select source, source_size, target, floor(copies + 1e-12) as whole, greatest(copies - floor(copies + 1e-12), 0) as part, greatest(target - floor(copies + 1e-12) * source_size, 0) as need from s3),
r as (select d.doc_id, d.size, s4.*, case when part > 0 then (u / (1 - u)) / (part / (1 - part)) else u / (1 - u) end as rk from d join s4 on d.source is not distinct from s4.source),
c as (select *, coalesce(sum(size) over (partition by source order by rk, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from r)
select doc_id, size, source_size, target, case when size > 0 then (whole + case when before + size / 2.0 <= need then 1 else 0 end)::bigint * size else 0 end as taken from c
"""
