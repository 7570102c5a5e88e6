"""How the filters of a corpus interact, in every order in which they may be applied.

Each filter has a table of the ids that fail it. What a filter removes after a set of others is the
left semi join of the rows with its table, followed by left anti joins with the tables of those others; the sets of others grow by
one filter a join, so five joins serve all of them. A part's figures for all orders are read from
its counts of (filter, set before it). Survivors are the part's rows less what the prefix has removed, redundant
removals are a filter's failures less what it removes.

Defined results: a null text counts as empty; a null id is never smaller than another nor has a smaller one; equal rows count each
but are joined as one; several labels of an id count if any says so; a null source is the part ""; an empty table
gives no part and so no row; very long texts are split into words whole; an id's key is 128 bits of its id and text; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, doc_id, digest, part, a, b, c, d, n, good, toxic): one row for equal documents of a part, n of them; a to d: whether it fails the filter."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("source", F.lit("")).alias("part"))
    words = text.select("doc_id", "part", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"), F.sha2("t", 256).alias("digest"))
    n, upper = F.size("w"), F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    flags = {"a": n < LEAST_WORDS, "b": 100 * F.size(F.array_distinct("w")) < DISTINCT_PERCENT * n, "c": 100 * upper > UPPER_PERCENT * F.length("t"), "d": F.col("t").rlike(r"[#$%&*|]")}
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("|"), "digest")))
    rows = words.select(key.alias("id"), "doc_id", F.unhex("digest").alias("digest"), "part", *[c.alias(x) for x, c in flags.items()])
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("_of")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.hex("id")))  # null ids don't meet in one task
    return rows.join(marked, own == F.col("_of"), "left").select(*rows.columns, (F.col("n") * F.coalesce("_good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("_toxic", F.lit(0))).alias("toxic"))


def repeats(rows: DataFrame) -> DataFrame:
    """(id): rows whose text a smaller doc_id has too, which are those that are not their text's smallest."""
    known = rows.where("doc_id is not null")
    least = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return known.join(least, ["digest", "doc_id"], "left_anti").select("id")


def removals(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """(part, f, others, n, good, toxic): what filter f, by its place, removes after the set of others, a bit each. rows: (id, part, n, good, toxic); failing: (id) of each filter.

    A row that fails m of k filters makes at most 2 ** (k - 1) rows here, whatever the corpus.
    """
    own = rows.select("id", "part", "n", "good", "toxic")
    state = reduce(DataFrame.unionByName, [own.join(ids, "id", "left_semi").withColumn("f", F.lit(f)) for f, ids in enumerate(failing.values())]).withColumn("others", F.lit(0))
    for g, ids in enumerate(failing.values()):
        both = F.array(F.col("others"), F.col("others") + F.lit(1 << g))
        state = state.withColumn("others", F.explode(F.when(F.col("f") == g, F.array("others")).otherwise(both)))
        gone = ids.select(F.col("id").alias("_id"))
        state = state.join(gone, (F.col("id") == F.col("_id")) & (F.col("others") >= 1 << g), "left_anti")
    return state.groupBy("part", "f", "others").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """Per part, order of the filters (their names joined) and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    rows: (id, part, n, good, toxic). failing: the failing ids of each filter, up to seven filters of one letter each.
    """
    names, k = list(failing), len(failing)
    wide = 1 << k
    cells = removals(rows, failing).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct((F.col("f") * wide + F.col("others")).alias("at"), F.struct("n", "good", "toxic").alias("v")))).alias("cells"))
    parts = rows.groupBy("part").agg(F.sum("n").alias("total")).join(cells, "part", "left")
    read = lambda i, c: F.coalesce(F.try_element_at("cells", i)[c], F.lit(0).cast("long"))
    table = F.transform(F.sequence(F.lit(0), F.lit(k * wide - 1)), lambda i: F.struct(*[read(i, c).alias(c) for c in ("n", "good", "toxic")]))
    orders = F.split(F.lit(",".join("".join(map(str, p)) for p in permutations(range(k)))), ",")
    each = parts.select("part", "total", table.alias("cells")).withColumn("order", F.explode(orders))
    each = each.withColumn("order", F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring("order", i, F.lit(1)).cast("int")))
    each = each.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    at = lambda f, others: F.get("cells", f * wide + others)
    bit = lambda f: F.call_function("shiftleft", F.lit(1), f)
    start = F.struct(F.lit(0).alias("others"), F.lit(0).cast("long").alias("gone"))
    before = F.aggregate(F.slice("order", F.lit(1), F.col("step") - 1), start, lambda s, f: F.struct((s["others"] + bit(f)).alias("others"), (s["gone"] + at(f, s["others"])["n"]).alias("gone")))
    each = each.withColumn("f", F.get("order", F.col("step") - 1)).withColumn("before", before)
    here, alone = at(F.col("f"), F.col("before.others")), at(F.col("f"), F.lit(wide - 1) - bit(F.col("f")))
    weight = F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)).cast("long") for s in range(k)])
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(wide - 1)), F.lit(0).cast("long"), lambda s, o: s + at(F.col("f"), o)["n"] * F.get(weight, F.least(F.bit_count(o), F.lit(k - 1))))
    named = F.array_join(F.transform("order", lambda f: F.get(F.array(*map(F.lit, names)), f)), "")
    removed = here["n"]
    return each.select("part", named.alias("filter_order"), "step", (F.col("total") - F.col("before.gone") - removed).alias("kept"), removed.alias("removed"), (at(F.col("f"), F.lit(0))["n"] - removed).alias("redundant"), alone["n"].alias("unique_fails"), here["good"].alias("good_lost"), here["toxic"].alias("toxic_lost"), shapley.alias("shapley"))


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """The five filters' tables of failing ids, each written once."""
    found: dict[str, DataFrame] = {x.upper(): rows.where(F.col(x)).select("id") for x in "abcd"} | {"E": repeats(rows)}
    return {x: staged(ids, f"failing-{x}") for x, ids in found.items()}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")), "audited")
    return audit(rows, failing_ids(rows))


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
w as (select *, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') as w from t),
m as (select doc_id, t, min(doc_id) over (partition by t) as least, part, len(w) as n, len(list_distinct(w)) as u, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as upper from w),
p as (select part, doc_id, (n < 50)::int + 2 * (100 * u < 65 * n)::int + 4 * (100 * upper > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as fails from m),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
cells as (select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from p left join l using (doc_id) group by 1, 2),
f as (select unnest(range(5)) as f), o as (select [a.f, b.f, c.f, d.f, e.f] as o from f a, f b, f c, f d, f e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select array_to_string(list_transform(o, lambda x: substr('ABCDE', x::int + 1, 1)), '') as filter_order, i::int as step, o[i] as f, 1 << o[i]::int as bit, coalesce(list_sum(list_transform(o[1:i - 1], lambda x: 1 << x::int)), 0)::int as before from o, range(1, 6) r(i)),
r as (select part, filter_order, step, f, sum(n) filter (fails & (before | bit) = 0) as kept, sum(n) filter (fails & bit <> 0 and fails & before = 0) as removed, sum(n) filter (fails & bit <> 0 and fails & before <> 0) as redundant, sum(n) filter (fails = bit) as unique_fails, sum(good) filter (fails & bit <> 0 and fails & before = 0) as good_lost, sum(toxic) filter (fails & bit <> 0 and fails & before = 0) as toxic_lost from cells, s group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, f), 0)::bigint as shapley from r
"""
