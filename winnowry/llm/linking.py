"""Connected groups from buckets of candidates, without all pairs of a bucket.

First every member of a bucket is compared with three members of it, one of them that which
meets most others in all its buckets: of edited copies of a text it is the one nearest to all. What that
leaves apart is compared in full, but only across different groups, so that a bucket of
one large group costs a comparison a member. A bucket whose members are all near each other by their
signatures, but few of them linked, costs all its pairs: they are compared, none is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.llm.staging import staged

#: Members from which on a bucket of few groups is joined group by group.
LARGE = 500
#: Edges that a task joins up: a few tens of MB of Python.
PART = 1 << 17
#: Members of several groups up to which a bucket is joined with itself where there is a comparison in blocks.
FEW = 48


def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: of the edges (a, b) of a task, (id, root) of each end, the root being the smallest id that they reach."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["id", "root"])


def rounds(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of the edges (a, b) by joins alone: each round an end takes the least component of its neighbours and of the end that this names."""
    edges = edges.where("a <> b").select("a", "b")
    both = staged(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("id").alias("j"), F.col("component").alias("far"))
        moved = staged(lower.join(jump, lower["low"] == jump["j"]).select("id", "old", F.least("low", "far").alias("component")), "labels")
        labels = moved.select("id", "component")
        if moved.where("old <> component").isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of the edges (a, b): the smallest id reachable.

    Parts of at most about ``PART`` edges are first joined up inside tasks, which leaves a star for each group of
    a part. Where there are several parts the stars meet in rounds, whose number grows with the logarithm of a group's breadth in stars.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    parts = -(-edges.count() // PART)
    stars = staged(edges.repartition(max(parts, 1)).mapInArrow(forest, "id long, root long"), "stars")
    if parts <= 1:
        return stars.withColumnRenamed("root", "component")
    return rounds(stars.select(F.col("id").alias("a"), F.col("root").alias("b")))


def starred(spokes: DataFrame, nodes: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """The pairs (a, b) of a hub and a member that are near."""
    y = spokes.join(nodes, "id").alias("y")
    return y.join(nodes.alias("x"), F.expr("x.id = y.hub")).where(near("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def apart(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, id, component) of the members of buckets that hold several groups."""
    placed = shared.select("bucket", "id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")
    return staged(placed.join(mixed, "bucket"), "mixed")


def link(members: DataFrame, nodes: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column], blocks: Callable[[DataFrame, DataFrame], DataFrame] | None = None, join_up: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """(id, component) of all ids that are linked with another.

    members: (bucket, id); nodes: id and what ``near(x, y)`` reads of the rows under the aliases x
    and y to tell whether they may be linked; verify: keeps the true links of pairs (a, b). Every
    pair that shares a bucket, is near and verified ends in one group. Buckets of the same
    members count once. blocks: if given, compares buckets of more than ``FEW`` members of several groups: the links (a, b)
    among rows (bucket, id, component, met and what ``near`` reads), without the pairs that were tried with hubs; a pair counts in the least bucket that the two ``met`` share.
    join_up: makes groups of links.
    """
    own, other = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.bit_xor(own).alias("h1"), F.bit_xor(other).alias("h2")).where("n > 1")
    sizes = sizes.groupBy("n", "first", "last", "h1", "h2").agg(F.min("bucket").alias("bucket"))
    shared = staged(members.join(sizes.select("bucket", "n"), "bucket"), "buckets")
    met = shared.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = shared.join(met, "id").groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max_by("id", "met").alias("central"))
    spokes = shared.join(hubs, "bucket").select("id", F.explode(F.array("first", "last", "central")).alias("hub")).where("id <> hub").select(F.greatest("id", "hub").alias("id"), F.least("id", "hub").alias("hub")).distinct()
    tried = starred(spokes, nodes, near)
    if blocks:
        tried = staged(tried, "tried")
    first = staged(verify(tried), "links")
    groups = join_up(first)

    mixed = apart(shared, groups)
    if mixed.isEmpty():
        return groups
    stats = mixed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"))
    stats = staged(stats.withColumn("large", F.col("n") > FEW if blocks else (F.col("n") > LARGE) & (F.col("groups") * 8 < F.col("n"))).select("bucket", "large"), "mixed")
    met = mixed.groupBy("id").agg(F.collect_list("bucket").alias("met"))
    mixed = mixed.join(stats, "bucket").join(met, "id").join(nodes, "id")
    once = F.expr("array_min(array_intersect(x.met, y.met)) = x.bucket")  # a pair counts in one of the buckets it shares
    few = mixed.where("not large")
    across = few.alias("x").join(few.alias("y"), F.expr("x.bucket = y.bucket and x.id < y.id and x.component <> y.component") & near("x", "y") & once).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    found = first
    if blocks:
        found = found.union(blocks(mixed.where("large"), tried))
        across = across.join(tried, ["a", "b"], "left_anti")
    elif not stats.where("large").isEmpty():
        big = mixed.where("large")
        tags = big.select("bucket", "component").distinct()
        crossed = tags.alias("p").join(tags.alias("q"), F.expr("p.bucket = q.bucket and p.component < q.component")).select("p.bucket", F.col("p.component").alias("p"), F.col("q.component").alias("q")).alias("c")
        left = crossed.join(big.alias("x"), F.expr("c.bucket = x.bucket and c.p = x.component"))
        pairs = left.join(big.alias("y"), F.expr("c.bucket = y.bucket and c.q = y.component") & near("x", "y") & once)
        across = across.union(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
    second = staged(verify(across.distinct()), "links")
    if second.isEmpty() and not blocks:
        return groups
    return join_up(found.union(second))
