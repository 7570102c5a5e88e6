"""Similarity against a history and in-run near-duplicates, in the order of ids. Vectors meet in blocks as matrix products."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowry.operators.lexical import lexical_best
from winnowry.operators.triage import BLOCK_ROWS, cosine_best
from winnowry.sources.tables import cut

#: Edges of a walk that a task settles.
SETTLE = 1 << 18


def _unit(table: pa.Table):
    import numpy as np

    m = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def earlier_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, sim): pairs of rows, a before b, whose cosine to nine places is at least ``least``. rows: (id, v of doubles)."""

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        sims = np.round(_unit(left) @ _unit(right).T, 9)
        a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
        i, j = np.nonzero((sims >= least) & (a[:, None] < b[None, :]))
        return pa.table({"a": a[i], "b": b[j], "sim": sims[i, j]})

    n = max(1, -(-rows.count() // BLOCK_ROWS))
    deal, every = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = [F.col(c).alias(c) for c in ("id", "v")]
    x, y = rows.select(*own).withColumn("x", deal).withColumn("y", every), rows.select(*own).withColumn("y", deal).withColumn("x", every)
    return x.groupBy("x", "y").cogroup(y.groupBy("x", "y")).applyInArrow(meet, "a long, b long, sim double")


def _walk(batches):
    """Fates of rows from their edges (a, b, kept: a is known to be kept), which come in order of b and then a; rows that wait for other tasks have none."""
    fate: dict[int, bool] = {}
    now, dropped, open_ = None, False, False
    ids, kept = [], []

    def close():
        if now is not None and (dropped or not open_):
            fate[now] = not dropped
            ids.append(now)
            kept.append(not dropped)

    for batch in batches:
        for a, b, sure in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("kept").to_pylist(), strict=True):
            if b != now:
                close()
                now, dropped, open_ = b, False, False
            before = True if sure else fate.get(a)
            dropped, open_ = dropped or before is True, open_ or before is None
        if len(ids) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.bool_())], ["id", "kept"])
            ids, kept = [], []
    close()
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.bool_())], ["id", "kept"])


def first_kept(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the rows that a walk in the order of ids keeps, where a kept row drops its later neighbours. edges: (a, b), a before b.

    Each round cuts the open edges into ranges of b of about ``SETTLE`` edges. A task walks its range in order and decides each row whose
    earlier neighbours are decided there or have no open earlier neighbour themselves. So a chain of decisions takes a round for each range that it crosses, not
    for each link, and what fits one range is settled in one round. A task holds a bit for each row of its range; a row's edges pass by one at a time.
    """
    edges, gone = cut(edges.select("a", "b").distinct(), "edges"), []
    while n := edges.count():
        waits = edges.select(F.col("b").alias("a")).distinct().withColumn("waits", F.lit(True))
        flagged = edges.join(waits, "a", "left").select("a", "b", F.col("waits").isNull().alias("kept"))
        ranges = flagged.repartitionByRange(max(1, -(-n // SETTLE)), "b").sortWithinPartitions("b", "a")
        fates = cut(ranges.mapInArrow(_walk, "id long, kept boolean"), "fates")
        out = fates.where("not kept").select("id")
        gone.append(out)
        left = edges.join(fates.select(F.col("id").alias("b")), "b", "left_anti").join(out.withColumnRenamed("id", "a"), "a", "left_anti")
        edges = cut(left.select("a", "b"), "edges")
    for out in gone:
        ids = ids.join(out, "id", "left_anti")
    return ids.select("id")


def without_near(rows: DataFrame, history: DataFrame, threshold: float) -> DataFrame:
    """(id, history_sim): rows kept by a walk in the order of ids: none similar in the history, nor among those kept before. A row without a vector is kept.

    rows, history: (id, v). history_sim is the best of the history, null without one.
    """
    ids, known = rows.select("id"), rows.where("v is not null")
    best = cosine_best(known, history.where("v is not null")).select("id", F.col("sim").alias("history_sim"))
    scored = cut(ids.join(best, "id", "left"), "scored")
    free = scored.where(F.coalesce(F.col("history_sim") < threshold, F.lit(True))).select("id")
    edges = earlier_pairs(known.join(free, "id"), threshold)
    return first_kept(free, edges).join(scored, "id")


def novelty(rows: DataFrame, history: DataFrame, threshold: float) -> DataFrame:
    """(id, novel, sim) of all rows (id, v): sim is the best of the history and of the rows kept before; 0 without either."""
    kept = cut(without_near(rows, history, threshold), "kept").select("id")
    known = rows.where("v is not null")
    before = cosine_best(known, known.join(kept, "id", "left_semi"), earlier=True).select("id", F.col("sim").alias("earlier"))
    past = cosine_best(known, history.where("v is not null")).select("id", F.col("sim").alias("past"))
    sim = F.coalesce(F.greatest("earlier", "past"), F.lit(0.0))
    return rows.select("id").join(before, "id", "left").join(past, "id", "left").join(kept.withColumn("novel", F.lit(True)), "id", "left").select("id", F.coalesce("novel", F.lit(False)).alias("novel"), sim.alias("sim"))


def by_method(rows: DataFrame, history: DataFrame) -> DataFrame:
    """(id, method, sim): cosine where the row has a vector, else the lexical mean; none where the history has nothing to offer. rows, history: (id, v, tokens)."""
    cosine = cosine_best(rows.where("v is not null").select("id", "v"), history.where("v is not null").select("id", "v"))
    lexical = lexical_best(rows.where("v is null").select("id", "tokens"), history.select("id", "tokens"))
    found = cosine.select("id", F.lit("cosine").alias("method"), "sim").union(lexical.select("id", F.lit("lexical").alias("method"), "sim"))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("sim", F.lit(0.0)).alias("sim"))
