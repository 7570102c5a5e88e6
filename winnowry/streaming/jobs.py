"""Incremental forms of the batch operators: each takes a streaming (or batch) DataFrame and returns one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from winnowry.functions.text import url_key
from winnowry.operators.triage import first_wins


def ingested(items: DataFrame, hours: int = 48, ts: str = "published_at") -> DataFrame:
    """One row of each URL key within the watermark, and one of each among the rows without a date.

    State of dated rows stays bounded, as keys older than the watermark are forgotten, and rows that come later than it are dropped: nearest to
    the rule of freshness. Rows without a date take no part in event time; they have a state of their own, of all their keys.
    """
    keyed = items.withColumn("url_key", url_key("url"))
    dated = keyed.where(F.col(ts).isNotNull()).withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark(["url_key"])
    undated = keyed.where(F.col(ts).isNull()).dropDuplicates(["url_key"])
    return dated.unionByName(undated)


def period_funnel(events: DataFrame, kind: str = "event_type", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows of each kind in periods of twelve hours."""
    wide = events.withWatermark(ts, late).groupBy(F.window(ts, "12 hours"), kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("high"))
    return wide.select(F.col("window.start").alias("start"), kind, "n", "high")


def feedback_rollup(feedback: DataFrame) -> DataFrame:
    """Running totals of each output; for update mode."""
    return feedback.groupBy("output_id").agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"))


def first_of_each(items: DataFrame, key: str = "url_key", pos: str = "pos") -> DataFrame:
    """A stream's rows whose key no earlier batch had, of each key the first by pos in its batch.

    What was seen is kept as keyed state beside each partition, so a batch costs what it brings and not what came before. Use the RocksDB state store where keys
    are many. A batch that is run again gives the same rows, as its state is restored with it.
    """
    columns = items.columns

    def take(group, pieces, state: GroupState):
        rows = pd.concat(list(pieces))
        if not state.exists:
            state.update((True,))
            yield rows.nsmallest(1, pos)[columns]

    return items.groupBy(key).applyInPandasWithState(take, items.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def with_history(items: DataFrame, history: str, checkpoint: str) -> DataStreamWriter:
    """Writes each micro-batch's items of addresses that no earlier batch had, first of each, to the history.

    A batch has a folder of its own and reads those before it, so a batch that is run again gives the same rows.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = first_wins(batch.withColumn("url_key", url_key("url")), F.col("url_key"))
        if number:
            past = spark.read.option("basePath", history).schema("url_key string, batch long").parquet(history).where(F.col("batch") < number)
            keyed = keyed.join(past.select("url_key"), "url_key", "left_anti")
        keyed.write.mode("overwrite").parquet(f"{history}/batch={number}")

    return items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
