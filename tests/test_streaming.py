"""Streaming forms against batch, over files that arrive one by one."""

from pyspark.sql import functions as F

from winnowry.streaming import jobs


def drained(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_ingested_keeps_one_of_each_url_key(spark, tmp_path):
    rows = [(1, "https://a.org/x", "2024-01-01 00:00:00"), (2, "https://A.org/x/", "2024-01-01 01:00:00"), (3, "https://b.org", "2024-01-01 02:00:00"), (4, "https://c.org", None)]
    items = spark.createDataFrame(rows, "item_id long, url string, at string").withColumn("published_at", F.to_timestamp("at"))
    items.coalesce(1).write.parquet(f"{tmp_path}/items")
    drained(jobs.ingested(spark.readStream.schema(items.schema).parquet(f"{tmp_path}/items")), "ingested")
    got = [r.url_key for r in spark.table("ingested").collect()]
    assert len(got) == len(set(got)) == 3 and "https://c.org" in got


def test_rollup_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (1, None), (2, 7)], "output_id long, likes long")
    rows.write.parquet(f"{tmp_path}/feedback")
    drained(jobs.feedback_rollup(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/feedback")), "rollup", "complete")
    assert sorted(map(tuple, spark.table("rollup").collect())) == sorted(map(tuple, jobs.feedback_rollup(rows).collect())) == [(1, 2, 5), (2, 1, 7)]


def test_stream_with_history(spark, tmp_path):
    where = str(tmp_path)
    for k, rows in enumerate([[(1, 1, "https://a.org/x"), (2, 2, "https://A.org/x/"), (3, 3, "https://b.org")], [(4, 4, "https://b.org/"), (5, 5, "https://c.org")]]):
        spark.createDataFrame(rows, "item_id long, pos long, url string").coalesce(1).write.mode("append").parquet(f"{where}/items")
        stream = spark.readStream.schema("item_id long, pos long, url string").parquet(f"{where}/items")
        query = jobs.with_history(stream, f"{where}/history", f"{where}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(r.item_id for r in spark.read.parquet(f"{where}/history").collect()) == [1, 3, 5]


def test_period_funnel_as_a_stream(spark, tmp_path):
    """Closed periods equal the batch; the last one stays open until the watermark passes it."""
    rows = [(k, f"2024-01-0{1 + k // 4} {k % 4 * 6:02d}:00:00", "ab"[k % 2], float(k * 9 % 100)) for k in range(16)]
    events = spark.createDataFrame(rows, "event_id long, at string, event_type string, value double").select("event_id", F.to_timestamp("at").alias("ts"), "event_type", "value")
    for part in range(4):
        events.where(F.floor(F.col("event_id") / 4) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    drained(jobs.period_funnel(stream), "periods")
    got = {(r.start, r.event_type): (r.n, r.high) for r in spark.table("periods").collect()}
    want = {(r.start, r.event_type): (r.n, r.high) for r in jobs.period_funnel(events).collect()}
    assert got.items() <= want.items() and len(want) - len(got) <= 2 and len(got) >= 12


def test_first_of_each_across_batches(spark, tmp_path):
    schema = "item_id long, pos long, url_key string"
    for k, rows in enumerate([[(1, 2, "a"), (2, 1, "a"), (3, 3, "b")], [(4, 4, "b"), (5, 6, "c"), (6, 5, "c")], [(7, 7, "a")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/items")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/items")
        query = jobs.first_of_each(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(r.item_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 3, 6]
