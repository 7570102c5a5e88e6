"""Tables by batch, snapshots by version, CSV: reruns, empty batches, failures, and a session without a folder of its own."""

import datetime
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from winnowry.operators import exports
from winnowry.sources import tables

NOW = "timestamp '2024-01-01 00:00:00'"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_is_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a", None), (2, "b", [1.5]), (2, "b", [1.5])], "id long, name string, v array<double>")
    assert [tables.append(df, path, b) for b in ("one", "two", "one")] == [3, 3, 3]
    assert tables.appended(spark, path, df.schema).groupBy("batch").count().orderBy("batch").collect() == [("one", 3), ("two", 3)]
    assert tables.append(df.where("id = 1"), path, "one") == 1
    assert rows_of(tables.appended(spark, path, df.schema).where("batch = 'one'").drop("batch")) == [(1, "a", None)]
    assert tables.append(df.where("id > 9"), path, "one") == 0
    assert [r.batch for r in tables.appended(spark, path, df.schema).select("batch").distinct().collect()] == ["two"]
    with pytest.raises(ValueError):
        tables.append(df.withColumn("batch", F.lit("x")), path, "one")


def test_the_first_batch_may_be_empty(spark, tmp_path):
    df = spark.createDataFrame([], "id long")
    assert tables.append(df, f"file://{tmp_path}/t", "b") == 0
    assert tables.appended(spark, f"file://{tmp_path}/t", df.schema).count() == 0


def test_a_failed_run_leaves_what_was_there(spark, tmp_path):
    path, df = f"file://{tmp_path}/t", spark.range(20)
    tables.append(df, path, "b")
    with pytest.raises(Exception, match="stopped"):
        tables.append(df.select(F.when(F.col("id") < 15, F.col("id")).otherwise(F.raise_error(F.lit("stopped")).cast("long")).alias("id")), path, "b")
    assert tables.appended(spark, path, df.schema).count() == 20


def test_what_is_read_back_is_compared(spark, tmp_path, monkeypatch):
    real = tables._read
    monkeypatch.setattr(tables, "_read", lambda *a: real(*a).where("id <> 3"))
    with pytest.raises(tables.Mismatch):
        tables.append(spark.range(5), f"file://{tmp_path}/t", "b")


def test_snapshots(spark, tmp_path):
    path, df = f"file://{tmp_path}/s", spark.range(3)
    assert tables.latest(spark, path, df.schema) == 0
    assert [tables.replace(df, path), tables.replace(df.where("id < 1"), path)] == [1, 2]
    doubled = tables.current(spark, path, df.schema).withColumn("id", F.col("id") + 7)
    assert tables.replace(doubled, path) == 3
    assert rows_of(tables.current(spark, path, df.schema)) == [(7,)]


def test_csv(spark, tmp_path):
    rows = [(1, 'a "quoted", one', None, 0.5), (2, "two\nlines", "", None), (3, "é", "x", 1.25)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c double")
    tables.write_csv(df, f"file://{tmp_path}/c", [F.desc("id")])
    got = tables.read_csv(spark, f"file://{tmp_path}/c", df.schema).collect()
    assert [tuple(r) for r in got] == [(3, "é", "x", 1.25), (2, "two\nlines", None, None), (1, 'a "quoted", one', None, 0.5)]
    text = "".join(open(f"{tmp_path}/c/{f}").read() for f in sorted(os.listdir(f"{tmp_path}/c")) if f.endswith(".csv"))
    assert text.startswith("id,a,b,c\n")


def test_feedback_leaves_what_it_does_not_tell(spark):
    outputs = spark.createDataFrame([(1, "NEW"), (2, "USED"), (3, "NEW")], "output_id long, status string")
    told = [(1, 1, 5, None, "first", 1), (2, 1, None, 7, None, 2), (3, 1, 6, None, None, 3), (4, 2, None, None, None, 1)]
    feedback = spark.createDataFrame([(f, o, x, s, None, n, datetime.datetime(2024, 1, t)) for f, o, x, s, n, t in told], "feedback_id long, output_id long, likes long, shares long, saves long, notes string, recorded_at timestamp")
    assert rows_of(exports.with_feedback(outputs, feedback).select("output_id", "status", "feedback_likes", "feedback_shares", "feedback_notes")) == [(1, "FEEDBACK", 6, 7, "first"), (2, "FEEDBACK", None, None, None), (3, "NEW", None, None, None)]


def test_ledger(spark):
    day = lambda t: datetime.datetime(2024, 1, t)
    events = [("a", day(1), 1, "RUNNING", None, None), ("a", day(2), 2, "SUCCESS", 9, None), ("b", day(1), 3, "RUNNING", None, None), ("c", day(3), 4, "RUNNING", None, None), ("c", day(3), 5, "FAILED", 2, "why")]
    df = spark.createDataFrame([(r, t, s, st, n, n, n, e) for r, t, s, st, n, e in events], "run_id string, event_at timestamp, seq int, status string, items_fetched int, items_evaluated int, items_output int, error_message string")
    got = {r.run_id: (r.status, r.started_at, r.completed_at, r.items_fetched, r.error_message) for r in exports.ledger(df).collect()}
    assert got == {"a": ("SUCCESS", day(1), day(2), 9, None), "b": ("RUNNING", day(1), None, 0, None), "c": ("FAILED", day(3), day(3), 2, "why")}


def test_layouts_are_whole(spark):
    assert (len(exports.THIRD), len(exports.SECOND), len(exports.FIRST), len(exports.CSV)) == (27, 25, 20, 12)
    row = spark.createDataFrame([("s", "u", None, None, "", "claim", None, 0.25, "H", None, [], None, None, None, ["a", "b"])], "source_name string, url string, published_at timestamp, archetype string, finding string, claim string, virality_score int, confidence double, image_headline string, image_suggestion string, reasons array<string>, population string, time_window string, study_type string, numbers array<string>")
    got = exports.first(row, F.expr(NOW)).first()
    assert got.asDict() == {"run_timestamp_utc": "2024-01-01T00:00:00+00:00", "archetype": "", "source_name": "s", "source_url": "u", "published_at": "", "extracted_claim": "claim", "virality_score": 0, "confidence": 0.25, "image_headline": "H", "image_suggestion": "", "why_it_will_work": "", "status": "NEW", "population": "", "time_window": "", "study_type": "", "must_include_numbers": "a, b"} | {c: "" for c in exports.FEEDBACK_COLUMNS}


def test_clusters_and_vectors(spark):
    corpus = spark.createDataFrame([("a", None, None), ("b", [1.0, 1.0], 1), ("c", None, None)], "headline string, vector array<double>, cluster_id int")
    found = spark.createDataFrame([("a", [3.0, 0.0], 1)], "headline string, vector array<double>, cluster_id int")
    both = exports.with_vectors(corpus, found)
    assert rows_of(both) == [("a", [3.0, 0.0], 1), ("b", [1.0, 1.0], 1), ("c", None, None)]
    assert [tuple(r) for r in exports.clusters(both).collect()] == [(1, [2.0, 0.5], 2)]


def test_bare_session(tmp_path):
    """Staged writes work where no folder is set, in a session of its own without any defaults."""
    code = """
from pyspark.sql import SparkSession
from winnowry.sources import tables
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert tables.cut(s.range(3)).count() == 3 and tables.shared_dir(s) == tables.shared_dir(s)
print("worked")
"""
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(__file__))}, capture_output=True, text=True, timeout=120)
    assert "worked" in out.stdout, out.stderr[-2000:]
