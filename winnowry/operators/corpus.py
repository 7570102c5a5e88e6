"""The reference corpus: where it is read from, its cache, its clusters."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.operators.exports import reference_headlines
from winnowry.operators.triage import ranked
from winnowry.sources import tables

# What a first cell says that is a header.
HEADERS = ("headline", "headlines", "title", "text")
SNAPSHOT = "headline string, normalized string, headline_hash string, cached_at timestamp"


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """(headline) of the first column, trimmed, without blanks; the first line goes if it is a header's word, of each file if there are several. A file that is not there gives none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "headline string")
    read = spark.read.schema("headline string").option("escape", '"').option("multiLine", True)
    top = read.csv(path).limit(1).select(F.lower(F.trim("headline"))).first()  # the first line, of the first file by name
    header = top is not None and top[0] in HEADERS
    return read.option("header", header).option("enforceSchema", True).csv(path).select(F.trim("headline").alias("headline")).where("headline <> ''")


def fresh(spark: SparkSession, path: str, as_of: str, hours: int) -> DataFrame | None:
    """The cached corpus, unless it is empty or its newest row is older than so many hours."""
    schema = spark.createDataFrame([], SNAPSHOT).schema
    if not tables.latest(spark, path, schema):
        return None
    held = tables.current(spark, path, schema)
    young = held.agg(F.max("cached_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {hours} hours")).first()[0]
    return held if young else None


def loaded(spark: SparkSession, path: str, origins: list[tuple[str, Callable[[], DataFrame], bool]], as_of: str, hours: int = 24, force: bool = False) -> tuple[DataFrame, str]:
    """The corpus and where it came from: the cache if it is fresh, else the first origin that has any headline, else nothing ("none").

    origins: (name, reader of (headline), whether what it gives is cached), in order. A reader that fails counts as empty. ``force`` passes the cache by.
    """
    if not force and (held := fresh(spark, path, as_of, hours)) is not None:
        return held, "cache"
    for name, read, keep in origins:
        try:
            found = tables.cut(reference_headlines(read(), F.to_timestamp(F.lit(as_of))), name)  # read once, and here, where it may fail
        except Exception as e:  # whatever a reader raises, the next origin is asked
            logging.getLogger(__name__).warning("%s: %s", name, str(e)[:500])
            continue
        if not found.isEmpty():
            if not keep:
                return found, name
            tables.replace(found, path)
            return tables.current(spark, path, found.schema), name
    return spark.createDataFrame([], SNAPSHOT), "none"


def clustered(rows: DataFrame, k: int = 8, restarts: int = 10, seed: int = 42) -> DataFrame:
    """rows: (id, v). Adds cluster: k-means in k groups, the cheapest of several starts; one group if there are fewer rows than k.

    Vectors are converted and written once, so that no iteration reads the source again.
    """
    held = tables.cut(rows.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features")), "vectors")
    if held.limit(k).count() < k:
        return rows.select("id", F.lit(0).alias("cluster"))
    held = held.persist()  # iterations read it from executors; the written table is what a lost one is restored from
    try:
        models = [KMeans(k=k, seed=seed + i).fit(held) for i in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        return tables.cut(best.transform(held).select("id", F.col("prediction").alias("cluster")), "clusters")
    finally:
        held.unpersist()


def summary(members: DataFrame, first: int = 3) -> DataFrame:
    """(cluster, n, examples): size and the first members, by id, of (id, cluster)."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    few = ranked(members, ["cluster"], ["id"]).where(F.col("rank") <= first).groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return sizes.join(few, "cluster")
