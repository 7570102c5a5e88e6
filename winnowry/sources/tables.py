"""Where results are written: append-only tables by batch, snapshots by version, CSV. Each write is read back and compared.

A batch is a partition that its own rerun replaces, so no row is written twice; Spark moves a partition into place
when its job is committed, so a failed run leaves what was there. A snapshot is a new version beside the old one; readers take the latest.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH, VERSION = "batch", "version"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, of ``spark.checkpoint.dir``. Where none is set, a local one is made in local mode; on a cluster that is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="winnowry-"))
        where = context.getCheckpointDir()
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written once and read again, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def proof(df: DataFrame) -> list[Column]:
    """Rows and the sum of their hashes."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")]


class Mismatch(RuntimeError):
    """What was read back is not what was written."""


def _put(df: DataFrame, path: str, by: str, value: str | int) -> int:
    if by in df.columns:
        raise ValueError(f"a column named {by} is the table's own")
    seen = Observation()
    out = df.observe(seen, *proof(df)).withColumn(by, F.lit(value))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if not seen.get["rows"]:  # without rows no partition is replaced; what an earlier run of the batch wrote goes
        df.limit(0).write.mode("overwrite").parquet(f"{path}/{by}={value}")
    back = _read(df.sparkSession, path, df.schema, by, type(value)).where(F.col(by) == value).select(*[f"`{c}`" for c in df.columns])
    found = back.agg(*proof(back)).first()
    if (found.rows, found.digest) != (seen.get["rows"], seen.get["digest"]):
        raise Mismatch(f"{path}, {by} {value}: {seen.get} written, {found.asDict()} read")
    return found.rows


def _read(spark: SparkSession, path: str, schema: T.StructType, by: str, kind: type) -> DataFrame:
    own = T.StructType([*schema.fields, T.StructField(by, T.LongType() if kind is int else T.StringType())])
    return spark.read.schema(own).option("basePath", path).parquet(path)


def append(df: DataFrame, path: str, batch: str) -> int:
    """Rows written as a batch of the table; the same batch again replaces it."""
    return _put(df, path, BATCH, batch)


def appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of the table, with the column ``batch``."""
    return _read(spark, path, schema, BATCH, str)


def replace(df: DataFrame, path: str, schema: T.StructType | None = None) -> int:
    """``df``, which may come of the present version, as the next version of the snapshot; the version's number."""
    version = latest(df.sparkSession, path, schema or df.schema) + 1
    _put(df, path, VERSION, version)
    return version


def latest(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """The number of the newest version, 0 without any."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return 0
    return _read(spark, path, schema, VERSION, int).agg(F.max(VERSION)).first()[0] or 0


def current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version's rows."""
    return _read(spark, path, schema, VERSION, int).where(F.col(VERSION) == latest(spark, path, schema)).drop(VERSION)


def write_csv(df: DataFrame, path: str, order: list) -> None:
    """A header and rows in order, over as many files as there are ranges; quotes are doubled, line breaks stay inside quotes."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").csv(path)
