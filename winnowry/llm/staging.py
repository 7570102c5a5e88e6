"""Written intermediate tables, and the keys that tie their rows to documents.

A staged table lies in the shared folder that ``spark.checkpoint.dir`` names, so a
lost executor costs a re-read and not a recomputation of all that led to it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; long texts make larger ones a matter of memory.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables. Where none is set, a local one is made in local mode; on a cluster that is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="winnowry-"))  # the conf itself can't be set in a running session
        where = context.getCheckpointDir()
    return where


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session asks for smaller ones yet."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key of the row's id and text. Equal rows share it and have equal results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
