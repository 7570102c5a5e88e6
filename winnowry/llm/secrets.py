"""Secret scan with corpus-wide ownership frequency.

Base patterns find keyed values, access keys and hex strings in every text. Besides
those, long tokens that mix character classes are candidates. The hash of every
candidate's value is counted over distinct repositories (documents) and owners
(sources): a value of one owner and few repositories that looks random is a live-looking
credential, and its span is added; a value of several owners, or of many repositories of one,
is a copied example, and is not.

Places are code points, ends exclusive. Defined results: null text is empty; null
owners count as one owner; repeated rows count as repositories of their own only if
their ids differ; a row without a doc_id is one repository with all such rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm.staging import small_batches, staged

#: The kinds in order, their patterns, the group that is measured and its least length.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter match is dropped, and nothing longer can begin inside it
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE = 6

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
#: Owners from which on a value is a copied example.
COPIED = 2
#: Repositories from which on a value is a copied example even within one owner.
SPREAD = 10
#: Bits per character from which on a value looks random.
RANDOM_BITS = 3.0

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("bits", pa.float64())])
SCHEMA = "doc_id long, owner string, spans array<struct<kind:string,start:long,end:long,value:string,bits:double>>"


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) by start, then kind as listed."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST_VALUE:
            found.append((m.start(), 0, m.end(), m[2]))
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e, v) for s, k, e, v in sorted(found)]


def entropy(value: str) -> float:
    """Bits per character, from the value's own character counts."""
    p = np.unique(np.frombuffer(value.encode(), np.uint8), return_counts=True)[1] / len(value.encode())
    return float(-(p * np.log2(p)).sum())


def mixed(value: str) -> bool:
    """Digits, and letters of both cases."""
    return bool(re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value))


def candidates(text: str) -> list[dict]:
    base = base_spans(text)
    found = [(s, k, e, v) for s, k, e, v in base]
    for m in TOKEN.finditer(text):
        if mixed(m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            found.append((m.start(), "token", m.end(), m[0]))
    return [{"kind": k, "start": s, "end": e, "value": v, "bits": entropy(v)} for s, k, e, v in found]


def scan(batches):
    for rows in batches:
        texts = rows.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("source").cast(pa.string()), pa.array([candidates(t) if t else [] for t in texts], pa.list_(SPAN))], ["doc_id", "owner", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, owner and spans (kind, start, end, value, bits, owners, repositories, live), by place.

    Candidates without a base pattern stay only if live. The texts are read once; what
    is shuffled is the candidates, summed by value and owner before they meet.
    """
    small_batches(docs.sparkSession)
    found = staged(docs.select("doc_id", "text", "source").mapInArrow(scan, SCHEMA).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = found.where(F.size("spans") > 0).select("row", "doc_id", "owner", F.explode("spans").alias("s")).withColumn("hash", F.sha2(F.col("s.value"), 256))
    owned = each.groupBy("hash", "owner", "doc_id").count().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    spread = owned.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    live = (F.col("owners") < COPIED) & (F.col("repositories") < SPREAD) & (F.col("s.bits") >= RANDOM_BITS)
    known = each.join(spread, "hash").withColumn("live", live).where((F.col("s.kind") != "token") | F.col("live"))
    order = F.when(F.col("s.kind") == "assign", 0).when(F.col("s.kind") == "access", 1).when(F.col("s.kind") == "hex", 2).otherwise(3)
    one = F.struct(F.col("s.start").alias("start"), order.alias("order"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), F.col("s.value").alias("value"), F.col("s.bits").alias("bits"), "owners", "repositories", "live")
    got = known.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("got"))  # as many as one text has
    return found.select("row", "doc_id", "owner").join(got, "row", "left").select("doc_id", "owner", F.coalesce("got", F.array().cast(got.schema["got"].dataType)).alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "token")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))
