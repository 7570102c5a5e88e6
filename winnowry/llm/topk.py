"""Exact top-k inner products by columnar branch-and-bound.

Vectors become integers floor(``SCALE`` * x). Queries and candidates are dealt into blocks by
hash; each pair of blocks meets in one task, where a query's scores accumulate
a block of dimensions at a time over the candidates' columns. After each block, candidates whose
score cannot reach the query's k-th best any more - by the mass that both vectors have left -
are compacted away. The best of all blocks are ranked at the end.

Defined results: vectors that are null, empty, or hold null or non-finite components take
no part, nor do rows without an id; a query meets only vectors of its own dimension;
ties go to the smaller id; equal rows are candidates of their own; the query's id is never its own candidate;
components and scores beyond a long count as the nearest long; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE = 256
K = 5
EVERY = 50
#: Rows of a block of queries and of candidates: what one task holds.
QUERY_ROWS, CANDIDATE_ROWS = 4096, 8192
DIMS = 8
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    return flat.flatten().to_numpy().reshape(table.num_rows, -1)


LEAST, MOST = -(2**63), 2**63 - 1


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()))


def left(x: np.ndarray) -> np.ndarray:
    """Norm of each row's components from each block of dimensions on."""
    mass = np.add.reduceat(x * x, np.arange(0, x.shape[1], DIMS), axis=1)
    return np.sqrt(np.cumsum(mass[:, ::-1], axis=1)[:, ::-1])


def search(k: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return OUT.empty_table()
        q, c = matrix(queries), matrix(rows)
        qid, cid = queries.column("id").to_numpy(), rows.column("id").to_numpy()
        exact = np.float64 if largest(q) * largest(c) * q.shape[1] < 2**53 else object
        columns = np.ascontiguousarray(c.T).astype(exact)
        qf, cl, ql = q.astype(exact), left(c.astype(np.float64)), left(q.astype(np.float64))
        ids, owners, scores = [], [], []
        for i in range(len(q)):
            alive = np.flatnonzero(cid != qid[i])
            part = np.zeros(len(alive), exact)
            for b, lo in enumerate(range(0, q.shape[1], DIMS)):
                own = columns[lo : lo + DIMS]
                part = part + qf[i, lo : lo + DIMS] @ (own if len(alive) == own.shape[1] else own[:, alive])
                if lo + DIMS < q.shape[1] and len(alive) > k:
                    slack = ql[i, b + 1] * cl[alive, b + 1] * (1 + 1e-9) + 1e-6
                    low = part.astype(np.float64)
                    floor = np.partition(low - slack, len(low) - k)[len(low) - k]
                    stay = low + slack >= floor
                    alive, part = alive[stay], part[stay]
            part = np.clip(part, LEAST, MOST) if exact is object else part
            best = np.lexsort((cid[alive], -part))[:k]
            ids.append(cid[alive][best])
            scores.append(part[best].astype(np.int64))
            owners.append(np.full(len(best), qid[i]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (owners, ids, scores)], schema=OUT)

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """queries, rows: (id, vector). Returns query_id, rank, vec_id and score of each query's k best rows of other ids."""

    def usable(df: DataFrame) -> DataFrame:
        fine = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
        return df.where(F.col("id").isNotNull() & fine & (F.size("vector") > 0)).select("id", F.transform("vector", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"), F.size("vector").alias("dims"))

    queries, rows = usable(queries), usable(rows)
    n_q, n_c = queries.count(), rows.count()
    q_blocks, c_blocks = max(1, -(-n_q // QUERY_ROWS)), max(1, -(-n_c // CANDIDATE_ROWS))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("q", deal(q_blocks)).withColumn("c", every(c_blocks))
    c = rows.withColumn("c", deal(c_blocks)).withColumn("q", every(q_blocks))
    found = q.groupBy("dims", "q", "c").cogroup(c.groupBy("dims", "q", "c")).applyInArrow(search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(rows.where(F.col("id") % EVERY == 0), rows)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
