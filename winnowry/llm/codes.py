"""Codes of vectors: each part of a vector becomes the index of its nearest codebook entry.

Codebooks are fitted by rounds of assignment and means over all vectors, in integers, so that results are exact and
the same on every run. The assignment keeps adaptive bounds: with each part go its ``b`` closest entries, a lower bound of its distance to each
of them in order, and one outer bound for all others. When entries have moved, bounds shrink by how far; a part whose
lower bounds all lie beyond the distance to its own entry keeps it. The rest are compared in integers, with the listed entries or, where the outer
bound fails too, with all. ``b`` falls from ``ENTRIES / 4`` to what nearly all parts needed in the last round, no lower than ``LEAST_B``.
The state is a written table; a lost executor re-reads it.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those of another length than
the first kept vector's or of a length that ``PARTS`` does not divide; null ids come last; equal rows stay, each with its code;
with fewer rows than entries the codebook has as many entries as rows; components beyond a long count as the nearest long, and so do errors;
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm.staging import staged
from winnowry.llm.topk import SCALE

PARTS, ENTRIES, ROUNDS = 16, 64, 2
LEAST_B = 4
#: Share of parts whose need the next b covers.
COVERED = 0.99
#: Distances that are held at once.
CELLS = 1 << 21
#: Lanes over which the sums of a label are dealt, as one label may hold a third of all rows.
LANES = 32
MOST = 2**63 - 1
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, v): integer vectors of the rows that take part."""
    fine = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    return rows.where(fine & (F.size("vector") > 0)).select("id", "label", F.transform("vector", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by entries; Python's integers where a long is too small."""
    largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), abs(int(entries.max(initial=0))), abs(int(entries.min(initial=0))))
    exact = np.int64 if 4 * largest * largest * x.shape[-1] * ENTRIES < MOST else object
    gap = x.astype(exact)[:, None, :] - entries.astype(exact)
    return (gap * gap).sum(-1)


def nearest(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From distances to all entries: the b closest in order, their lower bounds, the outer bound, and the least squared distance."""
    d = squared(x, entries)
    k = len(entries)
    order = np.sort(d * k + np.arange(k), axis=1)  # ties go to the lower index
    near, far = (order[:, :b] % k).astype(np.uint8), np.sqrt((order[:, : b + 1] // k).astype(np.float64)) * DOWN
    return near, far[:, :b], far[:, b] if k > b else np.full(len(x), np.inf), order[:, 0] // k


def again(x: np.ndarray, entries: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray, moved: np.ndarray) -> tuple:
    """The same after entries have moved, from the bounds; and how many entries each row had to look at (b + 1: all)."""
    b = near.shape[1]
    lower, outer = lower - moved[near], outer - moved.max()
    lower = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]  # in order again
    lower, outer = lower[:, :b].copy(), lower[:, b].copy()
    own = squared_pairs(x, entries[near[:, :1]])[:, 0]
    reach = np.sqrt(own.astype(np.float64)) * UP
    need = 1 + (lower[:, 1:] <= reach[:, None]).sum(1)
    need[outer <= reach] = b + 1
    near, lower[:, 0] = near.copy(), reach * DOWN * DOWN
    listed = np.flatnonzero((need > 1) & (need <= b))
    if len(listed):
        k = len(entries)
        order = np.sort(squared_pairs(x[listed], entries[near[listed]]) * k + near[listed], axis=1)
        near[listed], lower[listed], own[listed] = order % k, np.sqrt((order // k).astype(np.float64)) * DOWN, order[:, 0] // k
    whole = np.flatnonzero(need > b)
    if len(whole):
        near[whole], lower[whole], outer[whole], own[whole] = nearest(x[whole], entries, b)
    return near, lower, outer, own, need


def squared_pairs(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to the entries chosen for it."""
    largest = max(abs(int(a.max(initial=0))) for a in (x, -x, chosen, -chosen))
    exact = np.int64 if 4 * largest * largest * x.shape[-1] * ENTRIES < MOST else object
    gap = x.astype(exact)[:, None, :] - chosen.astype(exact)
    return (gap * gap).sum(-1)


def packed(x: np.ndarray, kind: type) -> pa.Array:
    """One binary value a row."""
    x = np.ascontiguousarray(x, kind)
    width = x.dtype.itemsize * int(np.prod(x.shape[1:]))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), PARTS, width)


def vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, PARTS, -1)


def lowered(x: np.ndarray) -> np.ndarray:
    """As short floats that are no larger; a bound may always be lower."""
    short = x.astype(np.float32)
    return np.where(short > x, np.nextafter(short, np.float32(-np.inf)), short)


def assign(books: np.ndarray, moved: np.ndarray | None, b: int, was: int = 0) -> Callable:
    """A pass over rows: codes and, for the next pass, bounds of b entries. moved: how far entries have moved since the rows' bounds of ``was`` entries; None: there are none yet."""
    step = max(1, CELLS // max(books.shape[1] * books.shape[2], 1))

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                x, n = vectors(batch), min(step, whole.num_rows - lo)
                near, lower, outer = np.zeros((n, PARTS, b), np.uint8), np.zeros((n, PARTS, b)), np.zeros((n, PARTS, 1))
                need, error = np.zeros((n, PARTS, 1), np.uint8), np.zeros(n, object)
                if moved is not None:
                    old = [unpacked(batch.column(c), kind, width) for c, kind, width in (("near", np.uint8, was), ("lower", np.float32, was), ("outer", np.float32, 1))]
                for p in range(PARTS):
                    if moved is None:
                        got = *nearest(x[:, p], books[p], b), np.full(n, b + 1)
                    else:
                        got = again(x[:, p], books[p], old[0][:, p], old[1][:, p].astype(np.float64), old[2][:, p, 0].astype(np.float64), moved[p])
                        if was > b:
                            got = got[0][:, :b], got[1][:, :b], np.minimum(got[2], got[1][:, b:].min(1)), got[3], got[4]
                    near[:, p], lower[:, p], outer[:, p, 0], need[:, p, 0] = got[0], got[1], got[2], np.minimum(got[4], 255)
                    error += got[3].astype(object)
                state = [packed(near, np.uint8), packed(lowered(lower), np.float32), packed(lowered(outer), np.float32), packed(need, np.uint8)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "v")), *state, pa.array([min(e, MOST) for e in error], pa.int64())], ["id", "label", "v", "near", "lower", "outer", "need", "error"])

    return run


def summed(b: int, k: int) -> Callable:
    """Per task: counts and sums of the parts of each entry, in halves that can't overflow; and how many parts needed how many entries (part -1)."""

    def run(batches):
        total = needs = None
        for batch in batches:
            x = vectors(batch)
            code, need = unpacked(batch.column("near"), np.uint8, b)[:, :, 0], np.frombuffer(b"".join(batch.column("need").to_pylist()), np.uint8)
            if total is None:
                total, needs = np.zeros((3, PARTS, k, x.shape[2]), np.int64), np.zeros(256, np.int64)
            needs += np.bincount(need, minlength=256)
            for p in range(PARTS):
                for h, part in enumerate((np.ones_like(x[:, p]), x[:, p] >> 32, x[:, p] & 0xFFFFFFFF)):
                    np.add.at(total[h, p], code[:, p], part)
        if total is not None:
            p, e, i = np.nonzero(total[0])
            m = np.flatnonzero(needs)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((p, m * 0 - 1), (e, m), (i, m * 0), (total[0, p, e, i], needs[m]), (total[1, p, e, i], m * 0), (total[2, p, e, i], m * 0))], ["part", "entry", "place", "n", "high", "low"])

    return run


def fit(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """rows: (id, vector, label). Returns (id, label, near, error) of all kept rows - near: codes, a byte a part - and the codebooks, by part, entry, place.

    The driver holds the codebooks alone: at most ``entries`` times the vectors' length, and as many sums of each task's.
    """
    kept = usable(rows)
    first = kept.orderBy(F.asc_nulls_last("id"), "v").where(F.size("v") % PARTS == 0).limit(1).collect()
    if not first:
        return kept.limit(0).select("id", "label", F.lit(b"").alias("near"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    kept = kept.where(F.size("v") == len(first[0].v))
    start = np.array([r.v for r in kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()], object)
    books = start.reshape(len(start), PARTS, -1).swapaxes(0, 1)
    k = books.shape[1]
    names = {c: t for c, t in kept.dtypes}
    schema = f"id {names['id']}, label {names['label']}, v array<long>, near binary, lower binary, outer binary, need binary, error long"
    b, was, moved, state = max(1, min(k, entries // 4)), 0, None, kept
    for _ in range(rounds):
        state = staged(state.mapInArrow(assign(books, moved, b, was), schema), "codes")
        sums = state.select("v", "near", "need").mapInArrow(summed(b, k), "part long, entry long, place long, n long, high long, low long")
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        found = sums.groupBy("part", "entry", "place").agg(wide("n"), wide("high"), wide("low")).collect()
        new, needs = books.copy(), {}
        for r in found:
            if r.part < 0:
                needs[r.entry] = int(r.n)
            else:
                new[r.part, r.entry, r.place] = ((int(r.high) << 32) + int(r.low)) // int(r.n)
        gap = new - books
        far = np.sqrt((gap * gap).sum(-1).astype(np.float64)) * UP
        was, moved, books = b, far, new
        listed = {m: n for m, n in needs.items() if m <= b}
        if listed:  # the next b covers what nearly all parts with a certain list needed
            b = next(m for m in range(1, b + 1) if sum(n for x, n in listed.items() if x <= m) >= COVERED * sum(listed.values()))
            b = max(min(was, LEAST_B), b)
    last = state.mapInArrow(assign(books, moved, b, was), schema)
    return last.select("id", "label", "near", "error").withColumn("near", own_bytes(b)), books


def own_bytes(b: int):
    """The first of each part's b bytes."""
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.hex(F.substring("near", p * b + 1, F.lit(1)))), ""))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error of all rows of the label; nulls are a label. coded: (label, error, ...)."""
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long").alias("label_error"))
    dealt = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("_lane"))
    lane = F.pmod(F.xxhash64("id", "near"), F.lit(LANES)).cast("int")
    return coded.join(dealt, F.col("label").eqNullSafe(F.col("_label")) & (lane == F.col("_lane"))).drop("_label", "_lane")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    coded, books = fit(rows)
    out = with_label_errors(staged(coded, "coded"))
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("near")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(name: str, books: str) -> str:
    """SQL of an assignment to the entries of ``books``."""
    return f"""{name} as materialized (select r, p, v, label, vec_id, min(struct_pack(d := list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), e := e)) as m from x join {books} using (p) group by all)"""


def _means(name: str, assigned: str, books: str) -> str:
    """SQL of the floors of the means; entries without parts stay."""
    floor = "((s - ((s % n) + n) % n) // n)::bigint"
    return f"""{name} as materialized (select b.p, b.e, coalesce(q.c, b.c) as c from {books} b left join (select p, e, list({floor} order by i) as c from (select p, m.e as e, i, sum(v[i]) as s, count(*) as n from {assigned}, range(1, (select len(any_value(v)) from x) + 1) t(i) group by all) group by 1, 2) q on q.p = b.p and q.e = b.e)"""


ORACLE = f"""
with k as (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (select *, row_number() over (order by vec_id nulls last, v) as r from k),
x as materialized (select r, vec_id, label, p::int as p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] as v from n, range({PARTS}) t(p)),
b0 as materialized (select p, r - 1 as e, v as c from x where r <= {ENTRIES}),
{_round('a0', 'b0')}, {_means('b1', 'a0', 'b0')}, {_round('a1', 'b1')}, {_means('b2', 'a1', 'b1')}, {_round('a2', 'b2')},
codes as (select r, vec_id, label, string_agg(printf('%02x', m.e), '' order by p) as code, sum(m.d)::bigint as error from a2 group by 1, 2, 3)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from b2) as codebooks_sha256 from codes
"""
