"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct k-word shingles. Its signature has ``COMPONENTS``
minima of 2 bits, and of the first ``INDEXED`` of them 32 bits. At the similarity sought two signatures
differ in a fifth of the wide and 15 of 100 narrow components on average; pairs that differ in at most ``DISTANCE`` of the
indexed ones, and in at most ``FAR`` of all, are candidates.
The indexed components are split into ``CHUNKS`` chunks: by the pigeonhole principle one chunk of such a pair has at
most ``DISTANCE // CHUNKS`` = 1 errors, so leaving each component of each chunk out in turn
gives keys of which every pair under the distance shares one. Links are confirmed
on the full sets.

A pair of similarity 0.8 exceeds a distance with a chance of about 2e-5, a closer one less.

Defined results: without words or text a document is linked with nothing; with fewer
words than k the whole sequence is its one shingle; equal rows are one text; a null doc_id
takes part and never becomes a component's id unless all of it are null; an empty table gives
none; ``keep_one`` keeps other columns whatever their names. Sets are of 64-bit hashes of whole shingles.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm.linking import link
from winnowry.llm.staging import row_key, small_batches, staged, unused
from winnowry.llm.textops import TOKENS, grams, hash_runs, mix, pieces, signed, spans, splitmix, token_table

INDEXED, CHUNKS, DISTANCE = 40, 10, 19
COMPONENTS, FAR = 1024, 201
#: Fewer components by which most pairs are told apart, each with the differences beyond which they are.
GLANCES = ((64, 24), (256, 64))
LOWER = np.where(np.isin(np.arange(256), np.arange(65, 91)), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
SEEDS = (splitmix(COMPONENTS, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and each text's first."""
    starts, ends, first = spans(TOKENS[data], offsets)
    words = hash_runs(LOWER[data], starts, ends)
    every, begin = grams(words, first, k)
    n_words = np.diff(first)
    out = []
    for d in range(len(n_words)):
        if n_words[d] >= k:
            out.append(np.unique(every[begin[d] : begin[d + 1]]))
        elif n_words[d]:
            short = splitmix(1, 977 + int(n_words[d]))
            for w in words[first[d] : first[d + 1]]:
                short = mix(short ^ w) * np.uint64(3) + np.uint64(1)
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def sign(k: int):
    """For mapInArrow: size, digest and signature of each text's set."""

    def run(batches):
        for rows, data, offsets in pieces(batches):
            with np.errstate(over="ignore"):
                sets, first = shingles(data, offsets, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                digest = np.zeros((2, len(n)), np.uint64)
                least = np.zeros((len(full), COMPONENTS), np.uint32)
                if len(full):
                    at = first[:-1][full]
                    for i, c in enumerate(splitmix(2, 5)):
                        digest[i, full] = np.add.reduceat(mix(sets ^ c), at)
                    short = (sets >> np.uint64(32)).astype(np.uint32)
                    for i, c in enumerate(SEEDS):
                        least[:, i] = np.minimum.reduceat(short * c, at)
            values = (mix(least.astype(np.uint64) | (np.arange(COMPONENTS, dtype=np.uint64) << np.uint64(32))) >> np.uint64(32)).astype(np.uint32)
            pairs = (values & np.uint32(3)).astype(np.uint8).reshape(len(values), -1, 4)
            bits = np.ascontiguousarray(pairs[:, :, 0] | pairs[:, :, 1] << 2 | pairs[:, :, 2] << 4 | pairs[:, :, 3] << 6).view(np.int64)
            keyed = keys(values)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * x.shape[1])]).astype(np.int32)), pa.array(x.ravel())) for x in (bits, keyed)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("row"), pa.array(n), pa.array(signed(digest[0])), pa.array(signed(digest[1])), *lists], ["doc_id", "row", "n", "s1", "s2", "sig", "keys"])

    return run


def keys(values: np.ndarray) -> np.ndarray:
    """Of each signature: a key for each component left out of its chunk."""
    size, made = INDEXED // CHUNKS, []
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            for out in range(size):
                h = np.full(len(values), c * size + out, np.uint64)
                for i in range(size):
                    if i != out:
                        h = mix(h ^ values[:, c * size + i].astype(np.uint64)) + np.uint64(i)
                made.append(mix(h))
    return signed(np.ascontiguousarray(np.stack(made, 1)))


def full_sets(k: int):
    def run(batches):
        for rows, data, offsets in pieces(batches):
            with np.errstate(over="ignore"):
                sets, first = shingles(data, offsets, k)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(sets)))], ["id", "elements"])

    return run


def unequal(a: Column, b: Column) -> Column:
    """Different 2-bit components of 32 in a long."""
    z = a.bitwiseXOR(b)
    return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def near(x: str, y: str, percent: int = 80) -> Column:
    """The glances stay short, as the JVM never compiles a method of more than 8,000 bytes; few pairs come to the whole distance."""
    fit = (100 * F.col(f"{x}.n") >= percent * F.col(f"{y}.n")) & (100 * F.col(f"{y}.n") >= percent * F.col(f"{x}.n"))
    a, b = F.col(f"{x}.sig"), F.col(f"{y}.sig")
    for components, far in GLANCES:
        fit = fit & (reduce(add, [unequal(a[i], b[i]) for i in range(components // 32)]) <= far)
    return fit & (F.aggregate(F.zip_with(a, b, unequal), F.lit(0), add) <= FAR)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """Per row: doc_id, row (its key), n_shingles, component_id, kept and group (null without shingles). Links: 100 * intersection >= percent * union."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text", row_key().alias("row"))
    signed_rows = staged(texts.mapInArrow(sign(k), "doc_id long, row long, n long, s1 long, s2 long, sig array<long>, keys array<long>"), "signed")
    nodes = signed_rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("row"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()), "sets")
    members = nodes.select("id", F.explode("keys").alias("bucket"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "pairs")
        wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id").join(nodes.select("id", "row"), "id")
        whole = texts.join(wanted, "row").dropDuplicates(["id"]).select("id", "text").mapInArrow(full_sets(k), "id long, elements array<long>")
        whole = staged(whole, "elements")
        both = pairs.join(whole.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a").join(whole.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
        common = F.size(F.array_intersect("ea", "eb"))
        return both.where(100 * common >= percent * (F.size("ea") + F.size("eb") - common)).select("a", "b")

    groups = link(members, nodes.select("id", "n", "sig"), verify, lambda x, y: near(x, y, percent))
    placed = nodes.select("s1", "s2", "n", "id").join(groups, "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("group"))
    rows = signed_rows.select("doc_id", "row", "n", "s1", "s2")
    full = staged(rows.where("n > 0").join(placed, ["s1", "s2", "n"]), "grouped")
    names = full.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = full.join(names, "group").select("doc_id", "row", "n", "component_id", "group").union(rows.where("n = 0").select("doc_id", "row", "n", "doc_id", F.lit(None).cast("long")))
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "group")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the first by doc_id, nulls last, then row key. Of documents without shingles equal rows are one."""
    found = near_duplicates(docs, k, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    kept = found.where("group is not null").groupBy("group").agg(first).select("first.doc_id", "first.row")
    kept = kept.union(found.where("group is null").select("doc_id", "row").distinct())
    key, own, other = (unused(docs, c) for c in ("key", "own", "other"))
    joined = docs.withColumn(key, row_key()).join(kept.select(F.col("doc_id").alias(own), F.col("row").alias(other)), (F.col(key) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(own)))
    return joined.dropDuplicates([key, "doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
