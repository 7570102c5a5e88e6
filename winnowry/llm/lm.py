"""Language-model scores by context-tree weighting over binary-decomposed bytes.

Each byte is eight binary decisions. A decision's node is its context of 0 to ``DEPTH``
bytes and the bits of the byte so far; counts of both outcomes come from all training
texts. A node's Krichevsky-Trofimov block probability is mixed half and half with the product of
its children's weighted probabilities, from the deepest contexts up; a prediction mixes
the nodes on its path by the resulting posteriors. A text's bytes are followed by one
end symbol (0xFF, which UTF-8 never holds) and preceded by end symbols as context.

Besides, unigram counts of tokens give each text a base score.

What is counted (grams, tokens) is summed in the tasks before it is shuffled. For
scoring, documents are dealt into blocks of about ``BLOCK_BYTES`` of text by hash; a block asks once
for each distinct gram and token it holds, and gets their values back beside its texts. Nothing grows in one place.

Defined results: null text is empty and has the end alone; a null doc_id learns and is
not held out; equal rows count each and score alike; an empty table gives none; other columns
are not read; a text longer than a block is a block's alone; without training texts every bit has probability 1/2, and counts are 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm.minhash import LOWER
from winnowry.llm.staging import small_batches, staged
from winnowry.llm.textops import TOKENS, hash_runs, pieces, spans

DEPTH = 3
FOLDS, HELD = 7, 2
BLOCK_BYTES = 10 << 20
END = 0xFF


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def byte_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context of DEPTH bytes, byte) of every byte and end as one number, and each text's first."""
    n = np.diff(offsets)
    begin = np.concatenate([[0], np.cumsum(n + DEPTH + 1)])
    padded = np.full(begin[-1], END, np.uint32)
    doc = np.repeat(np.arange(len(n)), n)
    padded[np.arange(len(data)) + (doc + 1) * DEPTH + doc] = data
    gram = padded[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        gram |= padded[DEPTH - d : len(padded) - d] << np.uint32(8 * d)
    keep = np.ones(len(gram), bool)
    for d in range(DEPTH):
        keep[begin[1:-1] - DEPTH + d] = False  # what would begin in the next text's padding
    return gram[keep], np.concatenate([[0], np.cumsum(n + 1)])


def distinct_tokens(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct tokens, lower-cased, and how often each stands."""
    _, at, n = np.unique(hashes, return_index=True, return_counts=True)
    low = LOWER[data].tobytes()
    return pa.array([low[starts[i] : ends[i]] for i in at], pa.binary()), n


def count(batches):
    """For mapInArrow: counts of tokens and grams, summed over what a piece holds."""
    for _, data, offsets in pieces(batches, limit=4 << 20):
        starts, ends, _ = spans(TOKENS[data], offsets)
        tokens, n = distinct_tokens(data, starts, ends, hash_runs(LOWER[data], starts, ends))
        grams, m = np.unique(byte_grams(data, offsets)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([tokens, pa.nulls(len(grams), pa.binary())]), pa.array(np.concatenate([np.zeros(len(n), np.int64), grams.astype(np.int64)])), pa.array(np.concatenate([n, m]).astype(np.int64))], ["token", "gram", "n"])


def ask(batches):
    """For mapInArrow over texts of blocks: the distinct tokens and grams of each block in a batch."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for b in np.unique(blocks):
            for _, data, offsets in pieces([batch.filter(pa.array(blocks == b))], limit=4 << 20):
                starts, ends, _ = spans(TOKENS[data], offsets)
                tokens, _ = distinct_tokens(data, starts, ends, hash_runs(LOWER[data], starts, ends))
                grams = np.unique(byte_grams(data, offsets)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens) + len(grams), b, np.int32)), pa.concat_arrays([tokens, pa.nulls(len(grams), pa.binary())]), pa.array(np.concatenate([np.zeros(len(tokens), np.int64), grams.astype(np.int64)]))], ["block", "token", "gram"])


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, to about 1e-12: Stirling's series, shifted by eight."""
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def kt(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - math.log(math.pi)


def decisions(grams: DataFrame, *kept: str) -> DataFrame:
    """A row for each of a gram's eight bits: context, node (a one before the bits so far) and bit."""
    byte = F.col("gram").bitwiseAND(F.lit(255))
    at = grams.select("gram", *kept, F.shiftright("gram", 8).alias("context"), byte.alias("byte"), F.explode(F.array(*[F.lit(i) for i in range(8)])).alias("i"))
    node = F.expr("shiftright(byte + 256, 8 - i)")
    return at.select("gram", *kept, "context", node.cast("int").alias("node"), F.expr("shiftright(byte, 7 - i) & 1").cast("int").alias("bit"))


def tree(grams: DataFrame) -> list[DataFrame]:
    """Nodes of each depth, 0 first: context, node, zeros, ones, and share, the weight of the node's own estimate."""
    out = []
    level = decisions(grams, "n").groupBy("context", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"))
    level = level.withColumn("pe", kt(F.col("zeros"), F.col("ones"))).withColumn("pw", F.col("pe")).withColumn("share", F.lit(1.0))
    for depth in range(DEPTH, -1, -1):
        level = staged(level, f"depth{depth}")
        out.append(level.select("context", "node", "zeros", "ones", "share"))
        if depth:
            shorter = F.col("context").bitwiseAND(F.lit((1 << (8 * (depth - 1))) - 1))
            level = level.groupBy(shorter.alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("below"))
            level = level.withColumn("pe", kt(F.col("zeros"), F.col("ones")))
            high = F.greatest("pe", "below")
            level = level.withColumn("pw", high + F.log(0.5 * (F.exp(F.col("pe") - high) + F.exp(F.col("below") - high))))
            level = level.withColumn("share", F.exp(F.lit(math.log(0.5)) + F.col("pe") - F.col("pw")))
    return out[::-1]


def gram_values(asked: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(gram, value): log10 of the probability of the gram's byte after its context."""
    rows = decisions(asked)
    p = None
    for depth, level in enumerate(levels):
        mask = (1 << (8 * depth)) - 1
        named = level.select(F.col("context").alias(f"c{depth}"), F.col("node").alias(f"v{depth}"), F.col("zeros").alias(f"z{depth}"), F.col("ones").alias(f"o{depth}"), F.col("share").alias(f"s{depth}"))
        rows = rows.join(named, (F.col("context").bitwiseAND(F.lit(mask)) == F.col(f"c{depth}")) & (F.col("node") == F.col(f"v{depth}")), "left")
    for depth in range(DEPTH, -1, -1):
        z, o = F.coalesce(f"z{depth}", F.lit(0)), F.coalesce(f"o{depth}", F.lit(0))
        own = (F.when(F.col("bit") == 1, o).otherwise(z) + 0.5) / (z + o + 1.0)
        share = F.coalesce(f"s{depth}", F.lit(1.0))
        p = own if p is None else share * own + (1 - share) * p
        rows = rows.withColumn(f"p{depth}", p)
        p = F.col(f"p{depth}")
    return rows.groupBy("gram").agg(F.sum(F.log10("p0")).alias("value"))


def rate(block, texts: pa.Table, values: pa.Table) -> pa.Table:
    """For a cogroup: scores of a block's texts from the values that the block asked for."""
    grams = values.filter(pa.compute.is_null(values.column("token")))
    g = grams.column("gram").to_numpy()
    order = np.argsort(g)
    g, gv = g[order], grams.column("value").to_numpy()[order]
    known = values.filter(pa.compute.is_valid(values.column("token")))
    out = []
    if known.num_rows:
        col = known.column("token").combine_chunks()
        off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset).astype(np.int64)
        raw = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
        th = hash_runs(raw, off[:-1] - off[0], off[1:] - off[0])
    else:
        th = np.zeros(0, np.uint64)
    by = np.argsort(th)
    th, tv, tn = th[by], known.column("value").to_numpy()[by], known.column("n").to_numpy()[by]
    for rows, data, offsets in pieces(texts.to_batches()):
        every, first = byte_grams(data, offsets)
        score = np.add.reduceat(gv[np.searchsorted(g, every.astype(np.int64))], first[:-1])
        starts, ends, tfirst = spans(TOKENS[data], offsets)
        at = np.searchsorted(th, hash_runs(LOWER[data], starts, ends))
        base = np.concatenate([[0], np.cumsum(tv[at])])
        seen = np.concatenate([[0], np.cumsum(tn[at] > 0)])
        out.append(pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(tfirst)), pa.array(seen[tfirst[1:]] - seen[tfirst[:-1]]), pa.array(base[tfirst[1:]] - base[tfirst[:-1]]), pa.array(score), pa.array(np.diff(offsets))], ["doc_id", "words", "known", "base", "score", "n_bytes"]))
    return pa.Table.from_batches(out, RATED)


RATED = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte. learn: which rows are counted."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = docs.where(learn).select("text").mapInArrow(count, "token binary, gram long, n long").groupBy("token", "gram").agg(F.sum("n").alias("n"))
    counts = staged(counts, "counts")
    sums = counts.where("token is not null").agg(F.sum("n"), F.count(F.lit(1))).first()
    n_docs, total = docs.agg(F.sum(learn.cast("long")), F.sum(F.octet_length("text"))).first()
    n_train = (sums[0] or 0) + (n_docs or 0)  # words and ends
    distinct = sums[1] + (1 if n_docs else 0)
    below = math.log10(n_train + distinct + 1)
    levels = tree(counts.where("token is null").select("gram", "n"))

    blocks = max(1, -(-int(total or 0) // BLOCK_BYTES))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    by_block = dealt.repartition(blocks, "block")
    asked = staged(by_block.mapInArrow(ask, "block int, token binary, gram long").distinct(), "asked")
    values = staged(gram_values(asked.where("token is null").select("gram").distinct(), levels), "values")
    grams = asked.where("token is null").join(values, "gram").select("block", "token", "gram", "value", F.lit(0).cast("long").alias("n"))
    words = asked.where("token is not null").select("block", "token").join(counts.where("token is not null").select("token", "n"), "token", "left")
    words = words.select("block", "token", F.lit(0).cast("long").alias("gram"), (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - below).alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    rated = by_block.groupBy("block").cogroup(grams.union(words).groupBy("block")).applyInArrow(rate, "doc_id long, words long, known long, base double, score double, n_bytes long")
    end = math.log10((n_docs or 0) + 1) - below
    return rated.select("doc_id", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + (1 if n_docs else 0)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + end).alias("base_score"), "score", (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, ~held_out()).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
