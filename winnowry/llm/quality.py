"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. Emissions weigh the line's own features and those of the
lines before and after it; transitions weigh each pair of neighbouring labels. The
forward-backward marginals of "good", weighted by the lines' lengths, make the
document's score.

Training takes at most ``SAMPLE`` labelled documents (smallest hashes of their ids) whose
crc32(doc_id as text) mod 5 is not 0; their lines carry the document's label. Scoring reads the text alone.
Defined results: a null or empty text is one empty line and has a score; a doc_id that is
null is not held out and never learned from; several labels of a document count as their
mean; equal rows have equal scores; an empty table gives none; other columns are kept by ``keep_good`` whatever their names; with no labels, or those of one class only, all weights are 0 and scores 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm.staging import small_batches
from winnowry.llm.textops import WORDS, hash_runs, pieces, spans

#: Documents of the training sample.
SAMPLE = 6000
FOLDS = 5
ACCEPT = 0.3
OWN = 15
SCHEMA = "doc_id long, score double, n_lines long, good_lines long"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def classes() -> np.ndarray:
    """Class bits of each byte: letter, upper, digit, space, punctuation, symbol, bar, non-ASCII."""
    b = np.arange(256)
    upper, lower = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122)
    digit, space, high = (b >= 48) & (b <= 57), (b == 32) | ((b >= 9) & (b <= 13)), b >= 128
    plain = np.isin(b, np.frombuffer(b".,;:'\"()-?", np.uint8))
    bar, shout = (b == ord("|")), (b == ord("!"))
    symbol = ~(upper | lower | digit | space | high | plain | bar | shout)
    return np.stack([upper, lower, digit, space, plain, bar, shout, symbol, high])


CLASSES = classes()


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (own, then those of the lines before and after), their lengths, and each text's first line."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    at = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")  # a text begins a line, so does what follows a break
    first = np.arange(n_docs) + np.searchsorted(breaks, offsets[:-1])
    first = np.append(first, len(at))
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    starts = np.concatenate([[o, *(breaks[lo:hi] + 1)] for o, lo, hi in zip(offsets[:-1], np.searchsorted(breaks, offsets[:-1]), np.searchsorted(breaks, offsets[1:]), strict=True)]) if len(breaks) else offsets[:-1].copy()
    starts = starts.astype(np.int64)
    ends = np.append(starts[1:] - 1, offsets[-1])
    last = first[1:] - 1
    ends[last] = offsets[1:]
    size = (ends - starts).astype(np.float64)

    total = np.zeros(len(data) + 1, np.int32)
    counts = []
    for c in CLASSES:
        np.cumsum(c[data], out=total[1:])
        counts.append(total[ends] - total[starts])
    upper, lower, digit, space, plain, bar, shout, symbol, high = (x.astype(np.float64) for x in counts)

    mapped = WORDS[data]
    ws, we, wfirst = spans(mapped, offsets)
    wl = np.searchsorted(starts, ws, "right") - 1
    n_words = np.bincount(wl, minlength=len(starts)).astype(np.float64)
    letters = np.bincount(wl, we - ws, len(starts))
    hashes = hash_runs(mapped, ws, we)
    # words that a text has had before: how much it repeats itself
    wdoc = np.repeat(np.arange(n_docs), np.diff(wfirst)).astype(np.uint64)
    keyed = hashes ^ (wdoc * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    again = np.zeros(len(keyed), bool)
    again[order[1:]] = keyed[order[1:]] == keyed[order[:-1]]
    repeats = np.bincount(wl, again, len(starts))
    same = np.zeros(len(keyed), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (wl[1:] == wl[:-1])
    doubled = np.bincount(wl, same, len(starts))

    per = 1 / np.maximum(size, 1)
    by_word = 1 / np.maximum(n_words, 1)
    own = np.stack([np.log1p(size) / 5, np.log1p(n_words) / 4, upper * per, digit * per, plain * per, 5 * np.minimum(bar * per, 0.2), 5 * np.minimum(shout * per, 0.2), 5 * np.minimum(symbol * per, 0.2), high * per, space * per, letters * by_word / 8, repeats * by_word, doubled * by_word, (upper > lower).astype(float), (size == 0).astype(float)], 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[last] = 0
    edge_before, edge_after = np.zeros(len(own)), np.zeros(len(own))
    edge_before[first[:-1]] = edge_after[last] = 1
    n_lines = np.log1p(np.diff(first))[doc] / 4
    return np.column_stack([np.ones(len(own)), own, before, after, edge_before, edge_after, n_lines]), size, first


def logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def chain(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all texts side by side, line by line: log marginals of both labels, log partition, expected moves.

    emit: (lines, 2); move: (2, 2).
    """
    n, start = np.diff(first), first[:-1]
    fore, back = emit.copy(), np.zeros_like(emit)
    order = np.argsort(-n, kind="stable")
    lengths = n[order]
    alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    for t in range(1, len(alive)):
        i = start[order[: alive[t]]] + t
        f = fore[i - 1]
        fore[i] += np.stack([logsum(f[:, 0] + move[0, y], f[:, 1] + move[1, y]) for y in (0, 1)], 1)
    for t in range(len(alive) - 1, 0, -1):
        i = start[order[: alive[t]]] + t
        b = back[i] + emit[i]
        back[i - 1] = np.stack([logsum(b[:, 0] + move[x, 0], b[:, 1] + move[x, 1]) for x in (0, 1)], 1)
    end = first[1:] - 1
    whole = logsum(fore[end, 0], fore[end, 1])
    marginal = fore + back - np.repeat(whole, n)[:, None]
    inner = np.ones(len(emit), bool)
    inner[start] = False
    i = np.flatnonzero(inner)
    moves = np.stack([[np.exp(fore[i - 1, x] + move[x, y] + emit[i, y] + back[i, y] - np.repeat(whole, n)[i]).sum() for y in (0, 1)] for x in (0, 1)]) if len(i) else np.zeros((2, 2))
    return marginal, whole, moves


def train(features: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 300, ridge: float = 2e-3) -> dict:
    """Maximum conditional likelihood (per line, both classes alike) by Adam; returns weights and moves."""
    n, dims = len(features), features.shape[1]
    mean, scale = features.mean(0), features.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    x = (features - mean) / scale
    if len(set(label.tolist())) < 2:
        return {"mean": mean, "scale": scale, "weight": np.zeros(dims), "move": np.zeros((2, 2))}
    y = np.repeat(label, np.diff(first))
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    seen = np.zeros((2, 2))
    for a in (0, 1):
        seen[a, a] = (y[inner] == a).sum()
    theta = np.zeros(dims + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, move = theta[:dims], theta[dims:].reshape(2, 2)
        score = x @ w
        marginal, _, moves = chain(np.stack([-score / 2, score / 2], 1), move, first)
        grad = np.concatenate([x.T @ (y - np.exp(marginal[:, 1])), (seen - moves).ravel()]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"mean": mean, "scale": scale, "weight": theta[:dims], "move": theta[dims:].reshape(2, 2)}


def marginals(model: dict, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    score = ((features - model["mean"]) / model["scale"]) @ model["weight"]
    return np.exp(chain(np.stack([-score / 2, score / 2], 1), model["move"], first)[0][:, 1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Model from a bounded sample of labelled documents; the driver holds its texts' lines, ``4 * (4 + 3 * OWN)`` bytes each."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("quality") >= 0.5).cast("int").alias("label"))
    got = texts.mapInArrow(learn_rows, "doc_id long, label int, lines binary").collect()
    got.sort(key=lambda r: (r[0], r[1], len(r[2])))
    dims = 1 + 3 * OWN + 3
    parts = [np.frombuffer(r[2], np.float32).reshape(-1, dims) for r in got]
    if not parts:
        return {"mean": np.zeros(dims), "scale": np.ones(dims), "weight": np.zeros(dims), "move": np.zeros((2, 2))}
    return train(np.concatenate(parts).astype(float), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array([r[1] for r in got]))


def learn_rows(batches):
    for rows, data, offsets in pieces(batches):
        x, _, first = line_features(data, offsets)
        x = x.astype(np.float32)
        lines = pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("label").cast(pa.int32()), lines], ["doc_id", "label", "lines"])


def rate(shared):
    def run(batches):
        model = shared.value
        for rows, data, offsets in pieces(batches):
            x, size, first = line_features(data, offsets)
            good = marginals(model, x, first)
            weight = np.maximum(size, 1)
            score = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(np.clip(score, 0, 1)), pa.array(np.diff(first)), pa.array(np.add.reduceat((good >= 0.5).astype(np.int64), first[:-1]))], ["doc_id", "score", "n_lines", "good_lines"])

    return run


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, n_lines and good_lines of every row; the model is a few hundred numbers."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(rate(docs.sparkSession.sparkContext.broadcast(model)), SCHEMA)


def keep_good(docs: DataFrame, model: dict, least: float = ACCEPT) -> DataFrame:
    """``docs`` without what the model rejects; each text is rated in the pass that drops it."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, data, offsets in pieces(batches):
            good = [r.column("score").to_numpy() for r in rate(shared)([rows])]
            yield rows.filter(pa.array(np.concatenate(good) >= least))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), "n_lines", "good_lines")
