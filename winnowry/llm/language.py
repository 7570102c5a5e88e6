"""Language of documents by interpolated Kneser-Ney models of characters, one for each language.

Texts become runs of symbols: letters without case - ``a`` to ``z`` are their own, all others share 37 symbols by hash - with one gap between
words. Spark counts runs of four symbols of each language over all documents that it may learn from; continuation counts, discounts
and interpolation follow from them. A model is a sorted array of the hashes of the runs that were seen (24 bits,
their symbols) with a log-probability for each language, and tables of the shorter runs. A document's language has
the lowest cross-entropy per symbol. Scores are a softmax of entropies whose temperature is fitted, like the cut of each language beyond which a document is
``rejected``, on all learned documents, of which ``REJECTED`` lie beyond: Spark adds up the losses and counts the ranks.

A model holds at most 2 ** 24 runs whatever the corpus, so its size is bounded; languages that together exceed ``MODEL_BYTES`` are scored by several passes over the
row, in one chain. The driver holds one group's arrays at a time; nothing of single documents comes to it.

Defined results: a null text and one without letters are ``und`` with score 0; so is every text where nothing was learned; a null lang or
id is never learned from, a null id is not held out; ties go to the first language by name; equal rows have equal results; an empty table
gives none; a very long text is read whole, as a piece of its own of some forty bytes a byte; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm.staging import small_batches, staged, unused
from winnowry.llm.textops import pieces

FOLDS, OUT = 4, 2
ORDER, BITS = 4, 6
#: Symbols; runs of one to four.
A1, A2, A3 = 1 << BITS, 1 << 2 * BITS, 1 << 3 * BITS
MODEL_BYTES = 128 << 20
REJECTED = 0.001
#: Bins of a language's values that a round of the search for its quantile counts.
BINS = 1024
UNKNOWN = "und"
#: Runs that a task holds before it hands on counts, and symbols that are looked up at once.
HELD, AT_ONCE = 1 << 20, 1 << 20


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == OUT, F.lit(False))


_symbols: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 if no letter."""
    if not _symbols:
        table = np.zeros(0x110000, np.uint8)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                low = ord(c.lower()[0])
                table[ord(c)] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % (1 << 32) % 37
        _symbols.append(table)
    return _symbols[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and each text's first; bytes that are not UTF-8 give some code point."""
    lead = (data & 0xC0) != 0x80
    first = np.concatenate([[0], np.cumsum(lead)])[offsets]
    at = np.flatnonzero(lead)
    out = data[at].astype(np.uint32)
    high = np.flatnonzero(out >= 0xC0)
    if len(high):
        more = np.concatenate([data, np.zeros(3, np.uint8)])
        place, b = at[high], out[high]
        n = 1 + (b >= 0xE0) + (b >= 0xF0)
        value = b & (0x3F >> n)
        for k in (1, 2, 3):
            value = np.where(n >= k, value << 6 | (more[place + k] & 0x3F), value)
        out[high] = np.minimum(value, 0x10FFFF)
    return out, first


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of the texts with the three before it, as one number, and each text's first of them. A text begins and ends with a gap."""
    points, first = code_points(data, offsets)
    sym = symbol_table()[points]
    before = np.concatenate([[0], sym[:-1]]).astype(np.uint8) if len(sym) else sym
    before[first[:-1][first[:-1] < len(sym)]] = 0
    kept = (sym != 0) | (before != 0)
    count = np.concatenate([[0], np.cumsum(kept)])[first]
    sym, size = sym[kept], np.diff(count)
    ends = np.zeros(len(size), bool)
    ends[size > 0] = sym[count[1:][size > 0] - 1] != 0
    start = np.concatenate([[0], np.cumsum(size + 4)])
    line = np.zeros(start[-1] + 3, np.uint32)
    line[np.arange(len(sym)) + np.repeat(4 * np.arange(len(size)) + 3, size)] = sym
    keys = line[:-3] << np.uint32(18) | line[1:-2] << np.uint32(12) | line[2:-1] << np.uint32(6) | line[3:]
    size = size + ends
    first = np.concatenate([[0], np.cumsum(size)])
    return keys[np.arange(first[-1]) + np.repeat(start[:-1] - first[:-1], size)], first


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the runs of each language in a task's texts."""
    found: dict[str, list] = {}
    held = 0

    def merged():
        for lang, parts in found.items():
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            yield lang, keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def out():
        for lang, keys, n in merged():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array(n)], ["lang", "run", "n"])

    for piece, data, offsets in pieces(batches):
        keys, first = runs(data, offsets)
        codes = piece.column("lang").dictionary_encode()
        of = np.repeat(codes.indices.to_numpy(), np.diff(first))
        for i, lang in enumerate(codes.dictionary.to_pylist()):
            each, n = np.unique(keys[of == i], return_counts=True)
            found.setdefault(lang, []).append((each, n))
            held += len(each)
        if held > HELD:
            found = {lang: [(keys, n)] for lang, keys, n in merged()}
            held = sum(len(p[0][0]) for p in found.values())
            if held > HELD // 2:
                yield from out()
                found, held = {}, 0
    yield from out()


def discount(n: np.ndarray) -> float:
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    return min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)


class Tables:
    """One language's interpolated estimates from its counts of runs of four."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.n = keys[order].astype(np.int64), n[order].astype(np.float64)
        three = np.bincount(self.keys % A3, minlength=A3).astype(np.float64)  # in how many ways a run is continued to the left
        two = (three.reshape(A1, A2) > 0).sum(0).astype(np.float64)
        one = (two.reshape(A1, A1) > 0).sum(0).astype(np.float64)
        p = np.full(1, 1 / A1)
        for c in (one, two, three):
            rows = c.reshape(-1, A1)
            d, total, kinds = discount(c), rows.sum(1, keepdims=True), (rows > 0).sum(1, keepdims=True)
            rest = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            lower = np.tile(p.reshape(-1, A1) if len(p) > 1 else p, (len(rows) * A1 // max(len(p), A1), 1))
            p = (np.maximum(rows - d, 0) / np.maximum(total, 1) + rest * lower).reshape(-1)
        self.short = p
        context = self.keys // A1
        self.total, kinds = np.bincount(context, self.n, A3), np.bincount(context, minlength=A3)
        self.discount = discount(self.n)
        self.rest = np.where(self.total > 0, self.discount * kinds / np.maximum(self.total, 1), 1.0)

    def of(self, runs: np.ndarray) -> np.ndarray:
        """Probabilities of the last symbol of each run after its first three."""
        at = np.minimum(np.searchsorted(self.keys, runs), len(self.keys) - 1)
        seen = np.where(self.keys[at] == runs, np.maximum(self.n[at] - self.discount, 0), 0) / np.maximum(self.total[runs // A1], 1)
        return seen + self.rest[runs // A1] * self.short[runs % A3]


def model(counts: pa.Table, langs: list[str]) -> dict:
    """Arrays of a group of languages: log-probabilities of the seen runs of four, of runs of three, and of what a context leaves to them."""
    of, keys, n = counts.column("lang").to_numpy(zero_copy_only=False), counts.column("run").to_numpy(), counts.column("n").to_numpy()
    tables = [Tables(keys[of == lang], n[of == lang]) for lang in langs]
    seen = np.unique(keys).astype(np.int64)
    log = lambda columns: np.stack([np.log(c).astype(np.float32) for c in columns], axis=1)
    return {"keys": seen.astype(np.uint32), "four": log([t.of(seen) for t in tables]), "three": log([t.short for t in tables]), "rest": log([t.rest for t in tables])}


def entropies(shared, into: str, symbols: str) -> Callable:
    """A pass over rows that appends each language's cross-entropy per symbol (nats) to a column and sets that of symbols; 0 without letters."""

    def run(batches):
        m = shared.value
        keys, wide = m["keys"], m["four"].shape[1]
        for piece, data, offsets in pieces(batches):
            found, first = runs(data, offsets)
            size = np.diff(first)
            total = np.zeros((len(size), wide))
            for lo in range(0, len(found), AT_ONCE):
                now = found[lo : lo + AT_ONCE]
                at = np.minimum(np.searchsorted(keys, now), len(keys) - 1)
                logs, new = m["four"][at], np.flatnonzero(keys[at] != now)
                logs[new] = m["rest"][now[new] // A1] + m["three"][now[new] % A3]
                of = np.searchsorted(first, np.arange(lo, lo + len(now)), "right") - 1
                low = of[0]
                for i in range(wide):
                    part = np.bincount(of - low, logs[:, i])
                    total[low : low + len(part), i] += part
            h = -total / np.maximum(size, 1)[:, None]
            old = piece.column(into).flatten().to_numpy()
            every = np.concatenate([old.reshape(len(size), len(old) // len(size)), h], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * every.shape[1], pa.int32()), pa.array(every.reshape(-1)))
            columns = {name: piece.column(name) for name in piece.schema.names} | {into: lists, symbols: pa.array(size)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def quantiles(values: DataFrame, q: float) -> dict[int, float]:
    """The q-quantile of each group's values, the higher one where it lies between two. values: (i, x).

    Rounds count values in bins between bounds that narrow around the rank, until one value is left; no group is sorted or held in a task.
    """
    open_ = {r.i: (r.lo, r.hi, int(np.ceil(q * (r.n - 1)))) for r in values.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    done: dict[int, float] = {}
    while open_:
        for i in [i for i, (lo, hi, _) in open_.items() if lo == hi]:
            done[i] = open_.pop(i)[0]
        if not open_:
            break
        lo, hi = (F.create_map(*[F.lit(v) for i, found in open_.items() for v in (i, found[k])])[F.col("i")] for k in (0, 1))
        place = F.least(F.floor((F.col("x") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        bins: dict[int, list] = {}
        for r in values.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy("i", place.alias("bin")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).collect():
            bins.setdefault(r.i, []).append(r)
        for i, found in bins.items():
            rank = open_[i][2]
            for r in sorted(found, key=lambda r: r.bin):
                if rank < r.n:
                    break
                rank -= r.n
            open_[i] = (r.lo, r.hi, rank)
    return done


class Identifier:
    """Models of the languages of a corpus and their calibration."""

    def __init__(self, learn: DataFrame) -> None:
        """learn: (doc_id, text, lang), all documents that may be learned from."""
        self.spark: SparkSession = learn.sparkSession
        small_batches(self.spark)
        known = learn.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
        tallied = known.select("text", "lang").mapInArrow(tally, "lang string, run int, n long")
        counts = staged(tallied.groupBy("lang", "run").agg(F.sum("n").alias("n")), "runs")
        sizes = {r.lang: r["count"] for r in counts.groupBy("lang").count().collect()}
        self.langs = sorted(sizes)
        self.shared = []
        for group in self.groups(sizes):
            self.shared.append(self.spark.sparkContext.broadcast(model(counts.where(F.col("lang").isin(group)).toArrow(), group)))
        self.beta, self.cuts = self.calibrated(known)

    def groups(self, sizes: dict[str, int]) -> list[list[str]]:
        """Languages whose models fit ``MODEL_BYTES`` together, in order; one by itself at least."""
        out: list[list[str]] = []
        runs_ = 0
        for lang in self.langs:
            if out and (runs_ + sizes[lang]) * 4 * (len(out[-1]) + 2) + 8 * A3 * (len(out[-1]) + 1) <= MODEL_BYTES:
                out[-1].append(lang)
                runs_ += sizes[lang]
            else:
                out.append([lang])
                runs_ = sizes[lang]
        return out

    def measured(self, docs: DataFrame) -> tuple[DataFrame, str, str]:
        """Adds to rows that have a text column entropies and symbols, in columns of the names returned, which the rows don't have."""
        h, n = unused(docs, "h"), unused(docs, "n")
        docs = docs.withColumn(h, F.expr("cast(array() as array<double>)")).withColumn(n, F.lit(0).cast("long"))
        for shared in self.shared:
            docs = docs.mapInArrow(entropies(shared, h, n), docs.schema)
        return docs, h, n

    def calibrated(self, known: DataFrame) -> tuple[float, list[float]]:
        """The temperature under which all learned documents' languages are likeliest, and the cut of each language."""
        none = [x for _ in self.langs for x in (0.0, float("inf"))]
        if not self.langs:
            return 1.0, none
        every, h, n = self.measured(known.select("text", "lang"))
        right = F.array_position(F.array(*map(F.lit, self.langs)), F.col("lang")).cast("int") - 1
        rows = staged(every.where(F.col(n) > 0).select(right.alias("i"), F.col(h).alias("h"), F.sqrt(F.col(n)).alias("root")), "entropies")
        exact = lambda x: x.cast("decimal(28,9)")  # noqa: E731  # sums that don't depend on the order
        betas = [2.0**e for e in np.arange(-3, 9, 0.5)]
        z = lambda beta, x: -F.lit(float(beta)) * F.col("root") * (x - F.array_min("h"))
        loss = lambda beta: F.log(F.aggregate("h", F.lit(0.0), lambda a, x: a + F.exp(z(beta, x)))) - z(beta, F.get("h", F.col("i")))
        losses = rows.agg(*[F.sum(exact(loss(b))).alias(f"b{k}") for k, b in enumerate(betas)]).first()
        if losses[0] is None:
            return 1.0, none
        beta = betas[min(range(len(betas)), key=lambda k: losses[k])]
        own = rows.select("i", "root", F.get("h", F.col("i")).alias("x"), F.array_min("h").alias("least"), (F.array_position("h", F.array_min("h")) - 1 == F.col("i")).alias("own")).where("own")
        means = {r.i: float(r.s) / r.n for r in own.groupBy("i").agg(F.sum(exact(F.col("x"))).alias("s"), F.count(F.lit(1)).alias("n")).collect()}
        mean = F.get(F.array(*[F.lit(means.get(i, 0.0)) for i in range(len(self.langs))]), F.col("i"))
        beyond = quantiles(own.select("i", ((F.col("x") - mean) * F.col("root")).alias("x")), 1 - REJECTED)
        return float(beta), [x for i in range(len(self.langs)) for x in (means.get(i, 0.0), beyond.get(i, float("inf")))]

    def predict(self, docs: DataFrame) -> DataFrame:
        """docs: (text, ...). Adds lang_pred, score, n_symbols, entropy (bits per symbol) and rejected, in place of text."""
        names = F.array(*map(F.lit, self.langs)) if self.langs else F.expr("cast(array() as array<string>)")
        measured, h, n = self.measured(docs)
        z = lambda x: -F.lit(self.beta) * F.sqrt(F.col(n)) * x
        lowest = F.array_min(h)
        best = (F.array_position(h, lowest) - 1).cast("int")
        share = 1 / F.aggregate(h, F.lit(0.0), lambda a, x: a + F.exp(z(x) - z(lowest)))
        cuts = F.array(*[F.lit(float(x)) for x in self.cuts]) if self.langs else F.expr("cast(array() as array<double>)")
        beyond = (lowest - F.get(cuts, 2 * best)) * F.sqrt(F.col(n)) > F.get(cuts, 2 * best + 1)
        lettered = (F.col(n) > 0) & (F.size(h) > 0)
        own = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
        return measured.select(*own, F.when(lettered, F.get(names, best)).otherwise(UNKNOWN).alias("lang_pred"), F.when(lettered, share).otherwise(0.0).alias("score"), F.col(n).alias("n_symbols"), F.when(lettered, lowest / float(np.log(2))).alias("entropy"), F.coalesce(lettered & beyond, F.lit(False)).alias("rejected"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    known = Identifier(docs.where(~held_out()))
    return known.predict(docs.select("doc_id", held_out().alias("held_out"), "text"))
