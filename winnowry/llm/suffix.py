"""Removal of long repeated byte strings, by prefix-free parsing.

Texts are parsed by a rolling hash over ``GRAM`` bytes: a trigger is a place whose hash is the
least of those in a string of ``LENGTH`` bytes. Triggers depend on the bytes around
them alone, so equal strings have equal triggers, and every string has one. A phrase
is the stretch of all strings that share a trigger.

Of the corpus order that the phrases' suffixes define, only one thing is asked: which
strings share their first ``LENGTH`` bytes with a neighbour. So suffixes are put into classes by that
depth, not into a total order: phrases first (the dictionary, by the hash of their trigger and one of all they
hold modulo the prime 2**61 - 1), and what is equal as a whole is settled there. Only phrases that share a trigger
but differ elsewhere are split, into stretches of ``STRETCH`` starts and then into single ones; of equal
phrases one goes on. A stretch of highly repetitive text thus costs one row a phrase.

Defined results: null text is empty; strings never cross texts; equal rows repeat each
other; an empty table gives none; other columns are not read; texts shorter than ``LENGTH`` stay whole; what is kept is bytes, as a cut may fall inside a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm.staging import row_key, small_batches, staged
from winnowry.llm.textops import Rolling, Stretches, mix, pieces, signed

LENGTH, GRAM, STRETCH = 400, 128, 16
RECORD = "row long, core long, ext long, lo int, hi int, at int"
NAMES = ["row", "core", "ext", "lo", "hi", "at"]


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of width values."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    rows = padded.reshape(-1, width)
    fore = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


def parse(length: int, gram: int):
    """For mapInArrow: the phrases of each text, with their trigger's and whole hash."""

    def run(batches):
        for rows, data, offsets in pieces(batches):
            size = np.diff(offsets)
            if not (size >= length).any():
                continue
            first, second = Rolling(data, 1), Stretches(data, 2)
            at = np.arange(len(data) - gram + 1)
            bits = np.uint64(int(len(data)).bit_length())
            keyed = first.of(at, at + gram) >> bits << bits | at.astype(np.uint64)
            least = sliding_least(keyed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
            inside = np.zeros(len(data) + 1, np.int32)
            long = np.flatnonzero(size >= length)
            inside[offsets[long]] += 1
            inside[offsets[long + 1] - length + 1] -= 1
            x = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
            trigger = least[x].astype(np.int64)
            cut = np.flatnonzero(np.diff(trigger)) + 1
            lo, hi = x[np.concatenate([[0], cut])], x[np.concatenate([cut, [len(x)]]) - 1]
            a = trigger[np.concatenate([[0], cut])]
            doc = np.searchsorted(offsets, a, "right") - 1
            o = offsets[doc]
            yield pa.RecordBatch.from_arrays([rows.column("row").take(pa.array(doc)), pa.array(signed(first.of(a, a + gram))), pa.array(signed(second.of(lo, hi + length))), *(pa.array((y - o).astype(np.int32)) for y in (lo, hi, a))], NAMES)

    return run


def split(length: int, stretch: int):
    """For mapInArrow over (row, text, parts): each part's stretches of starts, aligned to its trigger."""

    def run(batches):
        for rows, data, offsets in pieces(batches):
            first, second = Rolling(data, 1), Stretches(data, 2)
            parts = rows.column("parts")
            flat = parts.flatten()
            n = np.diff(parts.offsets.to_numpy())
            o = np.repeat(offsets[:-1], n)
            lo, hi, at = (flat.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "at"))
            near, far = (at - hi) // stretch, (at - lo) // stretch
            each = far - near + 1
            t = np.repeat(near, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            lo, hi, at, o = (np.repeat(y, each) for y in (lo, hi, at, o))
            row = np.repeat(np.repeat(rows.column("row").to_numpy(), n), each)
            lo, hi = np.maximum(lo, at - t * stretch - stretch + 1), np.minimum(hi, at - t * stretch)
            start = at - t * stretch + o
            core = first.of(start, start - stretch + 1 + length) ^ mix(t.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(signed(core)), pa.array(signed(second.of(lo + o, hi + o + length))), *(pa.array(y.astype(np.int32)) for y in (lo, hi, at))], NAMES)

    return run


def classed(records: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Records equal to another as a whole, and one of each that shares its core with a different one."""
    common = records.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    shared = staged(records.join(common, "core"), name)
    whole = staged(shared.groupBy("core", "ext").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "lo", "hi", "at")).alias("one")), name)
    equal = shared.join(whole.where("n > 1").select("core", "ext"), ["core", "ext"], "left_semi").select("row", "lo", "hi")
    apart = whole.join(whole.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core"), "core").select("one.*")
    return equal, apart


def remove(length: int):
    def run(batches):
        for rows, data, offsets in pieces(batches):
            spans = rows.column("spans").to_pylist()
            out = []
            for d, found in enumerate(spans):
                own = data[offsets[d] : offsets[d + 1]]
                edge = np.zeros(len(own) + 1, np.int32)
                for s in found or ():
                    edge[s["lo"]] += 1
                    edge[s["hi"] + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                begins = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
                out.append((len(own), int(gone.sum()), begins, own[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept, the bytes outside strings of ``length`` bytes that start anywhere else too."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text", row_key().alias("row"))
    phrases = staged(texts.mapInArrow(parse(length, gram), RECORD), "phrases")
    whole, apart = classed(phrases, "phrases")
    parts = apart.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("parts"))
    wanted = staged(texts.select("row", "text").join(parts, "row").dropDuplicates(["row"]), "texts")
    stretched, single = classed(staged(wanted.mapInArrow(split(length, STRETCH), RECORD), "stretches"), "stretches")
    parts = single.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("parts"))
    again = wanted.select("row", "text").join(parts, "row")
    alone, _ = classed(staged(again.mapInArrow(split(length, 1), RECORD), "starts"), "starts")
    spans = whole.union(stretched).union(alone).distinct().groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return texts.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
