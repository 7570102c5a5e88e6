"""Benchmark decontamination by one Aho-Corasick automaton over normalised items.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. An
item's windows are its runs of ``window`` words; an item of fewer words is one window.
Every text is scanned once, whole, by an automaton of all windows (words joined and
surrounded by one space); each hit is mapped back to words, and those to code points
of the original text.

Defined results: a null or wordless text has no words and no hits; an item without
words or without an id takes no part; repeated rows give a row each; other columns
of the inputs are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm.staging import row_key, small_batches, unused
from winnowry.llm.textops import WORDS, pieces, spans

WINDOW = 13
#: Bytes of item text in one automaton, about 100 MB of it in memory. Items beyond go to further automata.
AUTOMATON_BYTES = 4 << 20
SCHEMA = "doc_id long, n_words long, items array<string>, hits array<struct<first:long,last:long,start:long,end:long>>"

_built: dict[str, object] = {}


def windows(words: list[bytes], n: int) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(max(1, len(words) - n + 1))] if words else []


def normalised(text: str | None) -> list[bytes]:
    return np.append(WORDS, 0).astype(np.uint8)[np.frombuffer((text or "").encode() + b" ", np.uint8)].tobytes().replace(b"\0", b" ").split()


def automaton(items: list[tuple[str, str]], n: int):
    """Of (item id, text); each key carries its number of words and the ids that hold it."""
    import ahocorasick

    held: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        for w in windows(normalised(text), n):
            held[w].add(item)
    made = ahocorasick.Automaton()
    for w, ids in held.items():
        made.add_word(w.decode(), (w.count(b" ") - 1, tuple(sorted(ids))))
    made.make_automaton()
    return made


def scan(shared, n: int):
    """A function for mapInArrow; the automaton is built once in a Python worker."""

    def run(batches):
        items = shared.value
        if (key := hashlib.sha256(repr((n, items)).encode()).hexdigest()) not in _built:
            _built.clear()
            _built[key] = automaton(items, n) if items else None
        made = _built[key]
        for rows, data, offsets in pieces(batches):
            mapped = WORDS[data]
            starts, ends, first = spans(mapped, offsets)
            out_items: list[list[str]] = [[] for _ in range(len(first) - 1)]
            out_hits: list[list[dict]] = [[] for _ in range(len(first) - 1)]
            if made is not None and len(made) and len(starts):
                joined, begin = joined_words(mapped, starts, ends, first)
                for d in np.flatnonzero(np.diff(first)):
                    text = joined[begin[d] : begin[d + 1]].tobytes().decode()
                    found = list(made.iter(text))
                    if found:
                        space = [i for i, c in enumerate(text) if c == " "]
                        out_items[d] = sorted({x for _, (_, ids) in found for x in ids})
                        out_hits[d] = merged([(w := bisect.bisect_left(space, at) - size, w + size) for at, (size, _) in found], rows.column("text")[d].as_py(), starts[first[d] : first[d + 1]] - offsets[d], ends[first[d] : first[d + 1]] - offsets[d])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(first)), pa.array(out_items, pa.list_(pa.string())), pa.array(out_hits, pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")])))], ["doc_id", "n_words", "items", "hits"])

    return run


def joined_words(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``" w1 w2 ... wn "`` of each text that has words, and where each begins."""
    size = ends - starts
    has = (np.diff(first) > 0).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(np.add.reduceat(np.append(size + 1, 0), first[:-1]) * has + has)])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) + np.cumsum(has)[doc]  # each earlier text with words has one space more
    out = np.full(begin[-1], 32, np.uint8)
    step = np.ones(int(size.sum()), np.int64)
    ahead = np.cumsum(size)[:-1]
    src, dst = step.copy(), step
    src[0], dst[0] = starts[0], at[0]
    src[ahead] = starts[1:] - ends[:-1] + 1
    dst[ahead] = at[1:] - (at[:-1] + size[:-1]) + 1
    out[np.cumsum(dst)] = mapped[np.cumsum(src)]
    return out, begin


def merged(found: list[tuple[int, int]], text: str, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Maximal runs of hit words, with their code points in the original."""
    runs: list[list[int]] = []
    for lo, hi in sorted(found):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    raw = np.frombuffer(text.encode(), np.uint8)
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"first": lo, "last": hi - 1, "start": int(point[starts[lo]]), "end": int(point[ends[hi - 1]])} for lo, hi in runs]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, the items (as strings, sorted) with a window in it, and the
    maximal runs of hit words with their places in words and in the text's code points.

    Items go to the tasks as a broadcast of at most ``AUTOMATON_BYTES``; a larger benchmark
    is dealt to several automata, and the hits of all are merged.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // AUTOMATON_BYTES) or 1
    if blocks > 1:
        return merge_blocks(docs, items, window, blocks)
    shared = spark.sparkContext.broadcast(sorted((r[0], r[1]) for r in items.collect()))
    return docs.select("doc_id", "text").mapInArrow(scan(shared, window), SCHEMA)


def merge_blocks(docs: DataFrame, items: DataFrame, window: int, blocks: int) -> DataFrame:
    """All blocks' hits of a document, by one chain of scans: each scan adds to the row what its automaton finds."""
    spark = docs.sparkSession
    got = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.expr("array()").cast("array<string>").alias("items"), F.expr("array()").cast("array<struct<first:long,last:long,start:long,end:long>>").alias("hits"))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(sorted((r[0], r[1]) for r in part.collect()))
        got = got.mapInArrow(chained(shared, window), f"{SCHEMA}, text string").select("doc_id", "text", "n_words", "items", "hits")
    return got.drop("text")


def chained(shared, n: int):
    one = scan(shared, n)

    def run(batches):
        for batch in batches:
            at = 0
            for found in one([batch]):
                old = batch.slice(at, found.num_rows)
                at += found.num_rows
                items = [sorted({*a, *b}) for a, b in zip(old.column("items").to_pylist(), found.column("items").to_pylist(), strict=True)]
                hits = [union(a, b) for a, b in zip(old.column("hits").to_pylist(), found.column("hits").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([found.column("doc_id"), found.column("n_words"), pa.array(items, pa.list_(pa.string())), pa.array(hits, found.column("hits").type), old.column("text")], ["doc_id", "n_words", "items", "hits", "text"])

    return run


def union(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(a + b, key=lambda r: r["first"]):
        if out and x["first"] <= out[-1]["last"] + 1:
            if x["last"] > out[-1]["last"]:
                out[-1] |= {"last": x["last"], "end": x["end"]}
        else:
            out.append(dict(x))
    return out


def judged(found: DataFrame) -> DataFrame:
    """n_hit, and contaminated: at least a twentieth of the words are hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = judged(find_contamination(docs.select(row_key().alias("doc_id"), "text"), benchmark, window)).where("contaminated").select(F.col("doc_id").alias("row")).distinct()
    key, other = unused(docs, "key"), unused(docs, "other")
    return docs.withColumn(key, row_key()).join(bad.withColumnRenamed("row", other), F.col(key) == F.col(other), "left_anti").drop(key)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
with dw as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
ig as (select distinct item, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as g from (select item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) as i from iw where len(w) > 0)),
sizes as (select distinct n from ig),
dg as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select r, n, w, unnest(generate_series(1, len(w) - n + 1)) as i from dw, sizes where len(w) >= n)),
hit as (select distinct dg.r, dg.i, dg.n, ig.item from dg join ig on dg.n = ig.n and dg.g = ig.g),
words as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as p from (select distinct r, i, n from hit)) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit) group by r)
select dw.doc_id, len(dw.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(dw.w) as contaminated
from dw left join words using (r) left join items using (r)
"""
