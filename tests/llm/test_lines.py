"""Lines with changes all over, short lines, and the hashes of grams by definition."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winnowry.llm import fuzzy, linededup, sketch
from winnowry.llm.edits import similar
from winnowry.llm.staging import shared_dir

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def changed(pick: random.Random, line: str, percent: int) -> str:
    out = list(line)
    letters = [i for i, c in enumerate(line) if c != " "]
    for i in pick.sample(letters, max(1, round(len(letters) * percent / 100))):
        out[i] = pick.choice(LETTERS)
    return "".join(out)


def spread_pairs(lengths, percents, count: int):
    """(key, x, y): ``count`` pairs of an edit similarity of 0.9 or more for each length in words and share of changed letters."""
    pick = random.Random(17)
    vocabulary = ["".join(pick.choice(LETTERS) for _ in range(pick.randint(2, 9))) for _ in range(3000)]
    for n in lengths:
        for percent in percents:
            made = 0
            while made < count:
                x = " ".join(pick.choice(vocabulary) for _ in range(n))
                y = changed(pick, x, percent)
                if x != y and similar([x], [y], linededup.SIMILAR)[0]:
                    made += 1
                    yield (n, percent), x, y


def test_changes_all_over_a_line(spark):
    pairs = list(spread_pairs((5, 8, 10, 20, 30, 60, 100), (3, 6), 30))
    rows = [(2 * i + j, line) for i, (_, x, y) in enumerate(pairs) for j, line in enumerate((x, y))]
    gone = {r.doc_id for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 1").collect()}
    assert all(i % 2 for i in gone)
    for percent, least in ((3, 0.97), (6, 0.9)):
        of = [2 * i + 1 in gone for i, (key, _, _) in enumerate(pairs) if key[1] == percent]
        assert sum(of) >= least * len(of)


def test_short_lines_and_lines_without_words(spark):
    rows = [(1, "Read more\n\n---\na"), (2, "read  MORE!\n\n---\nb"), (3, "read more.\nA\n"), (4, None), (5, "Read moré")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Read more\n\n---\na", 4, 0), 2: ("\n---\nb", 4, 1), 3: ("", 3, 2), 4: (None, 0, 0), 5: ("Read moré", 1, 0)}


@pytest.mark.parametrize("width", [fuzzy.FINE, fuzzy.SHORT, fuzzy.LONG])
def test_grams_by_definition(width):
    lines = ["a", "abc", "abcd", "abcdefgh", "bcdefghi", "ü" * 9]
    raw = [x.encode() for x in lines]
    hashes, first = fuzzy.grams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), width)
    of = {}
    for x, lo, hi in zip(raw, first, [*first[1:], len(hashes)], strict=True):
        parts = [x[i : i + width] for i in range(max(1, len(x) - width + 1))]
        assert len(parts) == hi - lo
        for part, h in zip(parts, hashes[lo:hi], strict=True):
            assert of.setdefault(part, h) == h
    assert len(set(of.values())) == len(of)


def test_keys_and_simhashes_by_loops(monkeypatch):
    pick = random.Random(4)
    lines = ["".join(pick.choice("abcd efgh") for _ in range(n)) for n in (1, 5, 99, 100, 111, 112, 700, 5000)] + [""]
    monkeypatch.setattr(fuzzy, "LANE", 1000)  # lines too long for the counters
    batch = pa.RecordBatch.from_arrays([pa.array([len(x) for x in lines], pa.int32()), pa.array(lines), pa.array(range(len(lines)))], ["size", "line", "id"])
    got = {r["id"]: r["keys"] for b in fuzzy.keyed([batch]) for r in b.to_pylist()}
    alone = {i: r["keys"] for i in range(len(lines)) for b in fuzzy.keyed([batch.slice(i, 1)]) for r in b.to_pylist()}
    assert got == alone and [len(got[i]) // fuzzy.BANDS for i in range(8)] == [1, 1, 1, 2, 2, 1, 1, 1] and 8 not in got
    signs = {r["id"]: r["sim"] for b in fuzzy.signs([batch.slice(0, 8)]) for r in b.to_pylist()}
    for i, line in enumerate(lines[:8]):
        hashes, _ = fuzzy.grams(np.frombuffer(line.encode(), np.uint8), np.array([0, len(line)]), fuzzy.FINE)
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
        assert signs[i] % 2**64 == want


def test_no_python_on_executors(spark, monkeypatch):
    """The whole job is DataFrame functions; keys, SimHashes and comparisons are not left to Arrow."""

    def no(*args, **kwargs):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", no)
    rows = [(1, "a line of some words, more of them here\nshort"), (2, "A line of some words - more of them herr\nown"), (3, "short!\nnothing like the others at all")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "own", 3: "nothing like the others at all"}


def test_simhash_and_keys_by_loops(spark):
    pick = random.Random(9)
    lines = ["".join(pick.choice("abcd efgh") for _ in range(n)).strip() or "a" for n in (1, 5, 39, 63, 120, 500)] + ["x" * 400]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    grams = sketch.all_grams(F.col("line"), sketch.TINY)
    for r in df.select("line", grams.alias("grams"), sketch.simhash(F.col("line")).alias("sim"), F.transform(F.sort_array(grams), lambda x: F.xxhash64(x)).alias("drawn"), sketch.keys(F.col("line"), F.length("line")).alias("keys")).collect():
        assert len(r.grams) == max(1, len(r.line) - sketch.TINY + 1)
        drawn = r.drawn[: sketch.SAMPLE]
        assert r.sim % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in drawn) > len(drawn))
        assert len(r.keys) <= 4 * sketch.KEYS and len(r.keys) == len(set(r.keys))
    assert all(len({(i + a) % sketch.BINS for a in x} & {(j + b) % sketch.BINS for b in y}) < 2 for x in sketch.STEPS for y in sketch.STEPS for i in range(16) for j in range(16) if (x, i) != (y, j))


def test_every_line_that_can_be_similar_has_keys(spark):
    """Lines of few different grams too, which lie in few ranges, and lines of one change near their border."""
    pick = random.Random(3)
    short = ["".join(pick.choice(LETTERS) for _ in range(n)) for n in range(10, 20) for _ in range(5)]
    pairs = [("a" * 400, "a" * 399 + "b"), (("na " * 70).strip(), ("na " * 69) + "no"), ("ab" * 12, "ab" * 11 + "ac")]
    pairs += [(x, x[:i] + "-é"[len(x) % 2 :] + x[i + 1 :]) for x in short for i in [pick.randrange(1, len(x) - 1)]]
    pairs += [(x, x[:i] + x[i + 1 :]) for x in short for i in [pick.randrange(len(x))]]
    pairs = [(x.replace("-", "0"), y.replace("-", "0")) for x, y in pairs]
    rows = [(i, x, y) for i, (x, y) in enumerate(pairs)]
    of = lambda c: sketch.keys(F.col(c), F.length(c))
    got = spark.createDataFrame(rows, "i long, x string, y string").select("i", F.arrays_overlap(of("x"), of("y")).alias("meet")).collect()
    assert [r.i for r in got if not r.meet and similar([pairs[r.i][0]], [pairs[r.i][1]], linededup.SIMILAR)[0]] == []
    lines = [((w + " ") * n).strip()[:size] for w in ("a", "ab", "abcdefgh", "ü") for n in (3000,) for size in (9, 13, 18, 25, 39, 40, 116, 117, 129, 130, 400)]
    sizes = spark.createDataFrame([(x,) for x in lines], "line string").select(F.size(of("line")).alias("n")).collect()
    assert all(r.n for r in sizes)
    gone = {r.doc_id for r in linededup.dedup_lines(spark.createDataFrame([(2 * i + j, x) for i, p in enumerate(pairs[:8]) for j, x in enumerate(p)], "doc_id long, text string")).where("n_removed = 1").collect()}
    assert gone == {2 * i + 1 for i in range(8) if similar([pairs[i][0]], [pairs[i][1]], linededup.SIMILAR)[0]} and {1, 3, 5} <= gone


def test_tables_with_texts_do_not_stay(spark):
    """Nor do those of keys: what is left on disk does not grow with the texts."""
    where = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(where))
    pairs = list(spread_pairs((20,), (3,), 60))
    got = linededup.dedup_lines(spark.createDataFrame([(2 * i + j, x) for i, (_, *p) in enumerate(pairs) for j, x in enumerate(p)], "doc_id long, text string"))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(where)) - before}
    assert left and not left & {"occurrences", "members", "texts", "blocks"}
    assert got.where("n_removed = 1").count() >= 58
