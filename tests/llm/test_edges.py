"""Hash collisions made on purpose, clashing names, fuzzy lines against brute force, and the pipeline on odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from winnowry.llm import decontaminate, licenses, linededup, linking, lm, minhash, mixing, quality, suffix, topk
from winnowry.llm import edits as edits_of
from winnowry.llm.edits import distances

THUE = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
TWIN = THUE.translate({97: "b", 98: "a"})


def test_texts_made_to_collide(spark):
    df = spark.createDataFrame([(1, THUE), (2, TWIN)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2}
    learn = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][0]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    scored = lm.score_texts(spark.createDataFrame([(learn, THUE), (held, TWIN)], "doc_id long, text string"), ~lm.held_out())
    assert {r.doc_id: r.n_known for r in scored.collect()} == {learn: 2, held: 1}
    one, other = THUE[:1024], TWIN[:1024]
    got = suffix.remove_repeats(spark.createDataFrame([(1, one + "x" + "q" * 10), (2, other)], "doc_id long, text string"), length=1024).collect()
    assert [r.n_removed for r in got] == [0, 0]
    assert [r.n_base for r in licenses.find_licenses(df).collect()] == [0, 0]


def test_clashing_names(spark):
    line = " ".join(f"word{i}" for i in range(30))
    columns = "doc_id long, text string, source string, key string, own string, other string, places string, row string, _key string, _row string, _id string, _u string, `a b` string"
    rows = [(i, t, "s", *(f"{c}{i}" for c in range(10))) for i, t in ((1, line), (2, line), (3, "a text of its own with many words in it"))]
    df = spark.createDataFrame(rows, columns)
    as_rows = lambda out: sorted(tuple(r) for r in out.select(*[f"`{c}`" for c in df.columns]).collect())
    assert as_rows(linededup.dedup_lines(df)) == [rows[0], (2, "", *rows[1][2:]), rows[2]]
    assert as_rows(minhash.keep_one(df)) == [rows[0], rows[2]]
    bench = spark.createDataFrame([(1, rows[2][1])], "item_id long, text string")
    assert as_rows(decontaminate.keep_clean(df, bench)) == rows[:2]
    mixed = mixing.mix(df).drop("size", "source_size", "target", "copies", "taken").collect()
    assert sorted(tuple(r) for r in mixed) == sorted((r[0], *r[2:]) for r in rows)
    model = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert as_rows(quality.keep_good(df, model)) == rows


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("first", [32, 1])
def test_edit_similarity(spark, first, monkeypatch):
    monkeypatch.setattr(edits_of, "FIRST", first)
    pick = random.Random(3)
    some = ["".join(pick.choice("abcde") for _ in range(pick.randint(1, 6))) for _ in range(99)]
    rows = []
    for k in range(250):
        a = [pick.choice(some) for _ in range(pick.randint(5, 25))]
        b = list(a)
        for _ in range(pick.randint(1, 3)):
            i, how = pick.randrange(len(b)), pick.random()
            b[i : i + 1] = [] if how < 0.3 and len(b) > 1 else [pick.choice(some), b[i]] if how < 0.6 else [b[i] + "x"]
        rows.append((k, " ".join(a), " ".join(b)))
    want = {k for k, x, y in rows if edits(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9)}
    got = {r.k for r in linededup.alike(spark.createDataFrame(rows, "k long, x string, y string").where("x <> y")).collect()}
    same = {k for k, x, y in rows if x == y}
    assert got == want - same


@pytest.mark.parametrize("n", [500, 1000, 3000])
def test_long_lines_with_words_put_in(n):
    """A few words in front and another last one: the distance is small, though no word stands in its place."""
    pick = random.Random(n)
    line = lambda: [f"w{pick.randrange(10**5)}" for _ in range(n)]
    xs = [line() for _ in range(10)]
    ys = [["some", "new", "words", *x[:-1], "end"] for x in xs]
    join = lambda rows: [" ".join(r) for r in rows]
    assert edits_of.similar(join(xs), join(ys), 0.9).all()
    assert not edits_of.similar(join(xs), join(ys[1:] + ys[:1]), 0.9).any()


@pytest.mark.parametrize("part", [1 << 17, 20])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(linking, "PART", part)
    pick = random.Random(part)
    edges = [(i, i + 1) for i in range(100, 160)] + [(pick.randrange(200, 260), pick.randrange(200, 260)) for _ in range(40)]
    first = {x: x for edge in edges for x in edge}
    for _ in first:
        for a, b in edges:
            first[a] = first[b] = min(first[a], first[b])
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {x: f for x, f in first.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("caps", ["small", "large"])
def test_edit_distances(caps):
    pick = random.Random(caps)
    xs, ys = [], []
    for _ in range(400):
        some = pick.choice(["ab", "abcdefgh", "a\u00e9\U0001f600x", "".join(chr(300 + i) for i in range(400))])
        a = [pick.choice(some) for _ in range(pick.randint(0, 60))]
        b = list(a)
        for _ in range(pick.randint(0, 12)):
            i = pick.randint(0, len(b))
            b[i : i + pick.randint(0, 1)] = [pick.choice(some)] * pick.randint(0, 2)
        xs.append("".join(a))
        ys.append("".join(b))
    most = np.array([pick.randint(0, 20) if caps == "small" else 10**6 for _ in xs])
    assert list(distances(xs, ys, most)) == [min(edits(x, y), min(c, max(len(x), len(y))) + 1) for x, y, c in zip(xs, ys, most, strict=True)]


@pytest.mark.parametrize("n", [8, 15, -15, 30])
def test_fuzzy_lines_by_brute_force(spark, monkeypatch, n):
    """Groups of the pairs that reach the edit similarity; each changed line goes as the first of its group is another.

    Below 0 the lines share their ends, and buckets of more than three are compared in small blocks under several keys.
    """
    ends = ["some", "words", "which", "all", "lines", "begin", "and", "end", "with"] if n < 0 else []
    if ends:
        for of, name, value in ((linking, "FEW", 3), (linededup, "BLOCK", 7), (linededup, "SPREAD", 2)):
            monkeypatch.setattr(of, name, value)
        n = -n
    pick = random.Random(n)
    some = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(3, 8))) for _ in range(500)]
    lines = []
    for _ in range(40):
        words = ends + [pick.choice(some) for _ in range(n)]
        i = pick.randrange(len(ends), len(ends) + n)
        lines += [words, [*words[:i], words[i][:-1] + pick.choice("xyz"), *words[i + 1 :]], words[:-1] + ["end"]]
    lines = [" ".join(w) for w in lines]
    first = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            if first[i] != first[j] and abs(len(x) - len(lines[j])) < 9 and edits(x, lines[j]) <= int(0.1 * max(len(x), len(lines[j])) + 1e-9):
                low, high = sorted((first[i], first[j]))
                first = [low if f == high else f for f in first]
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    want = {i: int(f != i) for i, f in enumerate(first)}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.95 * sum(want.values()) > 30


def test_large_buckets_in_blocks(spark, monkeypatch):
    """All links between different groups, each found once, whichever of the buckets two lines share."""
    monkeypatch.setattr(linededup, "BLOCK", 7)
    monkeypatch.setattr(linededup, "SPREAD", 2)
    pick = random.Random(5)
    base, lines = [pick.choice("abcdefgh") * pick.randint(2, 7) for _ in range(12)], []
    for _ in range(60):
        words = list(base)
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(12)] = pick.choice("ijk") * pick.randint(1, 4)
        lines.append(" ".join(words))
    met = [sorted(pick.sample([10, 20, 30], pick.randint(1, 3))) for _ in lines]
    rows = [(b, i, i % 50, len(x), 0, met[i]) for i, x in enumerate(lines) for b in met[i]]
    big = spark.createDataFrame(rows, "bucket long, id long, component long, size int, sim long, met array<long>")
    got = linededup.in_blocks(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))(big).collect()
    most = lambda i, j: int(0.1 * max(len(lines[i]), len(lines[j])) + 1e-9)
    want = [(i, j) for j in range(60) for i in range(j) if i % 50 != j % 50 and set(met[i]) & set(met[j]) and edits(lines[i], lines[j]) <= most(i, j)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50


def test_huge_components(spark):
    rows = [(0, [1e20, 1.0]), (50, [1.0, 2.0]), (1, [1e20, 1.0]), (2, [-1e20, 0.0]), (3, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df.where("id = 0"), df).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (50, 2**63 - 1), (2, -(2**63))]
    assert topk.top_k(df.where("id < 0"), df.where("id < 0")).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    pick = random.Random(1)
    some = ["".join(pick.choice("abcdefghijklm") for _ in range(pick.randint(2, 9))) for _ in range(900)]
    prose = lambda n: ". ".join(" ".join(pick.choice(some) for _ in range(9)) for _ in range(n))
    base = [prose(12) for _ in range(60)]
    junk = [" ".join(["!!! $$$ ### BUY BUY ||| 999"] * 30) for _ in range(30)]
    passage = prose(4)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)] + [(1000 + i, t, "en", "s1", len(t)) for i, t in enumerate(junk)]
    rows += [(2000, base[0], None, None, None), (2000, base[0], None, None, None), (2001, base[1] + " tail", "en", "s2", 1), (None, prose(12), "en", "s0", 1), (2002, None, "en", "s0", 0), (2003, "", "en", "s0", 0), (2004, passage + ". " + prose(2), "en", "s0", 1)]
    where = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(1000 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{where}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
        docs.write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        kept[name] = Counter(r.doc_id for r in docs.collect())
    assert not any(1000 <= (i or 0) < 1030 for i in kept["quality"]) and set(range(60)) <= set(kept["quality"])
    assert kept["quality"][2000] == 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept["near"][2000] == kept["lines"][2000] == 0 and kept["near"][2001] == 0 and set(range(2, 60)) | {0, 1, None} <= set(kept["near"])
    assert 2004 in kept["near"] and 2004 not in kept["benchmark"] and set(kept["benchmark"]) >= set(range(60))
    assert all(texts[i] == base[i] for i in texts if i is not None and i < 60) and docs.columns[:5] == list(corpus_pipeline.COLUMNS)
    assert len(texts) >= 50 and all(r.taken == r["size"] * r.copies and r.copies > 0 for r in docs.collect())
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/none/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{where}/{table}.parquet").limit(0).write.parquet(f"{where}/none/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{where}/none").count() == 0
