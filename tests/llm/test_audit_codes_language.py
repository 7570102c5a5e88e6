"""Filter audit, vector codes and language against brute force, on rows with nulls, repeats, empty and long texts and no rows."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from winnowry.llm import audit, codes, language, staging

WORD = re.compile(r"[^\x20\x09-\x0D]+")
pick = random.Random(11)


def prose(n):
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) for _ in range(n))


LONG = prose(30_000)
DOCS = [(i, prose(pick.choice([10, 60, 90])) + pick.choice(["", " #", " " + "A" * 60, " x" * 60]), pick.choice(["s0", "s0", "s1"])) for i in range(60)]
DOCS += [(100 + i, DOCS[3][1], pick.choice(["s0", "s2"])) for i in range(5)] + [(3, DOCS[3][1], "s0")] * 2 + [(3, DOCS[3][1], "s1"), (3, DOCS[4][1], "s0"), (200, None, None), (201, "", "s0"), (201, "", "s0"), (None, DOCS[3][1], "s1"), (None, None, ""), (202, LONG, "s9"), (203, LONG, None), (204, "naïve ÉÉÉ Ünder\x0bÄ b", "s3")]
LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(3, 0, 1), (3, 1, 0), (201, None, 1), (None, 1, 1), (103, 1, None)]


def fails(doc_id, text, least):
    words = WORD.findall(text)
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), doc_id is not None and doc_id > least.get(text, doc_id)]


def audited(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    parts = defaultdict(list)
    for i, t, s in docs:
        parts[s or ""].append((fails(i, t or "", least), i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations(range(5)):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[f] += len(gone)
                out[part, "".join("ABCDE"[x] for x in order), step] = [len(left), len(gone), sum(r[0][f] for r in rows) - len(gone), sum(r[0][f] and sum(r[0]) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley["ABCDE".index(key[1][key[2] - 1])]
    return out


def test_audit(spark):
    docs = spark.createDataFrame([(*d, "clash", 1) for d in DOCS], "doc_id long, text string, source string, id string, n int")
    rows = audit.counted(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert sum(r.n for r in rows.collect()) == len(DOCS)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.audit(rows, audit.failing_ids(rows)).collect()}
    assert got == audited(DOCS, LABELS) and len({k[0] for k in got}) == 6
    none = audit.counted(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit.audit(none, audit.failing_ids(none)).count() == 0


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([(i, "p", 1, i % 2, 0) for i in range(20)], "id long, part string, n long, good long, toxic long")
    failing = {x: rows.where(c).select("id") for x, c in (("X", "id < 8"), ("Y", "id % 4 = 0"), ("Z", "id = 19"))}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost) for r in audit.audit(rows, failing).collect()}
    assert len(got) == 18 and got["YXZ", 2] == (9, 6, 2, 6, 4) and got["XYZ", 2] == (9, 3, 2, 3, 0) and got["ZXY", 1] == (19, 1, 0, 1, 1)


def coded(rows, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """By brute force, with Python's integers: (id, code, error) of the kept rows and the codebooks."""
    kept = [(i, [max(min(math.floor(256 * x), 2**63 - 1), -(2**63)) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next(len(v) for _, v in kept if len(v) % codes.PARTS == 0)
    kept, d = [r for r in kept if len(r[1]) == size], size // codes.PARTS
    cut = [[v[p * d : (p + 1) * d] for p in range(codes.PARTS)] for _, v in kept]
    books = [[x[p] for x in cut[:entries]] for p in range(codes.PARTS)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for x in cut:
                own[near(x[p], book)[1]].append(x[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(book)]
    best = [[near(x[p], books[p]) for p in range(codes.PARTS)] for x in cut]
    return sorted((str(i), bytes(e for _, e in b), min(sum(n for n, _ in b), 2**63 - 1)) for (i, _), b in zip(kept, best, strict=True)), books


@pytest.mark.parametrize("case", ["spread", "few", "huge", "long"])
def test_codes(spark, case):
    draw = random.Random(case)
    size, scale, n = (48, 1.0, 400) if case == "spread" else (32, 1.0, 40) if case == "few" else (16, 1e17, 200) if case == "huge" else (640, 0.5, 90)
    base = [[draw.gauss(0, 1) * scale for _ in range(size)] for _ in range(9)]
    rows = [(i, [x + draw.gauss(0, 0.3) * scale for x in draw.choice(base)], i % 3) for i in range(n)]
    rows += [(n + i, base[0], None) for i in range(30)] + [(7, base[1], 1), (7, base[1], 1), (None, base[2], None), (-5, None, 1), (-4, [], 1), (-3, [None] * size, 1), (-2, [float("nan")] * size, 1), (-1, [float("inf")] * size, 1), (900, base[0][:-1], 2), (901, base[0] + [0.0] * 16, 2)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(3)
    out, books = codes.fit(df)
    want, want_books = coded(rows)
    got = codes.with_label_errors(staging.staged(out, "t")).collect()
    assert sorted((str(r.id), bytes(r.near), r.error) for r in got) == want
    assert [[list(map(int, e)) for e in book] for book in books] == want_books
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert all(r.label_error == min(sums[r.label], 2**63 - 1) for r in got)


def test_bounds_spare_distances():
    """Most parts keep their entry by the bounds, and results are those of all distances."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-300, 300, (64, 4))
    x = entries[rng.integers(0, 64, 3000)] + rng.integers(-9, 9, (3000, 4))
    near, lower, outer, _ = codes.nearest(x, entries, 8)
    after = entries + rng.integers(-2, 3, entries.shape)
    moved = np.sqrt(((after - entries) ** 2).sum(1)) * codes.UP
    got = codes.again(x, after, near, codes.lowered(lower).astype(float), outer, moved)
    want = codes.nearest(x, after, 8)
    assert (got[0][:, 0] == want[0][:, 0]).all() and (got[3] == want[3]).all()
    assert (got[4] == 1).mean() > 0.9


def test_codes_of_nothing(spark):
    out, books = codes.fit(spark.createDataFrame([(1, None, 1)], "id long, vector array<float>, label int"))
    assert codes.with_label_errors(out).count() == 0 and books.size == 0


def symbols(text):
    """The symbol of each letter, one gap between words and at both ends."""
    out = [0]
    for c in text or "":
        low = ord(c.lower()[0])
        s = 0 if not unicodedata.category(c).startswith("L") else low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % 37
        if s or out[-1]:
            out.append(s)
    return out[1:] + [0] * (out[-1] != 0)


def kneser_ney(texts):
    """By definition, on tuples: the function from (context of three, symbol) to its probability."""
    counts = Counter()
    for t in texts:
        s = [0, 0, 0, *symbols(t)]
        counts.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    levels = {4: counts}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    below = {}
    for n, c in levels.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        total, kinds = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        below[n] = c, min(max(once / max(once + 2 * twice, 1), 0.05), 0.95), total, kinds

    def p(run):
        if not run:
            return 1 / 64
        c, d, total, kinds = below[len(run)]
        if not total[run[:-1]]:
            return p(run[1:])
        return (max(c[run] - d, 0) + d * kinds[run[:-1]] * p(run[1:])) / total[run[:-1]]

    return p


def test_language(spark, monkeypatch):
    alphabets = {"xx": "abcdefgh", "yy": "cdefghéß", "zz": "жзийклмн"}
    draw = random.Random(13)
    text = lambda k, n: " ".join("".join(draw.choice(alphabets[k]) for _ in range(draw.randint(1, 5))) for _ in range(n))
    rows = [(i, k := draw.choice(list(alphabets)), text(k, draw.randint(1, 30)) + draw.choice(["", "!\n", " 12 "])) for i in range(150)]
    rows += [(500, "xx", None), (501, "yy", ""), (502, "zz", "123 -- !"), (503, None, text("xx", 20)), (None, "zz", text("zz", 20)), (504, "xx", text("xx", 40_000)), (505, "xx", "Zoë 漢字 ab")] + [(7, rows[7][1], rows[7][2])] * 3
    df = spark.createDataFrame([(i, k, t, "x", 1) for i, k, t in rows], "doc_id long, lang string, text string, h string, n int").repartition(3)
    learned = defaultdict(list)
    for i, k, t in rows:
        if i is not None and k is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learned[k].append(t)
    models = {k: kneser_ney(learned[k]) for k in sorted(learned)}

    def check(known):
        seen = 0
        by = {(r.doc_id, r.h): r for r in known.predict(df.withColumn("h", df.text).drop("n")).collect()}
        for i, _, t in rows:
            r = by[i, t]
            s = [0, 0, 0, *symbols(t)]
            if len(s) == 3:
                assert (r.lang_pred, r.score, r.n_symbols, r.rejected) == ("und", 0.0, 0, False)
            elif len(s) < 3000:
                h = {k: -sum(math.log2(p(tuple(s[j - 3 : j + 1]))) for j in range(3, len(s))) / (len(s) - 3) for k, p in models.items()}
                best = min(h, key=lambda k: (round(h[k], 5), k))
                assert r.n_symbols == len(s) - 3 and math.isclose(r.entropy, h[r.lang_pred], rel_tol=1e-4) and h[r.lang_pred] - h[best] < 1e-4 and 0 < r.score <= 1
                seen += 1
            else:
                assert r.lang_pred == "xx"
        assert seen > 140

    known = language.Identifier(df.where(~language.held_out()).select("doc_id", "text", "lang"))
    assert len(known.shared) == 1
    check(known)
    far = spark.createDataFrame([("qqq zzz vvv kkk " * 20,)], "text string")
    assert known.predict(far).first().rejected
    monkeypatch.setattr(language, "MODEL_BYTES", 1)  # a pass for each language
    monkeypatch.setattr(language, "AT_ONCE", 50)
    monkeypatch.setattr(language, "HELD", 10)
    split = language.Identifier(df.where(~language.held_out()).select("doc_id", "text", "lang"))
    assert len(split.shared) == 3
    check(split)


def test_calibration_counts_every_learned_document(spark, monkeypatch):
    draw = random.Random(5)
    words = {"xx": "abcdefgh", "yy": "cdefghij"}
    rows = [(i, k := draw.choice(list(words)), " ".join("".join(draw.choice(words[k]) for _ in range(draw.randint(1, 6))) for _ in range(draw.randint(1, 9)))) for i in range(6000)]
    known = language.Identifier(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    every, h, n = known.measured(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    got = every.select("lang", h, n).collect()
    values, root, right = np.array([r[1] for r in got]), np.sqrt([r[2] for r in got]), np.array([known.langs.index(r.lang) for r in got])

    def loss(beta):
        z = -beta * values * root[:, None]
        return np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), right])

    assert known.beta == min((2.0**e for e in np.arange(-3, 9, 0.5)), key=loss)
    for i in range(2):
        own = (right == i) & (values.argmin(1) == i)
        mean = values[own, i].mean()
        assert math.isclose(known.cuts[2 * i], mean, rel_tol=1e-7)
        assert math.isclose(known.cuts[2 * i + 1], np.quantile((values[own, i] - mean) * root[own], 1 - language.REJECTED, method="higher"), rel_tol=1e-5)
    monkeypatch.setattr(language, "BINS", 3)
    some = spark.createDataFrame([(i, float(draw.randint(0, 50)) ** 3) for i in (0, 2) for _ in range(300)] + [(5, 1.5)], "i int, x double")
    by = {i: [r.x for r in some.collect() if r.i == i] for i in (0, 2, 5)}
    assert language.quantiles(some, 0.9) == {i: float(np.quantile(x, 0.9, method="higher")) for i, x in by.items()}


def test_language_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    known = language.Identifier(none)
    assert known.predict(none).count() == 0
    assert [tuple(r)[2:4] for r in known.predict(spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")).collect()] == [("und", 0.0)]


def test_held_out_language(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    own = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language.op13_language(spark, d).collect() if r.held_out]
    assert sum(own[r.doc_id] == r.lang_pred for r in got) >= 0.98 * len(got) > 100


def test_staging_without_a_folder():
    """Where spark.checkpoint.dir is not set, a local session gets a folder of its own and its conf stays as it is."""

    class Context:
        master, where = "local[2]", None

        def setCheckpointDir(self, where):
            self.where = where

        def getCheckpointDir(self):
            return self.where

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    first = staging.shared_dir(Session())
    assert first.startswith("file:") and staging.shared_dir(Session()) == first
    Session.sparkContext.master, Session.sparkContext.where = "spark://host:7077", None
    with pytest.raises(ValueError):
        staging.shared_dir(Session())
    assert isinstance(SparkSession.getActiveSession(), SparkSession | None)
