"""Walks in order against a loop, with zero, missing and repeated vectors."""

import math
import random

from collections import Counter

import pytest

from winnowry import registry
from winnowry.operators import lexical, similar, triage

DIR = "/root/testdata/sf0.001"


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0


def walked(rows, history, threshold):
    kept, sims = [], {}
    for i, v in sorted(rows):
        seen = [] if v is None else [cosine(v, w) for w in history] + [cosine(v, w) for _, w in kept if w is not None]
        sims[i] = max(seen, default=0.0)
        if all(s < threshold for s in seen):
            kept.append((i, v))
    return {i for i, _ in kept}, sims


def test_walk(spark):
    pick = random.Random(4)
    base = [[pick.gauss(0, 1) for _ in range(4)] for _ in range(9)]
    rows = [(i, [x + pick.gauss(0, 0.3) for x in pick.choice(base)]) for i in range(120)] + [(200, None), (201, [0.0] * 4), (202, base[0]), (203, base[0]), (204, None)]
    history = [base[3], base[4], [0.0] * 4]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    past = spark.createDataFrame([(i, v) for i, v in enumerate(history)], "id long, v array<double>")
    kept, sims = walked(rows, history, 0.9)
    assert {r.id for r in similar.without_near(df, past, 0.9).collect()} == kept and 10 < len(kept) < 100
    got = {r.id: (r.novel, r.sim) for r in similar.novelty(df, past, 0.9).collect()}
    assert {i for i, (novel, _) in got.items() if novel} == kept
    assert all(math.isclose(got[i][1], sims[i], abs_tol=1e-8) for i in sims)
    none = df.where("id < 0")
    assert similar.without_near(none, past, 0.9).count() == 0
    assert {r.id for r in similar.without_near(df, none, 0.9).collect()} == walked(rows, [], 0.9)[0]


def test_registered_walk(spark):
    v = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, _ = walked([x for x in v if x[0] % 5], [x for i, x in v if i % 5 == 0], 0.3)
    assert {r.id for r in registry.queries()["j10_greedy_near"](spark, DIR).collect()} == want


def settled(ids, edges):
    """The walk as a loop."""
    before, kept = {}, set()
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    for i in sorted(ids):
        if not before.get(i, set()) & kept:
            kept.add(i)
    return kept


@pytest.mark.parametrize("most", [similar.SETTLE, 2500, 40])
def test_long_chains_and_hubs(spark, monkeypatch, most):
    """A chain of 10,000 decisions, a hub of thousands and random edges; as many rounds as ranges at most."""
    if most == 40:
        edges, n = [(i, i + 1) for i in range(300)] + [(0, i) for i in range(400, 600)], 700
    else:
        edges, n = [(i, i + 1) for i in range(10_000)] + [(i, 30_000) for i in range(20_000, 23_000)], 40_000
    pick = random.Random(most)
    edges += [tuple(sorted(pick.sample(range(n), 2))) for _ in range(len(edges) // 4)]
    monkeypatch.setattr(similar, "SETTLE", most)
    rounds, cut = [], similar.cut
    monkeypatch.setattr(similar, "cut", lambda df, name: rounds.append(name) or cut(df, name))
    ids = spark.range(n)
    got = {r.id for r in similar.first_kept(ids, spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == settled(range(n), edges)
    assert rounds.count("fates") <= -(-len(edges) // most) + 1


def test_earlier_only(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    got = {r.id: r.best_id for r in triage.cosine_best(df, df, earlier=True).collect()}
    assert got == {2: 1, 3: 2, 4: 1}


def best_by_words(rows, history):
    norm = lambda b: math.sqrt(sum(n * n for n in b.values()))
    out = {}
    for i, x in rows:
        x, best = Counter(x), None
        for j, y in sorted(history):
            y = Counter(y)
            c = len(x.keys() & y.keys())
            if c:
                sim = math.floor((c / (len(x) + len(y) - c) + sum(x[t] * y[t] for t in x) / (norm(x) * norm(y))) / 2 * 1e9 + 0.5) / 1e9
                if best is None or sim > best[0]:
                    best = sim, j
        if best:
            out[i] = best
    return out


@pytest.mark.parametrize("rare", [64, 3, 0])
def test_words_against_all(spark, monkeypatch, rare):
    """Frequent words, words of one text, ties, repeated texts, empty and null ones; with lists of any length, and small blocks."""
    for name, value in (("RARE", rare), ("ROWS", 30), ("TEXTS", 25)):
        monkeypatch.setattr(lexical, name, value)
    pick = random.Random(rare)
    word = lambda: pick.choice(["the", "of", "a"]) if pick.random() < 0.6 else f"w{int(pick.paretovariate(0.7)) % 400}"
    text = lambda: [word() for _ in range(pick.randint(1, 7))]
    rows = [(i, text()) for i in range(200)] + [(300, []), (301, None), (302, ["unheard"]), (303, ["the"]), (304, ["the"] * 5)]
    history = [(i, text()) for i in range(1000, 1150)] + [(2000, ["the", "of"]), (1999, ["of", "the"]), (2001, []), (2002, None)]
    make = lambda r: spark.createDataFrame(r, "id long, tokens array<string>")
    got = {r.id: (r.sim, r.best_id) for r in lexical.lexical_best(make(rows), make(history)).collect()}
    assert got == best_by_words([r for r in rows if r[1]], [h for h in history if h[1]])
    assert lexical.lexical_best(make(rows), make([])).count() == lexical.lexical_best(make([]), make(history)).count() == 0


def test_no_join_on_frequent_words(spark):
    """2,000 texts that share three words are compared without a row for each pair."""
    rows = spark.range(2000).selectExpr("id", "array('the', 'of', 'and', concat('own', id)) as tokens")
    history = spark.range(2000).selectExpr("id + 5000 as id", "array('the', 'of', 'and', concat('other', id)) as tokens")
    got = lexical.lexical_best(rows, history).collect()
    assert len(got) == 2000 and {r.best_id for r in got} == {5000}


def test_blocks_hold_a_few_rows_similarities_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from winnowry.operators import triage

    draw = np.random.default_rng(1)
    rows, corpus = (pa.table({"id": list(ids), "v": draw.normal(size=(len(ids), 8)).tolist()}) for ids in (range(0, 1400, 2), range(1, 900, 3)))
    for earlier in (False, True):
        few = triage._best_of_blocks(earlier)(None, rows, corpus)
        with monkeypatch.context() as m:
            m.setattr(triage, "AT_ONCE", 10**6)
            assert triage._best_of_blocks(earlier)(None, rows, corpus).equals(few)
