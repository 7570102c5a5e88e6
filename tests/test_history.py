import math
from collections import Counter

from winnowry.operators import corpus
from winnowry.registry import QUERIES
from winnowry.sources.fixtures import view

DIR = "/root/testdata/sf0.001"


def test_clusters_are_the_cheapest_of_ten_restarts(spark, monkeypatch):
    seeds, fit = [], corpus.KMeans.fit
    monkeypatch.setattr(corpus.KMeans, "fit", lambda self, df: seeds.append(self.getSeed()) or fit(self, df))
    rows = QUERIES["a07_clusters"](spark, DIR).collect()
    assert len(set(seeds)) == 10 and sum(r.n for r in rows) == spark.read.parquet(f"{DIR}/embeddings.parquet").count()


def test_lexical_novelty_of_all_items(spark):
    import re

    bags = {r.item_id: Counter(re.findall(r"\w+", r.title.lower())) for r in view(spark, DIR, "fx_items").select("item_id", "title").collect()}
    past = {}
    for i in sorted(i for i in bags if i % 4 == 0):
        past.setdefault(frozenset(bags[i].items()), i)
    norm = lambda b: math.sqrt(sum(n * n for n in b.values()))
    want = {}
    for b in {frozenset(b.items()) for i, b in bags.items() if i % 4}:
        x, best = Counter(dict(b)), (0.0, 0)
        for h, j in past.items():
            y = Counter(dict(h))
            c = len(x.keys() & y.keys())
            if c:
                best = max(best, (round((c / (len(x) + len(y) - c) + sum(x[t] * y[t] for t in x) / (norm(x) * norm(y))) / 2, 9), -j))
        want[b] = best
    got = {r.id: (r.sim, r.best_id) for r in QUERIES["j08_lexical_novelty"](spark, DIR).collect()}
    assert got.keys() == {i for i, b in bags.items() if i % 4 and want[frozenset(b.items())][0]}
    assert all(math.isclose(sim, want[frozenset(bags[i].items())][0], abs_tol=2e-9) for i, (sim, _) in got.items())


def test_few_vectors_are_one_cluster(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>")
    assert {(r.id, r.cluster) for r in corpus.clustered(rows).collect()} == {(i, 0) for i in range(5)}
    found = corpus.clustered(rows, k=2, restarts=3)
    assert sorted(r.n for r in corpus.summary(found).collect()) in ([1, 4], [2, 3])
    assert [tuple(r) for r in corpus.summary(corpus.clustered(rows)).collect()] == [(0, 5, "0,1,2")]
