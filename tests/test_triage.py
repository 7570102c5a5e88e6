from hypothesis import given, settings
from hypothesis import strategies as st

from winnowry.operators import triage


def walk(items, most, cap=2):
    """One study after each other pick, both within their caps; then what is left of the studies."""
    others, studies, used = [x for x in items if x[1] != "STUDY_STAT"], [x for x in items if x[1] == "STUDY_STAT"], {}
    out, j = [], 0
    for x in others:
        if used.get(x[1], 0) < cap:
            used[x[1]] = used.get(x[1], 0) + 1
            out.append(x)
            if j < min(cap, len(studies)):
                out.append(studies[j])
                j += 1
    out += studies[j:]
    return sorted(x[0] for x in out[:most])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["STUDY_STAT", "A", "B"]), min_size=1, max_size=9))
def test_mixer_is_the_walk(spark, kinds):
    items = [(i, k, 10) for i, k in enumerate(kinds)]
    df = spark.createDataFrame([(0, *x) for x in items], "run_id long, pos long, archetype string, score int")
    assert sorted(r.pos for r in triage.interleaved(df, 5).collect()) == walk(items, 5)


def test_zero_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    got = {r.id: (r.sim, r.best_id) for r in triage.cosine_best(v, spark.createDataFrame([(7, [2.0, 0.0]), (8, [3.0, 0.0])], "id long, v array<double>")).collect()}
    assert got == {1: (0.0, 7), 2: (1.0, 7)}
