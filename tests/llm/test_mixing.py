from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import mixing as M


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=10), st.integers(0, 900))
def test_fit_stays_within_budget_and_stock(hist, budget):
    got = M.fit_budget(hist, budget)
    total = sum(n * k for n, k in got.items())
    assert total <= budget and all(0 < k <= hist[n] for n, k in got.items())
    if budget >= sum(n * c for n, c in hist.items()):
        assert got == hist


def test_fit_is_exact_with_ones():
    assert sum(n * k for n, k in M.fit_budget({1: 50, 7: 20, 30: 9}, 301).items()) == 301


DOCS = [(i, "abc"[i % 3], 5 + i % 11) for i in range(300)] + [(900, None, 5), (901, "zz", 5), (902, "a", 0), (903, "a", None)]


def run(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, 1, "r") for x in docs], "id bigint, src string, n bigint, rank int, repeats string")
    t = spark.createDataFrame(targets, "src string, share double, most int")
    out = M.mix(d, t, "id", "src", "n", "share", "most", **kw)
    return out.toPandas(), M.shares(out, t, "src", "share", "most").toPandas().set_index("source")


def test_shares(spark):
    got, shares = run(spark, DOCS, [("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.2, 2), ("none", 0.1, 4)])
    assert set(got["doc"]) <= set(range(300)) and got["doc"].is_unique
    for s, w, most in (("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.2, 2)):
        assert abs(shares.loc[s, "actual_share"] - w / 0.9) < 0.01
        assert got[got["source"] == s]["repeats"].max() <= most
    assert shares.loc["none", "tokens"] == 0


def test_caps_hold_when_the_total_is_given(spark):
    got, shares = run(spark, DOCS, [("a", 0.5, 2), ("b", 0.5, 1)], total=10**6)
    assert (got[got["source"] == "a"]["repeats"] == 2).all() and (got[got["source"] == "b"]["repeats"] == 1).all()


def test_seeded(spark):
    t = [("a", 0.5, 1), ("b", 0.5, 1)]
    one, two, other = (set(run(spark, DOCS, t, total=400, seed=s)[0]["doc"]) for s in (1, 1, 2))
    assert one == two != other


def test_empty(spark):
    assert len(run(spark, [], [("a", 1.0, 1)])[0]) == 0
    assert len(run(spark, DOCS, [(None, 1.0, 1), ("a", 0.0, 1)])[0]) == 0


def test_many_sources(spark):
    docs = [(i, f"s{i % 12_000}", 3) for i in range(24_000)]
    got, shares = run(spark, docs, [(f"s{i}", 1 / 12_000, 1) for i in range(12_000)])
    assert got["source"].nunique() == 12_000 and (shares["most_repeats"] == 1).all()
