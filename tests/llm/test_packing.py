from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import packing as P


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(1, 25))
def test_best_fill_is_the_best(sizes, room):
    counts = {n: sizes.count(n) for n in sizes}
    got = P.best_fill(sorted(counts, reverse=True), counts, room)
    best = max(sum(c) for k in range(len(sizes) + 1) for c in combinations(sizes, k) if sum(c) <= room)
    assert sum(n * k for n, k in got.items()) == best
    assert all(k <= counts[n] for n, k in got.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_everything(hist):
    used = dict.fromkeys(hist, 0)
    for n, first, per, times, _, _ in sorted(P.plan(hist, 40), key=lambda r: r[:2]):
        assert first == used[n]
        used[n] += per * times
    assert used == hist


def first_fit_decreasing(sizes, cap):
    room = []
    for n in sorted(sizes, reverse=True):
        i = next((i for i, r in enumerate(room) if r >= n), None)
        if n and i is None:
            room.append(cap - n)
        elif n:
            room[i] -= n
    return len(room)


def run(spark, rows, caps=((1, 10), (2, 7))):
    items = spark.createDataFrame([(*r, 5, "p") for r in rows], "doc bigint, n bigint, pack int, size string")
    specs = spark.createDataFrame(list(caps), "no int, cap int")
    return P.pack_items(items, specs, "doc", "n", "no", "cap").toPandas(), specs


def test_containers(spark):
    rows = [(i, 1 + i * 7 % 13) for i in range(200)] + [(900, 35), (901, 0), (902, None)] + [(1000 + i, 4) for i in range(120)]
    got, specs = run(spark, rows)
    sizes = {i: n or 0 for i, n in rows}
    for pack, cap in ((1, 10), (2, 7)):
        part = got[got["pack"] == pack]
        assert part.groupby("item")["size"].sum().to_dict() == sizes
        whole = part[part["item"].map(sizes) <= cap]
        assert (whole.groupby("item").size() == 1).all()  # split only above the capacity
        full = part.dropna(subset=["container"]).groupby("container").agg(used=("size", "sum"), unused=("unused", "first"))
        assert (full["used"] <= cap).all() and (full["used"] + full["unused"] == cap).all()
        assert sorted(full.index) == list(range(len(full)))
        assert len(full) <= first_fit_decreasing(part["size"], cap)
        assert part[part["size"] == 0]["container"].isna().all() and len(part[part["size"] == 0]) == 2
        big = part[part["item"] == 900].sort_values("piece")
        assert list(big["start"]) == [k * cap for k in range(len(big))]


def test_empty(spark):
    assert len(run(spark, [])[0]) == 0
    assert len(run(spark, [(1, 3)], ((1, 0), (2, None)))[0]) == 0
    assert len(run(spark, [(1, 0)])[0]) == 2


def test_summary(spark):
    items = spark.createDataFrame([(1, 6), (2, 4), (3, 5)], "d bigint, n bigint")
    specs = spark.createDataFrame([(1, 10)], "no int, cap int")
    r = P.pack_summary(P.pack_items(items, specs, "d", "n", "no", "cap"), specs, "no", "cap").first()
    assert (r["containers"], r["units"], r["unused"], r["least_containers"]) == (2, 15, 5, 2)


def test_a_length_with_very_many_items(spark, monkeypatch):
    monkeypatch.setattr(P, "RANK_BLOCK", 4)
    got, _ = run(spark, [(i, 3) for i in range(300)] + [(400 + i, 1 + i % 9) for i in range(90)], ((1, 10),))
    full = got.groupby("container").agg(used=("size", "sum"), unused=("unused", "first"))
    assert len(got) == 390 and (full["used"] + full["unused"] == 10).all() and sorted(full.index) == list(range(len(full)))
