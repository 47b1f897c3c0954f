import random

import numpy as np
import pytest

from weftgraph.llm import components as C


def brute(rows):
    parent = {x: x for a, b, _ in rows for x in (a, b) if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, v in rows:
        if v == "match" and a is not None and b is not None:
            x, y = sorted((find(a), find(b)), key=lambda s: s.encode())
            parent[y] = x
    return {x: find(x) for x in parent}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "a string, b string, verdict string, name string, v int")
    return {r["name"]: r["group_name"] for r in C.consolidate_pairs(df, "a", "b", "verdict = 'match'").collect()}


def shape(kind):
    rnd = random.Random(7)
    n = [f"{c}{i:03d}" for c in "aÄz" for i in range(60)]
    if kind == "chain":
        return [(n[i], n[i + 1], "match") for i in range(100)]
    if kind == "star":
        return [(n[0], x, "match") for x in n[1:90]] + [(n[5], n[0], "match")] * 3
    return [(rnd.choice([*n, None]), rnd.choice([*n, None]), rnd.choice(["match", "no_match", None, "error"])) for _ in range(260)] + [("solo", "solo", "match"), ("é", "z", "no_match")]


@pytest.mark.parametrize("local", [0, 40, C.LOCAL_EDGES])
@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_against_union_find(spark, monkeypatch, kind, local):
    monkeypatch.setattr(C, "LOCAL_EDGES", local)
    rows = shape(kind)
    assert run(spark, rows) == brute(rows)


def test_hubs_are_met_by_broadcast(spark, monkeypatch):
    from weftgraph.operators import skew

    for m in (C, skew):
        monkeypatch.setattr(m, "HOT_LEAST", 8)
        monkeypatch.setattr(m, "HOT_PARTS", 4)
    monkeypatch.setattr(C, "LOCAL_EDGES", 0)
    rows = shape("star") + shape("random")
    assert run(spark, rows) == brute(rows)


def test_empty_and_null(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None, "match"), (None, "x", "match")]) == {"x": "x"}


def test_arrays_of_a_long_chain():
    n = 20_000
    ids = np.random.default_rng(1).permutation(10 * n)[:n].astype(np.int64)
    v, r = C.contract_arrays(ids[:-1], ids[1:])
    assert len(v) == n and len(set(r.tolist())) == 1 and set(r.tolist()) <= set(ids.tolist())
    v, r = C.contract_arrays(np.empty(0, np.int64), np.empty(0, np.int64))
    assert len(v) == len(r) == 0
