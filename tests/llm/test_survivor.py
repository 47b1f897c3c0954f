import random
import re

import pytest

from weftgraph.llm import survivor as S

SCHEMA = "g bigint, v bigint, name string, al array<string>, trust int, seen string, field string, record string"


def brute(rows):
    out = {}
    for field in ("name", "al"):
        vals = {}
        for g, v, name, al, trust, seen, *_ in rows:
            for x in [name] if field == "name" else (al or []):
                x = (x or "").strip()
                if x.lower() not in S.PLACEHOLDERS:
                    vals.setdefault(g, set()).add((re.sub(r"\s*(…|\[…\])$", "", x), v, -1 if trust is None else trust, seen or "", x))
        for g, vs in vals.items():
            stems = {s for s, *_ in vs if s}
            ok = [x for x in vs if x[0] and not (x[0][-1].isalnum() and any(w != x[0] and w.startswith(x[0]) and w[len(x[0])].isalnum() for w in stems))]
            if ok:
                best = max(ok, key=lambda x: (x[2], x[3], -x[1]))
                out[(g, field)] = best[1]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "f", "r") for r in rows], SCHEMA)
    return {(r["grp"], r["field"]): r["record"] for r in S.survivors(df, "g", "v", ["name", "al"], "trust", "seen").collect()}


def sample(n, groups, seed):
    rnd = random.Random(seed)
    base = ["Lenomul Kufo Archive", "Lenomul Kufo Ar…", "Lenomul Kuf", "Lenomul Kufo", "n/a", "", None, "???", "Ada", "Adamant", "Ada Byron", "unknown", "Léa", "Léan"]
    return [(rnd.randrange(groups), i, rnd.choice(base), rnd.choice([None, [], [None], ["-", "Ada By"], ["Ada Byron"]]), rnd.choice([None, 1, 2, 3]), rnd.choice(["2024-01-01", "2024-01-02", None])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = sample(300, 40, seed)
    assert run(spark, rows + rows[:50]) == brute(rows)


def test_hot_group(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_LEAST", 10)
    monkeypatch.setattr(S, "HOT_PARTS", 3)
    for hot in (0, None):
        rows = [(hot if i % 3 else r[0] + 1, *r[1:]) for i, r in enumerate(sample(300, 30, 3))]
        assert run(spark, rows) == brute(rows)


def test_hot_group_of_values_that_begin_alike(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_LEAST", 10)
    monkeypatch.setattr(S, "HOT_PARTS", 3)
    rnd, long = random.Random(5), "the same beginning of more than forty characters "
    words = [long + "".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 7))).strip() for _ in range(400)]
    rows = [(1, i, w, None, rnd.randrange(3), "2024") for i, w in enumerate(words)]
    df = spark.createDataFrame([(*r, "f", "r") for r in rows], SCHEMA)
    stems = set(words)
    broken = {s for s in stems if s[-1].isalnum() and any(w != s and w.startswith(s) and w[len(s)].isalnum() for w in stems)}
    values = df.selectExpr("g as grp", "'name' as field", "name as stem").distinct()
    assert {r["stem"] for r in S._broken(values, S.F.col("grp") == 1).collect()} == broken
    assert run(spark, rows) == brute(rows)


def test_layer_against_brute_force(spark):
    rnd = random.Random(9)
    points = {(rnd.randrange(3), rnd.randrange(2), float(rnd.randrange(6)), rnd.choice([None, "a", "b", "c", "d"])) for _ in range(60)}
    key = lambda p: (p[1], p[2], p[3] or "")
    want = {p for p in points if not any(q != p and q[0] == p[0] and all(x >= y for x, y in zip(key(q), key(p), strict=True)) for q in points)}
    df = spark.createDataFrame(sorted(points, key=str), "g int, complete int, trust double, recency string")
    assert {tuple(r) for r in S._undominated(df, ["g"]).collect()} == want


def test_ties_and_nothing(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 8, "A B", None, 2, "2024"), (1, 3, "A B", None, 2, "2024"), (2, 4, "n/a", ["?"], 5, "2024")]) == {(1, "name"): 3}


def test_front_and_golden(spark):
    df = spark.createDataFrame([(1, 1, "A", None, 3, "2023", "", ""), (1, 2, "B", ["Bee"], 2, "2024", "", ""), (1, 3, "C", None, 1, "2022", "", ""), (2, 4, None, None, None, None, "", "")], SCHEMA)
    front = S.field_skyline(df, "g", "v", ["name"], "trust", "seen").collect()
    assert sorted((r["record"], r["complete"], r["survivor"]) for r in front) == [(1, 1, True), (2, 1, False), (4, 0, False)]  # 3 is dominated
    filled = S.field_skyline(df, "g", "v", ["al"], "trust", "seen").where("grp = 1").collect()
    assert sorted((r["record"], r["complete"], r["survivor"]) for r in filled) == [(1, 0, False), (2, 1, True)]  # 1 is undominated but lacks the field
    gold = {r["g"]: r for r in S.golden_records(df, "g", "v", ["name", "al"], "trust", "seen").collect()}
    assert gold[1]["name"] == "A" and gold[1]["al"] == ["Bee"] and gold[1]["al_from"] == 2 and gold[2]["name"] is None
