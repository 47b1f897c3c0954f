"""Golden and brute-force tests of the core operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.json import tolerant_extraction
from weftgraph.functions.pyfuncs import chunk_spans, ratio
from weftgraph.functions.routing import is_broad, is_global
from weftgraph.operators import graph as G
from weftgraph.operators import rank as R
from weftgraph.operators import resolve as S
from weftgraph.operators.skew import skew_safe_lookup, spread_rank
from weftgraph.streaming import jobs as J


def rows(df):
    return sorted(tuple(r) for r in df.collect())


CLIQUES = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "AB" for i in range(1, 5) for j in range(i + 1, 5)] + [("A1", "B1", 1.0)]


def test_modularity_of_two_cliques(spark):
    w = spark.createDataFrame(CLIQUES, "a string, b string, weight double")
    member = spark.createDataFrame([(f"{c}{i}", c) for c in "AB" for i in range(1, 5)], "node string, community string")
    assert G.modularity(w, member).first()[0] == 0.4231
    assert G.modularity(w.limit(0), member).first()[0] is None


def test_louvain_finds_the_cliques(spark):
    w = spark.createDataFrame([("x", *e) for e in CLIQUES], "part string, a string, b string, weight double")
    got = {}
    for r in G.louvain(w, "part").collect():
        got.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [[f"{c}{i}" for i in range(1, 5)] for c in "AB"]


def test_label_propagation_covers_all_nodes(spark):
    w = spark.createDataFrame(CLIQUES, "a string, b string, weight double")
    assert {r["node"] for r in G.label_propagation(w, 3).collect()} == {x for e in CLIQUES for x in e[:2]}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_connected_components(spark, shape):
    rnd = random.Random(4)
    e = {"chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 40)], "random": [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(99, None), (5, 5)], "none": []}[shape]
    parent = {x: x for p in e for x in p if x is not None and None not in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        if a is not None and b is not None:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    assert rows(G.connected_components(spark.createDataFrame(e, "a bigint, b bigint"))) == sorted((x, find(x)) for x in parent)


def test_shortest_paths_take_the_least_text(spark):
    e = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("a", "x", "R"), ("c", "x", "S")], "source string, target string, rel_type string")
    ends = spark.createDataFrame([("a",), ("c",)], "name string")
    got = rows(G.shortest_paths(ends, ends, e, 3))
    assert got == [("a", "c", 2, "a -[R]-> b -[R]-> c"), ("c", "a", 2, "c -[S]-> x <-[R]- a")]


def test_frontier_and_one_hop_of_isolated_seed(spark):
    e = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R")], "source string, target string, rel_type string")
    s = spark.createDataFrame([("a",), ("lonely",)], "name string")
    assert rows(G.frontier(s, e, 2)) == [("a", 0), ("b", 1), ("c", 2), ("lonely", 0)]
    assert ("lonely", None, None) in [tuple(r) for r in G.one_hop(s, e).collect()]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab.?! \n", max_size=60), st.integers(1, 12), st.integers(-2, 15))
def test_chunk_spans_cover_the_text(text, size, overlap):
    spans = chunk_spans(text, size, overlap)
    if not text.strip():
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b and b - a <= size and d > c


def test_chunk_size_must_be_positive():
    with pytest.raises(ValueError):
        chunk_spans("x", 0)


def test_ratio():
    assert ratio("", "x") == 0.0 and ratio("Ünï Corp", "uni corp") == 1.0
    assert ratio("Acme Corp", "Acme Corp International") >= 0.95
    assert ratio("abcd", "wxyz") == 0.0


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(T.keyword_query(F.lit("What is the Graph (v2)?"))) == "graph"
    assert get(T.entity_type(F.lit(None).cast("string"))) == "UNKNOWN" and get(T.entity_type(F.lit(" \t"))) == "UNKNOWN"
    assert get(T.snippet(F.lit("x" * 401))) == "x" * 399 + "…" and get(T.snippet(F.lit("x" * 400))) == "x" * 400
    assert [get(T.stem(F.lit(w))) for w in ("studies", "walking", "designed", "class", "cats", "database")] == ["study", "walk", "design", "class", "cat", "databas"]
    assert get(T.rel_type(F.lit("works at"))) == "WORKS_AT" and get(T.rel_type(F.lit(None).cast("string"))) == "RELATED_TO"
    assert get(T.render_path(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("R")), F.array(F.lit(False)))) == "A <-[R]- B"
    assert get(T.clean_names(F.array(F.lit(" a "), F.lit(None).cast("string"), F.lit(""), F.lit("a")))) == ["a"]
    assert get(T.embed_text(F.lit(None).cast("string"), F.lit("d"))) == "d"
    assert get(T.facts_found(F.lit("Ada met Bob"), F.array(F.lit("bob"), F.lit("Eve")))) == ["bob"]


def test_routing(spark):
    q = ["Give me an overview of all documents", "What are the main themes?", "Where does Ada work?", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(q)], "i int, q string").select("i", is_global(F.col("q")).alias("g"), is_broad(F.col("q")).alias("b"))
    assert [r["g"] for r in df.orderBy("i").collect()] == [True, True, False, False, False]
    assert [r["b"] for r in df.orderBy("i").collect()][:3] == [True, True, False]


def test_tolerant_json_of_null(spark):
    r = spark.createDataFrame([(None,), ("{",)], "t string").select(tolerant_extraction(F.col("t")).alias("x")).collect()
    assert all(x["x"]["entities"] == [] and x["x"]["relationships"] == [] for x in r)


def test_interleave_and_budget(spark):
    a = spark.createDataFrame([("g", "x", 1), ("g", "y", 2)], "g string, k string, rank int")
    b = spark.createDataFrame([("g", "y", 1), ("g", None, 2), ("g", "z", 3)], "g string, k string, rank int")
    got = R.interleave(a, b, "g", "k", "rank")
    assert [r["k"] for r in got.orderBy("position").collect()] == ["x", "y", "z"]
    sized = got.withColumn("n", F.when(F.col("k") == "y", 50).otherwise(10))
    assert [r["k"] for r in R.budgeted(sized, "g", "position", F.col("n"), 40).collect()] == ["x"]  # stops, does not skip


def test_skew_safe_lookup_with_a_hot_key(spark, monkeypatch):
    from weftgraph.operators import skew

    monkeypatch.setattr(skew, "HOT_LEAST", 5)
    monkeypatch.setattr(skew, "HOT_PARTS", 4)
    big = spark.createDataFrame([(1 if i < 30 else i, i) for i in range(60)] + [(None, 99)], "k int, i int")
    small = spark.createDataFrame([(k, k * 2) for k in range(50)], "k int, v int")
    got = {r["i"]: r["v"] for r in skew_safe_lookup(big, small, "k").collect()}
    assert len(got) == 61 and got[3] == 2 and got[40] == 80 and got[55] is None and got[99] is None


def test_spread_rank_is_a_rank(spark):
    df = spark.range(3000).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    got = spread_rank(df, ["g"], F.xxhash64("id")).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["rank"]) == list(range(len(part)))
    import numpy as np

    h = df.select("id", F.xxhash64("id").alias("h")).toPandas().merge(got, on="id").sort_values(["g", "rank"])
    assert all(np.all(np.diff(p["h"]) > 0) for _, p in h.groupby("g"))


def test_clusters_and_rewrite(spark):
    m = spark.createDataFrame([(1, "Acme"), (1, "Acme Corp"), (1, "ACME"), (2, "Solo")], "c int, n string")
    assert rows(S.clusters(m, "c", "n")) == [(1, "Acme Corp", 3, "Acme Corp|ACME|Acme")]
    e = spark.createDataFrame([("Acme", "Bob", "R"), ("ACME", "Bob", "R"), ("Acme", "ACME", "R")], "source string, target string, rel_type string")
    al = spark.createDataFrame([("Acme", "Acme Corp"), ("ACME", "Acme Corp")], "name string, canonical string")
    assert rows(S.rewrite_edges(e, al)) == [("Acme Corp", "Bob", "R")]


def test_within_groups_leaves_out_unusable_vectors(spark):
    v = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 0.0], "a"), (4, None, "a"), (5, [1.0, 0.0], "b"), (6, [float("nan"), 1.0], "a")]
    got = rows(S.within_groups(spark.createDataFrame(v, "i bigint, v array<float>, g string"), "i", "v", "g", 2, 0.5))
    assert [r[:2] for r in got] == [(1, 2)]


def test_streams(spark):
    e = spark.createDataFrame([(1, "2024-01-01", 7, "view"), (2, "2024-01-02", 7, "error"), (3, "2024-01-03", 7, "view"), (4, "2024-01-01", 8, "view"), (5, "2024-01-01", None, "view")], "event_id bigint, ts string, user_id bigint, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["event_id"] for r in J.until_terminal(e, "user_id", ["ts", "event_id"], "event_type").collect()) == [1, 2, 4]
    assert {r["event_id"]: r["processed"] for r in J.progress(e, "user_id", "ts", "event_id").collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    f = J.frames(e.limit(1), "event_id").unionByName(spark.createDataFrame([("data: {oops",), ("",)], "frame string"))
    assert len(J.read_frames(f, "frame", "event_id bigint").collect()) == 1


def _named(n, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(n, 8))
    for i in range(n):
        name = "".join(rng.choice(list("abdeilmnorst"), 7)) + " " + rng.choice(["Élan", "group", "östlich"])
        for j, (form, kind) in enumerate([(name, "Org"), (f" {name[:3]}{name[4:]} ", "ORG "), (name + "s", None), (" ".join(reversed(name.split())), "org"), (name[1:], "")]):
            v = base[i] + 0.12 * j * rng.normal(size=8)
            rows.append((10 * i + j, form, kind, None if j == 4 and i % 3 == 0 else [float(x) for x in v]))
    return rows


def _brute_duplicates(rows):
    import numpy as np

    from weftgraph.functions.pyfuncs import unicode_tokens

    first = {}
    for _, n, k, v in sorted(rows, key=lambda r: r[0]):
        if n is not None and n.strip():
            first.setdefault(n.strip(), ((k or "").strip().upper() or "UNKNOWN", v))
    out = set()
    for a in first:
        for b in first:
            (ka, va), (kb, vb) = first[a], first[b]
            if a < b and ka == kb and va and vb and {t[0] for t in unicode_tokens(a)} & {t[0] for t in unicode_tokens(b)}:
                x, y = np.array(va), np.array(vb)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93 and ratio(a, b) >= 0.87:
                    out.add((a, b))
    return out


@pytest.mark.parametrize("part", [4096, 7])
def test_duplicate_pairs_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(S, "PART_ROWS", part)
    rows = _named(40, 3)
    rows += [(9000, rows[0][1], "PERSON", rows[5][3]), rows[0], (9001, None, "Org", rows[0][3]), (9002, "  ", "Org", rows[0][3])]
    df = spark.createDataFrame(rows, "rec bigint, nm string, ty string, em array<double>")
    got = [(r["left"], r["right"]) for r in S.duplicate_pairs(df, "rec", "nm", "ty", "em", 8).collect()]
    want = _brute_duplicates(rows)
    assert len(want) >= 20 and sorted(got) == sorted(want)


def test_duplicates_with_other_spellings_are_merged(spark):
    rows = _named(40, 5)
    df = spark.createDataFrame(rows, "rec bigint, nm string, ty string, em array<double>")
    pairs = S.duplicate_pairs(df, "rec", "nm", "ty", "em", 8)
    group = {n: {n} for p in _brute_duplicates(rows) for n in p}
    for a, b in _brute_duplicates(rows):
        both = group[a] | group[b]
        group |= dict.fromkeys(both, both)
    want = {(n, min(g, key=lambda x: (-len(x), -len(x.split()), x))) for n, g in group.items()}
    want = {(n, c) for n, c in want if n != c}
    assert {tuple(r) for r in S.duplicate_aliases(pairs).collect()} == want and len(want) > 20
    name, canonical = sorted(want)[0]
    edges = spark.createDataFrame([(name, "other", "R"), (canonical, "other", "R"), (name, canonical, "R")], "source string, target string, rel_type string")
    assert [tuple(r) for r in S.rewrite_edges(edges, S.duplicate_aliases(pairs)).collect()] == [(canonical, "other", "R")]


def test_nearest_in_groups_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(S, "PART_ROWS", 7)
    rng = np.random.default_rng(4)
    v = [(i, [float(x) for x in np.round(rng.normal(size=3), 1)], "a" if i % 3 else "b") for i in range(60)] + [(90, None, "a"), (91, [1.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(v, "i bigint, v array<float>, g string")
    got = {tuple(r) for r in S.nearest_in_groups(df, F.expr("i % 4 = 0"), "i", "v", "g", 3, 2).select("query", "id", "rank").collect()}
    unit = {i: np.array(x, np.float32).astype(float) / np.linalg.norm(np.array(x, np.float32).astype(float)) for i, x, g in v if x and g and any(x)}
    want = set()
    for i, _, g in v:
        if i in unit and i % 4 == 0:
            order = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j, _, h in v if j in unit and j != i and h == g)
            want |= {(i, j, r + 1) for r, (_, j) in enumerate(order[:2])}
    assert got == want
    assert S.nearest_in_groups(df.limit(0), F.expr("i % 4 = 0"), "i", "v", "g", 3, 2).count() == 0


def test_a_hub_of_a_third_of_all_edges(spark, monkeypatch):
    from weftgraph.operators import skew

    edges = [("hub", f"n{i}", "R") for i in range(40)] + [(f"n{i}", f"m{i}", "R") for i in range(40)] + [(f"m{i}", f"k{i}", "S") for i in range(40)]
    df, seeds = spark.createDataFrame(edges, "source string, target string, rel_type string"), spark.createDataFrame([("hub",), ("k3",), ("alone",)], "name string")
    plain = rows(G.frontier(seeds, df, 2)), rows(G.one_hop(seeds, df)), rows(G.label_propagation(G.edge_weights(df), 2))
    for m in (G, skew):
        monkeypatch.setattr(m, "HOT_LEAST", 5)
    monkeypatch.setattr(skew, "HOT_PARTS", 8)
    assert G.hot_nodes(G.adjacency(df)) == ["hub"]
    assert (rows(G.frontier(seeds, df, 2)), rows(G.one_hop(seeds, df)), rows(G.label_propagation(G.edge_weights(df), 2))) == plain
    assert ("alone", None, None) in plain[1] and len(plain[0]) == 3 + 40 + 40
