import random

from weftgraph.llm import canonical as C


def forms(spark, rows=(("PERSON", 1, ["human"]), ("COMPANY", 2, ["firm", "trading house"]), ("RESEARCH_STUDY", 3, ["study"]))):
    ref = spark.createDataFrame([(k, n, f) for n, k, f in rows], "k int, n string, f array<string>")
    return C.reference_forms(ref, "k", ["n", "f"])


def mapped(spark, values, f=None):
    df = spark.createDataFrame([(v, 1, "x") for v in values], "t string, score int, form2 string")
    return {r["t"]: r["entry"] for r in C.map_values(df, "t", forms(spark) if f is None else f).collect()}


def test_values(spark):
    got = mapped(spark, ["person", "Persons", " [PERSON] ", "kind/human", "1. person", "compnay", "companies", "Company (main)", "firm - primary", "research study", "reserch study", "personne", "mollusc", "study of research", "n/a", "???", "", "  ", "x61q", None, "person"])
    want = {"person": 1, "Persons": 1, " [PERSON] ": 1, "kind/human": 1, "1. person": 1, "compnay": 2, "companies": 2, "Company (main)": 2, "firm - primary": 2, "research study": 3, "reserch study": 3, "personne": 1, "study of research": 3}
    assert {k: v for k, v in got.items() if v} == want
    assert None not in got and len(got) == 19


def test_ties_between_entries_fail(spark):
    f = forms(spark, (("abcdef", 1, []), ("abcdeg", 2, [])))
    assert mapped(spark, ["abcdeh", "abcdef"], f) == {"abcdeh": None, "abcdef": 1}


def test_empty_tables(spark):
    assert mapped(spark, ["person"], forms(spark).limit(0)) == {"person": None}
    df = spark.createDataFrame([], "t string")
    assert C.map_values(df, "t", forms(spark)).count() == 0


def test_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "human"), (2, None), (3, "zzz")], "id int, t string")
    assert {r["id"]: r["entry"] for r in C.map_column(df, "t", forms(spark)).collect()} == {1: 1, 2: None, 3: None}


def brute(values, forms, threshold, margin):
    """Cosines of every value with every form, without an index."""
    import math

    def grams(t):
        t = f"^{t}$"
        return {t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1)}

    df = {}
    for f in forms:
        for g in grams(f):
            df[g] = df.get(g, 0) + 1
    w = lambda g: math.log(1 + len(forms) / df.get(g, 1)) if g in df else math.log(1 + len(forms))
    norm = lambda gs: math.sqrt(sum(w(g) ** 2 for g in gs))
    out = {}
    for v in values:
        if v in forms:
            out[v] = forms[v]
            continue
        best = {}
        for f, e in forms.items():
            s = round(sum(w(g) ** 2 for g in grams(v) & grams(f)) / (norm(grams(v)) * norm(grams(f))), 6)
            best[e] = max(best.get(e, 0), s)
        first, *rest = sorted(((s, e) for e, s in best.items()), reverse=True)
        out[v] = first[1] if first[0] >= threshold and round(first[0] - (rest[0][0] if rest else 0), 6) >= margin else None
    return out


def test_index_loses_nothing_against_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(2, 9)))
    forms = {word(): rnd.randrange(12) for _ in range(60)}
    values = {word() for _ in range(150)} | {f[:-1] + rnd.choice("abcde") for f in forms if len(f) > 2}
    f = spark.createDataFrame(list(forms.items()), "form string, entry int")
    for threshold, margin in ((0.55, 0.02), (0.4, 0.1)):
        df = spark.createDataFrame([(v,) for v in values], "t string")
        got = {r["t"]: r["entry"] for r in C.map_values(df, "t", f, threshold, margin).collect()}
        assert got == brute(values, forms, threshold, margin)


def test_values_in_use(spark):
    schema = "id bigint, t string, name string, aliases array<string>, norm string, k string"
    rows = [(i, t, n, a, "x", "y") for i, (t, n, a) in enumerate(
        [("human", f"Person {x}", None) for x in "abcd"] + [("firm", f"House {x}", []) for x in "abcd"]
        + [("MENSCH", f"{x}, person", None) for x in "abc"] + [("thing", "Person a", [None, ""]), ("thing", "House b", None), ("thing", "nobody", ["House c", "Person d"])]
        + [("rare", "Person a", None), (None, "Person a", None), ("", "Person b", None), ("mensch", None, ["Person d"])]
    )]
    df = spark.createDataFrame(rows + rows[:3], schema)
    used = {r["raw"]: r["entry"] for r in C.values_in_use(df, "id", "t", "name", "aliases", forms(spark), votes=3).collect()}
    assert used == {"mensch": 1, "thing": None}
    assert C.values_in_use(df.limit(0), "id", "t", "name", "aliases", forms(spark)).count() == 0
    never = spark.createDataFrame([("persn",)], "raw string")
    got = {r["t"]: r["entry"] for r in C.map_values(df.selectExpr("'persn' as t"), "t", forms(spark), never=never).collect()}
    assert got == {"persn": None}


def test_long_values(spark):
    assert mapped(spark, ["word " * 10_000, "person"]) == {"word " * 10_000: None, "person": 1}
