import numpy as np
import pytest

from weftgraph.llm import vectors as V

DIM = 8


def brute(rows, k, least):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == DIM:
            a = np.array(v, np.float32)
            if np.isfinite(a).all() and a.any():
                seen[i] = a
    ids = sorted(seen)
    if len(ids) < 2:
        return set()
    x = np.stack([seen[i] for i in ids]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    out = set()
    for a in range(len(ids)):
        order = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a and (least is None or s[a, b] >= least))
        out |= {(ids[a], b) for _, b in order[:k]}
    return out


def clustered(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, DIM))
    rows = [(i + 1, [float(x) for x in centres[i % 12] + 0.25 * rng.normal(size=DIM)]) for i in range(n)]
    rows += [(n + 1 + i, rows[0][1]) for i in range(copies)]
    return rows


def run(spark, rows, k=3, least=None, **kw):
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    return {(r["id"], r["other"]) for r in V.similar_vectors(df, "id", "v", DIM, k, least, **kw).collect()}


@pytest.mark.parametrize("least", [None, 0.85])
def test_recall_against_brute_force(spark, least):
    rows = clustered(900, 1)
    want, got = brute(rows, 5, least), run(spark, rows, 5, least)
    assert len(want & got) / len(want) >= 0.9
    assert len(want & got) / len(got) >= 0.9


def test_a_third_of_all_rows_is_one_vector(spark, monkeypatch):
    monkeypatch.setattr(V, "COPIES_LEAST", 20)
    rows = clustered(200, 2, copies=100)
    want, got = brute(rows, 3, 0.85), run(spark, rows, 3, 0.85)
    copies = {1, *range(201, 301)}
    mine = {p for p in want if p[0] in copies}
    assert mine == {p for p in got if p[0] in copies}
    assert len(want & got) / len(want) >= 0.9


def test_heavy_lists_are_spread(spark, monkeypatch):
    monkeypatch.setattr(V, "BUCKET_ROWS", 20)
    monkeypatch.setattr(V, "MAX_LISTS", 4)
    monkeypatch.setattr(V, "LIST_ROWS", 10)
    monkeypatch.setattr(V, "SAMPLE_PER_LIST", 100)
    rows = clustered(400, 3)
    want, got = brute(rows, 3, 0.85), run(spark, rows, 3, 0.85)
    assert len(want & got) / len(want) >= 0.9


def test_unusable_and_repeated_rows(spark):
    a, b = [1.0] + [0.0] * 7, [0.9, 0.1] + [0.0] * 6
    rows = [(1, a), (1, a), (2, b), (3, None), (4, [1.0]), (5, [0.0] * 8), (6, [float("nan")] + [1.0] * 7), (7, [float("inf")] + [1.0] * 7), (None, a)]
    assert run(spark, rows, 3) == {(1, 2), (2, 1)}


def test_ties_go_to_the_smaller_id(spark):
    a, b = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    rows = [(9, a), (4, b), (2, b), (7, b)]
    assert {o for i, o in run(spark, rows, 2) if i == 9} == {2, 4}


def test_empty_and_single(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, [1.0] * 8)]) == set()


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, [1.0] * 8, 5, "x", 0.1), (2, [1.0] * 8, 6, "y", 0.2)], "key bigint, emb array<float>, id bigint, bucket string, cosine double")
    assert {(r["id"], r["other"]) for r in V.similar_vectors(df, "key", "emb", 8, 2).collect()} == {(1, 2), (2, 1)}


def test_lists_grow_with_the_rows():
    """Rows a list and copies a row stay within bounds from a million to four thousand million rows."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(500, 16))
    draw = lambda n: centres[rng.integers(0, 500, n)] + 0.6 * rng.normal(size=(n, 16))
    for rows in (10**6, 10**7, 10**8, 10**9):
        index = V.train(draw(V.SAMPLE_PER_LIST * V._coarse_lists(rows)), rows)
        assert 256 <= rows / index["offset"][-1] <= 1024
        assert rows / index["buckets"] <= 2 * V.BUCKET_ROWS
        x = draw(1000)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        probes = V._probes(x, index, 12, 0.25)
        row, to, home, ends, lists = V._routes(index, probes)
        assert home.sum() == len(x) and len(row) <= 12 * len(x) and ends[-1] == len(lists)
        assert (probes >= 0).all() and (probes < index["offset"][-1]).all() and to.max() < index["buckets"]
        per_bucket = np.bincount(V._bucket(index, probes[:, 0]), minlength=index["buckets"]) / len(x)
        assert rows < 10**8 or per_bucket.max() < 0.02  # no bucket holds a great share


def test_cells_divide_a_list_of_near_copies():
    """A third of all rows within a tight group still lies in lists of bounded size."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(8000, 16)), np.ones(16) + 0.01 * rng.normal(size=(4000, 16))])
    index = V.train(x[rng.choice(len(x), 4000, replace=False)], 3_000_000)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    own = V._probes(u, index, 1, 0.0)[:, 0]
    assert np.bincount(own).max() * 3_000_000 / len(x) < 40 * V.LIST_ROWS


def test_neighbours_on_both_sides_of_a_border_meet(spark, monkeypatch):
    """Small groups in many dimensions, more of them than lists: the lists nearest to two neighbours are often different."""
    monkeypatch.setattr(V, "BUCKET_ROWS", 500)
    monkeypatch.setattr(V, "LIST_ROWS", 8)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(500, 32)), 6, axis=0) + 0.4 * rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, v array<float>")
    got = {(r["id"], r["other"]) for r in V.similar_vectors(df, "id", "v", 32, 5, 0.8, nprobe=2).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T - 2 * np.eye(len(u))
    best = np.argsort(-s, axis=1)[:, :5]
    want = {(a, int(b)) for a in range(len(u)) for b in best[a] if s[a, b] >= 0.8}
    assert len(want & got) / len(want) >= 0.9
