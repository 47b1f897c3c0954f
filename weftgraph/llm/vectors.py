"""The k most similar vectors of every vector: inverted file, product-quantised residuals, exact reranking.

Index: coarse centroids by k-means on a bounded sample. Their number grows with the rows up to MAX_LISTS; from there on a
list is divided by the residual: every vector belongs to the nearest cell of a codebook of residuals that all lists share
(scaled by the list's own spread), with as many cells as bring a list back to LIST_ROWS vectors. So the centroids that have
to be kept are bounded while the lists go on growing with the rows, and a vector probes a constant number of lists.
Lists are gathered into buckets, neighbours together (recursive bisection along the main axis), so that the lists a vector
probes lie in few buckets. A vector is a member of every list it probes, and any two members of a list meet: a pair is missed
only if none of its vectors' nearest lists is the same, where it used to be missed if neither probed the list nearest to the
other. One shuffle sends each vector, with the product-quantised residual to its nearest list, to the buckets of its lists. A
bucket's task scans each list once for both vectors of a pair by the asymmetric distance (the entries of the tables summed as one
product with the decoded vectors), and compares exactly whatever the quantiser's own error allows to be near enough, at last in
double precision. A last shuffle merges the few results per vector and bucket.

Every row is indexed; only centroids, cells and quantisers are fitted on the sample, which is drawn from the different vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coarse lists, at most, and vectors of the training sample for each of them (about).
MAX_LISTS, SAMPLE_PER_LIST = 2_048, 16
#: A coarse list of more than twice LIST_ROWS vectors is divided into cells of about LIST_ROWS; 2 ** MAX_DEPTH cells at most.
LIST_ROWS, MAX_DEPTH = 512, 12
#: Vectors of a bucket: as many as give every partition of the session one, within these bounds.
BUCKET_LEAST, BUCKET_ROWS = 4_096, 16_384
#: Vectors whose value occurs more often than max(COPIES_LEAST, rows / COPIES_PARTS) travel once: fewer than COPIES_PARTS.
COPIES_LEAST, COPIES_PARTS = 256, 1_000
SUBSPACES, CODES = 8, 256
#: Candidates whose asymmetric estimate lies further below the least cosine are not reranked; in standard errors of the estimate
#: at a right angle, which are nearly twice those at a cosine of 0.85.
SLACK = 3.0


def usable(vec: Column, dim: int) -> Column:
    """True if the vector has ``dim`` finite components, not all zero."""
    ok = (F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of ``x`` (float32); empty clusters are reseeded from random rows."""
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(len(c)))
        full = n > 0
        sums = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        c[full] = sums[full] / n[full, None]
        if (~full).any():
            c[~full] = x[rng.integers(0, len(x), (~full).sum())]
    return c.astype(np.float32)


def _bisect(c: np.ndarray, weight: np.ndarray, target: float) -> np.ndarray:
    """Bucket of every centroid: groups of neighbouring centroids of about ``target`` weight."""
    bucket, stack, nxt = np.zeros(len(c), np.int32), [np.arange(len(c))], 0
    while stack:
        ix = stack.pop()
        if weight[ix].sum() <= target or len(ix) == 1:
            bucket[ix] = nxt
            nxt += 1
            continue
        x = c[ix] - c[ix].mean(0)
        axis = np.linalg.svd(x, full_matrices=False)[2][0] if len(ix) > 2 else x[0]
        order = ix[np.argsort(x @ axis, kind="stable")]
        parts = math.ceil(weight[ix].sum() / target)
        half = np.searchsorted(np.cumsum(weight[order]), weight[order].sum() * (parts // 2) / parts)
        half = min(max(int(half), 1), len(ix) - 1)
        stack += [order[:half], order[half:]]
    return bucket


def _coarse_lists(rows: int) -> int:
    """Twice the root of the rows, as a power of two, up to MAX_LISTS."""
    return int(min(MAX_LISTS, 2 ** round(math.log2(max(2.0, 2 * math.sqrt(rows))))))


def train(sample: np.ndarray, rows: int, bucket_rows: int | None = None, seed: int = 5) -> dict:
    """Coarse centroids, cells of the heavy lists, the buckets of lists and cells, and residual quantisers."""
    rng = np.random.default_rng(seed)
    x = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    target = BUCKET_ROWS if bucket_rows is None else bucket_rows
    c = _kmeans(x, min(_coarse_lists(rows), max(1, len(x) // 8)), 6, rng)
    near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
    drawn = np.bincount(near, minlength=len(c))
    weight = (drawn + 0.5) * rows / len(x)
    resid = x - c[near]
    norm2 = (resid * resid).sum(1)
    spread = np.sqrt((np.bincount(near, norm2, minlength=len(c)) + norm2.mean()) / (drawn + 1)).astype(np.float32)
    depth = np.where(weight > 2 * LIST_ROWS, np.clip(np.round(np.log2(weight / LIST_ROWS)), 1, MAX_DEPTH), 0).astype(np.int64)
    scaled = resid / np.maximum(spread[near], 1e-12)[:, None]
    cells, place = {}, {}
    for d in sorted(set(depth[depth > 0].tolist())):
        book = _kmeans(scaled, min(2**d, len(scaled)), 4, rng)
        book = book[_along_axes(book)]  # neighbouring cells stand side by side
        share = np.bincount(np.argmax(scaled @ book.T - 0.5 * (book * book).sum(1), axis=1), minlength=len(book)) + 0.5
        cells[d], place[d] = book, (np.cumsum(share) - share / 2) / share.sum()
    offset = np.concatenate([[0], np.cumsum([len(cells[d]) if d else 1 for d in depth.tolist()])])
    bucket = _bisect(c, weight, target).astype(np.int64)
    parts = np.where(depth > 0, np.maximum(1, np.ceil(weight / target)), 1).astype(np.int64)
    parts = np.minimum(parts, np.diff(offset))
    first = np.full(len(c), -1, np.int64)
    top = int(bucket.max()) + 1
    for i in np.nonzero(parts > 1)[0]:  # a heavy list gets buckets of its own
        first[i] = top
        top += int(parts[i])
    used = np.unique(np.concatenate([bucket[parts == 1], np.arange(int(bucket.max()) + 1, top)]))  # buckets that hold anything
    index = {"c": c, "spread": spread, "depth": depth, "cells": cells, "place": place, "offset": offset, "parts": parts, "buckets": len(used)}
    index["bucket"] = np.searchsorted(used, np.where(parts == 1, bucket, used[0]))
    index["first"] = np.searchsorted(used, np.where(parts > 1, first, used[0]))
    own = _probes(x, index, 1, 0.0)[:, 0]
    resid = x - _centres(index, own)
    small = resid[rng.choice(len(resid), size=min(4096, len(resid)), replace=False)]
    width = -(-x.shape[1] // SUBSPACES)
    small = np.pad(small, ((0, 0), (0, width * SUBSPACES - x.shape[1])))
    books = np.stack([np.resize(_kmeans(np.ascontiguousarray(small[:, m * width : (m + 1) * width]), CODES, 4, rng), (CODES, width)) for m in range(SUBSPACES)])
    return index | {"books": books.astype(np.float32)}


def _along_axes(c: np.ndarray) -> np.ndarray:
    """An order of the rows of ``c`` by recursive bisection along the main axis of each part."""
    out, stack = [], [np.arange(len(c))]
    while stack:
        ix = stack.pop()
        if len(ix) <= 2:
            out.append(ix)
            continue
        x = c[ix] - c[ix].mean(0)
        values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
        order = ix[np.argsort(x @ axes[:, np.argmax(values)], kind="stable")]
        stack += [order[len(ix) // 2 :], order[: len(ix) // 2]]
    return np.concatenate(out)


def _centres(index: dict, lists: np.ndarray) -> np.ndarray:
    """Centroids of ``lists``: that of the coarse list, and the cell's where it is divided."""
    coarse = np.searchsorted(index["offset"], lists, side="right") - 1
    out = index["c"][coarse].copy()
    for d, book in index["cells"].items():
        i = np.nonzero(index["depth"][coarse] == d)[0]
        out[i] += index["spread"][coarse[i], None] * book[lists[i] - index["offset"][coarse[i]]]
    return out


def _bucket(index: dict, lists: np.ndarray) -> np.ndarray:
    """Bucket of every one of ``lists``."""
    coarse = np.searchsorted(index["offset"], lists, side="right") - 1
    out = index["bucket"][coarse]
    for d, place in index["place"].items():
        i = np.nonzero((index["depth"][coarse] == d) & (index["parts"][coarse] > 1))
        of = coarse[i]
        out[i] = index["first"][of] + (place[lists[i] - index["offset"][of]] * index["parts"][of]).astype(np.int64)
    return out


def _best_columns(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest scores of every row, highest first."""
    k = min(k, score.shape[1])
    top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.tile(np.arange(k), (len(score), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)


def _probes(x: np.ndarray, index: dict, nprobe: int, drop: float) -> np.ndarray:
    """The ``nprobe`` nearest lists of every row, nearest first; a list much farther than the nearest is replaced by it."""
    c, depth = index["c"], index["depth"]
    score = x @ c.T - 0.5 * (c * c).sum(1)
    top = _best_columns(score, nprobe)
    val = np.take_along_axis(score, top, 1)
    lists = index["offset"][top]
    if index["cells"]:
        # the nearest cells of the coarse lists found, then the best of all
        n, k = top.shape
        wide_l, wide_v = np.repeat(lists[:, :, None], nprobe, 2), np.full((n, k, nprobe), -np.inf, np.float32)
        wide_v[:, :, 0] = val
        for d, book in index["cells"].items():
            i, j = np.nonzero((depth[top] == d) & (val >= val[:, :1] - 2 * drop - 1e-6))
            for a in range(0, len(i), 4096):
                r, t = i[a : a + 4096], top[i[a : a + 4096], j[a : a + 4096]]
                sp = index["spread"][t][:, None]
                s = sp * ((x[r] - c[t]) @ book.T) - 0.5 * sp * sp * (book * book).sum(1)
                cols = _best_columns(s, nprobe)
                w = cols.shape[1]
                wide_l[r, j[a : a + 4096], :w] = index["offset"][t][:, None] + cols
                wide_v[r, j[a : a + 4096], :w] = val[r, j[a : a + 4096]][:, None] + np.take_along_axis(s, cols, 1)
            wide_v[(depth[top] == d) & (val < val[:, :1] - 2 * drop - 1e-6)] = -np.inf
        wide_l, wide_v = wide_l.reshape(n, -1), wide_v.reshape(n, -1)
        best = _best_columns(wide_v, nprobe)
        lists, val = np.take_along_axis(wide_l, best, 1), np.take_along_axis(wide_v, best, 1)
    return np.where(val >= val[:, :1] - drop, lists, lists[:, :1])


def _routes(index: dict, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each row goes: (row, bucket, whether it is the row's home, offsets into, lists probed there); at home, the
    row's own list comes first."""
    n, k = probes.shape
    kept = np.concatenate([np.ones((n, 1), bool), probes[:, 1:] != probes[:, :1]], 1)
    r, j = np.nonzero(kept)
    lists = probes[r, j]
    to = _bucket(index, lists)
    home = to[np.nonzero(j == 0)[0]]
    by = np.lexsort((j, to, r))
    r, to, lists = r[by], to[by], lists[by]
    start = np.nonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (to[1:] != to[:-1])]))[0] if len(r) else np.empty(0, np.int64)
    return r[start], to[start], to[start] == home[r[start]], np.append(start, len(r)), lists


def _padded(index: dict, x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, index["books"].shape[0] * index["books"].shape[2] - x.shape[1])))


def _encode(index: dict, x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Product-quantised residuals of ``x`` to the centres of their ``own`` lists."""
    books = index["books"]
    width = books.shape[2]
    resid = _padded(index, x - _centres(index, own))
    codes = np.empty((len(x), len(books)), np.uint8)
    for s, b in enumerate(books):
        codes[:, s] = np.argmax(resid[:, s * width : (s + 1) * width] @ b.T - 0.5 * (b * b).sum(1), axis=1)
    return codes


def _decode(index: dict, codes: np.ndarray, own: np.ndarray, dim: int) -> np.ndarray:
    """Centre and quantised residual."""
    return _centres(index, own) + np.concatenate([b[codes[:, s]] for s, b in enumerate(index["books"])], 1)[:, :dim]


def _first_of_each(key: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` highest scores of every key."""
    best = np.lexsort((-score, key))
    of = key[best]
    return best[np.arange(len(of)) - np.searchsorted(of, of) < keep]


def _scan(x: np.ndarray, about: np.ndarray, r: np.ndarray, lists: np.ndarray, least: float | None, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (first < second) that share one of the lists: row ``r[i]`` is a member of ``lists[i]``. ``about`` are the decoded
    rows. At most ``keep`` of each row; pairs further below ``least`` than single precision explains are left out."""
    # scaled so that the estimate of a row's cosine with itself is 1: then it has no bias for any other
    with_own = np.einsum("ij,ij->i", x, about)
    about = about / np.maximum(with_own, 0.05)[:, None]
    error = np.sqrt(np.maximum(np.einsum("ij,ij->i", about, about) - 1, 0) / x.shape[1])
    floor = np.full(len(x), -np.inf) if least is None else np.where(with_own > 0.05, least - SLACK * error - 1e-5, -np.inf)
    floor = floor.astype(np.float32)
    by = np.lexsort((r, lists))
    r, lists = r[by], lists[by]
    found, held = [], 0

    def reduced() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        q, b, val = (np.concatenate(v) for v in zip(*found, strict=True))
        _, once = np.unique(q * len(x) + b, return_index=True)
        q, b, val = q[once], b[once], val[once]
        best = _first_of_each(np.concatenate([q, b]), np.concatenate([val, val]), keep) % max(1, len(q))
        best = np.unique(best)
        return [(q[best], b[best], val[best])]

    for rows in np.split(r, np.nonzero(np.diff(lists))[0] + 1) if len(r) else []:
        mine, theirs, low = x[rows], about[rows], floor[rows]
        a = 0
        while a < len(rows) - 1:
            z = min(len(rows), a + max(1, min(512, 2_000_000 // (len(rows) - a))))
            score = mine[a:z] @ theirs[a:].T
            i, j = np.nonzero(score >= low[a:])
            later = j > i
            i, j = i[later], j[later]
            if len(i) > score.size // 32:  # a dense block: the exact product is cheaper than pair by pair
                val = (mine[a:z] @ mine[a:].T)[i, j]
            else:
                val = np.einsum("ij,ij->i", mine[a + i], mine[a + j])
            if least is not None:
                ok = val >= least - 1e-5
                i, j, val = i[ok], j[ok], val[ok]
            if len(i) > keep * (z - a):
                best = np.unique(np.concatenate([_first_of_each(i, val, keep), _first_of_each(j, val, keep)]))
                i, j, val = i[best], j[best], val[best]
            if len(i):
                found.append((rows[a + i], rows[a + j], val))
                held += len(i)
                if held > 4_000_000:
                    found = reduced()
                    held = len(found[0][0]) // 2  # what is kept may not be reduced further for a while
            a = z
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    q, b, _ = reduced()[0]
    return q, b


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of every id: highest cosine, then smallest other id."""
    f = frame.sort_values(["id", "cosine", "other"], ascending=[True, False, True], kind="stable").drop_duplicates(["id", "other"])
    return f[f.groupby("id").cumcount() < k]


def _search_bucket(index: dict, copies: dict[int, list[int]], k: int, min_cosine: float | None, keep: int, dim: int, pdf: pd.DataFrame) -> pd.DataFrame:
    raw = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(-1, dim)
    ids, is_base = pdf["id"].to_numpy(np.int64), pdf["base"].to_numpy(bool)
    # equal vectors are searched once: classes of equal bytes (they probe the same lists)
    _, first, cls = np.unique(raw.view(np.dtype((np.void, 4 * dim))).ravel(), return_index=True, return_inverse=True)
    sent = pdf["lists"].to_numpy()
    probed = [sent[i] for i in first]
    lists = np.frombuffer(b"".join(probed), np.int32).astype(np.int64)
    times = np.array([len(p) // 4 for p in probed], np.int64)
    vec = raw[first].astype(np.float64)
    unit = vec / np.sqrt(np.einsum("ij,ij->i", vec, vec))[:, None]
    x = unit.astype(np.float32)
    based = np.zeros(len(first), bool)
    based[cls[is_base]] = True
    b_rows = np.nonzero(based)[0]
    codes = pdf["code"].to_numpy(np.int64)[first].view(np.uint8).reshape(-1, SUBSPACES)
    about = _decode(index, codes, pdf["own"].to_numpy(np.int64)[first], dim)
    q, b = _scan(x, about, np.repeat(np.arange(len(first)), times), lists, min_cosine, keep)
    cos = np.empty(len(q))
    for a in range(0, len(q), 200_000):
        cos[a : a + 200_000] = np.einsum("ij,ij->i", unit[q[a : a + 200_000]], unit[b[a : a + 200_000]])
    # a pair counts for both; at home a class is a neighbour of itself: its other ids have cosine 1
    q, b, cos = np.concatenate([q, b, b_rows]), np.concatenate([b, q, b_rows]), np.round(np.concatenate([cos, cos, np.ones(len(b_rows))]), 6)
    if min_cosine is not None:
        ok = cos >= min_cosine
        q, b, cos = q[ok], b[ok], cos[ok]
    # the k + 1 smallest ids of each class; those of values with very many copies come along
    members = pd.DataFrame({"cls": cls, "id": ids})
    extra = [(int(cls[i]), c) for i in np.nonzero(np.isin(ids, list(copies)))[0] for c in copies[int(ids[i])]] if copies else []
    if extra:
        members = pd.concat([members, pd.DataFrame(extra, columns=["cls", "id"])])
    members = members.drop_duplicates().sort_values(["cls", "id"])
    members = members[members.groupby("cls").cumcount() <= k]
    pairs = pd.DataFrame({"q": q, "b": b, "cosine": cos})
    # a class has at least one id, so more than k + 1 classes are never needed, but for ties
    pairs["worst"] = pairs.groupby("q")["cosine"].rank(method="min", ascending=False)
    pairs = pairs[pairs["worst"] <= k + 1]
    wide = pairs.merge(members.rename(columns={"cls": "b", "id": "other"}), on="b")
    queries = pd.DataFrame({"q": cls, "id": ids}).drop_duplicates()
    small = _best(wide.assign(id=wide["q"])[["id", "other", "cosine"]], k + 1).rename(columns={"id": "q"})
    out = queries.merge(small, on="q")[["id", "other", "cosine"]]
    hot = out["id"].isin(list(copies))
    out = out[(out["id"] != out["other"]) | hot]
    return pd.concat([_best(out[~out["id"].isin(list(copies))], k), out[out["id"].isin(list(copies))]])


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int, min_cosine: float | None = None, nprobe: int | None = None, rerank: int = 48, drop: float = 0.1) -> DataFrame:
    """The ``k`` most similar other ids of every usable vector: ``id``, ``other``, ``cosine``.

    Cosines are computed in double precision and rounded to 6 decimals; of equal ones the smaller id comes first.
    ``min_cosine`` leaves out pairs below it. Rows with an unusable vector (null, wrong length, NaN or infinite, all zero) or a
    null id are no part of the collection; rows that repeat an id with the same vector count once; different ids with
    equal vectors count separately. Fewer than two usable vectors give no rows.

    Approximate: a vector is a member of its ``nprobe`` nearest lists (8, and one more for each doubling beyond 1,024 lists; not of those farther than ``drop`` behind the nearest), where
    it meets all members; its best ``rerank`` in a bucket go on. Recall is measured in the tests and stated in the README. A value that a
    third of all rows share travels once; a list with very many different vectors is spread over buckets.
    """
    spark = df.sparkSession
    good = df.where(usable(F.col(vec_col), dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    hashed = good.select("id", F.xxhash64("v").alias("h"), F.hash("v").alias("g"))
    per_value = hashed.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    rows, values = per_value.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if rows < 2:
        return spark.createDataFrame([], "id bigint, other bigint, cosine double")
    many = max(COPIES_LEAST, rows // COPIES_PARTS)
    hot = per_value.where(F.col("n") > many) if rows > many else per_value.limit(0)
    hot = hot.select("h", "g", "least").collect()  # fewer than COPIES_PARTS values
    copies: dict[int, list[int]] = {}
    tagged = good
    if hot:
        hot_df = F.broadcast(spark.createDataFrame(hot, "h bigint, g int, least bigint"))
        order = Window.partitionBy("least").orderBy("id")
        few = hashed.join(hot_df, ["h", "g"]).withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1).select("least", "id").distinct()
        for r in few.collect():  # k + 1 ids for each of the few values
            copies.setdefault(r["least"], []).append(r["id"])
        tagged = good.withColumn("h", F.xxhash64("v")).withColumn("g", F.hash("v")).join(hot_df, ["h", "g"], "left").where("least is null or least = id").select("id", "v")
    # the sample is drawn by a hash of the vector, so it is the same however the rows are split up, and holds a vector once
    most = SAMPLE_PER_LIST * _coarse_lists(values)  # SAMPLE_PER_LIST * MAX_LISTS at any size
    share = min(1.0, most / values)
    drawn = tagged if share >= 1 else tagged.where(F.pmod(F.xxhash64("v", F.lit(11)), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    sample = np.array(drawn.select("v").distinct().limit(2 * most).toPandas()["v"].tolist(), np.float64)
    if not len(sample):
        sample = np.array(tagged.select("v").limit(1).toPandas()["v"].tolist(), np.float64)
    bucket_rows = min(BUCKET_ROWS, max(BUCKET_LEAST, rows // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    index = train(sample, values, max(1, bucket_rows * values // rows))
    near = nprobe or 8 + max(0, round(math.log2(index["offset"][-1] / 1024)))
    shared = spark.sparkContext.broadcast(index)  # MAX_LISTS centroids and two times 2 ** MAX_DEPTH cells at most, whatever the number of rows

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def binary(flat: np.ndarray, ends: np.ndarray):
            return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])

        ix = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                raw = np.asarray(part.column(1).flatten(), np.float32).reshape(-1, dim)
                wide = raw.astype(np.float64)
                x = (wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]).astype(np.float32)
                probes = _probes(x, ix, near, drop)
                code = _encode(ix, x, probes[:, 0]).view(np.int64).ravel()
                row, to, home, ends, lists = _routes(ix, probes)
                vec = binary(np.ascontiguousarray(raw[row]), np.arange(len(row) + 1) * 4 * dim)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(ids[row], pa.int64()), pa.array(home), pa.array(probes[row, 0].astype(np.int32)), pa.array(code[row]), binary(lists.astype(np.int32), ends * 4), vec], names=["bucket", "id", "base", "own", "code", "lists", "vec"])

    # a partition is a bucket
    routed = tagged.mapInArrow(route, "bucket bigint, id bigint, base boolean, own int, code bigint, lists binary, vec binary").repartitionById(index["buckets"], F.col("bucket").cast("int"))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            yield _search_bucket(shared.value, copies, k, min_cosine, rerank, dim, pd.concat(held, ignore_index=True))

    found = routed.select("id", "base", "own", "code", "lists", "vec").mapInPandas(search, "id bigint, other bigint, cosine double")
    found = found.repartition("id").groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    if not copies:
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    merged = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).withColumn("r", F.col("r").cast("int"))
    heads = list(copies)
    plain = merged.where(~F.col("id").isin(heads) & (F.col("r") <= k)).drop("r")
    # members of the values with many copies take the list of the one that travelled, without themselves
    lists = merged.where(F.col("id").isin(heads)).select(F.col("id").alias("least"), "other", "cosine")
    all_members = hashed.join(hot_df, ["h", "g"]).select("least", "id").distinct()
    theirs = all_members.join(F.broadcast(lists), "least").where("id <> other")  # at most (k + 1) * COPIES_PARTS rows
    theirs = theirs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("id", "other", "cosine")
    return plain.unionByName(theirs)


def similar_pairs(found: DataFrame) -> DataFrame:
    """Unordered pairs of ``similar_vectors``: ``id_a`` < ``id_b``, once each."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
