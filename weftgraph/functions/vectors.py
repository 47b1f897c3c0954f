"""Vector expressions and blocked search of a query set against all rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block in a blocked search.
BLOCK_ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for null, empty, unequal lengths and zero norms."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(fits, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def usable_vector(v: Column, dim: int) -> Column:
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def hash_embedder(dim: int = 64):
    """UDF text -> unit vector: every token adds to the component its MD5 names; zeros for null and blank texts.

    An Arrow UDF: as an expression of built-ins the 128-bit arithmetic over ``dim`` components generates code that takes
    longer to compile than to run.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = known.get(w)
                if h is None:
                    h = known[w] = int(hashlib.md5(w.encode()).hexdigest(), 16)
                v[h % dim] += 1 + (h % 7) / 7
            n = np.linalg.norm(v)
            out.append(v / (n or 1.0))
        return pd.Series(out)

    return embed


def _blocks(df: DataFrame, id_col: str, vec: str, prefix: str) -> DataFrame:
    """Rows packed into blocks of about BLOCK_ROWS: ids and one binary of doubles."""

    def pack(frames):
        for pdf in frames:
            for lo in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[lo : lo + BLOCK_ROWS]
                m = np.array(part["v"].tolist(), np.float64)
                yield pd.DataFrame({f"{prefix}_ids": [part["id"].tolist()], f"{prefix}_vecs": [m.tobytes()]})

    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("v"))
    return slim.mapInPandas(pack, f"{prefix}_ids array<bigint>, {prefix}_vecs binary")


def search_all(queries: DataFrame, base: DataFrame, id_col: str, vec: str, dim: int, k: int, include_self: bool = False) -> DataFrame:
    """``query``, ``id``, ``score``, ``rank`` (from 1): the exact ``k`` nearest rows of ``base`` for each row of ``queries``.

    Ids are BIGINT and unique; vectors that are not usable are left out on both sides. Blocks of queries meet blocks of
    rows; each meeting keeps k per query, so what is shuffled is k rows per query and block, not the scores. Scores are
    cosines in double precision rounded to 6 decimals; ties go to the smaller id.
    """
    q = _blocks(queries.where(usable_vector(F.col(vec), dim)), id_col, vec, "q")
    b = _blocks(base.where(usable_vector(F.col(vec), dim)), id_col, vec, "b")

    def meet(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                qi, bi = np.asarray(r.q_ids, np.int64), np.asarray(r.b_ids, np.int64)
                x, y = (np.frombuffer(v, np.float64).reshape(-1, dim) for v in (r.q_vecs, r.b_vecs))
                x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
                for lo in range(0, len(qi), 256):
                    s = np.round(x[lo : lo + 256] @ y.T, 6) + 0.0
                    if not include_self:
                        s[qi[lo : lo + 256, None] == bi[None, :]] = -9
                    order = np.lexsort((np.broadcast_to(bi, s.shape), -s), axis=1)[:, :k]
                    val = np.take_along_axis(s, order, 1)
                    keep = val > -2
                    rows = np.repeat(np.arange(len(s)), order.shape[1]).reshape(order.shape)
                    yield pd.DataFrame({"query": qi[lo + rows[keep]], "id": bi[order[keep]], "score": val[keep]})

    # a stated query set against all rows, in blocks
    pairs = q.crossJoin(b).mapInPandas(meet, "query bigint, id bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
