"""Entity resolution: blocked pairs, canonical names, merges into the store."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.pyfuncs import name_block_keys, name_similarity, name_words
from weftgraph.functions.text import block_keys, entity_type
from weftgraph.functions.vectors import usable_vector
from weftgraph.operators.graph import connected_components
from weftgraph.operators.skew import skew_safe_lookup
from weftgraph.runtime import cut

NAME_THRESHOLD, COSINE_THRESHOLD = 0.87, 0.93
#: Groups of more rows are cut into parts of about so many, and part meets part.
PART_ROWS = 4096


def blocked_pairs(df: DataFrame, name: str, kind: str) -> DataFrame:
    """``left``, ``right``, ``kind``: different names of one kind that share a block key, the smaller first, once each."""
    keyed = df.select(F.col(name).alias("n"), F.col(kind).alias("kind")).distinct().select("n", "kind", F.explode(block_keys(F.col("n"))).alias("key"))
    a, b = keyed.select("kind", "key", F.col("n").alias("left")), keyed.select("kind", "key", F.col("n").alias("right"))
    return a.join(b, ["kind", "key"]).where("left < right").select("left", "right", "kind").distinct()


def within_groups(df: DataFrame, id_col: str, vec: str, group: str, dim: int, least: float) -> DataFrame:
    """``left``, ``right``, ``cosine``: pairs of one group with a cosine, rounded to 6 decimals, of at least ``least``; exact.

    See ``close_in_groups`` for how a large group becomes many tasks. Vectors that are not usable are left out. Ids are
    BIGINT and unique."""
    slim = df.where(usable_vector(F.col(vec), dim)).select(F.col(group).cast("string").alias("g"), F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("v"))
    return close_in_groups(slim, least - 1e-6).withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") >= least)


def close_in_groups(df: DataFrame, least: float) -> DataFrame:
    """``left``, ``right``, ``cosine``: pairs of ids of one group (``g, id, v``) with a cosine of at least ``least``, not
    rounded. Every pair of a group is compared; two parts of a large group meet in one cell, cells are spread over the tasks."""
    counts = df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_ROWS).select("g", F.ceil(F.col("n") / PART_ROWS).alias("m"))
    parted = df.join(counts, "g", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("id"), "m"))
    cells = parted.select(F.explode(F.expr("transform(sequence(0L, m - 1), o -> struct(least(p, o) as i, greatest(p, o) as j))")).alias("c"), "g", "p", "id", "v")
    cells = cells.select(F.xxhash64("g", "c.i", "c.j").alias("cell"), F.expr("c.i = c.j").alias("same"), (F.col("p") == F.col("c.i")).alias("low"), "id", "v")

    def meet(ids, vecs, low, same):
        x = np.array(vecs, np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, low = np.asarray(ids, np.int64), np.asarray(low, bool)
        a, b = (np.arange(len(ids)),) * 2 if same else (np.nonzero(low)[0], np.nonzero(~low)[0])
        for at in range(0, len(a), 1024):
            r = a[at : at + 1024]
            s = x[r] @ x[b].T
            i, j = np.nonzero((s >= least) & ((r[:, None] < b[None, :]) if same else np.ones(s.shape, bool)))
            left, right = ids[r[i]], ids[b[j]]
            yield pd.DataFrame({"left": np.minimum(left, right), "right": np.maximum(left, right), "cosine": s[i, j]})

    def scan(frames):
        cell, same, held = None, True, ([], [], [])
        for pdf in frames:  # sorted, so the rows of a cell follow one another
            at = np.nonzero(np.diff(pdf["cell"].to_numpy()))[0] + 1
            for lo, hi in zip([0, *at], [*at, len(pdf)], strict=True):
                part = pdf.iloc[lo:hi]
                if not len(part):
                    continue
                if part["cell"].iloc[0] != cell:
                    if len(held[0]) > 1:
                        yield from meet(*held, same)
                    cell, same, held = part["cell"].iloc[0], bool(part["same"].iloc[0]), ([], [], [])
                for h, c in zip(held, ("id", "v", "low"), strict=True):
                    h.extend(part[c])
        if len(held[0]) > 1:
            yield from meet(*held, same)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(scan, "left bigint, right bigint, cosine double")


def nearest_in_groups(df: DataFrame, asks: Column, id_col: str, vec: str, group: str, dim: int, k: int) -> DataFrame:
    """``query``, ``id``, ``score``, ``rank``: the exact ``k`` nearest others of its group for each row of ``asks``.

    Queries and rows of a group are cut into parts, and part meets part in a cell of bounded size, so only queries are
    compared and a large group is many tasks. Cosines in double precision, rounded to 6 decimals; ties go to the smaller id.
    Vectors that are not usable are left out on both sides. Ids are BIGINT and unique.
    """
    slim = df.where(usable_vector(F.col(vec), dim)).select(F.col(group).cast("string").alias("g"), F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    parts = slim.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("m"), F.ceil(F.count_if("asks") / PART_ROWS).alias("mq")).where("mq > 0")
    at = skew_safe_lookup(slim, parts, "g").where("m is not null").withColumn("h", F.xxhash64("id"))
    base = at.select("g", "id", "v", F.pmod("h", "m").alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("mq") - 1)).alias("s"), F.lit(False).alias("q"))
    query = at.where("asks").select("g", "id", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("p"), F.pmod("h", "mq").alias("s"), F.lit(True).alias("q"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, q = pdf["id"].to_numpy(np.int64), pdf["q"].to_numpy(bool)
        a, b = ids[q], ids[~q]
        out = []
        for lo in range(0, len(a), 512):
            score = np.round(x[q][lo : lo + 512] @ x[~q].T, 6) + 0.0
            score[a[lo : lo + 512, None] == b[None, :]] = -9
            best = np.lexsort((np.broadcast_to(b, score.shape), -score), axis=1)[:, :k]
            val = np.take_along_axis(score, best, 1)
            keep = val > -2
            out.append(pd.DataFrame({"query": np.broadcast_to(a[lo : lo + 512, None], best.shape)[keep], "id": b[best[keep]], "score": val[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query": a, "id": a, "score": a.astype(float)})

    cells = base.unionByName(query).withColumn("cell", F.xxhash64("g", "p", "s")).select("cell", "id", "v", "q")
    found = cells.groupBy("cell").applyInPandas(meet, "query bigint, id bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def duplicate_pairs(df: DataFrame, record: str, name: str, kind: str, vec: str, dim: int) -> DataFrame:
    """``left``, ``right``, ``kind``, ``cosine``, ``similarity``: different names of one type that share a block key, with a
    cosine of at least COSINE_THRESHOLD and a name similarity of at least NAME_THRESHOLD; the smaller name first, once each.

    A name is one record, with the type and the vector of its row of smallest ``record``; without a usable vector there it
    is in no pair. Names are trimmed, as in the graph view. The cosine is applied where blocks meet, so only pairs
    above it come out of a block; every pair of a block is compared.
    """
    rows = df.select(record, F.trim(name).alias("name"), entity_type(F.col(kind)).alias("kind"), F.struct(vec).alias("v")).where("name <> ''")
    rows = rows.groupBy("name").agg(F.min_by(F.struct("kind", "v"), F.struct(record, F.xxhash64("kind", "v"))).alias("r"))
    rows = rows.select("name", "r.kind", F.col(f"r.v.{vec}").alias("v")).where(usable_vector(F.col("v"), dim))
    names = cut(rows.withColumn("id", F.monotonically_increasing_id()))
    keyed = names.select("id", "v", F.col("kind"), F.explode(name_block_keys()("name")).alias("key")).select("id", "v", F.concat_ws("\x1f", "kind", "key").alias("g"))
    near = close_in_groups(keyed, COSINE_THRESHOLD)
    near = near.groupBy("left", "right").agg(F.max("cosine").alias("cosine"))
    a, b = names.select(F.col("id").alias("left"), F.col("name").alias("a"), "kind"), names.select(F.col("id").alias("right"), F.col("name").alias("b"))
    pairs = near.join(a, "left").join(b, "right").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "kind", "cosine")
    return pairs.withColumn("similarity", name_similarity()("left", "right")).where(F.col("similarity") >= NAME_THRESHOLD)


def canonical_key(name: Column) -> Column:
    """Order of canonical names: the longest, then that of most words, then the first by code points."""
    n = F.trim(name)
    return F.struct((-F.length(n)).alias("a"), (-F.size(F.split(n, r"(?U)\s+"))).alias("b"), name.alias("c"))


def duplicate_aliases(pairs: DataFrame) -> DataFrame:
    """``name``, ``canonical`` of every name of ``pairs`` (``left``, ``right``) that is not its cluster's canonical name.

    Clusters are the connected components; canonical is the longest name, then that of most words, then the first.
    """
    comp = connected_components(cut(pairs.select(F.col("left").alias("a"), F.col("right").alias("b"))))
    member = cut(comp.select("component", F.col("node").alias("name")).withColumn("words", name_words()("name")))
    best = member.groupBy("component").agg(F.min_by("name", F.struct((-F.length("name")).alias("a"), (-F.col("words")).alias("b"), F.col("name").alias("c"))).alias("canonical"))
    return member.join(best, "component").where("name <> canonical").select("name", "canonical")


def clusters(member: DataFrame, component: str, name: str) -> DataFrame:
    """``component``, ``canonical``, ``size``, ``members`` joined by a bar (canonical first, the others sorted); two names or more."""
    g = member.groupBy(component).agg(F.min_by(name, canonical_key(F.col(name))).alias("canonical"), F.count_distinct(name).alias("size"), F.array_sort(F.collect_set(name)).alias("all"))
    g = g.where(F.col("size") > 1)
    rest = F.filter("all", lambda x: x != F.col("canonical"))
    return g.select(component, "canonical", "size", F.array_join(F.concat(F.array("canonical"), rest), "|").alias("members"))


def rewrite_edges(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their canonical names; loops and repeats that arise are dropped. ``alias``: name, canonical."""
    s = alias.select(F.col("name").alias("source"), F.col("canonical").alias("cs"))
    t = alias.select(F.col("name").alias("target"), F.col("canonical").alias("ct"))
    out = edges.join(s, "source", "left").join(t, "target", "left").select(F.coalesce("cs", "source").alias("source"), F.coalesce("ct", "target").alias("target"), "rel_type")
    return out.where("source <> target").distinct()
