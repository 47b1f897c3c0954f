"""Consolidating pairwise matches into groups by randomised graph contraction.

Each round draws a fresh hash order of the vertices; every vertex hooks to the smallest member of its closed
neighbourhood in that order, edges are relabelled with the hooks, loops and repeats are dropped. A constant share of the
vertices is expected to vanish per round whatever the shape of the graph, so chains need O(log n) rounds too. Once only
LOCAL_EDGES edges are left, the remaining rounds run the same steps on arrays in one task, as each would cost more to
schedule than to compute. At the end the rounds' mappings are expanded from the last to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import HOT_LEAST, HOT_PARTS, skew_safe_lookup
from weftgraph.runtime import cut


#: So many edges (half a megabyte) are contracted to the end by one task.
LOCAL_EDGES = 32_768


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of ``x`` (multiplications and shifts of splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def contract_arrays(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``v``, ``r`` as of ``contract`` for edges in arrays: the same rounds of hooks, relabelling and repeats dropped."""
    v = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(v, a), np.searchsorted(v, b)
    top, seed = np.arange(len(v)), 0
    while True:
        edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        if not len(edges):
            return v, v[top]
        a, b = edges[:, 0], edges[:, 1]
        order = np.argsort(_mixed(v, seed), kind="stable")
        place = np.empty(len(v), np.int64)
        place[order] = np.arange(len(v))
        least = place.copy()
        np.minimum.at(least, a, place[b])
        np.minimum.at(least, b, place[a])
        hook = order[least]
        top, a, b = hook[top], hook[a], hook[b]
        seed += 1


def _finish(edges: DataFrame) -> DataFrame:
    """``contract`` of at most LOCAL_EDGES edges, in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            all_edges = pd.concat(held)
            v, r = contract_arrays(all_edges["a"].to_numpy(np.int64), all_edges["b"].to_numpy(np.int64))
            yield pd.DataFrame({"v": v, "r": r})

    return edges.select("a", "b").coalesce(1).mapInPandas(run, "v bigint, r bigint")


def _relabel(edges: DataFrame, hooks: DataFrame, end: str, hot: list[int]) -> DataFrame:
    """``edges`` with ``end`` replaced by its hook; vertices of very high degree (``hot``, bounded) meet theirs by broadcast."""
    h = hooks.select(F.col("v").alias(end), F.col("r").alias("__r"))
    rest = [c for c in edges.columns if c != end]

    def out(df: DataFrame) -> DataFrame:
        return df.select(*rest, F.col("__r").alias(end))

    if not hot:
        return out(edges.join(h, end))
    is_hot = F.col(end).isin(hot)
    return out(edges.where(is_hot).join(F.broadcast(h.where(is_hot)), end)).unionByName(out(edges.where(~is_hot).join(h, end)))


def contract(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Component representative of every vertex that has an edge to another vertex.

    ``edges``: columns ``a``, ``b`` BIGINT, no nulls; loops and repeats are allowed. Returns ``v``, ``r``: ``r`` is one
    vertex of the component of ``v``, the same for all of them. An empty table gives an empty result.
    """
    canon = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current = cut(canon(edges.select("a", "b")))
    left = current.count()
    rounds: list[DataFrame] = []
    while left > LOCAL_EDGES:
        if len(rounds) >= max_rounds:
            raise RuntimeError(f"{left} edges remain after {max_rounds} rounds")
        seed = F.lit(len(rounds) * 7919 + 17)
        rank = lambda c: F.struct(F.xxhash64(F.col(c), seed).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        both = current.select(F.col("a").alias("v"), F.col("b").alias("w")).union(current.select("b", "a"))
        hooks = both.groupBy("v").agg(F.min(rank("w")).alias("m"), F.count(F.lit(1)).alias("deg"))
        hooks = cut(hooks.select("v", F.least(F.col("m"), rank("v"))["x"].alias("r"), "deg"))
        # a vertex of degree above the bound is hot; there are fewer than 2 * HOT_PARTS of them
        bound = max(HOT_LEAST, left // HOT_PARTS)
        hot = [r[0] for r in hooks.where(F.col("deg") > bound).select("v").collect()] if left > HOT_LEAST else []
        rounds.append(hooks.select("v", "r"))
        current = cut(canon(_relabel(_relabel(current, hooks, "a", hot), hooks, "b", hot)))
        left = current.count()
    total = cut(_finish(current))
    while rounds:
        later = total.select(F.col("v").alias("r"), F.col("r").alias("__top"))
        now = rounds.pop()
        total = skew_safe_lookup(now, later, "r").select("v", F.coalesce("__top", "r").alias("r"))
        if len(rounds) % 3 == 0:
            total = cut(total)
    return total


def consolidate_pairs(pairs: DataFrame, left: str, right: str, link: str | None = None) -> DataFrame:
    """Group of every name that occurs in ``pairs``.

    ``link``: SQL condition under which a row connects its two names (default: always). A row with a null side or a
    condition that is null or false connects nothing, but its names still come out. Names are compared exactly as stored.
    Returns ``name``, ``group_name``: the smallest name of the group in UTF-8 byte order; one row per different non-null
    name, groups of one included. Empty input gives no rows; repeated and reversed rows and loops change nothing; other
    columns, whatever they are called, are ignored. A group may hold a third of all names: nothing is collected per group.
    """
    ok = F.coalesce(F.expr(link), F.lit(False)) if link else F.lit(True)
    slim = pairs.select(F.col(left).alias("__x"), F.col(right).alias("__y"), ok.alias("__ok"))
    # explode of two columns keeps one scan; distinct pre-aggregates before its shuffle
    names = slim.select(F.explode(F.array("__x", "__y")).alias("name")).where("name is not null").distinct()
    names = cut(names.withColumn("v", F.monotonically_increasing_id()))
    n = names.count()
    links = slim.where("__ok and __x is not null and __y is not null and __x <> __y")
    links = links.select(F.least("__x", "__y").alias("__x"), F.greatest("__x", "__y").alias("__y")).distinct()
    m = links.count() if n > HOT_LEAST else 0
    a = names.select(F.col("name").alias("__x"), F.col("v").alias("a"))
    b = names.select(F.col("name").alias("__y"), F.col("v").alias("b"))
    edges = skew_safe_lookup(skew_safe_lookup(links, a, "__x", m), b, "__y", m).select("a", "b")
    reps = contract(edges)
    grouped = cut(names.join(reps, "v", "left").select("name", F.coalesce("r", "v").alias("__g")))
    least = grouped.groupBy("__g").agg(F.min("name").alias("group_name"))
    return skew_safe_lookup(grouped, least, "__g", n).select("name", "group_name")
