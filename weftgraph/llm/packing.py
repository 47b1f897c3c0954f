"""Filling containers of fixed capacity: minimum bin slack over the histogram of lengths.

Items of equal length are interchangeable, so containers are planned on the histogram (at most ``capacity`` rows,
whatever the number of items). The largest remaining length opens a container; a subset-sum dynamic programme on a
bitset finds the multiset of remaining lengths that fills the rest closest to capacity, and backtracking gives its
counts. The pattern is used as often as the remaining counts allow. Items then take their places by rank within their
length, which no single task computes for a whole length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import spread_rank
from weftgraph.runtime import cut


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of ``lengths`` (descending), each at most ``counts`` times, whose sum is the closest to ``room`` from below."""
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room or not counts[n]:
            continue
        times = min(counts[n], room // n)
        layers.append((n, times, reach))
        k = 1
        while times > 0:
            use = min(k, times)
            reach |= (reach << (n * use)) & mask
            times -= use
            k *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for n, times, before in reversed(layers):
        use = 0
        while not (before >> total & 1):
            total -= n
            use += 1
            assert use <= times
        if use:
            chosen[n] = use
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, per container, containers, first container, unused) of every length in every pattern."""
    counts = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    at, rows, container = dict.fromkeys(counts, 0), [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        big = lengths[0]
        counts[big] -= 1
        chosen = best_fill(lengths, counts, capacity - big)
        counts[big] += 1
        chosen[big] = chosen.get(big, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        unused = capacity - sum(n * k for n, k in chosen.items())
        for n, k in chosen.items():
            rows.append((n, at[n], k, times, container, unused))
            at[n] += k * times
            counts[n] -= k * times
        container += times
        if any(not counts[n] for n in chosen):
            lengths = [n for n in lengths if counts[n]]
    return rows


#: Ranks within a length that meet the plan under one key.
RANK_BLOCK = 256
PLAN_SCHEMA = "pack bigint, length bigint, first_rank bigint, per_container bigint, containers bigint, first_container bigint, unused bigint"


def pack_items(items: DataFrame, specs: DataFrame, item: str, size: str, pack: str, capacity: str) -> DataFrame:
    """Container of every item, or of every piece of an item above the capacity, for each row of ``specs``.

    ``items`` has one row per item (``item`` unique, BIGINT); each row of ``specs`` is a separate task over all items.
    Items above the capacity are cut into full pieces and a rest; no other item is split. Returns ``pack``, ``item``,
    ``piece`` (from 0), ``start`` (first unit of the piece), ``size``, ``container`` (from 0 within the pack) and the
    container's ``unused`` space. Items of size 0 or null take no space: piece 0, container and unused null. Specs with
    a null or non-positive capacity have no result. An empty table gives none. A length may have a third of all items.
    """
    spec = specs.select(F.col(pack).cast("bigint").alias("pack"), F.col(capacity).cast("bigint").alias("cap")).where("cap > 0").distinct()
    base = items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    pieces = base.crossJoin(spec)  # stated tasks, each over all items
    pieces = pieces.select("pack", "item", "cap", "n", F.explode(F.expr("sequence(0L, greatest(0L, (n - 1) div cap))")).alias("piece"))
    pieces = pieces.select("pack", "item", "piece", (F.col("piece") * F.col("cap")).alias("start"), F.expr("least(cap, n - piece * cap)").alias("size"))
    hist = pieces.where("size > 0").groupBy("pack", "size").agg(F.count(F.lit(1)).alias("n")).join(spec, "pack")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = plan(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), int(pdf["cap"].iloc[0]))
        out = pd.DataFrame(rows, columns=["length", "first_rank", "per_container", "containers", "first_container", "unused"], dtype="int64")
        out.insert(0, "pack", pdf["pack"].iloc[0])
        return out

    # at most `capacity` rows of histogram a group, and one pattern for each of them, whatever the number of items
    segments = cut(hist.groupBy("pack").applyInPandas(run, PLAN_SCHEMA))
    # a segment under each block of ranks that it reaches: a length with very many items meets its plan in many places
    last = F.expr("first_rank + per_container * containers - 1")
    reach = segments.withColumn("last_rank", last).withColumn("block", F.explode(F.expr(f"sequence(first_rank div {RANK_BLOCK}, last_rank div {RANK_BLOCK})")))
    ranked = spread_rank(pieces.where("size > 0"), ["pack", "size"], F.xxhash64("item", "piece"))
    ranked = ranked.select("pack", "item", "piece", "start", "size", "rank", F.expr(f"rank div {RANK_BLOCK}").alias("block"))
    placed = ranked.join(reach.withColumnRenamed("length", "size"), ["pack", "size", "block"]).where("rank between first_rank and last_rank")
    placed = placed.select("pack", "item", "piece", "start", "size", F.expr("first_container + (rank - first_rank) div per_container").alias("container"), "unused")
    none = pieces.where("size <= 0").select("pack", "item", "piece", "start", "size", F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("bigint").alias("unused"))
    return placed.unionByName(none)


def pack_summary(packed: DataFrame, specs: DataFrame, pack: str, capacity: str) -> DataFrame:
    """Per task: containers, units packed, unused units, the least possible number of containers and the share used."""
    by = packed.where("container is not null").groupBy("pack").agg((F.max("container") + 1).alias("containers"), F.sum("size").alias("units"), F.count(F.lit(1)).alias("pieces"))
    s = specs.select(F.col(pack).cast("bigint").alias("pack"), F.col(capacity).cast("bigint").alias("capacity"))
    out = by.join(s, "pack")
    return out.select("pack", "capacity", "pieces", "containers", "units", (F.col("containers") * F.col("capacity") - F.col("units")).alias("unused"), F.ceil(F.col("units") / F.col("capacity")).alias("least_containers"), F.round(F.col("units") / (F.col("containers") * F.col("capacity")), 6).alias("share_used"))


def measured(items: DataFrame) -> DataFrame:
    """Cut the lineage behind measured lengths, so that texts are tokenized once."""
    return cut(items)
