"""Graph operators: neighbourhoods, paths, weights, modularity, communities, components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.skew import HOT_LEAST, hot_keys, skew_safe_lookup
from weftgraph.runtime import cut


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: ``node``, ``other``, ``rel_type``, ``forward``. A union, no shuffle."""
    there = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "rel_type", F.lit(True).alias("forward"))
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "rel_type", F.lit(False).alias("forward"))
    return there.unionByName(back)


def degrees(*ends: DataFrame) -> DataFrame:
    """``node``, ``degree`` over all given one-column tables of edge ends (pre-aggregated)."""
    out = None
    for e in ends:
        e = e.toDF("node")
        out = e if out is None else out.unionByName(e)
    return out.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def one_hop(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``seed``, ``other``, ``rel_type``: distinct neighbours in either direction; seeds without any keep a row of nulls."""
    s = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    adj = adjacency(edges).select("node", "other", "rel_type")
    # a hub's edges meet its one seed row by broadcast
    near = skew_safe_lookup(adj, s.select(F.col("seed").alias("node"), "seed"), "node").where("seed is not null").select("seed", "other", "rel_type").distinct()
    return near.unionByName(s.join(near.select("seed").distinct(), "seed", "left_anti").select("seed", F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("rel_type")))


def hot_nodes(adj: DataFrame) -> list:
    """Nodes with so many edges that they are met by broadcast: fewer than HOT_PARTS."""
    n = adj.count()
    return [r[0] for r in hot_keys(adj, "node", n).collect()] if n > HOT_LEAST else []


def frontier(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``node``, ``depth``: every node within ``hops`` edges of a seed, with its least distance. One join per hop."""
    adj = cut(adjacency(edges).select("node", "other").distinct())
    hubs = hot_nodes(adj)
    seen = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, hops + 1):
        step = skew_safe_lookup(adj, front.select("node", F.lit(1).alias("__in")), "node", hot=hubs).where("__in = 1").select(F.col("other").alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return seen


def shortest_paths(sources: DataFrame, targets: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``source``, ``target``, ``hops``, ``text``: the path of fewest edges for each pair, of equal ones the least text.

    Each round extends the best path to every (source, node) by one edge and keeps the least text per newly reached node,
    so a round carries one row per source and node, never all paths.
    """
    adj = cut(adjacency(edges).distinct())
    s = sources.select(F.col(sources.columns[0]).alias("source")).distinct()
    seen = cut(s.select("source", F.col("source").alias("node"), F.col("source").alias("text"), F.lit(0).alias("hops")))
    front = seen
    for k in range(1, hops + 1):
        arrow = F.when(F.col("forward"), F.concat(F.lit(" -["), "rel_type", F.lit("]-> "))).otherwise(F.concat(F.lit(" <-["), "rel_type", F.lit("]- ")))
        step = front.select("source", "node", "text").join(adj, "node").select("source", F.col("other").alias("node"), F.concat("text", arrow, "other").alias("text"))
        step = step.groupBy("source", "node").agg(F.min("text").alias("text"))
        front = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(front)
    t = targets.select(F.col(targets.columns[0]).alias("node")).distinct()
    return seen.where("hops > 0").join(t, "node").select("source", F.col("node").alias("target"), "hops", "text")


def edge_weights(raw: DataFrame) -> DataFrame:
    """Undirected pairs with the number of rows between them."""
    return raw.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def modularity_terms(weights: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``community``, ``inside``, ``degree``, ``contribution``: the terms whose sum is the modularity of the partition.

    ``member``: ``node``, ``community``, one row per node; edges with an end outside the partition are left out. Without
    edges there are no rows.
    """
    m = member.select("node", "community")
    both = skew_safe_lookup(skew_safe_lookup(weights, m.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a"), m.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    both = both.where("ca is not null and cb is not null")
    ends = both.select(F.explode(F.array(F.struct(F.col("ca").alias("community"), "weight", F.when(F.expr("ca = cb"), F.col("weight")).otherwise(0.0).alias("w_in")), F.struct(F.col("cb").alias("community"), "weight", F.lit(0.0).alias("w_in")))).alias("s")).select("s.*")
    per = ends.groupBy("community").agg(F.sum("w_in").alias("inside"), F.sum("weight").alias("degree"))
    total = per.agg((F.sum("degree") / 2).alias("m"))
    out = per.crossJoin(total)  # one row
    return out.select("community", "inside", "degree", (F.col("inside") / F.col("m") - F.lit(resolution) * (F.col("degree") / (2 * F.col("m"))) ** 2).alias("contribution"))


def modularity(weights: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: ``modularity`` rounded to 4 decimals, null without edges."""
    return modularity_terms(weights, member, resolution).agg(F.round(F.sum("contribution"), 4).alias("modularity"))


def label_propagation(weights: DataFrame, rounds: int = 5) -> DataFrame:
    """``node``, ``community`` after synchronous rounds: every node takes the label of most weight around it, its own
    counting one; ties go to the smallest label."""
    adj = cut(weights.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(weights.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight")))
    labels = cut(adj.select("node").distinct().withColumn("community", F.col("node")))
    hubs = hot_nodes(adj)  # the same on both sides, as every edge is there in both directions
    for _ in range(rounds):
        votes = skew_safe_lookup(adj, labels.select(F.col("node").alias("other"), "community"), "other", hot=hubs).select("node", "community", "weight")
        votes = votes.unionByName(labels.select("node", "community", F.lit(1.0).alias("weight")))
        tally = votes.groupBy("node", "community").agg(F.sum("weight").alias("w"))
        best = tally.groupBy("node").agg(F.max("w").alias("top"))
        labels = cut(tally.join(best, "node").where("w = top").groupBy("node").agg(F.min("community").alias("community")))
    return labels


def connected_components(pairs: DataFrame) -> DataFrame:
    """``node``, ``component``: the smallest node of its component, for every node of ``pairs`` (columns ``a``, ``b``).

    Stars are contracted alternately (each node's larger neighbours, then its smaller ones, are tied to the smallest), which
    takes O(log^2 n) rounds of one aggregation and one join each. Null ends are dropped; empty input gives no rows.
    """
    e = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null")
    nodes = cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    e = cut(e.where("u <> v").distinct())
    while True:
        # large star: neighbours above the node are tied to the least of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        # small star: the node and its smaller neighbours are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        small = cut(small)
        same = small.count() == e.count() and not small.join(e, ["u", "v"], "left_anti").head(1)
        e = small
        if same:
            break
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def _louvain(nodes: list[str], edges: list[tuple[str, str, float]], resolution: float) -> dict[str, int]:
    """Communities of greatest modularity by local moves and aggregation, nodes visited in sorted order."""
    ids = {n: i for i, n in enumerate(sorted(nodes))}
    adj: list[dict[int, float]] = [{} for _ in ids]
    loops = [0.0] * len(ids)
    for a, b, w in edges:
        i, j = ids[a], ids[b]
        if i == j:
            loops[i] += w
        else:
            adj[i][j] = adj[i].get(j, 0.0) + w
            adj[j][i] = adj[j].get(i, 0.0) + w
    m2 = sum(sum(x.values()) for x in adj) + 2 * sum(loops)
    belongs = list(range(len(ids)))
    while m2 > 0:
        degree = [sum(x.values()) + 2 * s for x, s in zip(adj, loops, strict=True)]
        com, total, moved_any, moved = list(range(len(adj))), list(degree), False, True
        while moved:
            moved = False
            for i in range(len(adj)):
                around: dict[int, float] = {}
                for j, w in adj[i].items():
                    around[com[j]] = around.get(com[j], 0.0) + w
                old = com[i]
                total[old] -= degree[i]
                gain = {c: w - resolution * total[c] * degree[i] / m2 for c, w in around.items()}
                stay = gain.get(old, -resolution * total[old] * degree[i] / m2)
                best = max(sorted(gain), key=lambda c: gain[c], default=old)
                new = best if gain.get(best, stay) > stay + 1e-12 else old
                com[i] = new
                total[new] += degree[i]
                moved |= new != old
            moved_any |= moved
        names = {c: k for k, c in enumerate(sorted(set(com)))}
        belongs = [names[com[b]] for b in belongs]
        if not moved_any or len(names) == len(adj):
            break
        new_adj: list[dict[int, float]] = [{} for _ in names]
        new_loops = [0.0] * len(names)
        for i, x in enumerate(adj):
            ci = names[com[i]]
            new_loops[ci] += loops[i]
            for j, w in x.items():
                cj = names[com[j]]
                if ci != cj:
                    new_adj[ci][cj] = new_adj[ci].get(cj, 0.0) + w
                elif i < j:
                    new_loops[ci] += w
        adj, loops = new_adj, new_loops
    return {n: belongs[i] for n, i in ids.items()}


def louvain(weights: DataFrame, part: str, resolution: float = 1.0) -> DataFrame:
    """``part``, ``node``, ``community`` (named by its smallest member): Louvain communities of each part of the graph.

    A part is solved in one task, so it must fit there; for graphs of any size use ``label_propagation``. Parts are
    components or other bounded pieces named by the column ``part`` of ``weights``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["a"]) | set(pdf["b"]))
        com = _louvain(nodes, list(zip(pdf["a"], pdf["b"], pdf["weight"], strict=True)), resolution)
        name: dict[int, str] = {}
        for n in nodes:
            name.setdefault(com[n], n)
        return pd.DataFrame({"part": str(pdf[part].iloc[0]), "node": nodes, "community": [name[com[n]] for n in nodes]})

    return weights.groupBy(part).applyInPandas(run, "part string, node string, community string")


def communities(member: DataFrame, degree: DataFrame, least: int) -> DataFrame:
    """``community``, ``size``, ``members``: communities of at least ``least`` members, those of highest degree first."""
    ranked = member.join(degree, "node", "left").select("community", F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "node").alias("m"))
    out = ranked.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("m")).alias("ms")).where(F.col("size") >= least)
    return out.select("community", "size", F.transform("ms", lambda m: m["node"]).alias("members"))


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key; the window group limit cuts before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
