"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a budget of tokens. Whole passes over the source come first; the rest of the budget is fitted on the
source's histogram of exact lengths: a proportional share of each length, single steps from the longest length down,
then a bounded-knapsack dynamic programme on a bitset for what is left. Which documents of a length are taken is decided
by a seeded hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.packing import best_fill
from weftgraph.operators.skew import skew_safe_lookup, spread_rank
from weftgraph.runtime import cut

#: The dynamic programme closes a gap of at most so many tokens.
WINDOW = 1 << 16


def fit_budget(histogram: dict[int, int], budget: int, window: int = WINDOW) -> dict[int, int]:
    """How many items of each length to take, none twice, so that the total is as close below ``budget`` as the fit finds."""
    total = sum(n * c for n, c in histogram.items())
    if budget >= total:
        return dict(histogram)
    take = {n: c * budget // total for n, c in histogram.items()}
    left = budget - sum(n * k for n, k in take.items())
    for n in sorted(histogram, reverse=True):
        if left <= window:
            break
        k = min(histogram[n] - take[n], max(0, (left - window) // n + 1), left // n)
        take[n] += k
        left -= n * k
    # give some of the taken lengths back, so that the programme has a choice
    for n in sorted(take, reverse=True):
        if left >= window // 2:
            break
        k = min(take[n], (window // 2 - left) // n)
        take[n] -= k
        left += n * k
    free = {n: histogram[n] - take[n] for n in histogram if histogram[n] > take[n]}
    for n, k in best_fill(sorted(free, reverse=True), free, min(left, window * 2)).items():
        take[n] += k
    return {n: k for n, k in take.items() if k}


def budgets(have: DataFrame, total: int | None = None) -> DataFrame:
    """``have`` (``source``, ``tokens``, ``w``, ``r``) with ``passes`` and ``rest``: whole passes over each source and the rest of its budget.

    Without ``total`` the mix is as large as it can be while every source can still meet its share. With ``total``, sources
    that fall short give all they may.
    """
    whole = have.agg(F.sum("w").alias("whole"))
    most = have.crossJoin(whole).agg(F.floor(F.min(F.col("tokens") * F.col("r") * F.col("whole") / F.col("w"))).alias("total"), F.first("whole").alias("whole"))  # one row
    wanted = F.col("total") if total is None else F.lit(total)
    budget = F.least(F.round(wanted * F.col("w") / F.col("whole")).cast("bigint"), F.col("tokens") * F.col("r"))
    out = have.crossJoin(most).withColumn("b", budget)  # one row of totals
    return out.select("source", F.expr("b div tokens").alias("passes"), F.expr("b % tokens").alias("rest"))


def mix(docs: DataFrame, targets: DataFrame, doc: str, source: str, size: str, share: str, repeat: str, total: int | None = None, seed: int = 20) -> DataFrame:
    """``doc``, ``source``, ``size``, ``repeats`` of every chosen document.

    ``docs``: one row per document with its exact length. Documents without a source, of a source without a target, or of
    length 0 or null are never chosen; a target without documents is met with nothing and its share goes to the others in
    proportion. No document is used more than ``repeat`` times. A source listed twice keeps its first target by order of
    share and repeat. Any number of sources may be named. Empty tables give no rows.
    """
    want = targets.select(F.col(source).alias("source"), F.col(share).cast("double").alias("w"), F.col(repeat).cast("bigint").alias("r")).where("source is not null and w > 0 and r > 0")
    want = want.groupBy("source").agg(F.min(F.struct("w", "r")).alias("t")).select("source", "t.w", "t.r")
    slim = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size")).where("size > 0 and source is not null")
    slim = skew_safe_lookup(slim, want, "source").where("w is not null").select("doc", "source", "size")
    hist = cut(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    have = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("tokens")).join(want, "source")
    plan = hist.join(cut(budgets(have, total)), "source")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = int(pdf["rest"].iloc[0])
        take = fit_budget(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), rest) if rest else {}
        return pdf[["source", "size", "passes"]].assign(extra=[take.get(n, 0) for n in pdf["size"].tolist()])

    # a group is the source's histogram: as many rows as it has different lengths
    counts = cut(plan.groupBy("source").applyInPandas(run, "source string, size bigint, passes bigint, extra bigint"))
    ranked = spread_rank(slim, ["source", "size"], F.xxhash64("doc", F.lit(seed)))
    chosen = ranked.join(counts, ["source", "size"]).withColumn("repeats", F.col("passes") + (F.col("rank") < F.col("extra")).cast("bigint"))
    return chosen.where("repeats > 0").select("doc", "source", "size", "repeats")


def shares(chosen: DataFrame, targets: DataFrame, source: str, share: str, repeat: str) -> DataFrame:
    """Actual share of each target source beside its target; sources without documents have 0."""
    by = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    total = by.agg(F.sum("tokens").alias("total"))
    t = targets.select(F.col(source).alias("source"), F.col(share).alias("target_share"), F.col(repeat).alias("max_repeat"))
    out = t.join(by, "source", "left").crossJoin(total)  # one row
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("source", "target_share", "max_repeat", z("tokens"), z("documents"), z("most_repeats"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"))
