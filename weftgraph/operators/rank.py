"""Rankings: interleaving, budgets, keyword scores, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.skew import skew_safe_lookup
from weftgraph.runtime import cut

K1, B = 1.2, 0.75


def interleave(first: DataFrame, second: DataFrame, group: str, key: str, rank: str) -> DataFrame:
    """a0, b0, a1, b1, …: ``group``, ``key``, ``position`` from 1; of a key that occurs twice the first place stays.

    Both have ``group``, ``key``, ``rank`` (from 1). Null keys are dropped. A group may hold many keys: the minimum per key
    is pre-aggregated before they are numbered.
    """
    tag = lambda df, c: df.where(F.col(key).isNotNull()).select(group, key, (2 * F.col(rank) + c).alias("__o"))
    least = tag(first, 0).unionByName(tag(second, 1)).groupBy(group, key).agg(F.min("__o").alias("__o"))
    return least.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("__o", key))).drop("__o")


def budgeted(df: DataFrame, group: str, position: str, size: Column, budget: int) -> DataFrame:
    """Rows of each group in order while their sizes add up to at most ``budget``; it stops at the first that does not fit.

    Prefix sums only grow, so the filter is the stop."""
    w = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def bm25(docs: DataFrame, doc: str, tokens: str, queries: DataFrame, query: str, terms: str, k: int) -> DataFrame:
    """``query``, ``doc``, ``score`` (6 decimals), ``rank``: the ``k`` best documents of each query.

    ``docs`` has one row per document with its array of tokens, ``queries`` one per query with its array of different terms.
    Only postings of terms that some query asks for are kept: they are counted before the shuffle. Ties go to the smaller
    document. Documents and queries without tokens, or with null, match nothing.
    """
    sized = docs.select(F.col(doc).alias("doc"), F.col(tokens).alias("tokens")).where(F.size("tokens") > 0)
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean"))
    asked = queries.select(F.col(query).alias("query"), F.explode(terms).alias("term"))
    post = sized.select("doc", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    post = cut(post.groupBy("term", "doc", "len").agg(F.count(F.lit(1)).alias("tf")))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    # a term that very many documents hold meets its one row of counts by broadcast
    scored = skew_safe_lookup(post, df, "term").crossJoin(stats).withColumn("w", weight)  # one row of statistics
    hits = asked.join(scored, "term").groupBy("query", "doc").agg(F.round(F.sum("w"), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
