"""Joins and ranks that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it has more than 1/HOT_PARTS of the rows, so there are fewer than HOT_PARTS hot keys at any size.
HOT_PARTS = 500
#: Below so many rows a key is never hot.
HOT_LEAST = 20_000


def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Keys of ``df`` with more than ``max(HOT_LEAST, rows / HOT_PARTS)`` rows: at most HOT_PARTS of them. Nulls are no key."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = rows if rows is not None else df.count()
    return counts.where(F.col("__n") > max(HOT_LEAST, total // HOT_PARTS)).select(key)


def skew_safe_lookup(big: DataFrame, small: DataFrame, key: str, rows: int | None = None, hot: list | None = None) -> DataFrame:
    """Left join of ``big`` with ``small``, which has each key once.

    ``rows`` and ``hot``, the number of rows and the keys above the bound, are counted unless the caller knows them.

    Rows with a hot key meet the few lookup rows of hot keys in a broadcast join (fewer than HOT_PARTS rows); all
    others meet in a shuffled join, where no key has more than 1/HOT_PARTS of the rows. Null keys find nothing.
    Columns of ``small`` other than the key must not occur in ``big``.
    """
    if hot is None:
        total = rows if rows is not None else big.count()
        hot = [r[0] for r in hot_keys(big, key, total).collect()] if total > HOT_LEAST else []  # fewer than HOT_PARTS keys
    if not hot:
        return big.join(small, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = small.where(F.col(key).isin(hot))
    return big.where(is_hot).join(F.broadcast(few), key, "left").unionByName(big.where(~is_hot).join(small, key, "left"))


def spread_rank(df: DataFrame, keys: list[str], order: Column, name: str = "rank") -> DataFrame:
    """Ranks from 0 within ``keys`` in the order of the bigint hash ``order``, without one task per key.

    The hash is cut into 256 ranges by its upper bits. Rows are numbered within (keys, range); the rows of the lower ranges of the
    key, counted by a pre-aggregation, are added. So a key with a third of all rows is ranked by 256 tasks.
    ``order`` must be a 64-bit hash that differs between rows (ties get an arbitrary but fixed order by all columns).
    """
    ranged = df.withColumn("__h", order).withColumn("__p", F.shiftright("__h", 56))
    counts = ranged.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    below = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(below), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__p").orderBy("__h", *[c for c in df.columns if c not in keys])
    ranked = ranged.withColumn("__i", F.row_number().over(inside) - 1)
    cond = [ranked[k].eqNullSafe(offsets[k]) for k in [*keys, "__p"]]
    joined = ranked.join(offsets, cond, "inner")
    return joined.select(*[ranked[c] for c in df.columns], (F.col("__before") + F.col("__i")).cast("bigint").alias(name))
