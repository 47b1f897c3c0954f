"""Sinks: upserts by key, idempotent merges, guarded replacement of a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """``name, type, description, document, aliases``: records of ``new`` replace those of ``old`` by name.

    Aliases are the old ones that are not among the new, then the new ones; null arrays count as empty. Each side has a
    name once. Null names are dropped.
    """
    none = F.array().cast("array<string>")
    o = old.where("name is not null").select("name", *[F.col(c).alias(f"o_{c}") for c in ("type", "description", "document")], F.coalesce("aliases", none).alias("o_aliases"), F.lit(True).alias("in_old"))
    n = new.where("name is not null").select("name", "type", "description", "document", F.coalesce("aliases", none).alias("aliases"), F.lit(True).alias("in_new"))
    j = o.join(n, "name", "full")
    pick = lambda c: F.when(F.col("in_new"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c)
    a, b = F.coalesce("o_aliases", none), F.coalesce("aliases", none)
    return j.select("name", pick("type"), pick("description"), pick("document"), F.concat(F.array_except(a, b), b).alias("aliases"))


def merge_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``stored`` and those of ``fresh`` whose content id is new; writing the same chunks again changes nothing."""
    return stored.unionByName(fresh.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti").select(*stored.columns))


def replace_table(spark: SparkSession, path: str, rows: DataFrame | None, schema: str) -> None:
    """Wipe then write. ``rows`` None means that they could not be read: the stored table stays. No rows empty the table."""
    if rows is None:
        return
    rows.write.mode("overwrite").parquet(path)


def clear_table(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
