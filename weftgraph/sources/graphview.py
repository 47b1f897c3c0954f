"""The graph of the project's tables: nodes, edges, mentions, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import rel_type
from weftgraph.sources.tables import load

#: Word for a node without a name and without labels.
NO_LABEL = "Unknown"


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One node per trimmed name; the record loaded last wins. Partial aggregation, so a frequent name is no hot task."""
    e = load(spark, folder, "entity", "entity_id", "name", "type", "description", "document", "loaded_at")
    e = e.withColumn("name", F.trim("name")).where("name is not null and name <> ''")
    last = F.max_by(F.struct("type", "description", "document"), F.struct("loaded_at", "entity_id"))
    return e.groupBy("name").agg(last.alias("v")).select("name", "v.*")


def raw_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every relationship row with two different, non-blank ends and a normalised type."""
    r = load(spark, folder, "relationship", "source", "target", "rel_type", "description", "document", "recorded_at")
    r = r.select(F.trim("source").alias("source"), F.trim("target").alias("target"), rel_type(F.col("rel_type")).alias("rel_type"), "description", "document", "recorded_at")
    return r.where("source <> '' and target <> '' and source <> target")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return raw_edges(spark, folder).select("source", "target", "rel_type").distinct()


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    m = load(spark, folder, "mention", "name", "chunk_id").select(F.trim("name").alias("name"), "chunk_id")
    return m.where("name <> '' and chunk_id is not null").distinct()


def chunks(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """One row per chunk id; of rows delivered again and equal ids the smallest number stays."""
    c = load(spark, folder, "chunk", "chunk_no", "id", "text", "document", "chunk_index", *more)
    cols = [x for x in c.columns if x != "id"]
    return c.groupBy("id").agg(F.min_by(F.struct(*cols), F.col("chunk_no")).alias("v")).select("id", *[F.col(f"v.{x}") for x in cols])
