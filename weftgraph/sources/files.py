"""Readers of files: graphs as JSON, records as JSON lines, texts; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = (
    "document_name string, theme string, description string, entities array<struct<name:string,type:string,description:string>>, "
    "relationships array<struct<source:string,target:string,type:string,description:string>>"
)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of graph documents, one JSON object per file."""
    g = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    head = ["document_name", "theme"]
    return g.select(*head, F.inline_outer("entities")).where("name is not null"), g.select(*head, F.inline_outer("relationships")).where("source is not null or target is not null")


def graph_problems(entities: DataFrame, relationships: DataFrame, allowed: list[str]) -> DataFrame:
    """``problem``, ``subject``: types outside ``allowed``, repeated names, edges whose ends are missing, blank fields."""
    names = entities.select("name").distinct()
    label = F.concat_ws(" ", "source", "type", "target").alias("subject")
    found = [
        entities.where(~F.coalesce(F.col("type").isin(allowed), F.lit(False))).select(F.lit("type").alias("problem"), F.col("name").alias("subject")),
        entities.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated name").alias("problem"), F.col("name").alias("subject")),
        entities.where("coalesce(trim(description), '') = ''").select(F.lit("no description").alias("problem"), F.col("name").alias("subject")),
        relationships.join(names.withColumnRenamed("name", "source"), "source", "left_anti").select(F.lit("missing source").alias("problem"), label),
        relationships.join(names.withColumnRenamed("name", "target"), "target", "left_anti").select(F.lit("missing target").alias("problem"), label),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of JSON lines: lines that do not fit the schema come out as text."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    raw = spark.read.text(path).where("trim(value) <> ''").select("value", F.from_json("value", f"{schema}, _bad string", options).alias("r"))
    return raw.where("r._bad is null").select("r.*").drop("_bad"), raw.where("r._bad is not null").select(F.col("value").alias("line"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``file_name``, ``text``: whole files as UTF-8, blank ones left out."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    t = f.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode("content", "UTF-8").alias("text"))
    return t.where("trim(text) <> ''")
