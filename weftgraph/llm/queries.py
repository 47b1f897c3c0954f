"""The pN_ queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.canonical import map_column, map_values, reference_forms, values_in_use
from weftgraph.llm.components import consolidate_pairs
from weftgraph.llm.mixing import mix, shares
from weftgraph.llm.names import same_name_pairs, same_names
from weftgraph.llm.packing import measured, pack_items, pack_summary
from weftgraph.llm.spampages import page_shares, spam_pages
from weftgraph.llm.survivor import golden_records, survivors
from weftgraph.llm.tokens import with_token_counts
from weftgraph.llm.vectors import similar_pairs, similar_vectors
from weftgraph.runtime import cut
from weftgraph.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]


#: Components of a usable vector, neighbours per vector, least cosine of a case.
DIM, NEIGHBOURS, LEAST_COSINE = 64, 5, 0.85


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for table, key in (("entity", "entity_id"), ("chunk", "chunk_no")):
        near = similar_vectors(load(spark, folder, table, key, "embedding"), key, "embedding", DIM, NEIGHBOURS, LEAST_COSINE)
        pairs = similar_pairs(near).select(F.lit(table).alias("collection"), "id_a", "id_b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = same_names(load(spark, folder, "entity", "entity_id", "name", "aliases"), "entity_id", "name", "aliases")
    return same_name_pairs(groups).select(F.col("rec_a").alias("entity_a"), F.col("rec_b").alias("entity_b"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    v = load(spark, folder, "entity_version", "group_id", "version_id", "name", "description", "aliases", "trust", "seen_at")
    won = survivors(v, "group_id", "version_id", ["name", "description", "aliases"], "trust", "seen_at")
    return won.select(F.col("grp").alias("group_id"), "field", F.col("record").alias("version_id"))


def p3_golden(spark: SparkSession, folder: str) -> DataFrame:
    v = load(spark, folder, "entity_version", "group_id", "version_id", "name", "description", "aliases", "trust", "seen_at")
    return golden_records(v, "group_id", "version_id", ["name", "description", "aliases"], "trust", "seen_at")


def _type_forms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Forms of ``type_ref`` and those that the records of ``entity`` use for the same things; values used for several."""
    ref, columns = load(spark, folder, "type_ref"), ["type_name", "known_forms", "gloss"]
    e = load(spark, folder, "entity", "entity_id", "type", "name", "aliases")
    used = cut(values_in_use(e, "entity_id", "type", "name", "aliases", reference_forms(ref, "type_id", columns)))
    return reference_forms(ref, "type_id", columns, used.where("entry is not null")), used.where("entry is null")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "entity", "entity_id", "type")
    exact = load(spark, folder, "type_ref").select(F.col("type_name").alias("type"))
    free = e.where(F.col("type").rlike(r"(?U)[^\s\u200b]")).join(exact, "type", "left_anti")
    forms, never = _type_forms(spark, folder)
    mapped = map_column(free, "type", forms, never=never)
    return mapped.select("entity_id", F.coalesce("entry", F.lit(0)).cast("int").alias("type_id")).distinct()


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    """Report: every different value with its entry, 0 if unmatched, and the score."""
    forms, never = _type_forms(spark, folder)
    found = map_values(load(spark, folder, "entity", "type"), "type", forms, never=never)
    return found.select("type", F.coalesce("entry", F.lit(0)).cast("int").alias("type_id"), "form", F.round("score", 6).alias("score"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return consolidate_pairs(load(spark, folder, "merge_log", "name_a", "name_b", "verdict"), "name_a", "name_b", "verdict = 'match'")


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    return measured(with_token_counts(load(spark, folder, "documents", "doc_id", "source", "text")))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_items(_lengths(spark, folder), load(spark, folder, "pack_spec"), "doc_id", "n_tokens", "pack_no", "capacity_tokens")
    return packed.select(F.col("pack").cast("int").alias("pack_no"), F.col("item").alias("doc_id"), "piece", "start", F.col("size").alias("n_tokens"), "container", "unused")


def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    spec = load(spark, folder, "pack_spec")
    packed = pack_items(_lengths(spark, folder), spec, "doc_id", "n_tokens", "pack_no", "capacity_tokens")
    return pack_summary(packed, spec, "pack_no", "capacity_tokens").withColumnRenamed("pack", "pack_no")


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_lengths(spark, folder), load(spark, folder, "mix_target"), "doc_id", "source", "n_tokens", "target_share", "max_repeat")


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).select(F.col("doc").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "repeats")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(_mixed(spark, folder), load(spark, folder, "mix_target"), "source", "target_share", "max_repeat")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return page_shares(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p2_found, p3_found, p3_golden, p4_found, p4_values, p5_found, p6_containers, p6_summary, p7_selection, p7_shares, p8_found, p8_shares)
}
