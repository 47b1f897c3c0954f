"""Tolerant reading of JSON replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,type:string,description:string>>"


def tolerant_json(c: Column, schema: str) -> Column:
    """``c`` read as an object: without a code fence, else the widest part in braces, else null."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    text = F.when(F.try_parse_json(bare).isNotNull() & bare.rlike(r"(?s)^\s*\{"), bare).when(F.try_parse_json(braces).isNotNull(), braces)
    return F.from_json(text, schema)


def tolerant_extraction(c: Column) -> Column:
    """Entities and relationships of a reply; what is missing or unreadable is an empty array, never null."""
    x = tolerant_json(c, EXTRACTION)
    empty = F.from_json(F.lit('{"entities": [], "relationships": []}'), EXTRACTION)
    return F.struct(F.coalesce(x["entities"], empty["entities"]).alias("entities"), F.coalesce(x["relationships"], empty["relationships"]).alias("relationships"))
