"""Themes with the entity and relationship types that each allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULT_THEME = "Generic"
# The vocabulary of each theme.
THEMES = {
    "Personal CV / Resume": (
        "PERSON COMPANY UNIVERSITY ROLE PROJECT SKILL TOOL LANGUAGE CERTIFICATION LOCATION",
        "WORKED_AT STUDIED_AT HELD_ROLE WORKED_ON HAS_SKILL USES_TOOL MASTER_OF_LANGUAGE",
    ),
    "Technology, Tools & Docs": (
        "PERSON ORGANIZATION ROLE PROJECT SKILL TOOL FRAMEWORK DATABASE CERTIFICATION LOCATION EDUCATION",
        "WORKED_AT HELD_ROLE WORKED_ON HAS_SKILL USES_TOOL STUDIED_AT EARNED_CERTIFICATION",
    ),
    "Medical/Scientific": (
        "DISEASE SYMPTOM DRUG TREATMENT ANATOMY GENE RESEARCH_STUDY PERSON ORGANIZATION",
        "CAUSES TREATS IS_SYMPTOM_OF PREVENTS INTERACTS_WITH STUDIED_BY",
    ),
    "Business/Legal": ("COMPANY PERSON CONTRACT LAW FINANCIAL_METRIC PRODUCT LOCATION", "OWNS PARTNERS_WITH REGULATES SUED_BY SELLS EMPLOYS"),
    "Generic": ("PERSON ORGANIZATION CONCEPT EVENT LOCATION THING", "RELATED_TO PART_OF CAUSED PARTICIPATED_IN"),
}


def theme_table(spark: SparkSession) -> DataFrame:
    """``theme``, ``entities``, ``relationships``."""
    return spark.createDataFrame([(k, e.split(), r.split()) for k, (e, r) in THEMES.items()], "theme string, entities array<string>, relationships array<string>")
