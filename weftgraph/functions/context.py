"""Parts of an assembled context: entity blocks, relationship lines and paths, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heads of the parts that only a graph can give.
EDGE_HEADS = ("Relationships:", "Reasoning paths:")
EXCERPT_HEAD = r"^\[S\d+\] [^\n]* \(chunk \d+\)\n?"


def blocks(context: Column) -> Column:
    return F.split(context, "\n\n")


def _is_edge(b: Column) -> Column:
    return F.greatest(*[b.startswith(h) for h in EDGE_HEADS])


def without_graph(context: Column) -> Column:
    """The context without relationships and paths (ablation)."""
    return F.array_join(F.filter(blocks(context), lambda b: ~_is_edge(b)), "\n\n")


def edge_part(context: Column) -> Column:
    return F.array_join(F.filter(blocks(context), _is_edge), "\n\n")


def prose_part(context: Column) -> Column:
    """Texts of the excerpts without their headings."""
    ex = F.filter(blocks(context), lambda b: b.rlike(r"(?d)^\[S\d+\] "))
    return F.array_join(F.transform(ex, lambda b: F.regexp_replace(b, "(?d)" + EXCERPT_HEAD, "")), "\n\n")


def entity_part(context: Column) -> Column:
    return F.array_join(F.filter(blocks(context), lambda b: ~_is_edge(b) & ~b.rlike(r"(?d)^\[S\d+\] ")), "\n\n")
