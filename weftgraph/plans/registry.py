"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from weftgraph.plans import answer, graph, more, resolve, retrieve, score, streams, text

    return [graph, text, resolve, retrieve, score, streams, more, answer]


def queries() -> dict[str, Query]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
