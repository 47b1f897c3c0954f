"""The functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from weftgraph.functions.pyfuncs import chunk_spans, name_similarity
from weftgraph.functions.vectors import hash_embedder

# name: (parameters, result, expression)
SQL_FUNCTIONS = {
    "wg_rel_type": ("t STRING", "STRING", "upper(replace(coalesce(t, 'RELATED_TO'), ' ', '_'))"),
    "wg_entity_type": ("t STRING", "STRING", "coalesce(nullif(upper(trim(t)), ''), 'UNKNOWN')"),
    "wg_chunk_id": ("document STRING, i INT, t STRING", "STRING", "substring(sha2(concat_ws(chr(31), document, cast(i as string), t), 256), 1, 32)"),
    "wg_tokens_from_chars": ("n BIGINT", "BIGINT", "cast(ceil(greatest(n, 0) / 4) as bigint)"),
    "wg_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0), 0D)",
    ),
}


class ChunkText:
    """Table function (text, size, overlap) -> index, start_at, end_at, chunk."""

    def eval(self, text: str, size: int, overlap: int):
        i = 0
        for a, b in chunk_spans(text, size, overlap):
            chunk = text[a:b].strip()
            if chunk:
                yield i, a, b, chunk
                i += 1


def register(spark: SparkSession) -> None:
    """Make ``wg_...`` functions known to ``spark.sql``."""
    for name, (params, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    spark.udf.register("wg_name_similarity", name_similarity())
    spark.udf.register("wg_hash_embed", hash_embedder(64))
    spark.udtf.register("wg_chunk_text", udtf(ChunkText, returnType="index int, start_at int, end_at int, chunk string"))
