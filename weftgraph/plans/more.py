"""Queries on stores, contexts and checks of the evaluation."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import context as C
from weftgraph.functions.text import CONTENT_STOPWORDS, content_words
from weftgraph.operators import graph as G
from weftgraph.operators import store as S
from weftgraph.plans.graph import CHUNKS, EDGES, MENTIONS, NODES, _communities, _COM
from weftgraph.plans.resolve import SQL as RESOLVE_SQL
from weftgraph.plans.resolve import vec_topk_batch
from weftgraph.plans.score import _channels, _CHAN, _facts, _FACTS, _records
from weftgraph.plans.text import _stem_sql
from weftgraph.runtime import own_table
from weftgraph.sources import graphview as V
from weftgraph.sources.tables import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {NODES}, u AS (SELECT name, type, description FROM nodes), s AS (SELECT name, type, description FROM seed_entity)
SELECT coalesce(u.name, s.name) AS name, coalesce(CASE WHEN u.name IS NULL THEN s.type ELSE u.type END, '') AS type, coalesce(CASE WHEN u.name IS NULL THEN s.description ELSE u.description END, '') AS description FROM u FULL JOIN s ON u.name = s.name""")
def entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The extracted nodes upserted over the seed graph."""
    none = F.lit(None).cast("array<string>").alias("aliases")
    old = load(spark, d, "seed_entity").select("name", "type", "description", F.lit(None).cast("string").alias("document"), none)
    out = S.upsert_entities(old, V.nodes(spark, d).select("*", none))
    return out.select("name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description"))


@query(f"WITH {CHUNKS} SELECT count(*) AS first, count(*) AS again FROM chunks")
def chunk_store_twice(spark: SparkSession, d: str) -> DataFrame:
    """Chunks merged into an empty store, then once more."""
    c = V.chunks(spark, d).select("id", "document")
    one = S.merge_chunks(c.limit(0), c)
    two = S.merge_chunks(one, c)
    return one.agg(F.count(F.lit(1)).alias("first")).crossJoin(two.agg(F.count(F.lit(1)).alias("again")))  # single rows


@query(f"WITH {_COM} SELECT 'full' AS step, count(*) AS rows FROM com UNION ALL SELECT 'failed read', count(*) FROM com UNION ALL SELECT 'empty result', 0 UNION ALL SELECT 'rebuilt', count(*) FROM com UNION ALL SELECT 'cleared', 0")
def label_wipe_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the stored communities after a rebuild, a failed read, an empty result, another rebuild, a wipe."""
    path, schema = own_table(spark, "store"), "community string, size bigint"
    rows = _communities(spark, d).select("community", "size")
    steps = [("full", lambda: S.replace_table(spark, path, rows, schema)), ("failed read", lambda: S.replace_table(spark, path, None, schema)), ("empty result", lambda: S.replace_table(spark, path, rows.limit(0), schema)), ("rebuilt", lambda: S.replace_table(spark, path, rows, schema)), ("cleared", lambda: S.clear_table(spark, path, schema))]
    counts = []
    for name, step in steps:
        step()
        counts.append((name, spark.read.schema(schema).parquet(path).count()))
    return spark.createDataFrame(counts, "step string, rows bigint")


@query(f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM nodes) || ':' || (SELECT count(*) FROM edges) AS signature, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT upper(trim(type)) AS t FROM nodes WHERE type IS NOT NULL)) AS types")
def graph_signature(spark: SparkSession, d: str) -> DataFrame:
    n = V.nodes(spark, d)
    types = n.where("type is not null").select(F.upper(F.trim("type")).alias("t")).distinct().agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("types"))
    counts = n.agg(F.count(F.lit(1)).alias("n")).crossJoin(V.edges(spark, d).agg(F.count(F.lit(1)).alias("e"))).crossJoin(types)  # single rows
    return counts.select(F.concat_ws(":", F.col("n").cast("string"), F.col("e").cast("string")).alias("signature"), "types")


@query(f"WITH {NODES} SELECT name, CAST(CASE WHEN description IS NULL THEN 0 ELSE 1 END + CASE WHEN document IS NULL THEN 0 ELSE 1 END AS INTEGER) AS shown FROM nodes")
def inspector_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties an inspector shows: all that have a value but name, type and embedding."""
    props = F.create_map(*[x for c in ("name", "type", "description", "document") for x in (F.lit(c), F.col(c))])
    shown = F.map_filter(props, lambda k, v: ~k.isin("name", "type", "embedding") & v.isNotNull())
    return V.nodes(spark, d).select("name", F.size(shown).alias("shown"))


@query(f"""WITH {NODES}, {MENTIONS}, {CHUNKS} SELECT n.name, coalesce(string_agg(DISTINCT c.document, '|' ORDER BY c.document), any_value(n.document), '') AS documents
FROM nodes n LEFT JOIN mentions m ON m.name = n.name LEFT JOIN chunks c ON c.id = m.chunk_id GROUP BY n.name""")
def provenance_with_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a node's chunks; nodes without any keep their own document."""
    docs = V.chunks(spark, d).where("document is not null").select(F.col("id").alias("chunk_id"), F.col("document").alias("doc"))
    by = V.mentions(spark, d).join(docs, "chunk_id").select("name", "doc").distinct().groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("doc")), "|").alias("docs"))
    n = V.nodes(spark, d).select("name", "document").join(by, "name", "left")
    return n.select("name", F.coalesce("docs", "document", F.lit("")).alias("documents"))


@query(f"WITH {_COM}, t AS (SELECT *, row_number() OVER (ORDER BY size DESC, community) AS rank FROM com) SELECT rank, community, 'com-' || substr(sha1(array_to_string(list_sort(members), '|')), 1, 12) AS id, size, array_to_string(members[1:12], ', ') AS members FROM t WHERE rank <= 5")
def global_search(spark: SparkSession, d: str) -> DataFrame:
    """Answer to a broad question: the five largest communities with up to twelve members each."""
    from weftgraph.functions.text import community_id

    order = [F.desc("size"), "community"]
    top = G.top_k(_communities(spark, d).orderBy(*order).limit(5), [], order, 5)
    return top.select("rank", "community", community_id(F.col("members")).alias("id"), "size", F.array_join(F.slice("members", 1, 12), ", ").alias("members"))


@query(f"WITH a AS ({RESOLVE_SQL['vec_topk_batch']}) SELECT query, string_agg('v' || id || ' (' || label || ')', chr(10) ORDER BY rank) AS context FROM a JOIN embeddings e ON e.vec_id = a.id GROUP BY query")
def entity_rag_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The eight best entities of each query with their type, as one context."""
    lab = load(spark, d, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "id")
    a = vec_topk_batch(spark, d).join(lab, "id").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "label"))).alias("x"))
    line = lambda r: F.concat(F.lit("v"), r["id"].cast("string"), F.lit(" ("), r["label"].cast("string"), F.lit(")"))
    return a.select("query", F.array_join(F.transform("x", line), "\n").alias("context"))


_CTX = ["Ada: scientist\n\nRelationships:\nAda -[KNOWS]-> Bob\n\n[S1] notes.pdf (chunk 2)\nAda met Eve.", "Reasoning paths:\nA -[R]-> B", "plain text only", ""]


@query("SELECT * FROM (VALUES (0, 'Ada: scientist', 'Relationships:' || chr(10) || 'Ada -[KNOWS]-> Bob', 'Ada met Eve.', length('Ada: scientist' || '  ' || '[S1] notes.pdf (chunk 2) Ada met Eve.')), (1, '', 'Reasoning paths:' || chr(10) || 'A -[R]-> B', '', 0), (2, 'plain text only', '', '', 15), (3, '', '', '', 0)) t(i, entity, edge, prose, x)")
def ablation_strip(spark: SparkSession, d: str) -> DataFrame:
    """Contexts cut into entity, edge and prose parts, and the length of what is left without the graph."""
    df = spark.createDataFrame(list(enumerate(_CTX)), "i int, c string")
    return df.select("i", C.entity_part(F.col("c")).alias("entity"), C.edge_part(F.col("c")).alias("edge"), C.prose_part(F.col("c")).alias("prose"), F.length(C.without_graph(F.col("c"))).alias("x"))


@query(f"{_CHAN} SELECT count(*) AS problems FROM ch JOIN j USING (doc_id, fact) WHERE (channel = 'prose') <> found")
def attribution_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Facts credited to the prose are exactly those found there: no problem may come out."""
    return _channels(spark, d).join(_facts(spark, d), ["doc_id", "fact"]).where("(channel = 'prose') <> found").agg(F.count(F.lit(1)).alias("problems"))


@query(f"WITH {EDGES} SELECT document, count(*) AS contaminated FROM raw WHERE document IS NOT NULL AND regexp_matches(coalesce(description, ''), '\\[S[0-9]+\\]') GROUP BY document")
def contamination_check(spark: SparkSession, d: str) -> DataFrame:
    """Graph-only texts that hold an excerpt heading: must be empty."""
    r = V.raw_edges(spark, d).where(F.col("document").isNotNull() & F.coalesce("description", F.lit("")).rlike(r"\[S[0-9]+\]"))
    return r.groupBy("document").agg(F.count(F.lit(1)).alias("contaminated"))


_W = ", ".join(f"'{w}'" for w in CONTENT_STOPWORDS)


def _stems_of(table: str, key: str, col: str, out: str) -> str:
    return f"""{out}0 AS (SELECT DISTINCT {key} AS k, unnest(regexp_extract_all(lower({col}), '[a-z0-9]+')) AS w FROM {table}), {out}1 AS (SELECT k, {_stem_sql('w')} AS w FROM {out}0 WHERE length(w) >= 3 AND w NOT IN ({_W})),
{out}2 AS (SELECT k, CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM {out}1), {out} AS (SELECT DISTINCT k, CASE WHEN w LIKE '%e' AND length(w) > 4 THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM {out}2)"""


@query(f"WITH {_stems_of('type_ref', 'type_id', 'gloss', 'q')}, {_stems_of('seed_entity', 'name', 'description', 't')} SELECT DISTINCT q.k AS type_id, t.k AS name, q.w AS leaked FROM q, t WHERE q.w = t.w OR (length(q.w) >= 4 AND substr(q.w, 1, 4) = substr(t.w, 1, 4))")
def lex_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Words of a question (a type's gloss) that a text (a seed's description) gives away, by word family."""
    q = load(spark, d, "type_ref", "type_id", "gloss").select("type_id", F.explode(content_words(F.col("gloss"))).alias("a"))
    t = load(spark, d, "seed_entity", "name", "description").select("name", F.explode(content_words(F.col("description"))).alias("b"))
    family = lambda c: F.when(F.length(c) >= 4, F.substring(c, 1, 4)).otherwise(F.col(c))
    return q.withColumn("f", family("a")).join(t.withColumn("f", family("b")), "f").select("type_id", "name", F.col("a").alias("leaked")).distinct()


@query("SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 0) AS k FROM events")
def as_int(spark: SparkSession, d: str) -> DataFrame:
    """Integers read with a default: zero survives, garbage becomes it."""
    n = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) as bigint)")
    return load(spark, d, "events", "event_id", "props").select("event_id", F.coalesce(n, F.lit(0).cast("bigint")).alias("k"))


@query("SELECT * FROM (VALUES ('r1', 2, 3), ('r2', 2, 2)) t(id, gold, paragraphs)")
def hotpot_sampled_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Parse, sample by hash with a hard cap, pool: gold titles and paragraphs of every record kept."""
    r = _records(spark).where("reject is null").orderBy(F.md5(F.concat(F.lit("20260721|"), "id"))).limit(20)
    return r.select("id", F.size(F.array_distinct(F.transform("facts", lambda f: f["title"]))).alias("gold"), F.size("context").alias("paragraphs"))


@query(_FACTS + " SELECT doc_id, CAST(sum(CAST(found AS INTEGER)) AS BIGINT) AS found, CAST(count(*) - sum(CAST(found AS INTEGER)) AS BIGINT) AS lost, bool_and(strict) AS strict_complete FROM j GROUP BY doc_id")
def score_question_metrics(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("found").cast("int")
    return _facts(spark, d).groupBy("doc_id").agg(F.sum(hit).alias("found"), (F.count(F.lit(1)) - F.sum(hit)).alias("lost"), F.bool_and("strict").alias("strict_complete"))
