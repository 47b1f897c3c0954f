"""Queries of entity resolution and of vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.pyfuncs import name_similarity
from weftgraph.functions.vectors import search_all
from weftgraph.operators import graph as G
from weftgraph.operators import resolve as R
from weftgraph.plans.graph import EDGES
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


_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_TOP = f"""WITH {_E}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS score FROM e a, e b WHERE {{where}} AND a.vec_id <> b.vec_id)
SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 8"""


@query(_TOP.format(where="a.vec_id = 0"))
def vec_topk_single(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest vectors of vector 0."""
    e = load(spark, d, "embeddings", "vec_id", "embedding")
    return search_all(e.where("vec_id = 0"), e, "vec_id", "embedding", 64, 8)


@query(_TOP.format(where="a.vec_id % 50 = 0"))
def vec_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set, ids divisible by 50, against all rows."""
    e = load(spark, d, "embeddings", "vec_id", "embedding")
    return search_all(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 64, 8)


@query(f"""WITH {_E}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS score FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3""")
def vec_topk_within_label(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest of the same label: candidates restricted to each query's own pool."""
    e = load(spark, d, "embeddings", "vec_id", "embedding", "label")
    return R.nearest_in_groups(e, F.expr("vec_id % 50 = 0"), "vec_id", "embedding", "label", 64, 3)


_PAIRS = f"{_E}, p AS (SELECT a.vec_id AS l, b.vec_id AS r, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.4)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings", "vec_id", "embedding", "label")
    return R.within_groups(e, "vec_id", "embedding", "label", 64, 0.4)


@query(f"WITH {_PAIRS} SELECT l AS left_id, r AS right_id, c AS cosine FROM p")
def er_semantic_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), "cosine")


_COMP = f"""WITH RECURSIVE {_PAIRS}, s AS (SELECT l AS a, r AS b FROM p UNION SELECT r, l FROM p), w AS (SELECT a AS node, a AS c FROM s UNION SELECT s.b, w.c FROM w JOIN s ON s.a = w.node),
k AS (SELECT node, min(c) AS component FROM w GROUP BY node)"""


@query(_COMP + " SELECT node, component FROM k")
def er_components(spark: SparkSession, d: str) -> DataFrame:
    return G.connected_components(_pairs(spark, d).select(F.col("left").alias("a"), F.col("right").alias("b")))


@query(_COMP + """, n AS (SELECT component, 'v' || node AS name FROM k), g AS (SELECT component, arg_min(name, (-length(name), -1, name)) AS canonical, count(*) AS size, list(name ORDER BY name) AS al FROM n GROUP BY component)
SELECT component, canonical, size, array_to_string(list_concat([canonical], list_filter(al, lambda x: x <> canonical)), '|') AS members FROM g WHERE size > 1""")
def er_canonical(spark: SparkSession, d: str) -> DataFrame:
    m = er_components(spark, d).select("component", F.concat(F.lit("v"), F.col("node").cast("string")).alias("name"))
    return R.clusters(m, "component", "name")


_NAMES = "nm AS (SELECT DISTINCT trim(name) AS name FROM seed_entity)"


@query(f"""WITH {_NAMES}, k AS (SELECT DISTINCT name, unnest(list_concat(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(name), '[^a-z0-9_]', ' ', 'g'), ' +'), lambda x: x <> ''), lambda x: substr(x, 1, 1)), [substr(regexp_replace(lower(name), '[^a-z0-9_]', '', 'g'), 1, 1)])) AS key FROM nm)
SELECT DISTINCT a.name AS left_name, b.name AS right_name FROM k a JOIN k b ON a.key = b.key AND a.name < b.name""")
def er_block_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "seed_entity", "name").select(F.trim("name").alias("name"), F.lit("all").alias("kind"))
    return R.blocked_pairs(s, "name", "kind").select(F.col("left").alias("left_name"), F.col("right").alias("right_name"))


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "entity", "entity_id", "name", "type", "embedding")
    return R.duplicate_pairs(e, "entity_id", "name", "type", "embedding", 64)


@query()
def er_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entity names of one type that share a block key and meet both thresholds."""
    p = _duplicates(spark, d)
    return p.select(F.col("left").alias("left_name"), F.col("right").alias("right_name"), "kind", F.round("cosine", 6).alias("cosine"), F.round("similarity", 6).alias("similarity"))


@query()
def er_duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of duplicate names: canonical first in ``members``, the others sorted."""
    a = R.duplicate_aliases(_duplicates(spark, d))
    g = a.groupBy("canonical").agg((F.count(F.lit(1)) + 1).alias("size"), F.array_sort(F.collect_list("name")).alias("others"))
    return g.select("canonical", "size", F.concat_ws("|", "canonical", F.array_join("others", "|")).alias("members"))


@query()
def er_duplicate_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the graph view with the duplicates merged into their canonical names."""
    return R.rewrite_edges(V.edges(spark, d), R.duplicate_aliases(_duplicates(spark, d))).withColumnsRenamed({"source": "s", "target": "t"})


@query("SELECT DISTINCT trim(name) AS name, regexp_replace(lower(trim(name)), '[^a-z0-9_]', '', 'g') AS norm, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(trim(name)), '[^a-z0-9_]', ' ', 'g'), ' +'), lambda x: x <> ''), ' ') AS tokens FROM entity WHERE trim(name) <> ''")
def name_norm_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "entity", "name").select(F.trim("name").alias("name")).where("name <> ''").distinct()
    return n.select("name", T.ascii_norm(F.col("name")).alias("norm"), F.array_join(T.ascii_tokens(F.col("name")), " ").alias("tokens"))


def _pairs_of_log(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "merge_log", "name_a", "name_b").where("name_a is not null and name_b is not null")
    return m.select(F.least("name_a", "name_b").alias("left_name"), F.greatest("name_a", "name_b").alias("right_name")).where("left_name <> right_name").distinct()


@query("""WITH p AS (SELECT DISTINCT least(name_a, name_b) AS left_name, greatest(name_a, name_b) AS right_name FROM merge_log WHERE name_a IS NOT NULL AND name_b IS NOT NULL AND name_a <> name_b),
t AS (SELECT *, regexp_replace(lower(left_name), '[^a-z0-9_]', '', 'g') AS na, regexp_replace(lower(right_name), '[^a-z0-9_]', '', 'g') AS nb, ' ' || trim(regexp_replace(regexp_replace(lower(left_name), '[^a-z0-9_]', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS ta, ' ' || trim(regexp_replace(regexp_replace(lower(right_name), '[^a-z0-9_]', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS tb FROM p)
SELECT left_name, right_name, na <> nb AND least(length(na), length(nb)) >= 3 AND (
 (length(ta) < length(tb) AND regexp_matches(tb, replace(' ' || trim(ta), ' ', ' (.* )?') || ' ') AND len(string_split(trim(ta), ' ')) < len(string_split(trim(tb), ' '))) OR
 (length(tb) < length(ta) AND regexp_matches(ta, replace(' ' || trim(tb), ' ', ' (.* )?') || ' ') AND len(string_split(trim(tb), ' ')) < len(string_split(trim(ta), ' '))) OR
 (starts_with(CASE WHEN length(na) <= length(nb) THEN nb ELSE na END, CASE WHEN length(na) <= length(nb) THEN na ELSE nb END) AND least(length(na), length(nb)) / greatest(length(na), length(nb), 1) >= 0.6)) AS contained FROM t""")
def er_containment(spark: SparkSession, d: str) -> DataFrame:
    """One name of a logged pair holds the other."""
    p = _pairs_of_log(spark, d)
    return p.select("left_name", "right_name", T.containment(F.col("left_name"), F.col("right_name")).alias("contained"))


@query()
def er_name_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Name similarity of every logged pair."""
    p = _pairs_of_log(spark, d)
    return p.select("left_name", "right_name", F.round(name_similarity()("left_name", "right_name"), 6).alias("similarity"))


_ALIAS = """al AS (SELECT name, canonical FROM (SELECT name, first_value(name) OVER (PARTITION BY key ORDER BY length(name) DESC, name) AS canonical FROM (SELECT DISTINCT trim(name) AS name, lower(trim(name)) AS key FROM entity WHERE trim(name) <> '')) WHERE name <> canonical)"""


def _alias(spark: SparkSession, d: str) -> DataFrame:
    """Names that differ in case only, mapped to the longest and first of them."""
    n = load(spark, d, "entity", "name").select(F.trim("name").alias("name")).where("name <> ''").distinct().withColumn("key", F.lower("name"))
    c = n.groupBy("key").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("canonical"))
    return n.join(c, "key").where("name <> canonical").select("name", "canonical")


@query(f"WITH {EDGES}, {_ALIAS} SELECT DISTINCT s, t, rel_type FROM (SELECT coalesce(a.canonical, source) AS s, coalesce(b.canonical, target) AS t, rel_type FROM edges LEFT JOIN al a ON a.name = source LEFT JOIN al b ON b.name = target) WHERE s <> t")
def er_rewrite_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.rewrite_edges(V.edges(spark, d), _alias(spark, d)).withColumnsRenamed({"source": "s", "target": "t"})


@query(f"WITH {_ALIAS}, f AS (SELECT DISTINCT trim(name) AS name FROM entity WHERE document IN (SELECT file_name FROM documents WHERE lang = 'en')), g AS (SELECT canonical, list(name) AS names FROM al GROUP BY canonical) SELECT canonical, len(names) AS merged FROM g WHERE list_has_any(list_append(names, canonical), (SELECT list(name) FROM f))")
def er_fresh_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that touch an entity of the fresh documents (the English ones)."""
    a = _alias(spark, d)
    docs = load(spark, d, "documents", "file_name", "lang").where("lang = 'en'").select(F.col("file_name").alias("document"))
    fresh = load(spark, d, "entity", "name", "document").join(docs, "document", "left_semi").select(F.trim("name").alias("member")).distinct()
    member = a.select("canonical", F.col("name").alias("member")).unionByName(a.select("canonical", F.col("canonical").alias("member")).distinct())
    touched = member.join(fresh, "member", "left_semi").select("canonical").distinct()
    return a.join(touched, "canonical", "left_semi").groupBy("canonical").agg(F.count(F.lit(1)).alias("merged"))


@query(f"""WITH {_ALIAS}, n AS (SELECT trim(name) AS name, lower(trim(name)) AS key, entity_id, nullif(trim(coalesce(description, '')), '') AS de FROM entity WHERE trim(name) <> ''),
c AS (SELECT DISTINCT canonical, lower(canonical) AS key FROM al) SELECT c.canonical, coalesce(arg_min(n.de, (CASE WHEN n.name = c.canonical THEN 0 ELSE 1 END, n.entity_id)) FILTER (WHERE n.de IS NOT NULL), '') AS description, string_agg(DISTINCT n.name, '|' ORDER BY n.name) AS aliases FROM c JOIN n USING (key) GROUP BY c.canonical""")
def entity_alias_absorb(spark: SparkSession, d: str) -> DataFrame:
    """The canonical record keeps its description, else takes the first of its duplicates; all names become aliases."""
    c = _alias(spark, d).select("canonical", F.lower("canonical").alias("key")).distinct()
    text = F.nullif(F.trim(F.coalesce("description", F.lit(""))), F.lit("")).alias("de")
    n = load(spark, d, "entity", "name", "entity_id", "description").select(F.trim("name").alias("name"), "entity_id", text).where("name <> ''").withColumn("key", F.lower("name"))
    j = c.join(n, "key")
    own = F.struct(F.when(F.expr("name = canonical"), 0).otherwise(1).alias("o"), "entity_id")
    g = j.groupBy("canonical").agg(F.min_by("de", F.when(F.col("de").isNotNull(), own)).alias("de"), F.array_sort(F.collect_set("name")).alias("al"))
    return g.select("canonical", F.coalesce("de", F.lit("")).alias("description"), F.array_join("al", "|").alias("aliases"))


@query(f"WITH {_ALIAS} SELECT count(DISTINCT canonical) AS clusters, count(*) AS merged FROM al")
def er_merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return _alias(spark, d).agg(F.count_distinct("canonical").alias("clusters"), F.count(F.lit(1)).alias("merged"))


@query(f"""WITH {EDGES}, {_ALIAS}, bad AS (SELECT DISTINCT al.canonical FROM al JOIN (SELECT source AS n, rel_type FROM edges UNION ALL SELECT target, rel_type FROM edges) e ON e.n = al.name WHERE NOT regexp_full_match(e.rel_type, '[A-Za-z_][A-Za-z0-9_]*'))
SELECT name, canonical, canonical NOT IN (SELECT canonical FROM bad) AS merged FROM al""")
def er_merge_store(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates merged into the store; a cluster with an unsafe relationship type is held back whole."""
    e = V.edges(spark, d)
    ends = e.select(F.col("source").alias("name"), "rel_type").unionByName(e.select(F.col("target").alias("name"), "rel_type"))
    a = _alias(spark, d)
    bad = a.join(ends.where(~T.safe_rel_type(F.col("rel_type"))), "name").select("canonical", F.lit(True).alias("held")).distinct()
    return a.join(bad, "canonical", "left").select("name", "canonical", F.col("held").isNull().alias("merged"))
