"""Queries on the graph: sources, sinks, joins, degrees, neighbourhoods, paths, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import community_id, safe_rel_type
from weftgraph.operators import graph as G
from weftgraph.sources import graphview as V
from weftgraph.sources.tables import load

NODES = """nodes AS (SELECT name, type, description, document FROM (
  SELECT trim(name) AS name, type, description, document, row_number() OVER (PARTITION BY trim(name) ORDER BY loaded_at DESC, entity_id DESC) AS rn
  FROM entity WHERE trim(name) <> '') WHERE rn = 1)"""
RAW = """raw AS (SELECT * FROM (SELECT trim(source) AS source, trim(target) AS target, upper(replace(coalesce(rel_type, 'RELATED_TO'), ' ', '_')) AS rel_type,
  description, document, recorded_at FROM relationship) WHERE source <> '' AND target <> '' AND source <> target)"""
EDGES = RAW + ", edges AS (SELECT DISTINCT source, target, rel_type FROM raw)"
ADJ = EDGES + ", adj AS (SELECT source AS node, target AS other, rel_type, true AS forward FROM edges UNION ALL SELECT target, source, rel_type, false FROM edges)"
MENTIONS = "mentions AS (SELECT DISTINCT trim(name) AS name, chunk_id FROM mention WHERE trim(name) <> '' AND chunk_id IS NOT NULL)"
CHUNKS = """chunks AS (SELECT id, chunk_no, text, document, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chunk_no, loaded_at) AS rn FROM chunk) WHERE rn = 1)"""
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {NODES} SELECT name, coalesce(nullif(upper(trim(type)), ''), 'UNKNOWN') AS type, coalesce(description, '') AS description, coalesce(document, '') AS document FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Label scan of all nodes without their vectors."""
    kind = F.coalesce(F.nullif(F.upper(F.trim("type")), F.lit("")), F.lit("UNKNOWN")).alias("type")
    return V.nodes(spark, d).select("name", kind, F.coalesce("description", F.lit("")).alias("description"), F.coalesce("document", F.lit("")).alias("document"))


@query(f"WITH {NODES}, {EDGES} SELECT source, target, rel_type FROM edges WHERE source IN (SELECT name FROM nodes) AND target IN (SELECT name FROM nodes)")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = V.nodes(spark, d).select("name")
    e = V.edges(spark, d).join(n.withColumnRenamed("name", "source"), "source", "left_semi")
    return e.join(n.withColumnRenamed("name", "target"), "target", "left_semi").select("source", "target", "rel_type")


@query(f"""WITH {NODES}, {EDGES} SELECT e.source, e.target, e.rel_type, coalesce(a.type, '') AS source_type, coalesce(b.type, '') AS target_type
FROM edges e JOIN nodes a ON a.name = e.source JOIN nodes b ON b.name = e.target""")
def edge_load(spark: SparkSession, d: str) -> DataFrame:
    n = V.nodes(spark, d).select("name", F.coalesce("type", F.lit("")).alias("t"))
    e = V.edges(spark, d).join(n.select(F.col("name").alias("source"), F.col("t").alias("source_type")), "source")
    return e.join(n.select(F.col("name").alias("target"), F.col("t").alias("target_type")), "target").select("source", "target", "rel_type", "source_type", "target_type")


@query(f"""WITH {NODES}, {RAW} SELECT DISTINCT source, rel_type, target, coalesce(description, '') AS description FROM raw
WHERE source IN (SELECT name FROM nodes) AND target IN (SELECT name FROM nodes)""")
def edge_typed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Relationship sink keyed by source, type, target and description."""
    n = V.nodes(spark, d).select("name")
    r = V.raw_edges(spark, d).select("source", "rel_type", "target", F.coalesce("description", F.lit("")).alias("description"))
    r = r.join(n.withColumnRenamed("name", "source"), "source", "left_semi").join(n.withColumnRenamed("name", "target"), "target", "left_semi")
    return r.distinct().select("source", "rel_type", "target", "description")


@query(f"""WITH {RAW} SELECT source, target, rel_type, description FROM (SELECT source, target, rel_type, coalesce(description, '') AS description,
row_number() OVER (PARTITION BY source, target ORDER BY recorded_at DESC, rel_type DESC, coalesce(description, '') DESC) AS rn FROM raw) WHERE rn = 1""")
def edge_fallback_merge(spark: SparkSession, d: str) -> DataFrame:
    """Relationship sink keyed by source and target: the last type wins."""
    text = F.coalesce("description", F.lit(""))
    last = F.max(F.struct("recorded_at", "rel_type", text.alias("description"))).alias("m")
    return V.raw_edges(spark, d).groupBy("source", "target").agg(last).select("source", "target", "m.rel_type", "m.description")


@query("""WITH k AS (SELECT lower(trim(name)) AS key, * FROM entity WHERE trim(name) <> '')
SELECT key, name, coalesce(type, '') AS type, first_id FROM (SELECT key, name, type, min(entity_id) OVER (PARTITION BY key) AS first_id,
row_number() OVER (PARTITION BY key ORDER BY loaded_at DESC, entity_id DESC) AS rn FROM k) WHERE rn = 1""")
def entity_dedupe_lastwins(spark: SparkSession, d: str) -> DataFrame:
    """One record per case-folded name: the last wins, the first position stays."""
    e = load(spark, d, "entity", "entity_id", "name", "type", "loaded_at").withColumn("key", F.lower(F.trim("name"))).where("key <> ''")
    last = F.max_by(F.struct("name", F.coalesce("type", F.lit("")).alias("type")), F.struct("loaded_at", "entity_id")).alias("v")
    return e.groupBy("key").agg(last, F.min("entity_id").alias("first_id")).select("key", "v.name", "v.type", "first_id")


@query("""SELECT name, type FROM (SELECT name, coalesce(type, '') AS type, row_number() OVER (PARTITION BY name ORDER BY entity_id, loaded_at) AS rn
FROM entity WHERE name IS NOT NULL) WHERE rn = 1""")
def entity_first_type(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "entity", "entity_id", "name", "type", "loaded_at").where("name is not null")
    return e.groupBy("name").agg(F.min_by(F.coalesce("type", F.lit("")), F.struct("entity_id", "loaded_at")).alias("type"))


@query("""WITH e AS (SELECT trim(name) AS name, list_filter(coalesce(aliases, []), lambda x: x IS NOT NULL AND trim(x) <> '') AS al, entity_id FROM entity WHERE trim(name) <> ''),
p AS (SELECT name, arg_min(al, entity_id) AS old, arg_max(al, entity_id) AS new FROM e GROUP BY name)
SELECT name, array_to_string(list_sort(list_distinct(list_concat(list_filter(old, lambda x: NOT list_contains(new, x)), new))), '|') AS aliases FROM p""")
def entity_upsert_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases after an upsert of each name's last record over its first: old ones that are not new, then the new ones."""
    e = load(spark, d, "entity", "entity_id", "name", "aliases").withColumn("name", F.trim("name")).where("name <> ''")
    al = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    p = e.withColumn("al", al).groupBy("name").agg(F.min_by("al", "entity_id").alias("old"), F.max_by("al", "entity_id").alias("new"))
    merged = F.concat(F.array_except("old", "new"), F.col("new"))
    return p.select("name", F.array_join(F.array_sort(F.array_distinct(merged)), "|").alias("aliases"))


@query(f"""WITH {NODES}, {EDGES}, {MENTIONS}, ends AS (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges UNION ALL SELECT name FROM mentions),
g AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)
SELECT n.name, coalesce(g.degree, 0) AS degree FROM nodes n LEFT JOIN g ON g.node = n.name""")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    """Degree of every node, isolated ones included; mentions count."""
    e = V.edges(spark, d)
    g = G.degrees(e.select("source"), e.select("target"), V.mentions(spark, d).select("name"))
    return V.nodes(spark, d).select("name").join(g, F.col("name") == g.node, "left").select("name", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


@query(SQL["graph_degree"] + " ORDER BY degree DESC, name LIMIT 20")
def graph_degree_topk(spark: SparkSession, d: str) -> DataFrame:
    """The fallback when nothing matches a question: the nodes of highest degree."""
    return graph_degree(spark, d).orderBy(F.desc("degree"), "name").limit(20)


@query(f"""WITH {ADJ} SELECT DISTINCT s.name AS seed, coalesce(a.other, '') AS other, coalesce(a.rel_type, '') AS rel_type FROM seed_entity s LEFT JOIN adj a ON a.node = s.name""")
def graph_neighbors_1hop(spark: SparkSession, d: str) -> DataFrame:
    out = G.one_hop(load(spark, d, "seed_entity", "name"), V.edges(spark, d))
    return out.select("seed", F.coalesce("other", F.lit("")).alias("other"), F.coalesce("rel_type", F.lit("")).alias("rel_type"))


@query(f"""WITH {ADJ}, h1 AS (SELECT DISTINCT other AS node FROM adj WHERE node IN (SELECT name FROM seed_entity)),
h2 AS (SELECT DISTINCT other AS node FROM adj WHERE node IN (SELECT node FROM h1)),
u AS (SELECT name AS node, 0 AS depth FROM seed_entity UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM u GROUP BY node""")
def graph_frontier_2hop(spark: SparkSession, d: str) -> DataFrame:
    return G.frontier(load(spark, d, "seed_entity", "name"), V.edges(spark, d), 2)


_STEP = "t || CASE WHEN a.forward THEN ' -[' || a.rel_type || ']-> ' ELSE ' <-[' || a.rel_type || ']- ' END || a.other"
_PATHS = f"""WITH {ADJ}, adjd AS (SELECT DISTINCT * FROM adj), s AS (SELECT name FROM seed_entity),
l0 AS (SELECT name AS source, name AS node, name AS t FROM s),
l1 AS (SELECT source, a.other AS node, min({_STEP}) AS t FROM l0 JOIN adjd a USING (node) GROUP BY 1, 2),
v1 AS (SELECT source, node FROM l0 UNION SELECT source, node FROM l1),
l2 AS (SELECT source, a.other AS node, min({_STEP}) AS t FROM l1 JOIN adjd a USING (node) WHERE (source, a.other) NOT IN (SELECT (source, node) FROM v1) GROUP BY 1, 2),
v2 AS (SELECT * FROM v1 UNION SELECT source, node FROM l2),
l3 AS (SELECT source, a.other AS node, min({_STEP}) AS t FROM l2 JOIN adjd a USING (node) WHERE (source, a.other) NOT IN (SELECT (source, node) FROM v2) GROUP BY 1, 2),
p AS (SELECT source, node AS target, 1 AS hops, t AS text FROM l1 UNION ALL SELECT source, node, 2, t FROM l2 UNION ALL SELECT source, node, 3, t FROM l3)
SELECT source, target, hops, text FROM p WHERE target IN (SELECT name FROM s) AND source < target"""


@query(_PATHS)
def graph_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """One shortest path for every pair of seeds within three hops."""
    s = load(spark, d, "seed_entity", "name")
    return G.shortest_paths(s, s, V.edges(spark, d), 3).where("source < target")


@query(f"SELECT source, target, hops, text, rank FROM (SELECT *, row_number() OVER (ORDER BY hops, text) AS rank FROM ({_PATHS})) WHERE rank <= 6")
def paths_rendered(spark: SparkSession, d: str) -> DataFrame:
    """The six reasoning paths of fewest hops (a report of top paths)."""
    best = graph_shortest_paths(spark, d).orderBy("hops", "text").limit(6)
    return G.top_k(best, [], ["hops", "text"], 6)


@query(f"WITH {RAW} SELECT least(source, target) AS a, greatest(source, target) AS b, CAST(count(*) AS DOUBLE) AS weight FROM raw GROUP BY 1, 2")
def graph_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_weights(V.raw_edges(spark, d))


_MOD = f"""WITH {NODES}, {RAW}, w AS (SELECT least(source, target) AS a, greatest(source, target) AS b, CAST(count(*) AS DOUBLE) AS weight FROM raw GROUP BY 1, 2),
m AS (SELECT name, coalesce(upper(trim(type)), '') AS c FROM nodes),
j AS (SELECT x.c AS ca, y.c AS cb, weight FROM w JOIN m x ON x.name = w.a JOIN m y ON y.name = w.b),
ends AS (SELECT ca AS community, weight, CASE WHEN ca = cb THEN weight ELSE 0.0 END AS w_in FROM j UNION ALL SELECT cb, weight, 0 FROM j),
p AS (SELECT community, sum(w_in) AS inside, sum(weight) AS degree FROM ends GROUP BY community), t AS (SELECT sum(degree) / 2 AS m FROM p)"""


def _by_type(spark: SparkSession, d: str) -> DataFrame:
    return V.nodes(spark, d).select(F.col("name").alias("node"), F.coalesce(F.upper(F.trim("type")), F.lit("")).alias("community"))


@query(_MOD + " SELECT round(sum(inside / t.m - (degree / (2 * t.m)) ** 2), 4) AS modularity FROM p, t")
def community_modularity_by_type(spark: SparkSession, d: str) -> DataFrame:
    return G.modularity(G.edge_weights(V.raw_edges(spark, d)), _by_type(spark, d))


@query(_MOD + " SELECT community, inside + 0.0 AS inside, degree, round(inside / t.m - (degree / (2 * t.m)) ** 2, 6) + 0.0 AS contribution FROM p, t")
def community_modularity_terms(spark: SparkSession, d: str) -> DataFrame:
    out = G.modularity_terms(G.edge_weights(V.raw_edges(spark, d)), _by_type(spark, d))
    return out.withColumn("contribution", F.round("contribution", 6) + 0.0)


_COM = f"""{NODES}, {EDGES}, nb AS (SELECT DISTINCT source AS n, target AS o FROM edges UNION SELECT target, source FROM edges), dg AS (SELECT n, count(*) AS degree FROM nb GROUP BY n),
mem AS (SELECT document AS community, name, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN dg ON dg.n = nodes.name WHERE document IS NOT NULL),
com AS (SELECT community, count(*) AS size, list(name ORDER BY degree DESC, name) AS members FROM mem GROUP BY community HAVING count(*) >= 3)"""


def _communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the nodes of one document, at least three each; degree counts different neighbours."""
    nb = G.adjacency(V.edges(spark, d)).select("node", "other").distinct()
    degree = nb.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    member = V.nodes(spark, d).where("document is not null").select(F.col("name").alias("node"), F.col("document").alias("community"))
    return G.communities(member, degree, 3)


@query(f"WITH {_COM} SELECT community, size, array_to_string(members, '|') AS members FROM com")
def community_min_size(spark: SparkSession, d: str) -> DataFrame:
    return _communities(spark, d).select("community", "size", F.array_join("members", "|").alias("members"))


@query(f"WITH {_COM} SELECT community, 'com-' || substr(sha1(array_to_string(list_sort(members), '|')), 1, 12) AS id FROM com")
def community_ids(spark: SparkSession, d: str) -> DataFrame:
    return _communities(spark, d).select("community", community_id(F.col("members")).alias("id"))


@query(f"WITH {_COM} SELECT array_to_string(members[1:3], ' / ') AS title, size, rank FROM (SELECT *, row_number() OVER (ORDER BY size DESC, array_to_string(members[1:3], ' / '), community) AS rank FROM com) WHERE rank <= 10")
def community_list(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest communities with their fallback titles (a listing)."""
    c = _communities(spark, d).withColumn("title", F.array_join(F.slice("members", 1, 3), " / "))
    top = c.orderBy(F.desc("size"), "title", "community").limit(10)
    return G.top_k(top, [], [F.desc("size"), "title", "community"], 10).select("title", "size", "rank")


@query(f"""WITH {_COM} SELECT community, array_to_string(members[1:12], ', ') || CASE WHEN size > 12 THEN ' (+' || (size - 12) || ' more)' ELSE '' END AS line FROM com""")
def community_member_lines(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("size") > 12, F.concat(F.lit(" (+"), (F.col("size") - 12).cast("string"), F.lit(" more)"))).otherwise("")
    return _communities(spark, d).select("community", F.concat(F.array_join(F.slice("members", 1, 12), ", "), more).alias("line"))


@query(f"""WITH {_COM}, ranked AS (SELECT name, ord FROM (SELECT community, unnest(members) AS name, unnest(range(1, len(members) + 1)) AS ord FROM com)),
big AS (SELECT *, row_number() OVER (ORDER BY size DESC, community) AS cr FROM com), f AS (SELECT cr, unnest(members) AS name, unnest(range(1, len(members) + 1)) AS ord FROM big),
o AS (SELECT name, min(cr * 1000000 + ord) AS o FROM f GROUP BY name) SELECT name, rank FROM (SELECT name, row_number() OVER (ORDER BY o) AS rank FROM o) WHERE rank <= 20""")
def community_top_members(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty different members over the communities from the largest down (members used to pull excerpts)."""
    # twenty members cannot need more than twenty communities
    big = G.top_k(_communities(spark, d).orderBy(F.desc("size"), "community").limit(20), [], [F.desc("size"), "community"], 20, "cr")
    flat = big.select("cr", F.posexplode("members").alias("ord", "name"))
    first = flat.groupBy("name").agg(F.min(F.struct("cr", "ord")).alias("o"))
    return G.top_k(first.orderBy("o").limit(20), [], ["o"], 20).select("name", "rank")


@query()
def community_label_prop(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(G.edge_weights(V.raw_edges(spark, d)))


@query()
def community_louvain(spark: SparkSession, d: str) -> DataFrame:
    """Louvain communities of the edges of every document by itself."""
    w = V.raw_edges(spark, d).where("document is not null").groupBy("document", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return G.louvain(w, "document")


@query(f"WITH {ADJ} SELECT DISTINCT s.name AS node, rel_type FROM adj JOIN seed_entity s ON s.name = adj.node")
def rel_types_touching(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "seed_entity", "name").withColumnRenamed("name", "node")
    return G.adjacency(V.edges(spark, d)).join(s, "node").select("node", "rel_type").distinct()  # a fixed table of 60 rows


@query("SELECT DISTINCT coalesce(rel_type, 'RELATED_TO') AS rel_type, regexp_full_match(upper(replace(coalesce(rel_type, 'RELATED_TO'), ' ', '_')), '[A-Za-z_][A-Za-z0-9_]*') AS safe, upper(replace(coalesce(rel_type, 'RELATED_TO'), ' ', '_')) AS norm FROM relationship")
def safe_rel_types(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.functions.text import rel_type

    r = load(spark, d, "relationship", "rel_type").select(F.coalesce("rel_type", F.lit("RELATED_TO")).alias("rel_type")).distinct()
    return r.withColumn("norm", rel_type(F.col("rel_type"))).withColumn("safe", safe_rel_type(F.col("norm")))


@query(f"""WITH {NODES}, {MENTIONS}, {CHUNKS} SELECT n.name, array_to_string(list_sort(list(DISTINCT c.document)), '|') AS documents FROM nodes n
JOIN mentions m ON m.name = n.name JOIN chunks c ON c.id = m.chunk_id WHERE c.document IS NOT NULL GROUP BY n.name""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Documents in whose chunks a node is mentioned."""
    docs = V.chunks(spark, d).where("document is not null").select(F.col("id").alias("chunk_id"), "document")
    pairs = V.mentions(spark, d).join(docs, "chunk_id").select("name", "document").distinct().join(V.nodes(spark, d).select("name"), "name", "left_semi")
    return pairs.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("document")), "|").alias("documents"))


@query(f"WITH {NODES}, {MENTIONS} SELECT name, coalesce(document, '') AS document FROM nodes WHERE name NOT IN (SELECT name FROM mentions)")
def prov_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that no chunk mentions, with their own document."""
    n = V.nodes(spark, d).select("name", F.coalesce("document", F.lit("")).alias("document"))
    return n.join(V.mentions(spark, d).select("name"), "name", "left_anti")


@query("SELECT DISTINCT file_name FROM documents WHERE file_name NOT IN (SELECT document FROM chunk WHERE document IS NOT NULL)")
def missing_docs(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "chunk", "document").where("document is not null").select(F.col("document").alias("file_name"))
    return load(spark, d, "documents", "file_name").distinct().join(c, "file_name", "left_anti")


@query("SELECT DISTINCT document FROM chunk WHERE document IS NOT NULL")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chunk", "document").where("document is not null").distinct()


@query(f"WITH {NODES} SELECT count(*) AS n, CAST(sum(length(coalesce(name, '')) + length(coalesce(description, ''))) AS BIGINT) AS chars FROM nodes")
def graph_size(spark: SparkSession, d: str) -> DataFrame:
    return V.nodes(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("name", F.lit(""))) + F.length(F.coalesce("description", F.lit("")))).alias("chars"))


@query(f"""WITH {NODES}, {EDGES}, {CHUNKS} SELECT (SELECT count(*) FROM entity) AS extracted, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT lower(trim(name))) FROM entity WHERE trim(name) <> '') AS unique_names,
(SELECT count(*) FROM edges) AS relationships, (SELECT count(*) FROM chunks) AS chunks""")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    unique = load(spark, d, "entity", "name").where("trim(name) <> ''").agg(F.count_distinct(F.lower(F.trim("name"))).alias("unique_names"))
    out = one(load(spark, d, "entity", "entity_id"), "extracted").crossJoin(one(V.nodes(spark, d), "nodes")).crossJoin(unique)  # single rows
    return out.crossJoin(one(V.edges(spark, d), "relationships")).crossJoin(one(V.chunks(spark, d), "chunks"))


@query(f"WITH {NODES} SELECT DISTINCT coalesce(nullif(upper(trim(type)), ''), 'UNKNOWN') AS type, count(*) AS nodes FROM nodes GROUP BY 1")
def graph_types_present(spark: SparkSession, d: str) -> DataFrame:
    return graph_nodes(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"WITH {NODES} SELECT name, upper(trim(type)) AS type FROM nodes WHERE upper(trim(type)) IN ('PERSON', 'COMPANY') AND contains(lower(name), 'an')")
def graph_ui_filter(spark: SparkSession, d: str) -> DataFrame:
    n = V.nodes(spark, d).select("name", F.upper(F.trim("type")).alias("type"))
    return n.where(F.col("type").isin("PERSON", "COMPANY") & F.contains(F.lower("name"), F.lit("an")))


@query(f"""WITH {NODES}, {EDGES}, seeds AS (SELECT name FROM nodes), names AS (SELECT name AS x FROM nodes)
SELECT 'unknown type' AS problem, name AS subject FROM nodes WHERE upper(trim(type)) NOT IN (SELECT type_name FROM type_ref)
UNION ALL SELECT 'blank description', name FROM nodes WHERE coalesce(trim(description), '') = ''
UNION ALL SELECT 'missing source', source || ' ' || rel_type || ' ' || target FROM edges WHERE source NOT IN (SELECT x FROM names)
UNION ALL SELECT 'missing target', source || ' ' || rel_type || ' ' || target FROM edges WHERE target NOT IN (SELECT x FROM names)""")
def validate_graph(spark: SparkSession, d: str) -> DataFrame:
    """A row for every problem of the graph: types outside the list, blank descriptions, edges without an end."""
    n, e = V.nodes(spark, d), V.edges(spark, d)
    known = load(spark, d, "type_ref", "type_name").withColumnRenamed("type_name", "t")
    label = F.concat_ws(" ", "source", "rel_type", "target").alias("subject")
    typed = n.withColumn("t", F.upper(F.trim("type"))).where("t is not null").join(known, "t", "left_anti").select(F.lit("unknown type").alias("problem"), F.col("name").alias("subject"))
    blank = n.where("coalesce(trim(description), '') = ''").select(F.lit("blank description").alias("problem"), F.col("name").alias("subject"))
    src = e.join(n.select(F.col("name").alias("source")), "source", "left_anti").select(F.lit("missing source").alias("problem"), label)
    tgt = e.join(n.select(F.col("name").alias("target")), "target", "left_anti").select(F.lit("missing target").alias("problem"), label)
    return typed.unionByName(blank).unionByName(src).unionByName(tgt)


@query(f"""WITH {ADJ} SELECT count(*) AS triangles FROM (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges) x
JOIN (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges) y ON y.a = x.b JOIN (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges) z ON z.a = x.a AND z.b = y.b""")
def graph_triangles_extra(spark: SparkSession, d: str) -> DataFrame:
    """Beyond parity: number of triangles. Edges point from the end of lower degree to the other, so hubs open no wedges."""
    p = V.edges(spark, d).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    deg = G.degrees(p.select("a"), p.select("b"))
    o = p.join(deg.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    low = F.expr("da < db or (da = db and a < b)")
    o = o.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("hi"))
    x, y, z = o.toDF("u", "v"), o.toDF("u", "w"), o.toDF("p", "q")
    wedge = x.join(y, "u").where("v < w")
    close = z.select(F.least("p", "q").alias("v"), F.greatest("p", "q").alias("w"))
    return wedge.join(close, ["v", "w"]).agg(F.count(F.lit(1)).alias("triangles"))
