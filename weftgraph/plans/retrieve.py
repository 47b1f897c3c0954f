"""Queries of retrieval: keyword and vector seeds, context, excerpts, communities for broad questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import keyword_terms, snippet
from weftgraph.functions.vectors import hash_embedder
from weftgraph.operators import graph as G
from weftgraph.operators import rank as R
from weftgraph.plans.graph import ADJ, CHUNKS, EDGES, MENTIONS, NODES
from weftgraph.plans.resolve import SQL as RESOLVE_SQL
from weftgraph.plans.resolve import vec_topk_batch, vec_topk_within_label
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


_SEEDS = "seeds AS (SELECT name, row_number() OVER (ORDER BY name) AS rank FROM seed_entity)"


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """The curated seeds in name order: a fixed table of sixty rows."""
    return load(spark, d, "seed_entity", "name").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("name")))


_BM25 = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tok FROM documents), s AS (SELECT doc_id, len(tok) AS dl, tok FROM t WHERE len(tok) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM s), q AS (SELECT DISTINCT name AS query, unnest(regexp_extract_all(lower(description), '[a-z0-9]+')) AS term FROM seed_entity),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(tok) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
h AS (SELECT query, doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY query, doc_id)
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM h) WHERE rank <= 8"""


@query(_BM25)
def kw_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight best documents by keywords for the description of every seed."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    docs = load(spark, d, "documents", "doc_id", "text").select("doc_id", words("text").alias("tokens"))
    q = load(spark, d, "seed_entity", "name", "description").select("name", F.array_distinct(words("description")).alias("terms"))
    return R.bm25(docs, "doc_id", "tokens", q, "name", "terms", 8)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'vaccine') OR contains(lower(text), 'ledger') OR contains(lower(text), 'brevet')")
def kw_contains_fallback(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    hit = F.exists(F.array(F.lit("vaccine"), F.lit("ledger"), F.lit("brevet")), lambda t: F.contains(low, t))
    return load(spark, d, "documents", "doc_id", "text").where(hit).select("doc_id")


@query(f"WITH {NODES} SELECT name, CAST(0.0 AS DOUBLE) AS score FROM nodes WHERE contains(lower(name), 'university') OR contains(lower(coalesce(description, '')), 'vaccine')")
def kw_contains_scored(spark: SparkSession, d: str) -> DataFrame:
    hit = F.contains(F.lower("name"), F.lit("university")) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit("vaccine"))
    return V.nodes(spark, d).where(hit).select("name", F.lit(0.0).alias("score"))


_INTER = f"""WITH a AS ({RESOLVE_SQL['vec_topk_batch']}), b AS ({RESOLVE_SQL['vec_topk_within_label']}),
u AS (SELECT query, id, min(o) AS o FROM (SELECT query, id, 2 * rank AS o FROM a UNION ALL SELECT query, id, 2 * rank + 1 FROM b) GROUP BY query, id)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY o, id) AS position FROM u"""


@query(_INTER)
def hybrid_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists of seeds taken in turn, each seed at its first place."""
    cols = ("query", "id", "rank")
    return R.interleave(vec_topk_batch(spark, d).select(*cols), vec_topk_within_label(spark, d).select(*cols), "query", "id", "rank")


@query(f"WITH i AS ({_INTER}) SELECT query, id, position FROM i WHERE position <= 8")
def seeds_topk_after_merge(spark: SparkSession, d: str) -> DataFrame:
    """The cut to k comes after the merge."""
    return hybrid_interleave(spark, d).where("position <= 8")


@query(f"WITH {ADJ}, {_SEEDS} SELECT s.name, s.rank, count(*) AS edges FROM seeds s JOIN adj a ON a.node = s.name GROUP BY s.name, s.rank")
def seed_filter_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the seeds only, keeping the seeds' ranks."""
    a = G.adjacency(V.edges(spark, d)).select(F.col("node").alias("name")).join(_seeds(spark, d), "name")  # sixty rows
    return a.groupBy("name", F.col("rank").cast("bigint").alias("rank")).agg(F.count(F.lit(1)).alias("edges"))


_STRUCT = f"""WITH {CHUNKS}, {MENTIONS}, {_SEEDS}, r AS (SELECT c.id, c.document, c.chunk_index, count(DISTINCT s.rank) AS seed_mentions, min(s.rank) AS best_seed_rank
FROM seeds s JOIN mentions m USING (name) JOIN chunks c ON c.id = m.chunk_id GROUP BY 1, 2, 3)"""


def _structural(spark: SparkSession, d: str) -> DataFrame:
    m = V.mentions(spark, d).join(_seeds(spark, d), "name")  # sixty rows
    by = m.groupBy("chunk_id").agg(F.count_distinct("rank").alias("seed_mentions"), F.min("rank").cast("bigint").alias("best_seed_rank"))
    return V.chunks(spark, d).join(by, F.expr("id = chunk_id")).select("id", "document", "chunk_index", "text", "seed_mentions", "best_seed_rank")


@query(_STRUCT + " SELECT id, seed_mentions, best_seed_rank FROM r")
def excerpt_structural(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that mention seeds, with how many and the best of them."""
    return _structural(spark, d).select("id", "seed_mentions", "best_seed_rank")


_ORDER = "seed_mentions DESC, best_seed_rank, document, chunk_index, id"


@query(_STRUCT + f" SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM r) WHERE rank <= 20")
def excerpt_structural_top(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best chunks by structure (a top list)."""
    order = [F.desc("seed_mentions"), "best_seed_rank", "document", "chunk_index", "id"]
    return G.top_k(_structural(spark, d).orderBy(*order).limit(20), [], order, 20).select("id", "rank")


_BUDGET = f"""{_STRUCT}, a AS (SELECT r.document, r.id, row_number() OVER (PARTITION BY r.document ORDER BY {_ORDER}) AS rank FROM r WHERE r.document IS NOT NULL),
b AS (SELECT document, id, row_number() OVER (PARTITION BY document ORDER BY chunk_index, id) AS rank FROM chunks WHERE document IS NOT NULL),
u AS (SELECT document, id, min(o) AS o FROM (SELECT document, id, 2 * rank AS o FROM a UNION ALL SELECT document, id, 2 * rank + 1 FROM b) GROUP BY 1, 2),
p AS (SELECT document, id, row_number() OVER (PARTITION BY document ORDER BY o, id) AS position FROM u),
f AS (SELECT p.*, CAST(sum(length(c.text) + 20) OVER (PARTITION BY p.document ORDER BY position) AS BIGINT) AS used FROM p JOIN chunks c USING (id))"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    docs = V.chunks(spark, d).where("document is not null")
    first = G.top_k(_structural(spark, d).where("document is not null").drop("text"), ["document"], [F.desc("seed_mentions"), "best_seed_rank", "document", "chunk_index", "id"], 1 << 30)
    second = G.top_k(docs.select("document", "id", "chunk_index"), ["document"], ["chunk_index", "id"], 1 << 30)
    order = R.interleave(first.select("document", "id", "rank"), second.select("document", "id", "rank"), "document", "id", "rank")
    sized = order.join(docs.select("id", (F.length("text") + 20).alias("size")), "id")
    return R.budgeted(sized, "document", "position", F.col("size"), 4000)


@query(_BUDGET + " SELECT document, id, position, used FROM f WHERE used <= 4000")
def excerpt_merge_budget(spark: SparkSession, d: str) -> DataFrame:
    """Per document: structural excerpts first, then those in reading order, as far as 4000 characters go."""
    return _merged(spark, d).select("document", "id", "position", "used")


@query(_BUDGET + ", k AS (SELECT document, count(*) AS shown FROM f WHERE used <= 4000 GROUP BY document), t AS (SELECT document, count(*) AS total FROM f GROUP BY document) SELECT document, shown, total - shown AS omitted FROM k JOIN t USING (document)")
def excerpt_omitted(spark: SparkSession, d: str) -> DataFrame:
    shown = _merged(spark, d).groupBy("document").agg(F.count(F.lit(1)).alias("shown"))
    total = V.chunks(spark, d).where("document is not null").groupBy("document").agg(F.count(F.lit(1)).alias("total"))
    return shown.join(total, "document").select("document", "shown", (F.col("total") - F.col("shown")).alias("omitted"))


@query(f"""WITH {ADJ}, {_SEEDS}, n AS (SELECT DISTINCT s.name AS seed, a.rel_type, a.other FROM seeds s JOIN adj a ON a.node = s.name)
SELECT seed, seed || ': ' || string_agg('-[' || rel_type || ']- ' || other, '; ' ORDER BY rel_type, other) AS block FROM n GROUP BY seed""")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """One line of context per seed: its neighbours by type and name. Sixty seeds bound the groups collected."""
    n = G.one_hop(load(spark, d, "seed_entity", "name"), V.edges(spark, d)).where("other is not null")
    g = n.groupBy("seed").agg(F.array_sort(F.collect_set(F.struct("rel_type", "other"))).alias("x"))
    return g.select("seed", F.concat("seed", F.lit(": "), F.array_join(F.transform("x", lambda r: F.concat(F.lit("-["), r["rel_type"], F.lit("]- "), r["other"])), "; ")).alias("block"))


@query(f"""WITH {EDGES}, l AS (SELECT DISTINCT document, source || ' -[' || rel_type || ']-> ' || target AS line FROM raw WHERE document IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY line) AS rn FROM l) SELECT document, string_agg(line, chr(10) ORDER BY line) AS lines FROM k WHERE rn <= 60 GROUP BY document""")
def community_prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    """At most sixty relationship lines of each community (documents stand for communities)."""
    line = F.concat("source", F.lit(" -["), "rel_type", F.lit("]-> "), "target").alias("line")
    k = G.top_k(V.raw_edges(spark, d).where("document is not null").select("document", line).distinct(), ["document"], ["line"], 60)
    return k.groupBy("document").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))


@query(f"WITH {CHUNKS} SELECT c.id, s.name FROM chunks c, seed_entity s WHERE length(s.name) >= 3 AND regexp_matches(c.text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(s.name) || '([^\\p{{L}}\\p{{N}}_]|$)')")
def name_pattern_match(spark: SparkSession, d: str) -> DataFrame:
    """Word-bounded occurrences of the seeds' names, whatever their case (sixty fixed patterns)."""
    s = load(spark, d, "seed_entity", "name").where("length(name) >= 3").withColumn("pattern", F.concat(F.lit(r"(?iU)(?<![\p{L}\p{N}_])"), F.regexp_replace("name", r"([^\p{L}\p{N} ])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}_])")))
    # the substring test is cheap and drops nearly all pairs before a pattern runs
    near = F.expr("contains(lower(text), lower(name))")
    return V.chunks(spark, d).select("id", "text").join(s, near).where(F.expr("text rlike pattern")).select("id", "name")


@query(f"WITH {NODES}, {MENTIONS}, {CHUNKS} SELECT DISTINCT m.name, m.chunk_id FROM mentions m WHERE m.name IN (SELECT name FROM nodes) AND m.chunk_id IN (SELECT id FROM chunks)")
def chunk_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mention sink: both ends must exist."""
    m = V.mentions(spark, d).join(V.nodes(spark, d).select("name"), "name", "left_semi")
    return m.join(load(spark, d, "chunk", "id").select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select("name", "chunk_id")


@query(f"WITH {NODES} SELECT name, coalesce(trim(description), '') = '' AS without FROM nodes")
def embed_nullable(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with blank descriptions keep their row and get no vector."""
    text = F.nullif(F.coalesce(F.trim("description"), F.lit("")), F.lit(""))
    n = V.nodes(spark, d).withColumn("t", text).withColumn("v", F.when(F.col("t").isNotNull(), hash_embedder(64)("t")))
    return n.select("name", F.col("v").isNull().alias("without"))


@query(f"WITH a AS ({RESOLVE_SQL['vec_topk_batch']}), b AS ({RESOLVE_SQL['vec_topk_within_label']}) SELECT query, count(*) AS shared FROM (SELECT query, id FROM a WHERE rank <= 4) x JOIN (SELECT query, id FROM b) y USING (query, id) GROUP BY query")
def excerpt_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = vec_topk_batch(spark, d).where("rank <= 4").select("query", "id")
    return a.join(vec_topk_within_label(spark, d).select("query", "id"), ["query", "id"]).groupBy("query").agg(F.count(F.lit(1)).alias("shared"))


@query(f"WITH a AS ({RESOLVE_SQL['vec_topk_batch']}) SELECT query, string_agg('v' || id, ' ' ORDER BY rank) AS context FROM a WHERE rank <= 4 GROUP BY query")
def rag_passage_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The four best passages of each query in order, as one context."""
    a = vec_topk_batch(spark, d).where("rank <= 4").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    return a.select("query", F.array_join(F.transform("x", lambda r: F.concat(F.lit("v"), r["id"].cast("string"))), " ").alias("context"))


@query(f"WITH {CHUNKS}, m AS (SELECT DISTINCT chunk_id FROM mention) SELECT id, toggle, toggle AND id IN (SELECT chunk_id FROM m WHERE chunk_id IS NOT NULL) AS shown FROM chunks, (VALUES (true), (false)) t(toggle)")
def retrieval_toggle(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval with the excerpt channel on and off."""
    m = load(spark, d, "mention", "chunk_id").where("chunk_id is not null").distinct().select(F.col("chunk_id").alias("id"), F.lit(True).alias("hit"))
    c = V.chunks(spark, d).select("id").join(m, "id", "left").select("id", F.explode(F.array(F.lit(True), F.lit(False))).alias("toggle"), F.coalesce("hit", F.lit(False)).alias("hit"))
    return c.select("id", "toggle", (F.col("toggle") & F.col("hit")).alias("shown"))


@query()
def local_search_e2e(spark: SparkSession, d: str) -> DataFrame:
    """For every seed taken as a question: keyword seeds, their neighbours, and the best excerpts of their chunks."""
    q = load(spark, d, "seed_entity", "name", "description").select(F.col("name").alias("question"), keyword_terms(F.col("description")).alias("terms"))
    docs = V.nodes(spark, d).select("name", F.split(F.lower(F.concat_ws(" ", "name", "description")), r"(?U)[^\p{L}\p{N}]+").alias("tokens"))
    hits = R.bm25(docs, "name", "tokens", q, "question", "terms", 8).select("query", F.col("doc").alias("name"), "rank")
    around = hits.join(G.adjacency(V.edges(spark, d)), F.expr("name = node")).groupBy("query").agg(F.count_distinct("other").alias("neighbours"))
    ev = V.mentions(spark, d).join(hits, "name").groupBy("query", "chunk_id").agg(F.count_distinct("rank").alias("n"), F.min("rank").alias("best"))
    top = G.top_k(ev, ["query"], [F.desc("n"), "best", "chunk_id"], 4)
    ex = top.join(V.chunks(spark, d), F.expr("chunk_id = id")).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", snippet(F.col("text")).alias("text")))).alias("excerpts"))
    seeds = hits.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), "|").alias("seeds"))
    return seeds.join(around, "query", "left").join(ex, "query", "left").select("query", "seeds", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.transform("excerpts", lambda x: x["text"]).alias("excerpts"))
