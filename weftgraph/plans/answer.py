"""Answering questions: routing, hybrid entry by keywords with the degree fallback, numbered excerpts, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.routing import CUE_WORDS, ROUTE_SQL, is_broad, is_global
from weftgraph.operators import graph as G
from weftgraph.operators import rank as R
from weftgraph.plans.graph import _COM, CHUNKS, MENTIONS, NODES, _communities
from weftgraph.plans.text import _TERMS, _in
from weftgraph.runtime import cut
from weftgraph.sources import graphview as V
from weftgraph.sources.tables import load

QUERIES, SQL = {}, {}
#: Entities and excerpts of a local answer, communities and members of a global one.
SEEDS, EXCERPTS, COMMUNITIES, MEMBERS = 8, 4, 5, 12


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_BROAD = f"len(list_filter({_TERMS.format('text')}, lambda w: w NOT IN ({_in(CUE_WORDS)}))) = 0"
_QUESTIONS = f"""qs AS (SELECT name || ':local' AS question, description AS text FROM seed_entity UNION ALL SELECT name || ':global', 'Summarize everything about ' || description FROM seed_entity
 UNION ALL SELECT * FROM (VALUES ('all', 'Give an overview of the main themes'), ('none:local', 'xyzzyq'), ('none:global', 'Summarize xyzzyq')) v(a, b)),
qr AS (SELECT question, text, CASE WHEN {ROUTE_SQL} THEN CASE WHEN {_BROAD} THEN 'broad' ELSE 'focused' END ELSE 'local' END AS mode FROM qs)"""
_HITS = """tok AS (SELECT name, regexp_extract_all(lower(concat_ws(' ', name, description)), '[a-z0-9]+') AS tok FROM nodes), sized AS (SELECT name, len(tok) AS dl, tok FROM tok WHERE len(tok) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM sized), ask AS (SELECT DISTINCT question, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM qr),
p AS (SELECT term, name, dl, count(*) AS tf FROM (SELECT name, dl, unnest(tok) AS term FROM sized) WHERE term IN (SELECT term FROM ask) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
h AS (SELECT question, name, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM ask JOIN p USING (term) JOIN df USING (term), st GROUP BY question, name),
kw AS (SELECT question, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, name) AS rank FROM h) WHERE rank <= 8),
fb AS (SELECT n AS name, row_number() OVER (ORDER BY degree DESC, n) AS rank FROM dg JOIN nodes ON nodes.name = dg.n QUALIFY rank <= 8),
hits AS (SELECT question, name, rank FROM kw UNION ALL SELECT question, name, rank FROM qr, fb WHERE mode = 'local' AND question NOT IN (SELECT question FROM kw))"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Two questions on every seed, local and about the whole corpus; one broad question; two that nothing matches."""
    s = load(spark, d, "seed_entity", "name", "description")
    two = s.select(F.concat("name", F.lit(":local")).alias("question"), F.col("description").alias("text")).unionByName(s.select(F.concat("name", F.lit(":global")).alias("question"), F.concat(F.lit("Summarize everything about "), "description").alias("text")))
    more = spark.createDataFrame([("all", "Give an overview of the main themes"), ("none:local", "xyzzyq"), ("none:global", "Summarize xyzzyq")], "question string, text string")
    q = two.unionByName(more)
    return q.withColumn("mode", F.when(~is_global(F.col("text")), "local").when(is_broad(F.col("text")), "broad").otherwise("focused"))


def _hits(spark: SparkSession, d: str, questions: DataFrame) -> DataFrame:
    """``question``, ``name``, ``rank``: the best entities by keywords; those of highest degree for a local question without any."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    nodes = V.nodes(spark, d).select("name", "description")
    docs = nodes.select("name", words(F.concat_ws(" ", "name", "description")).alias("tokens"))
    kw = R.bm25(docs, "name", "tokens", questions.select("question", F.array_distinct(words("text")).alias("terms")), "question", "terms", SEEDS)
    kw = cut(kw.select(F.col("query").alias("question"), F.col("doc").alias("name"), "rank"))
    nb = G.adjacency(V.edges(spark, d)).select("node", "other").distinct()
    degree = nb.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).join(nodes.select(F.col("name").alias("node")), "node")
    order = [F.desc("degree"), "node"]
    top = G.top_k(degree.orderBy(*order).limit(SEEDS), [], order, SEEDS).select(F.col("node").alias("name"), "rank")
    without = questions.where("mode = 'local'").join(kw.select("question").distinct(), "question", "left_anti")
    return kw.unionByName(without.select("question").crossJoin(top))  # eight rows


@query(f"WITH {_COM}, {_QUESTIONS}, {_HITS} SELECT question, mode, name, rank FROM hits JOIN qr USING (question)")
def question_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Entities that every question starts from, with the question's route."""
    q = _questions(spark, d)
    return _hits(spark, d, q).join(q.select("question", "mode"), "question").select("question", "mode", "name", "rank")


_EXCERPTS = f"""ev AS (SELECT question, c.id, c.document, c.chunk_index, c.text, count(DISTINCT rank) AS n, min(rank) AS best FROM hits JOIN qr USING (question) JOIN mentions m USING (name) JOIN chunks c ON c.id = m.chunk_id WHERE mode = 'local' GROUP BY ALL),
ex AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, best, document, chunk_index, id) AS s FROM ev QUALIFY s <= {EXCERPTS}),
tot AS (SELECT question, count(*) AS found FROM ev GROUP BY question),
blocks AS (SELECT question, string_agg('[S' || s || '] ' || coalesce(document, '') || ' (chunk ' || coalesce(CAST(chunk_index AS VARCHAR), '') || ')' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY s)
 || CASE WHEN any_value(found) > {EXCERPTS} THEN chr(10) || chr(10) || '(' || (any_value(found) - {EXCERPTS}) || ' further excerpts omitted)' ELSE '' END AS context FROM ex JOIN tot USING (question) GROUP BY question)"""
_TALKS = f"""cm AS (SELECT community, size, members, unnest(members) AS name FROM com), hc AS (SELECT question, community, count(*) AS n FROM hits JOIN qr USING (question) JOIN cm USING (name) WHERE mode = 'focused' GROUP BY 1, 2),
big AS (SELECT community, size, members, row_number() OVER (ORDER BY size DESC, community) AS rank FROM com QUALIFY rank <= {COMMUNITIES}),
foc AS (SELECT question, community, size, members, row_number() OVER (PARTITION BY question ORDER BY n DESC, size DESC, community) AS rank FROM hc JOIN com USING (community) QUALIFY rank <= {COMMUNITIES}),
talk AS (SELECT question, community, members, rank FROM foc UNION ALL SELECT question, community, members, rank FROM qr, big WHERE mode <> 'local' AND question NOT IN (SELECT question FROM foc)),
sums AS (SELECT question, string_agg(community || ': ' || array_to_string(members[1:{MEMBERS}], ', '), chr(10) ORDER BY rank) AS context FROM talk GROUP BY question)"""


def _numbered(hits: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``question``, ``context``: the best chunks that mention the entities, as ``[Sn] document (chunk i)`` and the text,
    with a note on how many more there are."""
    ev = mentions.join(hits, "name").groupBy("question", "chunk_id").agg(F.count_distinct("rank").alias("n"), F.min("rank").alias("best"))
    ev = cut(ev.join(chunks.select("id", "document", "chunk_index"), F.expr("chunk_id = id")).drop("chunk_id"))
    found = ev.groupBy("question").agg(F.count(F.lit(1)).alias("found"))
    top = G.top_k(ev, ["question"], [F.desc("n"), "best", F.asc_nulls_last("document"), "chunk_index", "id"], EXCERPTS, "s")
    head = F.concat(F.lit("[S"), F.col("s").cast("string"), F.lit("] "), F.coalesce("document", F.lit("")), F.lit(" (chunk "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("")), F.lit(")\n"), F.coalesce("text", F.lit("")))
    lines = top.join(chunks.select("id", "text"), "id").select("question", F.struct("s", head.alias("block")).alias("b"))
    whole = lines.groupBy("question").agg(F.array_sort(F.collect_list("b")).alias("bs")).join(found, "question")  # EXCERPTS a question
    note = F.when(F.col("found") > EXCERPTS, F.concat(F.lit("\n\n("), (F.col("found") - EXCERPTS).cast("string"), F.lit(" further excerpts omitted)"))).otherwise("")
    return whole.select("question", F.concat(F.array_join(F.transform("bs", lambda b: b["block"]), "\n\n"), note).alias("context"))


@query(f"WITH {_COM}, {CHUNKS}, {MENTIONS}, {_QUESTIONS}, {_HITS}, {_EXCERPTS} SELECT question, context FROM blocks")
def question_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Numbered excerpts of every local question."""
    q = _questions(spark, d)
    local = _hits(spark, d, q).join(q.where("mode = 'local'").select("question"), "question", "left_semi")
    return _numbered(local, V.mentions(spark, d), V.chunks(spark, d))


def _summaries(hits: DataFrame, questions: DataFrame, com: DataFrame) -> DataFrame:
    """``question``, ``context``: the communities with most of a focused question's entities; the largest for a broad one
    and where there are none."""
    of = com.select("community", "size", F.explode("members").alias("name"))
    focused = hits.join(questions.where("mode = 'focused'").select("question"), "question", "left_semi")
    count = of.join(focused, "name").groupBy("question", "community", "size").agg(F.count(F.lit(1)).alias("n"))
    near = cut(G.top_k(count, ["question"], [F.desc("n"), F.desc("size"), "community"], COMMUNITIES).select("question", "community", "rank"))
    order = [F.desc("size"), "community"]
    big = G.top_k(com.select("community", "size").orderBy(*order).limit(COMMUNITIES), [], order, COMMUNITIES).select("community", "rank")
    rest = questions.where("mode <> 'local'").join(near.select("question").distinct(), "question", "left_anti").select("question").crossJoin(big)  # five rows
    line = F.concat("community", F.lit(": "), F.array_join(F.slice("members", 1, MEMBERS), ", "))
    talk = near.unionByName(rest).join(com, "community").groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("ls"))
    return talk.select("question", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("context"))


@query(f"WITH {_COM}, {CHUNKS}, {MENTIONS}, {_QUESTIONS}, {_HITS}, {_EXCERPTS}, {_TALKS} SELECT question, mode, coalesce(b.context, s.context, '') AS context FROM qr LEFT JOIN blocks b USING (question) LEFT JOIN sums s USING (question)")
def retrieve_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question entry: every question is routed and gets its context, excerpts if local and communities if not."""
    q = cut(_questions(spark, d))
    hits = cut(_hits(spark, d, q))
    local = hits.join(q.where("mode = 'local'").select("question"), "question", "left_semi")
    parts = _numbered(local, V.mentions(spark, d), V.chunks(spark, d)).unionByName(_summaries(hits, q, cut(_communities(spark, d))))
    return q.join(parts, "question", "left").select("question", "mode", F.coalesce("context", F.lit("")).alias("context"))


@query(f"WITH {NODES} SELECT coalesce(trim(e.name), '') AS raw, CASE WHEN trim(e.name) <> '' THEN trim(e.name) WHEN trim(e.type) <> '' THEN trim(e.type) ELSE 'Unknown' END AS label, count(*) AS records FROM entity e GROUP BY 1, 2")
def graph_labels(spark: SparkSession, d: str) -> DataFrame:
    """What a node is called: its name, else its first label (type), else a fixed word."""
    e = load(spark, d, "entity", "name", "type")
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return e.groupBy(F.coalesce(F.trim("name"), F.lit("")).alias("raw"), F.coalesce(full("name"), full("type"), F.lit(V.NO_LABEL)).alias("label")).agg(F.count(F.lit(1)).alias("records"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def normalize_space(spark: SparkSession, d: str) -> DataFrame:
    """Runs of white space as one blank."""
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\n\f\r]+", " ")).alias("text"))


@query(f"WITH {CHUNKS} SELECT id, coalesce(document, '') || chr(10) || text AS paragraph FROM chunks")
def paragraph_text(spark: SparkSession, d: str) -> DataFrame:
    """A paragraph of the pooled corpus: its title, then its body on the next line."""
    return V.chunks(spark, d).select("id", F.concat(F.coalesce("document", F.lit("")), F.lit("\n"), "text").alias("paragraph"))


@query("""WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE user_id IS NOT NULL)
SELECT event_id, CAST(least(100, floor(100 * done / total)) AS BIGINT) AS percent FROM n""")
def job_percent(spark: SparkSession, d: str) -> DataFrame:
    """Progress of each job in whole percent; it never goes back and ends at 100."""
    from weftgraph.streaming import jobs as J

    e = load(spark, d, "events", "event_id", "ts", "user_id")
    done = J.progress(e, "user_id", "ts", "event_id")
    total = e.where("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return done.join(total, "user_id").select("event_id", F.least(F.lit(100), F.floor(100 * F.col("processed") / F.col("total"))).cast("bigint").alias("percent"))
