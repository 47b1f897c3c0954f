"""Queries on texts: chunks, keys, keyword queries, routing, stems, snippets, tolerant JSON, costs by length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.json import tolerant_extraction
from weftgraph.functions.pyfuncs import chunker
from weftgraph.functions.routing import CUE_WORDS, ROUTE_SQL, is_broad, is_global
from weftgraph.functions.vectors import hash_embedder
from weftgraph.plans.graph import CHUNKS
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


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CUT = " , ".join(f"CASE WHEN strpos(reverse(substr(text, s + 1, 1000)), reverse({b})) > 0 THEN s + 1001 - strpos(reverse(substr(text, s + 1, 1000)), reverse({b})) ELSE 0 END" for b in ("'. '", "'? '", "'! '", "chr(10)"))
_STRIP = "regexp_replace({}, '^[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{85}}\\x{{1c}}-\\x{{1f}}\\x0b]+|[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{85}}\\x{{1c}}-\\x{{1f}}\\x0b]+$', '', 'g')"
_SPANS = f"""WITH RECURSIVE w AS (
  SELECT doc_id, text, length(text) AS n, CAST(0 AS BIGINT) AS s, CASE WHEN length(text) <= 1000 THEN length(text) ELSE (SELECT CASE WHEN m > 0 THEN m ELSE 1000 END FROM (SELECT greatest({_CUT.replace('s + 1001', '1001').replace('s + 1,', '1,')}) AS m)) END AS e
  FROM documents WHERE {_STRIP.format('text')} <> ''
  UNION ALL
  SELECT doc_id, text, n, s, CASE WHEN s + 1000 >= n THEN n ELSE CASE WHEN m > 0 THEN m ELSE s + 1000 END END AS e FROM (
    SELECT doc_id, text, n, s, greatest({_CUT}) AS m FROM (SELECT doc_id, text, n, CASE WHEN e - 200 > s THEN e - 200 ELSE s + 1 END AS s FROM w WHERE e < n))),
c AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, s, e, {_STRIP.format('substr(text, s + 1, e - s)')} AS chunk FROM w WHERE {_STRIP.format('substr(text, s + 1, e - s)')} <> '')"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", "doc_id", "file_name", "text")
    c = docs.select("doc_id", "file_name", F.explode(chunker()("text")).alias("c"))
    return c.select("doc_id", "file_name", F.col("c.index").alias("chunk_index"), F.col("c.start").alias("start_at"), F.col("c.end").alias("end_at"), F.col("c.text").alias("text"))


@query(_SPANS + " SELECT doc_id, chunk_index, CAST(s AS INTEGER) AS start_at, CAST(e AS INTEGER) AS end_at, length(chunk) AS n_chars FROM c")
def chunk_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of every document, cut at ends of sentences and lines."""
    return _chunks(spark, d).select("doc_id", "chunk_index", "start_at", "end_at", F.length("text").cast("bigint").alias("n_chars"))


@query(_SPANS + ", k AS (SELECT c.*, file_name FROM c JOIN documents USING (doc_id)) SELECT doc_id, chunk_index, substr(sha256(file_name || chr(31) || chunk_index || chr(31) || chunk), 1, 32) AS id FROM k WHERE chunk_index < 40")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content ids of the first forty chunks of every document (the store's own limit per document)."""
    c = _chunks(spark, d).where("chunk_index < 40")
    return c.select("doc_id", "chunk_index", T.chunk_id(F.col("file_name"), F.col("chunk_index"), F.col("text")).alias("id"))


@query(f"WITH {CHUNKS} SELECT id, chunk_no, coalesce(document, '') AS document FROM chunks")
def chunk_idempotent_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunk sink: writing the same content again changes nothing."""
    return V.chunks(spark, d).select("id", "chunk_no", F.coalesce("document", F.lit("")).alias("document"))


@query("SELECT file_name, lower(file_name) LIKE '%.pdf' AND trim(text) <> '' AS accepted FROM documents")
def doc_upload_guard(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", "file_name", "text")
    return docs.select("file_name", (F.lower("file_name").endswith(".pdf") & (F.trim("text") != "")).alias("accepted"))


@query("""WITH m AS (SELECT lower(trim(text)) AS key, doc_id, lang FROM documents WHERE trim(text) <> '')
SELECT md5(key) AS key, arg_max(doc_id, doc_id) AS doc_id, min(doc_id) AS first_id, count(*) AS copies FROM m GROUP BY key""")
def doc_dedupe_lastwins(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "documents", "doc_id", "text").where("trim(text) <> ''").select(F.md5(F.lower(F.trim("text"))).alias("key"), "doc_id")
    return m.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


_TERMS = f"""list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower({{}}), '[+\\-!(){{{{}}}}\\[\\]^"~*?:\\\\/]|&&|\\|\\|', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ({_in(T.KEYWORD_STOPWORDS)})))"""


@query(f"SELECT entity_id, array_to_string(list_sort({_TERMS.format('description')}), ' OR ') AS terms FROM (SELECT DISTINCT entity_id, description FROM entity WHERE description IS NOT NULL)")
def kw_query(spark: SparkSession, d: str) -> DataFrame:
    """Keyword query of every description; terms sorted for comparison."""
    e = load(spark, d, "entity", "entity_id", "description").where("description is not null").distinct()
    return e.select("entity_id", F.array_join(F.array_sort(T.keyword_terms(F.col("description"))), " OR ").alias("terms"))


@query(f"SELECT doc_id, CASE WHEN {ROUTE_SQL} THEN 'global' ELSE 'local' END AS route FROM documents")
def route_query(spark: SparkSession, d: str) -> DataFrame:
    """Route of every document's text taken as a question."""
    docs = load(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.when(is_global(F.col("text")), "global").otherwise("local").alias("route"))


@query(f"SELECT doc_id, len(list_filter({_TERMS.format('text')}, lambda w: w NOT IN ({_in(CUE_WORDS)}))) = 0 AS broad FROM documents")
def route_cues(spark: SparkSession, d: str) -> DataFrame:
    """Questions with nothing specific left beside cue words."""
    docs = load(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", is_broad(F.col("text")).alias("broad"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN regexp_replace(substr(text, 1, 399), '[\\s\\x{a0}]+$', '') || '…' ELSE text END AS snippet FROM documents")
def excerpt_snippet(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def _stem_sql(w: str) -> str:
    c = f"CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN substr({w}, 1, length({w}) - 3) || 'y'"
    for s in T.STEM_SUFFIXES:
        c += f" WHEN {w} LIKE '%{s}' AND length({w}) > {len(s) + 2} THEN substr({w}, 1, length({w}) - {len(s)})"
    return c + f" ELSE {w} END"


_STEMS = f"""WITH q AS (SELECT DISTINCT entity_id, lower(description) AS t FROM entity WHERE description IS NOT NULL),
w AS (SELECT DISTINCT entity_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS w FROM q), k AS (SELECT * FROM w WHERE length(w) >= 3 AND w NOT IN ({_in(T.CONTENT_STOPWORDS)})),
s1 AS (SELECT entity_id, {_stem_sql('w')} AS w FROM k), s2 AS (SELECT entity_id, CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM s1),
s3 AS (SELECT DISTINCT entity_id, CASE WHEN w LIKE '%e' AND length(w) > 4 THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM s2)"""


@query(_STEMS + " SELECT entity_id, string_agg(w, ' ' ORDER BY w) AS words FROM s3 GROUP BY entity_id")
def lex_content_words(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "entity", "entity_id", "description").where("description is not null").distinct()
    return e.select("entity_id", T.content_words(F.col("description")).alias("w")).where("size(w) > 0").select("entity_id", F.array_join("w", " ").alias("words"))


@query("""WITH g AS (SELECT type_id, unnest(regexp_extract_all(lower(gloss), '[a-z0-9]+')) AS a FROM type_ref), s AS (SELECT DISTINCT name, unnest(regexp_extract_all(lower(description), '[a-z0-9]+')) AS b FROM seed_entity)
SELECT DISTINCT type_id, name FROM g, s WHERE a = b OR (length(a) >= 4 AND substr(a, 1, 4) = substr(b, 1, 4))""")
def lex_stem_family(spark: SparkSession, d: str) -> DataFrame:
    """Seed entities whose description shares a word family with a type's gloss: equal words or a common beginning of four."""
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)))
    g = load(spark, d, "type_ref", "type_id", "gloss").select("type_id", words("gloss").alias("a"))
    s = load(spark, d, "seed_entity", "name", "description").select("name", words("description").alias("b"))
    family = lambda c: F.when(F.length(c) >= 4, F.substring(c, 1, 4)).otherwise(F.col(c))
    return g.withColumn("k", family("a")).join(s.withColumn("k", family("b")), "k").where(T.same_family(F.col("a"), F.col("b"))).select("type_id", "name").distinct()


_JOB = """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events"""


@query(_JOB)
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "props")
    return e.select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1).cast("bigint")).alias("k"))


@query("""WITH r AS (SELECT * FROM (VALUES (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 0), (5, 0, 0), (6, 0, 0), (7, 1, 0)) t(reply, entities, relationships)) SELECT * FROM r""")
def json_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a language model: plain, fenced, within prose, garbage, empty, no object, without relationships."""
    body = '{"entities": [{"name": "A", "type": "X", "description": ""}], "relationships": [{"source": "A", "target": "B", "type": "R", "description": ""}]}'
    rows = [(1, body), (2, f"```json\n{body}\n```"), (3, f"Here it is: {body} Done."), (4, "no json at all"), (5, ""), (6, "[1, 2]"), (7, '{"entities": [{"name": "A"}]}')]
    df = spark.createDataFrame(rows, "reply int, text string").withColumn("x", tolerant_extraction(F.col("text")))
    return df.select("reply", F.size("x.entities").alias("entities"), F.size("x.relationships").alias("relationships"))


@query("""SELECT document, count(*) AS extracted, CAST(sum(CASE WHEN description IS NULL OR trim(description) = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM entity WHERE document IS NOT NULL GROUP BY document""")
def extract_failure_isolation(spark: SparkSession, d: str) -> DataFrame:
    """An extraction without a description counts as empty and does not stop its document."""
    e = load(spark, d, "entity", "document", "description").where("document is not null")
    return e.groupBy("document").agg(F.count(F.lit(1)).alias("extracted"), F.sum(F.when(F.coalesce(F.trim("description"), F.lit("")) == "", 1).otherwise(0)).alias("empty"))


@query("SELECT entity_id, regexp_replace(regexp_replace(coalesce(name, '') || ' — ' || coalesce(description, ''), '^[ —]+', ''), '[ —]+$', '') AS txt FROM (SELECT DISTINCT entity_id, name, description FROM entity)")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "entity", "entity_id", "name", "description").distinct()
    return e.select("entity_id", T.embed_text(F.col("name"), F.col("description")).alias("txt"))


@query("""WITH t AS (SELECT name, unnest(regexp_split_to_array(lower(description), ' +')) AS w FROM seed_entity), h AS (SELECT name, md5(w) AS h FROM t WHERE w <> ''),
n AS (SELECT name, ('0x' || substr(h, 17, 16))::UBIGINT % 64 AS d, (('0x' || substr(h, 1, 16))::UBIGINT % 7 * 2 + ('0x' || substr(h, 17, 16))::UBIGINT % 7) % 7 AS r FROM h),
v AS (SELECT name, d, sum(1 + r / 7.0) AS x FROM n GROUP BY name, d) SELECT name, CAST(d AS INTEGER) AS dim, round(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY name)) AS DOUBLE), 6) AS value FROM v""")
def vec_hash_embed_norm(spark: SparkSession, d: str) -> DataFrame:
    """Hash embedding of the seed descriptions, as its non-zero components."""
    s = load(spark, d, "seed_entity", "name", "description").select("name", F.posexplode(hash_embedder(64)("description")).alias("dim", "x"))
    return s.where("x <> 0").select("name", "dim", F.round("x", 6).alias("value"))


@query("SELECT source, count(*) AS calls, CAST(sum(CAST(ceil((n_chars + 600) / 4.0) AS BIGINT)) AS BIGINT) AS prompt, CAST(count(*) * 400 AS BIGINT) AS completion FROM documents GROUP BY source")
def cost_estimate_batch(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of one call per document: a quarter of its characters and of 600 more, and 400 of an answer."""
    docs = load(spark, d, "documents", "source", "n_chars")
    tokens = F.ceil((F.greatest("n_chars", F.lit(0)) + 600) / F.lit(4.0)).cast("bigint")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("prompt"), (F.count(F.lit(1)) * 400).alias("completion"))


_PRICES = "(VALUES ('alpha', 2.0), ('alpha-mini', 0.5), ('beta', 1.0)) p(model, usd)"
_MODELS = "(VALUES ('alpha-2024'), ('alpha-mini-3'), ('beta'), ('gamma')) m(name)"


@query(f"""WITH p AS (SELECT * FROM {_PRICES}), m AS (SELECT * FROM {_MODELS}) SELECT name, max_by(usd, length(model)) AS usd FROM m LEFT JOIN p ON starts_with(name, model) GROUP BY name""")
def cost_price_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Price of a model: the longest key its name begins with; none is unpriced."""
    p, m = spark.sql(f"SELECT model, CAST(usd AS DOUBLE) usd FROM {_PRICES.replace(' p(', ' AS p(')}"), spark.sql(f"SELECT * FROM {_MODELS.replace(' m(', ' AS m(')}")
    return m.join(p, F.expr("startswith(name, model)"), "left").groupBy("name").agg(F.max_by("usd", F.length("model")).alias("usd"))  # a price list


@query("""WITH l AS (SELECT coalesce(theme, 'none') AS ledger, sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) AS tokens, CASE WHEN theme IS NULL THEN NULL ELSE round(sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) * 2.0 / 1000000, 6) END AS usd FROM documents GROUP BY theme)
SELECT ledger, CAST(tokens AS BIGINT) AS tokens, usd FROM l""")
def cost_ledger(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", "theme", "n_chars")
    by = docs.groupBy("theme").agg(F.sum(F.ceil(F.col("n_chars") / F.lit(4.0)).cast("bigint")).alias("tokens"))
    usd = F.when(F.col("theme").isNotNull(), F.round(F.col("tokens") * 2.0 / 1000000, 6))
    return by.select(F.coalesce("theme", F.lit("none")).alias("ledger"), "tokens", usd.alias("usd"))


@query(f"""WITH l AS ({SQL['cost_ledger']}) SELECT CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN count(*) = count(usd) THEN round(sum(usd), 6) END AS usd FROM l""")
def cost_total(spark: SparkSession, d: str) -> DataFrame:
    """Total of the ledgers: without a price if any ledger has none."""
    return cost_ledger(spark, d).agg(F.sum("tokens").alias("tokens"), F.when(F.count(F.lit(1)) == F.count("usd"), F.round(F.sum("usd"), 6)).alias("usd"))


@query("""WITH m AS (SELECT coalesce(lang, '-') AS lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most, count(DISTINCT source) AS sources FROM documents GROUP BY 1) SELECT * FROM m""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", "lang", "n_chars", "source")
    return docs.groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_distinct("source").alias("sources"))


@query("SELECT doc_id FROM documents ORDER BY md5('20260721|' || doc_id), doc_id LIMIT 20")
def sample_prefix_stable(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of twenty: a smaller sample is its beginning."""
    docs = load(spark, d, "documents", "doc_id")
    return docs.orderBy(F.md5(F.concat(F.lit("20260721|"), F.col("doc_id").cast("string"))), "doc_id").limit(20)
