"""Queries of evaluation: ranking metrics, fact recall, channels, sweeps, verdicts, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.vectors import search_all
from weftgraph.plans.graph import EDGES
from weftgraph.sources import graphview as V
from weftgraph.sources.tables import load

QUERIES, SQL = {}, {}
#: Cut-offs of a sweep.
SWEEP = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_R = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), lab AS (SELECT label, count(*) - 1 AS total FROM e GROUP BY label),
s AS (SELECT a.vec_id AS query, a.label AS ql, b.vec_id AS id, CAST(a.label = b.label AS INTEGER) AS rel, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s),
ks AS (SELECT unnest([1,2,3,4,5,6,8,10,12,16,20,24,32,48,64]) AS k),
m AS (SELECT query, any_value(ql) AS label, any_value(total) AS total, max(CASE WHEN rank = 1 THEN rel ELSE 0 END) AS hit1, sum(CASE WHEN rank <= 8 THEN rel ELSE 0 END) AS rel8, min(CASE WHEN rel = 1 AND rank <= 64 THEN rank END) AS first
 FROM r JOIN lab ON lab.label = r.ql GROUP BY query),
sw AS (SELECT query, any_value(ql) AS label, k, sum(rel) / any_value(total) AS recall FROM r JOIN lab ON lab.label = r.ql, ks WHERE rank <= k GROUP BY query, k)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """The 64 nearest of each stated query with their relevance: the same label."""
    e = load(spark, d, "embeddings", "vec_id", "embedding", "label")
    near = search_all(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 64, 64)
    total = e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("total"))
    lab = e.select("vec_id", "label")
    r = near.join(lab.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(lab.select(F.col("vec_id").alias("id"), F.col("label").alias("il")), "id")
    return r.join(total.withColumnRenamed("label", "ql"), "ql").select("query", F.col("ql").alias("label"), "rank", (F.col("ql") == F.col("il")).cast("int").alias("rel"), "total")


@query(_R + " SELECT round(avg(hit1), 6) AS hit_at_1, round(avg(rel8 / total), 6) AS recall_at_8, round(avg(rel8 / 8), 6) AS precision_at_8, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr, count(*) AS queries FROM m")
def score_hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    per = _ranked(spark, d).groupBy("query", "total").agg(F.max(F.when(F.col("rank") == 1, F.col("rel")).otherwise(0)).alias("hit1"), F.sum(F.when(F.col("rank") <= 8, F.col("rel")).otherwise(0)).alias("rel8"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    avg = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return per.agg(avg("hit1", "hit_at_1"), avg(F.col("rel8") / F.col("total"), "recall_at_8"), avg(F.col("rel8") / 8, "precision_at_8"), avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "mrr"), F.count(F.lit(1)).alias("queries"))


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).withColumn("k", F.explode(F.array(*[F.lit(k) for k in SWEEP]))).where("rank <= k")
    return r.groupBy("query", "label", "total", "k").agg((F.sum("rel") / F.col("total")).alias("recall"))


@query(_R + " SELECT k, round(avg(recall), 6) AS recall FROM sw GROUP BY k")
def score_k_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d).groupBy("k").agg(F.round(F.avg("recall"), 6).alias("recall"))


@query(_R + ", c AS (SELECT k, round(avg(recall), 6) AS recall FROM sw GROUP BY k), t AS (SELECT max(CASE WHEN k = 8 THEN recall END) AS at8 FROM c) SELECT min(k) FILTER (WHERE recall >= 2 * at8 - 1e-9) AS least_k, max(at8) AS target FROM c, t")
def score_budget_match(spark: SparkSession, d: str) -> DataFrame:
    """The smallest cut-off that reaches twice the recall at 8."""
    c = score_k_sweep(spark, d)
    t = c.agg(F.max(F.when(F.col("k") == 8, F.col("recall"))).alias("at8"))
    return c.crossJoin(t).agg(F.min(F.when(F.expr("recall >= 2 * at8 - 1e-9"), F.col("k"))).alias("least_k"), F.max("at8").alias("target"))  # one row


@query(_R + ", c AS (SELECT k, round(avg(recall), 6) AS recall FROM sw GROUP BY k) SELECT CASE WHEN count(*) FILTER (WHERE recall >= 0.5) = 0 THEN 'won' WHEN min(k) FILTER (WHERE recall >= 0.5) / 64.0 >= 1 THEN 'won' ELSE 'lost' END AS headline, round(min(k) FILTER (WHERE recall >= 0.5) / 64.0, 6) AS share FROM c")
def score_headline(spark: SparkSession, d: str) -> DataFrame:
    """Lost if some cut-off reaches half the relevant within less than the whole context, else won."""
    k = F.min(F.when(F.col("recall") >= 0.5, F.col("k")))
    return score_k_sweep(spark, d).agg(k.alias("k")).select(F.when(F.col("k").isNull() | (F.col("k") / 64.0 >= 1), "won").otherwise("lost").alias("headline"), F.round(F.col("k") / 64.0, 6).alias("share"))


_VERDICT = "CASE WHEN abs(diff) < 1e-9 THEN 'TIE' WHEN abs(diff) < floor - 1e-9 THEN 'TOO CLOSE' WHEN diff > 0 THEN 'B ahead' ELSE 'A ahead' END"


@query(_R + f", p AS (SELECT label, count(DISTINCT query) AS n, avg(recall) FILTER (WHERE k = 4) AS a, avg(recall) FILTER (WHERE k = 16) AS b FROM sw GROUP BY label), f AS (SELECT *, b - a AS diff, CASE WHEN n >= 2 THEN 1.0 / n ELSE 0 END AS floor FROM p) SELECT label, n, round(diff, 6) AS diff, {_VERDICT} AS verdict, n < 5 AS underpowered FROM f")
def score_type_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Two systems (cut-offs 4 and 16) compared per label, each with its own floor of 1/n."""
    p = _sweep(spark, d).groupBy("label").agg(F.count_distinct("query").alias("n"), F.avg(F.when(F.col("k") == 4, F.col("recall"))).alias("a"), F.avg(F.when(F.col("k") == 16, F.col("recall"))).alias("b"))
    f = p.withColumn("diff", F.col("b") - F.col("a")).withColumn("floor", F.when(F.col("n") >= 2, 1.0 / F.col("n")).otherwise(0.0))
    return f.select("label", "n", F.round("diff", 6).alias("diff"), F.expr(_VERDICT).alias("verdict"), (F.col("n") < 5).alias("underpowered"))


@query(_R + f", p AS (SELECT count(DISTINCT query) AS n, avg(recall) FILTER (WHERE k = 4) AS a, avg(recall) FILTER (WHERE k = 16) AS b FROM sw), f AS (SELECT *, b - a AS diff, CASE WHEN n >= 2 THEN 1.0 / n ELSE 0 END AS floor FROM p) SELECT n, round(floor, 6) AS floor, round(diff, 6) AS diff, {_VERDICT} AS verdict FROM f")
def score_effect_floor(spark: SparkSession, d: str) -> DataFrame:
    p = _sweep(spark, d).agg(F.count_distinct("query").alias("n"), F.avg(F.when(F.col("k") == 4, F.col("recall"))).alias("a"), F.avg(F.when(F.col("k") == 16, F.col("recall"))).alias("b"))
    f = p.withColumn("diff", F.col("b") - F.col("a")).withColumn("floor", F.when(F.col("n") >= 2, 1.0 / F.col("n")).otherwise(0.0))
    return f.select("n", F.round("floor", 6).alias("floor"), F.round("diff", 6).alias("diff"), F.expr(_VERDICT).alias("verdict"))


@query(_R + ", p AS (SELECT avg(recall) FILTER (WHERE k = 1) AS a, avg(recall) FILTER (WHERE k = 4) AS b, avg(recall) FILTER (WHERE k = 8) AS c FROM sw) SELECT round(b - a, 6) AS gain_ab, round(c - b, 6) AS gain_bc, round(CASE WHEN a > 0 THEN c / a ELSE 0 END, 6) AS ratio FROM p")
def score_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Paired gains between three systems and the ratio of the last to the first."""
    at = lambda k, n: F.avg(F.when(F.col("k") == k, F.col("recall"))).alias(n)
    p = _sweep(spark, d).agg(at(1, "a"), at(4, "b"), at(8, "c"))
    return p.select(F.round(F.expr("b - a"), 6).alias("gain_ab"), F.round(F.expr("c - b"), 6).alias("gain_bc"), F.round(F.expr("CASE WHEN a > 0 THEN c / a ELSE 0 END"), 6).alias("ratio"))


_FACTS = """WITH f AS (SELECT DISTINCT document, trim(name) AS fact FROM entity WHERE trim(name) <> '' AND document IS NOT NULL),
j AS (SELECT d.doc_id, coalesce(d.theme, '-') AS theme, fact, contains(lower(d.text), lower(fact)) AS found, contains(d.text, fact) AS strict FROM documents d JOIN f ON f.document = d.file_name)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the names extracted from it as required facts, and whether its text has them."""
    f = load(spark, d, "entity", "name", "document").select("document", F.trim("name").alias("fact")).where("fact <> '' and document is not null").distinct()
    docs = load(spark, d, "documents", "doc_id", "file_name", "theme", "text")
    j = docs.join(f, F.expr("file_name = document"))
    return j.select("doc_id", F.coalesce("theme", F.lit("-")).alias("theme"), "fact", F.expr("contains(lower(text), lower(fact))").alias("found"), F.expr("contains(text, fact)").alias("strict"))


@query(_FACTS + " SELECT doc_id, count(*) AS required, CAST(sum(CAST(found AS INTEGER)) AS BIGINT) AS found, round(avg(CAST(found AS INTEGER)), 6) AS recall, bool_and(found) AS complete FROM j GROUP BY doc_id")
def score_fact_recall(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("found").cast("int")
    return _facts(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("required"), F.sum(hit).alias("found"), F.round(F.avg(hit), 6).alias("recall"), F.bool_and("found").alias("complete"))


@query(_FACTS + " SELECT doc_id, count(*) AS misses, string_agg(fact, '|' ORDER BY fact) AS missing FROM j WHERE NOT found GROUP BY doc_id")
def score_misses(spark: SparkSession, d: str) -> DataFrame:
    m = _facts(spark, d).where("not found").groupBy("doc_id").agg(F.count(F.lit(1)).alias("misses"), F.array_sort(F.collect_set("fact")).alias("x"))
    return m.select("doc_id", "misses", F.array_join("x", "|").alias("missing"))


@query(_FACTS + " SELECT theme, round(avg(CAST(found AS INTEGER)) - avg(CAST(strict AS INTEGER)), 6) AS change, abs(avg(CAST(found AS INTEGER)) - avg(CAST(strict AS INTEGER))) < 1e-9 AS unaffected FROM j GROUP BY theme")
def score_rule_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """How much the permissive rule (whatever the case) gives over the strict one."""
    p = _facts(spark, d).groupBy("theme").agg((F.avg(F.col("found").cast("int")) - F.avg(F.col("strict").cast("int"))).alias("c"))
    return p.select("theme", F.round("c", 6).alias("change"), (F.abs("c") < 1e-9).alias("unaffected"))


@query(_FACTS + " SELECT theme, count(DISTINCT doc_id) AS n, round(avg(CAST(found AS INTEGER)), 6) AS recall FROM j GROUP BY theme")
def type_split(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).groupBy("theme").agg(F.count_distinct("doc_id").alias("n"), F.round(F.avg(F.col("found").cast("int")), 6).alias("recall"))


_CHAN = _FACTS + f""", {EDGES}, en AS (SELECT DISTINCT document, source AS fact FROM raw UNION SELECT document, target FROM raw),
ch AS (SELECT j.doc_id, j.fact, CASE WHEN j.found THEN 'prose' WHEN en.fact IS NOT NULL THEN 'edge' ELSE 'none' END AS channel FROM j JOIN documents d USING (doc_id) LEFT JOIN en ON en.document = d.file_name AND en.fact = j.fact)"""


def _channels(spark: SparkSession, d: str) -> DataFrame:
    r = V.raw_edges(spark, d)
    ends = r.select(F.col("document").alias("file_name"), F.col("source").alias("fact")).unionByName(r.select(F.col("document").alias("file_name"), F.col("target").alias("fact"))).distinct().withColumn("edge", F.lit(True))
    names = load(spark, d, "documents", "doc_id", "file_name")
    j = _facts(spark, d).join(names, "doc_id").join(ends, ["file_name", "fact"], "left")
    return j.select("doc_id", "fact", F.when(F.col("found"), "prose").when(F.col("edge"), "edge").otherwise("none").alias("channel"))


@query(_CHAN + " SELECT channel, count(*) AS hits, round(count(*) / (SELECT count(*) FROM ch), 6) AS share FROM ch GROUP BY channel")
def score_channels(spark: SparkSession, d: str) -> DataFrame:
    """Where facts come from: the prose, only the edges, or nowhere."""
    by = _channels(spark, d).groupBy("channel").agg(F.count(F.lit(1)).alias("hits"))
    return by.crossJoin(by.agg(F.sum("hits").alias("t"))).select("channel", "hits", F.round(F.col("hits") / F.col("t"), 6).alias("share"))  # one row


@query(_CHAN + " SELECT doc_id, fact, channel FROM ch")
def score_classify_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every fact with its best channel."""
    return _channels(spark, d)


@query("""WITH c AS (SELECT document, chunk_index, chunk_no, text FROM chunk WHERE document IS NOT NULL)
SELECT document, md5(arg_min(text, (chunk_index, chunk_no))) AS first_text, count(DISTINCT text) AS texts, (SELECT count(*) FROM (SELECT chunk_index FROM c x WHERE x.document = c.document GROUP BY chunk_index HAVING count(DISTINCT text) > 1)) > 0 AS conflict FROM c GROUP BY document""")
def pool_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs pooled by title: the first text stays, titles whose paragraphs differ are listed as conflicts."""
    c = load(spark, d, "chunk", "document", "chunk_index", "chunk_no", "text").where("document is not null")
    per = c.groupBy("document", "chunk_index").agg(F.count_distinct("text").alias("n")).groupBy("document").agg((F.max("n") > 1).alias("conflict"))
    g = c.groupBy("document").agg(F.md5(F.min_by("text", F.struct("chunk_index", "chunk_no"))).alias("first_text"), F.count_distinct("text").alias("texts"))
    return g.join(per, "document")


_TITLES = "title array<string>, sentences array<array<string>>"


def _records(spark: SparkSession) -> DataFrame:
    """Nested questions in both encodings, and malformed ones."""
    good = '"question": "q", "answer": "a", "type": "bridge", '
    rows = [
        (1, '{"_id": "r1", ' + good + '"supporting_facts": [["A", 0], ["B", 1]], "context": [["A", ["a0", "a1"]], ["B", ["b0", "b1"]], ["C", ["c0"]]]}'),
        (2, '{"id": "r2", ' + good + '"supporting_facts": {"title": ["A", "C"], "sent_id": [1, 0]}, "context": {"title": ["A", "C"], "sentences": [["a0", "a1"], ["c0"]]}}'),
        (3, '{"_id": "r3", "answer": "a", "supporting_facts": [["A", 0]], "context": [["A", ["a0"]]]}'),
        (4, '{"_id": "r4", ' + good + '"supporting_facts": [["A", 9]], "context": [["A", ["a0"]]]}'),
        (5, '{"_id": "r5", ' + good + '"supporting_facts": [["A", 0]], "context": []}'),
        (6, "[]"),
        (7, "not json"),
        (8, '{' + good + '"supporting_facts": [["A", 0]], "context": [["A", ["a0"]]]}'),
    ]
    df = spark.createDataFrame(rows, "line int, raw string")
    js = lambda path: F.get_json_object("raw", path)
    columns = js("$.context.title").isNotNull()
    ctx_c = F.from_json(js("$.context"), _TITLES)
    ctx_f = F.from_json(js("$.context"), "array<array<string>>")
    context = F.when(columns, F.arrays_zip(ctx_c["title"].alias("title"), ctx_c["sentences"].alias("sentences"))).otherwise(F.transform(ctx_f, lambda p: F.struct(p[0].alias("title"), F.from_json(p[1], "array<string>").alias("sentences"))))
    sup_c = F.from_json(js("$.supporting_facts"), "title array<string>, sent_id array<int>")
    sup_f = F.from_json(js("$.supporting_facts"), "array<array<string>>")
    facts = F.when(columns, F.arrays_zip(sup_c["title"].alias("title"), sup_c["sent_id"].alias("sent"))).otherwise(F.transform(sup_f, lambda p: F.struct(p[0].alias("title"), p[1].cast("int").alias("sent"))))
    out = df.select("line", "raw", F.coalesce(js("$._id"), js("$.id")).alias("id"), js("$.question").alias("question"), context.alias("context"), facts.alias("facts"))
    dangling = F.size(F.filter("facts", lambda f: ~F.exists("context", lambda p: (p["title"] == f["title"]) & (F.size(p["sentences"]) > f["sent"]))))
    reason = (
        F.when(F.try_parse_json("raw").isNull(), "not json").when(~F.col("raw").startswith("{"), "not an object").when(F.col("id").isNull(), "no id").when(F.col("question").isNull(), "no question")
        .when(F.coalesce(F.size("context"), F.lit(0)) <= 0, "no context").when(dangling > 0, "dangling fact")
    )
    return out.withColumn("reject", reason)


@query("SELECT * FROM (VALUES (1, ''), (2, ''), (3, 'no question'), (4, 'dangling fact'), (5, 'no context'), (6, 'not an object'), (7, 'not json'), (8, 'no id')) t(line, reject)")
def hotpot_parse(spark: SparkSession, d: str) -> DataFrame:
    """Nested records in two encodings parsed alike; malformed ones with their reason."""
    return _records(spark).select("line", F.coalesce("reject", F.lit("")).alias("reject"))


@query("SELECT * FROM (VALUES ('r1', 'A', true, 5), ('r1', 'B', true, 5), ('r1', 'C', false, 3), ('r2', 'A', true, 5), ('r2', 'C', true, 3)) t(id, title, gold, chars)")
def score_gold_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Gold and distractor paragraphs of the parsed records with their length as title and body."""
    r = _records(spark).where("reject is null").select("id", "facts", F.explode("context").alias("p"))
    return r.select("id", F.col("p.title").alias("title"), F.exists("facts", lambda f: f["title"] == F.col("p.title")).alias("gold"), F.length(F.concat_ws(" ", F.array(F.col("p.title")), F.array_join("p.sentences", ""))).alias("n"), F.size("p.sentences").alias("s")).select("id", "title", "gold", (F.col("n") - F.when(F.col("s") > 0, 1).otherwise(0)).alias("chars"))


@query("SELECT * FROM (VALUES ('r1', 'A', 'a0'), ('r1', 'B', 'b1'), ('r2', 'A', 'a1'), ('r2', 'C', 'c0')) t(id, title, sentence)")
def supporting_sentences(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark).where("reject is null").select("id", "context", F.explode("facts").alias("f"))
    hit = F.filter("context", lambda p: p["title"] == F.col("f.title"))[0]["sentences"]
    return r.select("id", F.col("f.title").alias("title"), F.get(hit, F.col("f.sent")).alias("sentence"))


@query("""WITH t AS (SELECT 'Personal CV / Resume' AS theme, 10 AS n UNION ALL SELECT 'Technology, Tools & Docs', 11 UNION ALL SELECT 'Medical/Scientific', 9 UNION ALL SELECT 'Business/Legal', 7 UNION ALL SELECT 'Generic', 6)
SELECT doc_id, coalesce(t.theme, 'Generic') AS theme, coalesce(n, 6) AS entity_types FROM documents d LEFT JOIN t ON t.theme = d.theme""")
def theme_schema_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Allowed entity types of every document's theme; an unknown theme gets those of Generic."""
    from weftgraph.sources.themes import theme_table

    t = theme_table(spark).select("theme", F.size("entities").alias("n"))
    docs = load(spark, d, "documents", "doc_id", "theme").withColumnRenamed("theme", "own")
    j = docs.join(t, F.col("own") == F.col("theme"), "left")  # five themes
    return j.select("doc_id", F.coalesce("theme", F.lit("Generic")).alias("theme"), F.coalesce("n", F.lit(6)).alias("entity_types"))


@query("SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(n_chars, 0) AS n_chars, coalesce(theme, 'Generic') AS theme FROM documents")
def row_normalise(spark: SparkSession, d: str) -> DataFrame:
    c = lambda x, y: F.coalesce(x, F.lit(y)).alias(x)
    return load(spark, d, "documents", "doc_id", "lang", "source", "n_chars", "theme").select("doc_id", c("lang", ""), c("source", ""), F.coalesce("n_chars", F.lit(0).cast("bigint")).alias("n_chars"), c("theme", "Generic"))


@query("""WITH u AS (SELECT * FROM (VALUES (1, 10, 5, NULL, NULL), (2, 0, 0, 7, 3), (3, NULL, NULL, 4, 4), (4, NULL, NULL, NULL, NULL), (5, 0, 0, 0, 0)) t(call, p1, c1, p2, c2))
SELECT call, CASE WHEN coalesce(p1, 0) + coalesce(c1, 0) > 0 THEN p1 WHEN coalesce(p2, 0) + coalesce(c2, 0) > 0 THEN p2 ELSE 0 END AS prompt, CASE WHEN coalesce(p1, 0) + coalesce(c1, 0) > 0 THEN false WHEN coalesce(p2, 0) + coalesce(c2, 0) > 0 THEN false ELSE true END AS estimated FROM u""")
def usage_trust_order(spark: SparkSession, d: str) -> DataFrame:
    """Token usage from the first source that reports any; zero for both counts is no report."""
    u = spark.createDataFrame([(1, 10, 5, None, None), (2, 0, 0, 7, 3), (3, None, None, 4, 4), (4, None, None, None, None), (5, 0, 0, 0, 0)], "call int, p1 int, c1 int, p2 int, c2 int")
    one, two = F.expr("coalesce(p1, 0) + coalesce(c1, 0) > 0"), F.expr("coalesce(p2, 0) + coalesce(c2, 0) > 0")
    return u.select("call", F.when(one, F.col("p1")).when(two, F.col("p2")).otherwise(0).alias("prompt"), (~one & ~two).alias("estimated"))


@query(_R + ", c AS (SELECT k, round(avg(recall), 6) AS recall FROM sw GROUP BY k) SELECT k, CASE WHEN recall >= (SELECT recall FROM c WHERE k = 16) - 1e-9 THEN 'matches or beats' ELSE 'behind' END AS parity FROM c")
def parity_classify(spark: SparkSession, d: str) -> DataFrame:
    c = score_k_sweep(spark, d)
    t = c.where("k = 16").select(F.col("recall").alias("goal"))
    return c.crossJoin(t).select("k", F.when(F.expr("recall >= goal - 1e-9"), "matches or beats").otherwise("behind").alias("parity"))  # one row
