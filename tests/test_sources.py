import json

from weftgraph.functions.register import register
from weftgraph.operators import store as S
from weftgraph.sources import files


def test_graph_source_and_its_problems(spark, tmp_path):
    g = {"document_name": "d", "theme": "Generic", "description": "", "entities": [{"name": "A", "type": "PERSON", "description": "x"}, {"name": "B", "type": "WHAT", "description": " "}, {"name": "A", "type": "PERSON", "description": "y"}], "relationships": [{"source": "A", "target": "Z", "type": "R", "description": ""}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    e, r = files.read_graph(spark, str(tmp_path / "g.json"))
    assert e.count() == 3 and r.count() == 1
    got = sorted(tuple(x) for x in files.graph_problems(e, r, ["PERSON"]).collect())
    assert got == [("missing target", "A R Z"), ("no description", "B"), ("repeated name", "A"), ("type", "B")]


def test_records_and_texts(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": 1}\nnope\n{"id": "x"}\n')
    good, bad = files.read_records(spark, str(tmp_path / "r.jsonl"), "id int")
    assert [r["id"] for r in good.collect()] == [1] and bad.count() == 2
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.txt").write_text("  ")
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path)).collect()] == [("a.txt", "héllo")]


def test_sql_functions(spark):
    register(spark)
    one = lambda q: spark.sql(q).first()[0]
    assert one("SELECT wg_rel_type('works at')") == "WORKS_AT" and one("SELECT wg_rel_type(NULL)") == "RELATED_TO"
    assert one("SELECT wg_tokens_from_chars(9L)") == 3 and one("SELECT wg_entity_type(' ')") == "UNKNOWN"
    assert abs(one("SELECT wg_cosine(array(1D, 0D), array(1D, 1D))") - 0.70710678) < 1e-6 and one("SELECT wg_cosine(array(0D), array(1D))") == 0
    assert one("SELECT wg_name_similarity('Acme', 'ACME')") == 1.0
    assert len(one("SELECT wg_hash_embed('a b')")) == 64
    assert [r["chunk"] for r in spark.sql("SELECT * FROM wg_chunk_text('Ab cd. Ef gh. Ij', 8, 1)").collect()][0] == "Ab cd."


def test_upsert_and_merge(spark):
    schema = "name string, type string, description string, document string, aliases array<string>"
    old = spark.createDataFrame([("A", "X", "old", "d1", ["p", "q"]), ("B", "Y", "keep", "d1", None), (None, "Z", "", "", None)], schema)
    new = spark.createDataFrame([("A", "X2", None, "d2", ["q", "r"]), ("C", "W", "", "d2", None)], schema)
    got = {r["name"]: r for r in S.upsert_entities(old, new).collect()}
    assert set(got) == {"A", "B", "C"} and got["A"]["aliases"] == ["p", "q", "r"] and got["A"]["description"] is None and got["B"]["description"] == "keep"
    c = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "y")], "id string, t string")
    once = S.merge_chunks(c.limit(0), c)
    assert once.count() == 2 and S.merge_chunks(once, c).count() == 2


def test_replace_keeps_what_could_not_be_read(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "a int"
    S.replace_table(spark, path, spark.createDataFrame([(1,), (2,)], schema), schema)
    S.replace_table(spark, path, None, schema)
    assert spark.read.parquet(path).count() == 2
    S.replace_table(spark, path, spark.createDataFrame([], schema), schema)
    assert spark.read.schema(schema).parquet(path).count() == 0
