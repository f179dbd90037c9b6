"""Table functions from SQL and DataFrames: deep, broken and null texts."""

import json

from talus.functions import tables


def test_json_leaves_in_sql(spark):
    tables.register(spark)
    deep = "[" * 5000 + "1" + "]" * 5000
    nested = json.dumps({"a": {"b": [1, {"c": "x"}, None, True]}, "d": "", "é": 1.5})
    rows = [(1, nested), (2, "{broken"), (3, None), (4, ""), (5, "7"), (6, json.dumps({"k": {"x": {}}})), (7, '{"a": 1, "a": 2}'), (8, deep)]
    spark.createDataFrame(rows, "id int, doc string").createOrReplaceTempView("docs")
    got = spark.sql("SELECT id, path, kind, value FROM docs, LATERAL json_leaves(doc) WHERE id < 8").collect()
    want = [(1, "a.b[0]", "number", "1"), (1, "a.b[1].c", "string", "x"), (1, "a.b[3]", "boolean", "true"), (1, "d", "string", ""), (1, "é", "number", "1.5"), (5, "", "number", "7"), (7, "a", "number", "2")]
    assert sorted(map(tuple, got)) == sorted(want)
    assert spark.sql("SELECT * FROM docs, LATERAL json_leaves(doc) WHERE id = 8").count() <= 1  # deep text: its leaf or nothing, no error
    assert sorted(map(tuple, tables.json_leaves(spark.table("docs").where("id < 8"), ["id"], "doc").collect())) == sorted(want)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, '{"a": "b"}')], "value int, path int, doc string")
    assert [tuple(r) for r in tables.json_leaves(df, ["value"], "doc").collect()] == [(1, "a", "string", "b")]


def test_token_sets(spark):
    rows = [(1, json.dumps({"countries": ["Italy", " DE "], "eu": {"any": "italy", "n": 3}})), (2, None), (3, "[]")]
    got = {r.id: r.tokens for r in tables.token_sets(spark.createDataFrame(rows, "id int, doc string"), "id", "doc").collect()}
    assert got == {1: ["de", "italy"], 2: [], 3: []}
    df = spark.createDataFrame([(["de", "italy"], "Rome, ITALY"), (["de"], "Paris"), ([], "x")], "t array<string>, s string")
    assert [r[0] for r in df.select(tables.in_token_set(df.t, df.s)).collect()] == [True, False, False]


def test_postings_of_linked_data(spark):
    tables.register(spark)
    one = {"@type": "JobPosting", "title": "A", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Berlin", "addressCountry": "DE"}}, "url": "u1"}
    graph = {"@graph": [{"@type": "Thing"}, dict(one, title="B", jobLocation=[{"address": "Rome"}])]}
    items = {"@type": "ItemList", "itemListElement": [{"item": dict(one, title="C", hiringOrganization="Beta")}, dict(one, title="D", **{"@type": ["JobPosting", "X"]})]}
    page = "".join(f'<p><script type="application/ld+json">{b}</script>' for b in (json.dumps(one), "{broken", json.dumps(graph), json.dumps([items]))) + "<script>{}</script>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<html>")], "page int, html string")
    df.createOrReplaceTempView("p")
    got = spark.sql("SELECT page, at, title, company, location, url FROM p, LATERAL json_ld_postings(html)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "A", "Acme", "Berlin, DE", "u1"), (1, 1, "B", "Acme", "Rome", "u1"), (1, 2, "C", "Beta", "Berlin, DE", "u1"), (1, 3, "D", "Acme", "Berlin, DE", "u1")]
