import random
import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import compose, graph, language, lookup, merge, metrics, ranking, vectors, views
from talus.sources import postings


def test_ranks_bands_and_ties(spark):
    rows = [(1, 84, dt.date(2026, 1, 1)), (2, 96, None), (3, 88, None), (4, 92, None), (5, 84, dt.date(2026, 1, 2)), (6, None, None), (7, 70, None), (8, 69, None)]
    got = ranking.rank_jobs(spark.createDataFrame(rows, "id long, total_score int, fetched_date date")).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 4, 3, 5, 1, 7, 8, 6]
    assert [r["rank"] for r in got] == list(range(1, 9))
    assert {r["id"]: r["band"] for r in got}[7] == "Good Match" and {r["id"]: r["band"] for r in got}[6] == "Low Priority"


def test_global_rank_equals_one_window(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 50).alias("k"))
    order = [F.desc("k"), F.asc("id")]
    want = {r["id"]: r["rank"] for r in ranking.row_numbers(df, order).collect()}
    for buckets in (1, 3, 200):
        assert {r["id"]: r["rank"] for r in ranking.global_rank(df, order, buckets).collect()} == want


def test_prefilter_counts_a_key_only_when_kept(spark):
    rows = [(1, "a", True, True), (2, "a", False, False), (3, "a", False, True), (4, "a", False, True), (5, "b", True, True), (6, "z", False, True)]
    df = spark.createDataFrame(rows, "seq int, key string, expired boolean, geo_ok boolean")
    existing = spark.createDataFrame([("z",)], "key string")
    got = lookup.prefilter(df, F.col("key"), "seq", [("expired", F.col("expired")), ("geo", ~F.col("geo_ok"))], existing)
    assert [r["reason"] for r in got.orderBy("seq").collect()] == ["expired", "geo", "kept", "duplicate", "expired", "duplicate"]


def test_lookup_and_titles(spark):
    tiers = spark.createDataFrame([("amazon", 1, 0), ("aws", 2, 1), ("", 3, 2)], "name string, tier int, pos int")
    jobs = spark.createDataFrame([("amazon aws",), ("aws",), ("",), ("else",)], "c string")
    got = {r["c"]: (r["tier"], r["is_fallback"]) for r in lookup.lookup_join(jobs, F.col("c"), tiers, "name", F.col("pos"), {"tier": F.lit(4)}).collect()}
    assert got == {"amazon aws": (1, False), "aws": (2, False), "": (4, True), "else": (4, True)}
    terms = lookup.flatten_dictionary(spark, {"x": ["data", "product"], "y": ["data", "product owner"], "z": ["analyst"]})
    titles = spark.createDataFrame([("Senior Product Owner",), ("DATA",), ("cook",), ("product analyst",)], "t string")
    assert [r["category"] for r in lookup.classify_titles(titles, "t", terms).orderBy("t").collect()] == ["y", "y", "unknown", "x"]
    hits = lookup.keyword_categories(spark.createDataFrame([(1, "We use AI and paint; SQL+"), (2, None)], "id int, t string"), "id", "t", {"a": ["ai", "sql+"], "b": ["said"]}).orderBy("id").collect()
    assert hits[0]["categories"] == {"a": ["ai"]} or hits[0]["categories"] == {"a": ["ai", "sql+"]}
    assert hits[1]["categories"] == {}


def test_paths_closure_and_levels(spark):
    edges = spark.createDataFrame([("analyst", "senior", 1.0), ("senior", "pm", 2.0), ("analyst", "pm", 5.0), ("pm", "analyst", -1.0), ("x", "y", 1.0)], "src string, dst string, cost double")
    got = {r["node"]: (r["cost"], r["path"]) for r in graph.shortest_paths(edges, spark.createDataFrame([("analyst",)], "n string")).collect()}
    assert got == {"analyst": (0.0, ["analyst"]), "senior": (1.0, ["analyst", "senior"]), "pm": (3.0, ["analyst", "senior", "pm"])}
    deps = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a"), ("q", "r"), ("r", "q")], "src string, dst string")
    done, cyclic = graph.levels(deps)
    assert {r["node"]: r["level"] for r in done.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r["node"] for r in cyclic.collect()} == {"q", "r"}
    known = graph.closure(deps)
    assert {(r["node"], r["reaches"]) for r in known.collect()} == {("c", "b"), ("c", "a"), ("b", "a"), ("q", "r"), ("r", "q")}
    gaps = spark.createDataFrame([("p1", "c")], "profile string, skill string")
    assert [r["skill"] for r in graph.learning_path(gaps, known).orderBy("step").collect()] == ["a", "b", "c"]


def test_merge_and_lifecycle(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, merge.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], t.schema), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    once = merge.upsert(t, t, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b")]
    assert merge.insert_or_ignore(t, spark.createDataFrame([(2, "x", 1), (3, "y", 5), (3, "z", 2)], "k int, v string, seq int"), ["k"], "seq").collect()[0]["v"] == "z"
    big = spark.range(2500).select("id", F.concat(F.lit("t"), F.col("id") % 2).alias("tenant_id"))
    good = merge.verify_copy(big, big.repartition(5)).first()
    assert good["same_count"] and good["same_rows"] and good["n_copy"] == 2500 and merge.scoped(big, "t0").count() == 1250
    changed = merge.verify_copy(big, big.withColumn("tenant_id", F.when(F.col("id") == 7, "zz").otherwise(F.col("tenant_id")))).first()
    assert changed["same_count"] and not changed["same_rows"]
    days = spark.createDataFrame([(dt.date(2026, 1, 5),), (dt.date(2026, 2, 15),)], "d date")
    assert merge.month_partitions(days, "d").count() == 3
    parts = spark.createDataFrame([(2025, m) for m in (9, 10, 11, 12)], "year int, month int")
    assert [r["month"] for r in merge.expired_partitions(parts, F.lit(dt.date(2026, 2, 15)), 3).orderBy("month").collect()] == [9, 10]


def test_metrics_with_known_answers(spark):
    market = spark.createDataFrame([("ai", float(x)) for x in (50_000, 60_000, 70_000, 80_000, 90_000)] + [("ai", 0.0)], "r string, s double")
    assert metrics.benchmark(market, ["r"], "s").first()["p50"] == 70_000
    e = spark.createDataFrame([("x", "t", 1.0)] * 5 + [("x", "c", 0.0)] * 5, "experiment string, variant string, value double")
    w = metrics.winner(metrics.experiment_results(e, ["experiment", "variant"], "value"), "experiment", "variant", 5).first()
    assert (w["winner"], w["lift"]) == ("t", None)
    f = spark.createDataFrame([(1, "accepted"), (1, "applied"), (1, "rejected"), (1, "seen")], "k int, s string")
    assert metrics.acceptance(f, "k", "s", ["accepted", "applied"], ["rejected"]).first()["rate"] == 0.6667
    r = spark.createDataFrame([("q", 1, True), ("q", 2, True), ("q", 3, False)], "g string, rank int, rel boolean")
    assert ranking.precision_ndcg(r, "g", "rank", "rel", 2).first()["ndcg_at_k"] == 1.0
    few = vectors.similarity_bounds(spark.range(19).select((F.col("id") / 19).alias("s")), "s").first()
    assert (few["floor"], few["ceil"]) == (0.30, 0.82)
    have = spark.createDataFrame([(["python", "sql"],)], "h array<string>")
    c = lookup.coverage(have, "h", ["python", "sql", "tableau"]).first()
    assert (c["coverage"], c["missing"]) == (0.6667, ["tableau"])


def test_sources(spark):
    day = F.lit(dt.date(2026, 1, 1))
    green = spark.read.json(spark.sparkContext.parallelize([json.dumps({"title": " T ", "_company_name": "C", "location": {"name": "Berlin"}, "absolute_url": "u", "content": "<p>a&amp;b</p>", "updated_at": "2025-12-30T01:00"})]))
    r = postings.greenhouse(green, day).first()
    assert (r["title"], r["location"], r["description"], r["posted_date"]) == ("T", "Berlin", "a&b", dt.date(2025, 12, 30))
    job = {"@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Berlin", "addressCountry": "DE"}}], "description": "<b>Hi</b>", "datePosted": "2026-01-02T00"}
    block = lambda x: f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'
    html = block(job) + block({"@graph": [job, {"@type": "Other"}]}) + block([job]) + block({"@type": ["ItemList"], "itemListElement": [{"item": job}]}) + block("{broken")
    rows = postings.json_ld(spark.createDataFrame([(html, "http://x"), (None, "y")], "html string, url string")).collect()
    assert len(rows) == 4 and (rows[0]["company"], rows[0]["location"], rows[0]["description"]) == ("Acme", "Berlin, DE", "Hi")
    feed = "<rss><channel><item><title>A</title><link>l</link><pubDate>2026-01-03</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="h"/><summary>s</summary></entry></feed>'
    got = postings.feed_items(spark.createDataFrame([(feed,), (atom,), ("<bad",)], "xml string")).collect()
    assert [(r["title"], r["url"]) for r in got] == [("A", "l"), ("B", "h")]
    walked = postings.placeholders(spark.createDataFrame([(1, json.dumps({"a": {"b": ["FILL_IN_X", "ok"]}}))], "id int, doc string"), "id", "doc").collect()
    assert [r["path"] for r in walked] == ["a.b[0]"]


def test_language_profiles(spark):
    en, de = "the quick brown fox jumps over the lazy dog and then they went to the house ", "der schnelle braune fuchs springt ueber den faulen hund und dann gingen sie nach haus "
    train = spark.createDataFrame([(en * 3, "en"), (de * 3, "de")], "t string, lang string")
    found = language.detect(spark.createDataFrame([(1, en), (2, de), (3, "short"), (4, None)], "id int, t string"), language.fit_profiles(train, "t", "lang"), "id", "t")
    assert {r["id"]: r["language"] for r in found.collect()} == {1: "en", 2: "de", 3: "Unknown", 4: "Unknown"}


def test_top_k_of_more_queries_than_a_block(spark):
    n = vectors.QUERY_BLOCK + 88
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(n)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.top_k(e, e, "vec_id", "vec_id", "embedding", 3).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    assert len(got) == n
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    for i in range(0, n, 37):
        s = np.round(v @ v[i], 6)
        assert [got[i][k] for k in (1, 2, 3)] == sorted((j for j in range(n) if j != i), key=lambda j: (-s[j], j))[:3]


def test_graph_rounds_are_no_silent_end(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "src int, dst int, cost double")
    start = spark.createDataFrame([(0,)], "src int")
    assert graph.shortest_paths(chain, start).where("node = 30 and cost = 30").count() == 1
    for run in (lambda: graph.shortest_paths(chain, start, rounds=5), lambda: graph.closure(chain, rounds=3), lambda: graph.levels(chain, rounds=3)):
        with pytest.raises(RuntimeError, match="not done"):
            run()


def test_closure_and_levels_take_logarithmic_rounds(spark):
    chain = spark.range(1023).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    known = graph.closure(chain, rounds=11)
    assert known.where("depth = reaches - node").count() == known.count() == 1023 * 1024 // 2
    long = spark.range(4095).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    done, cyclic = graph.levels(long.unionByName(spark.createDataFrame([(9000, 9001), (9001, 9000), (9002, 9001)], "src long, dst long")), rounds=14)
    assert done.where("level = 4095 - node").count() == done.count() == 4096
    assert {r["node"] for r in cyclic.collect()} == {9000, 9001, 9002}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_and_closure_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 24
    edges = {(a, b) for a in range(n) for b in range(n) if (b < a or seed == 3) and rng.random() < 0.09}
    df = spark.createDataFrame([*edges, *list(edges)[:3]], "src int, dst int")
    reach, todo = dict.fromkeys(edges, 1), list(edges)
    while todo:
        new = {}
        for a, b in todo:
            for c, d in edges:
                if b == c and (a, d) not in reach and (a, d) not in new:
                    new[a, d] = reach[a, b] + 1
        reach.update(new)
        todo = list(new)
    assert {(r["node"], r["reaches"]): r["depth"] for r in graph.closure(df).collect()} == {p: d for p, d in reach.items() if p[0] != p[1]}
    nodes = {x for e in edges for x in e}
    on_cycle = {a for a, b in reach if a == b}
    bad = on_cycle | {a for a, b in reach if b in on_cycle}
    level = {}

    def longest(x):
        if x not in level:
            level[x] = max((longest(b) + 1 for a, b in edges if a == x), default=0)
        return level[x]

    done, cyclic = graph.levels(df)
    assert {r["node"] for r in cyclic.collect()} == bad
    assert {r["node"]: r["level"] for r in done.collect()} == {x: longest(x) for x in nodes - bad}


def test_checksums_do_not_overflow(spark):
    equal = spark.range(20_000_000).select(F.lit("x").alias("x"), F.lit("y").alias("y"))
    r = merge.verify_copy(equal, equal).first()
    assert r["same_count"] and r["same_rows"]
    assert views.batch_signature(equal, ["x", "y"]).first()["n"] == 20_000_000


def test_signature_counts_repeated_rows(spark):
    one = spark.createDataFrame([("a", "b"), ("c", "d")], "x string, y string")
    mark = lambda df: views.batch_signature(df, ["x", "y"]).first()["signature"]
    assert mark(one) == mark(one.orderBy("y").repartition(3))
    assert len({mark(one), mark(one.unionByName(one)), mark(one.unionByName(one).unionByName(one)), mark(one.where("false"))}) == 4


def test_large_dictionaries_join_by_grams(spark, monkeypatch):
    texts = ["senior data analyst", "ai", "data", "planner", "an", "xyz", "aanalyst"]
    terms = ["analyst", "data", "ai", "an", "plan", "a", "senior data"]
    frames = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(t,) for t in [*terms, ""]], "p string")
    want = sorted((t, p) for t in texts for p in terms if p in t)
    for bound in (50_000, 2):
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", bound)
        assert sorted((r["t"], r["p"]) for r in lookup.contained_pairs(frames[0], "t", frames[1], "p").collect()) == want


def test_ranks_of_one_value_are_split_and_whole(spark):
    rows = spark.range(5000).select(F.col("id"), F.lit(7).alias("score"))
    ranked = ranking.global_rank(rows, [F.desc("score"), F.asc("id")], 8)
    assert ranked.where("rank <> id + 1").count() == 0 and ranked.count() == 5000


def test_acquisition_and_publishing_on_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a", "u", 0), (2, "a", "v", 0), (3, "b", "u", 0), (4, None, None, 0), (5, None, None, 0), (6, "c", "w", 1)], "id int, h string, u string, bad int")
    out = compose.acquire(rows, [("bad", F.col("bad") == 1)], [("content", F.col("h")), ("address", F.col("u"))], "id")
    assert {r["id"]: r["outcome"] for r in out.collect()} == {1: "inserted", 2: "content", 3: "address", 4: "inserted", 5: "inserted", 6: "bad"}
    old = spark.createDataFrame([(1, "k", "x")], "event_id int, kind string, key string")
    new = spark.createDataFrame([(1, "k", "y"), (2, "k", "x"), (3, "k", "z"), (4, "k", "z"), (5, "k", None), (6, "k", None), (6, "k", None)], "event_id int, kind string, key string")
    assert sorted(r["event_id"] for r in compose.publish_once(new, old, "event_id", "kind", "key", "event_id").collect()) == [3, 5, 6]


def test_keywords_with_a_space_are_substrings_and_words_end_at_any_letter(spark):
    rows = [(1, "on.\nOf | tht"), (2, "thof "), (3, "émit"), (4, "(MIT)"), (5, "mité smite mit_"), (6, "x off")]
    hits = lookup.keyword_categories(spark.createDataFrame(rows, "id int, t string"), "id", "t", {"a": ["of "], "b": ["mit"]})
    assert {r.id: dict(r.categories) for r in hits.collect()} == {1: {"a": ["of "]}, 2: {"a": ["of "]}, 3: {}, 4: {"b": ["mit"]}, 5: {}, 6: {}}
