"""Driver queries: joins, aggregates, merges, vectors, graphs, experiments, events and
lifecycle (survey groups D, E, G, I, J, K, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import text
from talus.operators import graph, lookup, merge, metrics, ranking, vectors
from talus.plans.ranked import read




# ------------------------------------------------------------------ dedupe and merge
def fingerprint_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.lower("text"), F.col("lang")).alias("fp"))
    return merge.first_per_key(docs, ["fp"], "doc_id").select("doc_id", "fp")


FINGERPRINT = "SELECT min(doc_id) AS doc_id, fp FROM (SELECT doc_id, sha256(lower(text) || '|' || lang)[1:16] AS fp FROM documents) GROUP BY fp"


def two_key_dedup(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    page = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.|m\.|blog\.)?", ""), r"/\d+[^/]*.*$", "").alias("place"), F.sha2("html", 256).alias("mark"))
    old, new = page.where("page_id % 2 = 0"), page.where("page_id % 2 = 1")
    return merge.two_key_duplicates(new, old, "place", "mark", "page_id")


TWO_KEY = """
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://(www\\.|m\\.|blog\\.)?', ''), '/\\d+[^/]*.*$', '') AS place, sha256(html) AS mark FROM pages),
o1 AS (SELECT place, min(page_id) AS e FROM p WHERE page_id % 2 = 0 GROUP BY place), o2 AS (SELECT mark, min(page_id) AS e FROM p WHERE page_id % 2 = 0 GROUP BY mark)
SELECT page_id, coalesce(o1.e, o2.e) AS existing_id FROM p LEFT JOIN o1 USING (place) LEFT JOIN o2 USING (mark) WHERE page_id % 2 = 1 AND coalesce(o1.e, o2.e) IS NOT NULL"""


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def upsert_latest(spark, sf_dir):
    o = _orders(spark, sf_dir)
    new = o.where("o_orderkey % 3 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_orderkey": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))})
    return merge.upsert(o, new, ["o_orderkey"])


UPSERT = """
WITH n AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n"""


def coalesce_update(spark, sf_dir):
    o = _orders(spark, sf_dir)
    patch = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "P").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).alias("o_totalprice")).where("o_orderkey % 5 = 0")
    return merge.coalesce_update(o, patch, ["o_orderkey"])


COALESCE = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 15 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders"""


def ensure_rows(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), _orders(spark, sf_dir)
    tracked = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("Applied").alias("status"))
    return merge.ensure_rows(tracked, o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", {"status": F.lit("Not Started")})


ENSURE = """SELECT c_custkey, 'Applied' AS status FROM customer WHERE c_custkey % 4 = 0 UNION ALL
SELECT DISTINCT o_custkey, 'Not Started' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)"""


def rejected_backfill(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = docs.select("doc_id", F.when(F.col("lang") != "en", F.concat(F.lit("language "), F.col("lang"))).alias("why_lang"), F.when(F.col("n_chars") < 500, F.lit("short")).alias("why_size"))
    return merge.reject_backfill(rows, labels, "doc_id", ["why_lang", "why_size"], "rejected").select("doc_id", "explanation")


BACKFILL = """SELECT doc_id, coalesce(CASE WHEN lang <> 'en' THEN 'language ' || lang END, CASE WHEN n_chars < 500 THEN 'short' END, 'rejected') AS explanation
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""


def version_latest(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("version"), "l_partkey")
    return merge.latest_version(lines.groupBy("l_orderkey", "version").agg(F.max("l_partkey").alias("l_partkey")), ["l_orderkey"], "version")


VERSION = """SELECT l_orderkey, version, l_partkey FROM (SELECT l_orderkey, l_linenumber AS version, max(l_partkey) AS l_partkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS r FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE r = 1"""


def publish_versions(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("content"))
    published = part.where("p_partkey % 3 <> 0").select("p_partkey", F.lit(1).alias("version"), F.when(F.col("p_partkey") % 3 == 1, F.col("content")).otherwise("old").alias("content"))
    return merge.publish_version(published, part, ["p_partkey"], "content").select("p_partkey", "version", "content")


PUBLISH = "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 2 ELSE 1 END AS version, p_name AS content FROM part WHERE p_partkey % 3 <> 1"


def status_changes(spark, sf_dir):
    o = _orders(spark, sf_dir)
    changes = o.select((F.col("o_orderkey") * 2).alias("o_orderkey"), "o_orderstatus")
    good, bad = merge.validated_changes(changes, o.select("o_orderkey"), "o_orderkey", "o_orderstatus", ["O", "F"])
    return good.withColumn("error", F.lit("")).unionByName(bad).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


STATUS = """WITH c AS (SELECT o_orderkey * 2 AS k, o_orderstatus AS s FROM orders)
SELECT CASE WHEN s NOT IN ('O', 'F') THEN 'unknown status' WHEN k NOT IN (SELECT o_orderkey FROM orders) THEN 'unknown id' ELSE '' END AS error, count(*) AS n FROM c GROUP BY 1"""


def unscored_documents(spark, sf_dir):
    return lookup.unscored(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id")


UNSCORED = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


# ------------------------------------------------------------------ aggregates
def jobs_per_day(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


PER_DAY = "SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1"

KINDS = ["view", "click", "purchase", "signup", "error", "refund"]


def status_zero_fill(spark, sf_dir):
    return metrics.zero_filled_counts(read(spark, sf_dir, "events"), "event_type", KINDS)


ZERO = """SELECT coalesce(k.status, e.status) AS status, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'refund']) AS status) k
FULL JOIN (SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1) e ON k.status = e.status"""


def funnel_cumulative(spark, sf_dir):
    out = metrics.funnel(read(spark, sf_dir, "events"), "event_type", ["signup", "view", "refund", "click", "purchase"])
    return out.select("stage", "n", "reached", "pct_of_first", "pct_of_previous")


FUNNEL = """
WITH s(pos, stage) AS (VALUES (0, 'signup'), (1, 'view'), (2, 'refund'), (3, 'click'), (4, 'purchase')),
c AS (SELECT pos, stage, coalesce((SELECT count(*) FROM events WHERE event_type = stage), 0) AS n FROM s),
r AS (SELECT *, sum(n) OVER (ORDER BY pos DESC)::BIGINT AS reached FROM c),
p AS (SELECT *, first_value(reached) OVER (ORDER BY pos) AS f, last_value(nullif(reached, 0) IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM r)
SELECT stage, n::BIGINT AS n, reached, CASE WHEN f > 0 THEN round_even(100.0::DOUBLE * reached / f, 1) ELSE 0.0::DOUBLE END AS pct_of_first,
  CASE WHEN pos = 0 THEN 100.0::DOUBLE WHEN coalesce(v, 0) > 0 THEN round_even(100.0::DOUBLE * reached / v, 1) ELSE 0.0::DOUBLE END AS pct_of_previous FROM p"""


def conversion_sets(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(lookup.small(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.select(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("offer"), (F.col("o_totalprice") > 200000).alias("interview"))
    return metrics.conversion_sets(rows, ["segment", "nation", "priority"], {"interview": F.col("interview"), "offer": F.col("offer")})


CONVERSION = """
WITH r AS (SELECT c_mktsegment AS segment, n_name AS nation, o_orderpriority AS priority, (o_orderstatus = 'F')::INT AS offer, (o_totalprice > 200000)::INT AS interview
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT CASE WHEN grouping(segment) = 0 THEN 'segment' WHEN grouping(nation) = 0 THEN 'nation' ELSE 'priority' END AS dimension, coalesce(segment, nation, priority, 'Unknown') AS value,
  count(*) AS n, sum(interview)::BIGINT AS interview, sum(offer)::BIGINT AS offer, round_even(100.0::DOUBLE * sum(interview) / count(*), 1) AS interview_rate, round_even(100.0::DOUBLE * sum(offer) / count(*), 1) AS offer_rate
FROM r GROUP BY GROUPING SETS ((segment), (nation), (priority))"""


def feature_importance(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return metrics.feature_importance(o, ["c_mktsegment", "o_orderpriority", "c_nationkey"], F.col("o_orderstatus") == "F")


IMPORTANCE = """
WITH o AS (SELECT c_mktsegment, o_orderpriority, c_nationkey::VARCHAR AS c_nationkey, (o_orderstatus = 'F')::INT AS f FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT 'c_mktsegment' AS feature, c_mktsegment AS value, f FROM o UNION ALL SELECT 'o_orderpriority', o_orderpriority, f FROM o UNION ALL SELECT 'c_nationkey', c_nationkey, f FROM o),
g AS (SELECT feature, value, avg(f) AS rate FROM p GROUP BY 1, 2)
SELECT feature, count(*) AS n_values, round_even(max(rate) - min(rate), 4) AS importance FROM g GROUP BY feature"""


def calibration_ece(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("score", F.least(F.lit(100), F.floor(F.col("n_chars") / 60)))
    bands, error = metrics.calibration(docs, "score", "quality")
    return bands.crossJoin(F.broadcast(error.select("ece")))


ECE = """
WITH s AS (SELECT least(floor(least(100, floor(n_chars / 60)) / 10) * 10, 90)::BIGINT AS band, quality FROM documents JOIN labels USING (doc_id)),
b AS (SELECT band, count(*) AS n, (band + 5.0::DOUBLE) / 100 AS midpoint, avg(quality) AS observed FROM s GROUP BY band)
SELECT band, n, midpoint, round_even(observed, 4) AS observed, round_even(sum(n * abs(observed - midpoint)) OVER () / sum(n) OVER (), 4) AS ece FROM b"""


def score_metrics(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 5000).cast("long").alias("score"))
    return lookup.nearest_rank(o, ["o_orderpriority"], "score", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95})


SCORE_METRICS = """
WITH s AS (SELECT o_orderpriority, floor(o_totalprice / 5000)::BIGINT AS score FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM s)
SELECT o_orderpriority, count(*) AS n, max(score) FILTER (i = round_even(0.5::DOUBLE * (n - 1), 0)) AS p50, max(score) FILTER (i = round_even(0.75::DOUBLE * (n - 1), 0)) AS p75,
  max(score) FILTER (i = round_even(0.9::DOUBLE * (n - 1), 0)) AS p90, max(score) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95 FROM r GROUP BY o_orderpriority"""


def score_histogram(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_totalprice") / 5000).alias("score"))
    return metrics.histogram(o, "score", [0, 35, 50, 70, 80, 90]).select(F.col("bin").cast("long").alias("bin"), "low", "n")


HISTOGRAM = """WITH e(bin, low, high) AS (VALUES (0, 0.0, 35.0), (1, 35.0, 50.0), (2, 50.0, 70.0), (3, 70.0, 80.0), (4, 80.0, 90.0), (5, 90.0, 1e18))
SELECT bin::BIGINT AS bin, low::DOUBLE AS low, (SELECT count(*) FROM orders WHERE o_totalprice / 5000 >= low AND o_totalprice / 5000 < high)::BIGINT AS n FROM e"""


def salary_percentiles(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return metrics.benchmark(o, ["c_mktsegment", "c_nationkey"], "o_totalprice")


SALARY = """SELECT c_mktsegment, c_nationkey, count(*) AS n, round_even(quantile_cont(o_totalprice, 0.25), 4) AS p25, round_even(quantile_cont(o_totalprice, 0.5), 4) AS p50,
  round_even(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0 GROUP BY 1, 2"""


def _snapshots(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("p_type", F.trunc("l_shipdate", "year").alias("year")).agg(F.count(F.lit(1)).alias("demand"))


def demand_growth(spark, sf_dir):
    return metrics.growth(_snapshots(spark, sf_dir), ["p_type"], "year", "demand")


SNAP = "s AS (SELECT p_type, date_trunc('year', l_shipdate)::DATE AS year, count(*) AS demand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
GROWTH = f"""WITH {SNAP}, g AS (SELECT p_type, arg_min(demand, year) AS first, arg_max(demand, year) AS last, count(*) AS n FROM s GROUP BY 1)
SELECT p_type, first, last, round_even(CASE WHEN n < 2 THEN 0.0::DOUBLE WHEN first = 0 THEN last ELSE (last - first) / first::DOUBLE END, 4) AS growth FROM g"""


def emerging_items(spark, sf_dir):
    return metrics.emerging(_snapshots(spark, sf_dir), "year", "p_type", "demand", -0.7)


EMERGING = f"""WITH {SNAP}, e AS (SELECT min(year) AS t0, max(year) AS t1 FROM s),
g AS (SELECT p_type, coalesce(sum(demand) FILTER (year = t0), 0) AS f, sum(demand) FILTER (year = t1) AS l FROM s, e WHERE year = t0 OR year = t1 GROUP BY 1)
SELECT * FROM (SELECT p_type, f::BIGINT AS first, l::BIGINT AS last, round_even(CASE WHEN f = 0 THEN l ELSE (l - f) / f::DOUBLE END, 4) AS growth FROM g WHERE l IS NOT NULL) WHERE growth >= -0.7"""


def cost_rollup(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return metrics.cost_rollup(lines, ["l_suppkey", "l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")


COST = """
SELECT CASE WHEN grouping(s) = 0 THEN 'l_suppkey' WHEN grouping(f) = 0 THEN 'l_returnflag' WHEN grouping(t) = 0 THEN 'l_linestatus' ELSE 'total' END AS dimension,
  coalesce(s, f, t, 'all') AS value, count(*) AS calls, round_even(sum(l_quantity), 2) AS tokens, round_even(sum(l_extendedprice), 2) AS cost
FROM (SELECT l_suppkey::VARCHAR AS s, l_returnflag AS f, l_linestatus AS t, l_quantity, l_extendedprice FROM lineitem) GROUP BY GROUPING SETS ((s), (f), (t), ())"""


def cost_monthly(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("calls"), F.bround(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("cost"))


MONTHLY = "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS calls, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS cost FROM lineitem GROUP BY 1"


def quota_check(spark, sf_dir):
    quotas = spark.createDataFrame([("view", 900), ("click", 1_000_000), ("error", 10)], "event_type string, limit long")
    usage = read(spark, sf_dir, "events").select("event_type", F.lit(1).alias("one"))
    return metrics.quota_check(usage, quotas, ["event_type"], "one")


QUOTA = """WITH q(event_type, "limit") AS (VALUES ('view', 900), ('click', 1000000), ('error', 10)), u AS (SELECT event_type, count(*) AS used FROM events GROUP BY 1)
SELECT u.event_type, used, "limit"::BIGINT AS "limit", "limit" IS NULL OR used < "limit" AS allowed FROM u LEFT JOIN q ON u.event_type = q.event_type"""


def budget_running(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value is not null")
    return metrics.running_budget(e, "user_id", ["ts", "event_id"], "value", 2000.0).select("event_id", "spent", "utilisation", "state")


BUDGET = """WITH s AS (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS t FROM events WHERE value IS NOT NULL)
SELECT event_id, round_even(t, 2) AS spent, round_even(t / 2000.0::DOUBLE, 6) AS utilisation, CASE WHEN round_even(t / 2000.0::DOUBLE, 6) >= 1 THEN 'exceeded' WHEN round_even(t / 2000.0::DOUBLE, 6) >= 0.8 THEN 'warn' ELSE 'ok' END AS state FROM s"""


def provider_health(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    errors = F.sum((F.col("event_type") == "error").cast("long"))
    out = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), errors.alias("errors"))
    rate = F.bround(F.col("errors") / F.col("calls"), 4)
    return out.withColumns({"error_rate": rate, "failover": rate >= 0.5})


HEALTH = "SELECT user_id, count(*) AS calls, sum((event_type = 'error')::INT)::BIGINT AS errors, round_even(avg((event_type = 'error')::INT), 4) AS error_rate, round_even(avg((event_type = 'error')::INT), 4) >= 0.5 AS failover FROM events GROUP BY 1"


def feedback_acceptance(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    a = metrics.acceptance(e, "day", "event_type", ["purchase", "signup", "click"], ["error"])
    return a.join(metrics.feedback_weights(e, "day", "event_type", ["purchase", "signup"], ["error"]), "day")


ACCEPTANCE = """WITH g AS (SELECT ts::DATE AS day, sum((event_type IN ('purchase', 'signup', 'click'))::INT) AS p, sum((event_type = 'error')::INT) AS q,
  5.0::DOUBLE * (sum((event_type IN ('purchase', 'signup'))::INT) - sum((event_type = 'error')::INT)) AS weight FROM events GROUP BY 1)
SELECT day, p::BIGINT AS positives, q::BIGINT AS negatives, CASE WHEN p + q > 0 THEN round_even(p / (p + q)::DOUBLE, 4) ELSE 0.0::DOUBLE END AS rate, weight FROM g"""


# ------------------------------------------------------------------ vectors and conversations
def embedding_centroid(spark, sf_dir):
    c = vectors.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.bround("x", 5).alias("x"))


CENTROID = """
WITH u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
p AS (SELECT label, unnest(range(0, 64)) AS i, unnest(v) AS x FROM u), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT label, i::INT AS i, round_even(x / n, 5) AS x FROM m JOIN n USING (label)"""


def sim_calibration(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    c = vectors.centroids(e.where("label = 0"), "label", "embedding").select("centroid")  # one row
    sims = e.crossJoin(F.broadcast(c)).select("vec_id", vectors.cosine(F.col("embedding"), F.col("centroid")).alias("s"))
    bounds = vectors.similarity_bounds(sims, "s")
    out = sims.crossJoin(F.broadcast(bounds))
    return out.select("vec_id", F.bround("floor", 5).alias("floor"), F.bround("ceil", 5).alias("ceil"), vectors.similarity_score(F.col("s"), F.col("floor"), F.col("ceil")).alias("score"))


SIM = """
WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
p AS (SELECT unnest(range(0, 64)) AS i, unnest(v) AS x FROM u WHERE label = 0), m AS (SELECT i, avg(x) AS x FROM p GROUP BY 1), c AS (SELECT list(x ORDER BY i) AS c FROM m),
s AS (SELECT vec_id, list_dot_product(v, c) / sqrt(list_dot_product(c, c)) AS s FROM u, c), b AS (SELECT quantile_cont(s, 0.1) AS lo, quantile_cont(s, 0.9) AS hi FROM s)
SELECT vec_id, round_even(lo, 5) AS floor, round_even(hi, 5) AS ceil, round_even((least(greatest(s, lo), hi) - lo) / (hi - lo) * 25, 0)::INT AS score FROM s, b"""


def vector_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return vectors.top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", 5).select("query", "id", "similarity", F.col("rank").cast("long").alias("rank"))


TOPK_VECTORS = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, e.vec_id AS id, round_even(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS similarity FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 5"""


def bow_neighbours(spark, sf_dir):
    return vectors.bow_neighbours(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 0.1)


BOW = """
WITH w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS token FROM conversations),
t AS (SELECT conv_id, turn, token, count(*) AS tf FROM w WHERE token <> '' GROUP BY 1, 2, 3), n AS (SELECT conv_id, turn, sqrt(sum(tf * tf)) AS l FROM t GROUP BY 1, 2),
d AS (SELECT a.conv_id, a.turn, b.turn AS other, sum(a.tf * b.tf) AS d FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.token = b.token AND b.turn < a.turn GROUP BY 1, 2, 3),
s AS (SELECT d.conv_id, d.turn, other, round_even(d.d / (x.l * y.l), 6) AS similarity FROM d JOIN n x ON x.conv_id = d.conv_id AND x.turn = d.turn JOIN n y ON y.conv_id = d.conv_id AND y.turn = other)
SELECT conv_id, turn, other AS best, similarity FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY similarity DESC, other DESC) AS r FROM s WHERE similarity >= 0.1) WHERE r = 1"""


def recent_window(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return ranking.recent(c.select("conv_id", "turn", "role"), ["conv_id"], "turn", 2)


RECENT = "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2"


def history_compress(spark, sf_dir):
    out = ranking.compress_history(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", keep=2, over=3, limit=200)
    return out.select("conv_id", "n", F.sha2("summary", 256).alias("summary_sha256"))


COMPRESS = """
WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
g AS (SELECT conv_id, max(n) AS n, coalesce(string_agg(role || ': ' || text, ' ' ORDER BY turn) FILTER (n > 3 AND r > 2), '') AS s FROM m GROUP BY conv_id)
SELECT conv_id, n, sha256(CASE WHEN length(s) > 200 THEN s[1:200] || '…' ELSE s END) AS summary_sha256 FROM g"""


def precision_ndcg(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return ranking.precision_ndcg_at(docs.withColumn("good", F.col("quality") == 0), "source", [F.desc("n_chars"), F.asc("doc_id")], "good", 5)


NDCG = """
WITH r AS (SELECT source, quality = 0 AS good, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)),
g AS (SELECT source, sum((good AND rank <= 5)::INT) AS hits, sum(CASE WHEN good AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(good::INT) AS rel FROM r GROUP BY 1)
SELECT source, round_even(hits / 5.0::DOUBLE, 4) AS precision_at_k, round_even(CASE WHEN rel > 0 THEN dcg / list_sum(list_transform(range(1, (least(rel, 5) + 1)::BIGINT), lambda i: 1 / log2(i + 1))) ELSE 0.0 END, 4)::DOUBLE AS ndcg_at_k FROM g"""


# ------------------------------------------------------------------ experiments and learning
def ab_assign(spark, sf_dir):
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    unit = F.col("user_id").cast("string")
    v = ["control", "a", "b"]
    return users.select("user_id", metrics.assign_scaled(unit, "exp1", v).alias("scaled"), metrics.assign_modulo(unit, "exp1", v).alias("modulo"))


HASH = "('0x' || sha256({})[1:8])::BIGINT"
ASSIGN = f"""WITH u AS (SELECT DISTINCT user_id, {HASH.format("'exp1:' || user_id::VARCHAR")} AS h FROM events)
SELECT user_id, ['control', 'a', 'b'][least(floor(h / 4294967295.0::DOUBLE * 3), 2)::INT + 1] AS scaled, ['control', 'a', 'b'][(h % 3)::INT + 1] AS modulo FROM u"""


def ab_winner(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    v = metrics.assign_modulo(F.col("user_id").cast("string"), "exp1", ["control", "a", "b"])
    rows = e.select(F.lit("exp1").alias("experiment"), v.alias("variant"), (F.col("event_type") == "purchase").cast("double").alias("value"))
    return metrics.winner(metrics.experiment_results(rows, ["experiment", "variant"], "value"), "experiment", "variant", 5)


WINNER = f"""
WITH r AS (SELECT ['control', 'a', 'b'][({HASH.format("'exp1:' || user_id::VARCHAR")} % 3)::INT + 1] AS variant, round_even(avg((event_type = 'purchase')::INT), 4) AS mean FROM events GROUP BY 1 HAVING count(*) >= 5)
SELECT 'exp1' AS experiment, (SELECT variant FROM r ORDER BY mean DESC, variant DESC LIMIT 1) AS winner, max(mean) AS rate, CASE WHEN min(mean) <> 0 THEN round_even((max(mean) - min(mean)) / min(mean), 4) END AS lift, count(*) AS variants FROM r"""


def rollout_flags(spark, sf_dir):
    flags = spark.createDataFrame([("new-ui", 30, False, None), ("dead", 100, True, True), ("forced", 0, False, True)], "flag string, rollout int, killed boolean, forced boolean")
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return metrics.rollout(F.col("user_id"), flags, users, "unit")


FLAGS = f"""WITH f(flag, rollout, killed, forced) AS (VALUES ('new-ui', 30, false, NULL::BOOLEAN), ('dead', 100, true, true), ('forced', 0, false, true)), u AS (SELECT DISTINCT user_id::VARCHAR AS unit FROM events)
SELECT unit, flag, CASE WHEN killed THEN false ELSE coalesce(forced, {HASH.format("flag || ':' || unit")} % 100 < rollout) END AS enabled FROM u, f"""


def bandit_posteriors(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("arm"), (F.col("event_type") == "purchase").cast("long").alias("reward"))
    return metrics.bandit_posteriors(e, "arm", "reward")


BANDIT = """WITH g AS (SELECT user_id % 5 AS arm, count(*) AS pulls, sum((event_type = 'purchase')::INT)::BIGINT AS w FROM events GROUP BY 1)
SELECT arm, pulls, round_even(w / pulls::DOUBLE, 4) AS mean, 1 + w AS alpha, 1 + pulls - w AS beta FROM g"""


def _features(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    symbols = F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#$%&*!|]", ""))
    return docs.select("quality", "n_chars", (symbols / F.col("n_chars")).alias("symbol_share"), F.lit(1).alias("constant"), F.floor(F.col("n_chars") / 100).alias("score"))


def ltr_weights(spark, sf_dir):
    return metrics.correlation_weights(_features(spark, sf_dir), ["n_chars", "symbol_share", "constant"], "quality")


FEATURES = """f AS (SELECT quality, n_chars, length(regexp_replace(text, '[^#$%&*!|]', '', 'g')) / n_chars::DOUBLE AS symbol_share, floor(n_chars / 100) AS score FROM documents JOIN labels USING (doc_id))"""
LTR = f"""WITH {FEATURES} SELECT 'n_chars' AS feature, round_even(corr(n_chars, quality), 4) AS weight FROM f UNION ALL SELECT 'symbol_share', round_even(corr(symbol_share, quality), 4) FROM f UNION ALL SELECT 'constant', 0.0::DOUBLE"""


def ltr_pairwise(spark, sf_dir):
    return metrics.pairwise_accuracy(_features(spark, sf_dir), "score", "quality")


PAIRWISE = f"""WITH {FEATURES} SELECT round_even(avg((p.score > n.score)::INT), 4) AS accuracy, count(*) AS pairs FROM f p JOIN f n ON p.quality = 1 AND n.quality = 0"""


# ------------------------------------------------------------------ graph
def _trade(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = lines.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("src", "dst", (1 + F.col("n") % 17).cast("double").alias("cost"))


def shortest_path(spark, sf_dir):
    start = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    return graph.shortest_paths(_trade(spark, sf_dir), start).select("source", "node", "cost")


TRADE = """e AS (SELECT s_nationkey AS src, c_nationkey AS dst, (1 + count(*) % 17)::DOUBLE AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
# Two passes of all nodes between (Floyd and Warshall's algorithm, a row of the recursion for each node between).
PATHS = f"""WITH RECURSIVE {TRADE}, n AS (SELECT n_nationkey AS k FROM nation),
d0 AS (SELECT a.k AS s, b.k AS t, CASE WHEN a.k = b.k THEN 0.0::DOUBLE ELSE e.cost END AS c FROM n a CROSS JOIN n b LEFT JOIN e ON e.src = a.k AND e.dst = b.k),
m AS (SELECT -1 AS k, map_from_entries(list((s * 1000 + t, c))) AS d FROM d0
  UNION ALL SELECT m.k + 1, map_from_entries(list_transform(map_entries(m.d), lambda x: (x.key, list_min([x.value, m.d[(x.key // 1000) * 1000 + m.k + 1] + m.d[(m.k + 1) * 1000 + x.key % 1000]])))) FROM m WHERE m.k < (SELECT max(k) FROM n))
SELECT x.key // 1000 AS source, x.key % 1000 AS node, x.value AS cost FROM (SELECT unnest(map_entries(d)) AS x FROM m WHERE k = (SELECT max(k) FROM n)) WHERE x.value IS NOT NULL"""


def _prerequisites(spark, sf_dir) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    return part.where("src > 1").select("src", F.floor(F.col("src") / (2 + F.col("src") % 3)).cast("long").alias("dst")).where("dst >= 1 and dst < src")


def prereq_closure(spark, sf_dir):
    return graph.closure(_prerequisites(spark, sf_dir)).select("node", "reaches")


PREREQ = "e AS (SELECT p_partkey AS src, p_partkey // (2 + p_partkey % 3) AS dst FROM part WHERE p_partkey > 1 AND p_partkey // (2 + p_partkey % 3) >= 1)"
CLOSURE = f"WITH RECURSIVE {PREREQ}, c AS (SELECT src AS node, dst AS reaches FROM e UNION SELECT node, dst FROM c JOIN e ON reaches = src) SELECT node, reaches FROM c"


def dependency_levels(spark, sf_dir):
    done, cyclic = graph.levels(_prerequisites(spark, sf_dir))
    return done.unionByName(cyclic.select("node", F.lit(-1).alias("level")))


LEVELS = f"""WITH RECURSIVE {PREREQ}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), l AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT src FROM e)
  UNION ALL SELECT src, level + 1 FROM l JOIN e ON l.node = e.dst) SELECT node, max(level) AS level FROM l GROUP BY node"""


# ------------------------------------------------------------------ events and lifecycle
def event_dedup(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("key", F.when(F.col("user_id") % 10 != 0, F.concat_ws(":", "user_id", F.to_date("ts"))))
    once = merge.first_per_key(e.where("key is not null"), ["event_type", "key"], "event_id").select("event_id", "event_type")
    return once.unionByName(e.where("key is null").select("event_id", "event_type"))


EVENT_DEDUP = """SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, ts::DATE ORDER BY event_id) AS r FROM events) WHERE r = 1 OR user_id % 10 = 0"""


def partition_offsets(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return merge.rank_in_partitions(e, text.hash_bucket(F.col("user_id").cast("string")), "event_id", 4).select("event_id", "partition", F.col("offset").cast("long").alias("offset"))


OFFSETS = f"""WITH p AS (SELECT event_id, {HASH.format("user_id::VARCHAR")} % 4 AS partition FROM events) SELECT event_id, partition, row_number() OVER (PARTITION BY partition ORDER BY event_id) - 1 AS "offset" FROM p"""


def consumer_lag(spark, sf_dir):
    heads = partition_offsets(spark, sf_dir).groupBy("partition").agg((F.max("offset") + 1).alias("head"))
    commits = spark.createDataFrame([(0, 100), (1, 0), (2, 50)], "partition long, committed long")
    return heads.join(F.broadcast(commits), "partition", "left").select("partition", "head", (F.col("head") - F.coalesce("committed", F.lit(0))).alias("lag"))


LAG = f"""WITH h AS (SELECT {HASH.format("user_id::VARCHAR")} % 4 AS partition, count(*) AS head FROM events GROUP BY 1), c(partition, committed) AS (VALUES (0, 100), (1, 0), (2, 50))
SELECT h.partition, head, head - coalesce(committed, 0) AS lag FROM h LEFT JOIN c ON h.partition = c.partition"""


def dlq_split(spark, sf_dir):
    from talus.streaming import events

    good, bad = events.split_poison(read(spark, sf_dir, "events"), "props", "k int", poison=F.col("event_type") == "error")
    return good.select("event_id", F.lit("ok").alias("topic"), F.col("parsed.k").cast("long").alias("k")).unionByName(bad.select("event_id", F.lit("events.DLQ").alias("topic"), F.lit(None).cast("long").alias("k")))


DLQ = """SELECT event_id, CASE WHEN event_type = 'error' THEN 'events.DLQ' ELSE 'ok' END AS topic, CASE WHEN event_type <> 'error' THEN (props->>'k')::BIGINT END AS k FROM events"""


def tumbling_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


TUMBLING = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def sliding_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


SLIDING = "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1"


def session_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    g = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""


def retention_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    _, counts = merge.retention(e, "ts", F.lit("2024-01-25").cast("timestamp_ntz"), 14)
    return counts


RETENTION = "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-25' - INTERVAL 14 DAY) AS kept, count(*) FILTER (ts < TIMESTAMP '2024-01-25' - INTERVAL 14 DAY) AS deleted FROM events"


def tenant_erase(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("tenant_id"))
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "tenant_id")
    _, counts = merge.erase_tenant({"customer": c, "orders": o}, "tenant_id", "BUILDING")
    return counts


ERASE = """SELECT 'customer' AS "table", count(*) AS deleted FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL
SELECT 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"""


def month_plan(spark, sf_dir):
    parts = merge.month_partitions(read(spark, sf_dir, "orders"), "o_orderdate")
    old = merge.expired_partitions(parts, F.lit("1996-02-15").cast("date"), 3).select("name", F.lit(True).alias("expired"))
    return parts.join(old, "name", "left").select("name", "year", "month", F.coalesce("expired", F.lit(False)).alias("expired"))


MONTHS = """WITH m AS (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate))::TIMESTAMP, date_trunc('month', max(o_orderdate))::TIMESTAMP + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m FROM orders)
SELECT strftime(m, 'p%Y_%m') AS name, year(m)::INT AS year, month(m)::INT AS month, m < TIMESTAMP '1995-11-01' AS expired FROM m"""


def checksum_verify(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    # As many partitions as the session has: a fixed number would grow with the table.
    return merge.verify_copy(lines, lines.repartition("l_partkey"))


CHECKSUM = "SELECT count(*) AS n_source, count(*) AS n_copy, true AS same_count, true AS same_rows FROM lineitem"

QUERIES = {
    "fingerprint_dedup": (fingerprint_dedup, FINGERPRINT), "two_key_dedup": (two_key_dedup, TWO_KEY), "upsert_latest": (upsert_latest, UPSERT),
    "coalesce_update": (coalesce_update, COALESCE), "ensure_rows": (ensure_rows, ENSURE), "rejected_backfill": (rejected_backfill, BACKFILL), "version_latest": (version_latest, VERSION),
    "publish_versions": (publish_versions, PUBLISH), "status_changes": (status_changes, STATUS), "unscored_documents": (unscored_documents, UNSCORED),
    "jobs_per_day": (jobs_per_day, PER_DAY), "status_zero_fill": (status_zero_fill, ZERO), "funnel_cumulative": (funnel_cumulative, FUNNEL), "conversion_sets": (conversion_sets, CONVERSION),
    "feature_importance": (feature_importance, IMPORTANCE), "calibration_ece": (calibration_ece, ECE), "score_metrics": (score_metrics, SCORE_METRICS), "score_histogram": (score_histogram, HISTOGRAM),
    "salary_percentiles": (salary_percentiles, SALARY), "demand_growth": (demand_growth, GROWTH), "emerging_items": (emerging_items, EMERGING), "cost_rollup": (cost_rollup, COST),
    "cost_monthly": (cost_monthly, MONTHLY), "quota_check": (quota_check, QUOTA), "budget_running": (budget_running, BUDGET), "provider_health": (provider_health, HEALTH),
    "feedback_acceptance": (feedback_acceptance, ACCEPTANCE), "embedding_centroid": (embedding_centroid, CENTROID), "sim_calibration": (sim_calibration, SIM), "vector_topk": (vector_topk, TOPK_VECTORS),
    "bow_neighbours": (bow_neighbours, BOW), "recent_window": (recent_window, RECENT), "history_compress": (history_compress, COMPRESS), "precision_ndcg": (precision_ndcg, NDCG),
    "ab_assign": (ab_assign, ASSIGN), "ab_winner": (ab_winner, WINNER), "rollout_flags": (rollout_flags, FLAGS), "bandit_posteriors": (bandit_posteriors, BANDIT),
    "ltr_weights": (ltr_weights, LTR), "ltr_pairwise": (ltr_pairwise, PAIRWISE), "shortest_path": (shortest_path, PATHS), "prereq_closure": (prereq_closure, CLOSURE), "dependency_levels": (dependency_levels, LEVELS),
    "event_dedup": (event_dedup, EVENT_DEDUP), "partition_offsets": (partition_offsets, OFFSETS), "consumer_lag": (consumer_lag, LAG), "dlq_split": (dlq_split, DLQ),
    "tumbling_windows": (tumbling_windows, TUMBLING), "sliding_windows": (sliding_windows, SLIDING), "session_windows": (session_windows, SESSIONS), "retention_counts": (retention_counts, RETENTION),
    "tenant_erase": (tenant_erase, ERASE), "month_plan": (month_plan, MONTHS), "checksum_verify": (checksum_verify, CHECKSUM),
}
