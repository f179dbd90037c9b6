"""Driver queries over the composed views."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import views
from talus.plans.ranked import read


def _parts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("company"), F.col("o_orderdate").alias("day"))
    scores = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") * 7 % 101).alias("total_score"))
    applications = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    return jobs, scores, applications


def applications_overview(spark, sf_dir):
    jobs, scores, applications = _parts(spark, sf_dir)
    return views.applications_overview(applications, jobs, scores).select("job_id", "status", "company", "total_score")


OVERVIEW = "SELECT o_orderkey AS job_id, o_orderstatus AS status, o_custkey AS company, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 7 % 101 ELSE 0 END AS total_score FROM orders WHERE o_orderkey % 4 = 0"


def ranked_jobs_join(spark, sf_dir):
    return views.ranked_jobs(*_parts(spark, sf_dir)).select("job_id", "total_score", F.coalesce("status", F.lit("Not Started")).alias("status"))


RANKED = "SELECT o_orderkey AS job_id, o_orderkey * 7 % 101 AS total_score, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE 'Not Started' END AS status FROM orders WHERE o_orderkey % 3 <> 0"


def list_view(spark, sf_dir):
    """A page of a list view: the operator's own limit and offset."""
    jobs, scores, applications = _parts(spark, sf_dir)
    rows = views.ranked_jobs(jobs, scores, applications)
    page = views.list_view(rows, [F.col("total_score") >= 50, F.col("status").isNotNull()], "total_score", ["total_score", "day"], tie="job_id", offset=10, limit=20)
    return page.select("job_id", "total_score", "total")


LIST = """WITH r AS (SELECT o_orderkey AS job_id, o_orderkey * 7 % 101 AS total_score FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 AND o_orderkey * 7 % 101 >= 50)
SELECT job_id, total_score, (SELECT count(*) FROM r) AS total FROM r ORDER BY total_score DESC, job_id LIMIT 20 OFFSET 10"""


def headline_counts(spark, sf_dir):
    jobs, scores, applications = _parts(spark, sf_dir)
    return views.headline_counts({"jobs": (jobs, None), "companies": (jobs, "company"), "scores": (scores, None), "applications": (applications, None)})


HEADLINE = """SELECT 'jobs' AS name, count(*) AS n FROM orders UNION ALL SELECT 'companies', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'scores', count(*) FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 'applications', count(*) FROM orders WHERE o_orderkey % 4 = 0"""


def top_companies(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return views.best_per_key(o, "o_custkey", "o_totalprice", 10)


TOP = "SELECT o_custkey, max(o_totalprice) AS best, count(*) AS n FROM orders GROUP BY 1 ORDER BY best DESC, o_custkey LIMIT 10"


def stale_research(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    r = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("ts"))
    return views.stale_research(c, r, F.lit("1998-06-01").cast("timestamp_ntz"), 200)


STALE = """SELECT c_custkey AS job_id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE t IS NULL OR t < TIMESTAMP '1998-06-01' - INTERVAL 200 DAY"""


def learned_rank(spark, sf_dir):
    w = spark.createDataFrame([("l_quantity", 0.5), ("l_discount", -2.0)], "feature string, weight double")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    return views.learned_rank(lines, w, ["l_quantity", "l_discount"], "l_orderkey")


LEARNED = "SELECT l_orderkey, round_even(0.5::DOUBLE * max(l_quantity) - 2.0::DOUBLE * max(l_discount), 4) AS score FROM lineitem GROUP BY 1"


def last_non_null(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "click", F.col("value")).alias("clicked"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("failed"))
    return views.last_non_null(e, ["user_id"], "at")


LAST = """SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'click' AND value IS NOT NULL) AS clicked, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1"""


def merge_maps(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.create_map(F.col("event_type"), F.col("event_id")).alias("m"))
    return views.merge_maps(e, ["user_id"], "at", "m").select("user_id", F.explode("m").alias("kind", "event_id"))


MAPS = "SELECT user_id, event_type AS kind, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2"


def envelopes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    out = views.envelopes(e, F.col("event_type"), F.col("event_id").cast("string"), F.col("user_id").cast("string"), "ts")
    return out.select("event_id", "type", "version", "tenant_id", "idempotency_key", "created_at")


ENVELOPES = "SELECT sha256(event_type || ':' || event_id)[1:32] AS event_id, event_type AS type, 1 AS version, user_id::VARCHAR AS tenant_id, event_id::VARCHAR AS idempotency_key, ts AS created_at FROM events"


def status_history(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_type").alias("event_type"))
    return views.status_history(e, "user_id", "ts", "event_type").groupBy("event_type", "previous").agg(F.count(F.lit(1)).alias("n"), F.sum("lasted").alias("seconds"))


HISTORY = """WITH e AS (SELECT user_id, ts, min(event_type) AS s FROM events GROUP BY 1, 2), p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM e),
c AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM p WHERE p IS NULL OR p <> s)
SELECT s AS event_type, p AS previous, count(*) AS n, sum(epoch(date_trunc('second', n))::BIGINT - epoch(date_trunc('second', ts))::BIGINT)::BIGINT AS seconds FROM c GROUP BY 1, 2"""

QUERIES = {
    "applications_overview": (applications_overview, OVERVIEW), "ranked_jobs_join": (ranked_jobs_join, RANKED), "list_view": (list_view, LIST), "headline_counts": (headline_counts, HEADLINE),
    "top_companies": (top_companies, TOP), "stale_research": (stale_research, STALE), "learned_rank": (learned_rank, LEARNED), "last_non_null": (last_non_null, LAST),
    "merge_maps": (merge_maps, MAPS), "envelopes": (envelopes, ENVELOPES), "status_history": (status_history, HISTORY),
}
