"""Driver queries of the report tables and their checks, over orders as postings (survey A19,
B12, B14, B22, C6, C7, C29, D3, E13, E33, E37, G10, L8, L13, L14), with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talus.functions import gates, sentences, text
from talus.operators import compose, exports, lifecycle, merge
from talus.operators.graph import checkpoint_dir
from talus.plans.ranked import read

PLACES = ["Milano, Italy", "London", "Berlin", "Duke Street 1", "Remote - Europe", " Oslo ", "Nowhere", "", "New York, USA", "Amsterdam"]
CODES = ["it", "gb", "de", "gb", "eu", "eu", "eu", "eu", "eu", "nl"]
LABELS = ["Italy", "United Kingdom", "Germany", "United Kingdom", "Remote/EU", "Norway", "Nowhere", "Unknown", "New York, USA", "Netherlands"]
TITLES = ["Product Intern", "Senior Director", "Strategy Internship", "Data Engineer"]
TEXTS = ["English speaking team, hybrid work. " * 2, "Italian required for this role, fluent.", "German is a plus, but not required here.", "Fully remote position for analysts."]


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def _jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    score = (k * 37 % 101).cast("int")
    fields = {
        "job_id": k, "total_score": score, "priority_bucket": text.band(score, text.STRATEGIC_BUCKETS), "title": _pick(TITLES, k), "company": F.col("c_name"), "location": _pick(PLACES, k),
        "description": _pick(TEXTS, F.floor(k / 8)), "fetched_date": F.to_date("o_orderdate"), "posted_date": F.to_date("o_orderdate"), "role_category": F.col("c_mktsegment"), "visa_gate": _pick(["PASS", "FAIL", "OTHER"], k),
        "language_risk": _pick(["LOW", "MEDIUM", "HIGH"], F.floor(k / 4)), "url": F.concat(F.lit("http://x/"), k.cast("string")),
    }
    named = o.select(*[c.alias(n) for n, c in fields.items()])
    return named.withColumns({c: F.lit(None).cast("string") for c in exports.SCORED_COLUMNS if c not in fields})


def country_fields(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return j.select("job_id", exports.country_code(F.col("location")).alias("code"), exports.country_label(F.col("location")).alias("label"))


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
COUNTRIES = f"SELECT o_orderkey AS job_id, {_LIST(CODES)}[o_orderkey % 10 + 1] AS code, {_LIST(LABELS)}[o_orderkey % 10 + 1] AS label FROM orders"


def _applications(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("notes"), F.to_date("o_orderdate").alias("last_updated"))


def _tables(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    recommended = j.select("job_id", F.lit("Apply This Week").alias("recommendation"), F.col("job_id").alias("place"))
    return exports.report_tables(j, _applications(spark, sf_dir), recommended, ["it", "nl"], interns_only=True, reject_non_english=True)


def jobs_master(spark, sf_dir):
    """The dashboard's table: internships in or not clearly outside Italy and the Netherlands, whose text asks for no other language."""
    m = _tables(spark, sf_dir)["jobs_master"]
    return m.select(F.col("rank").cast("long").alias("rank"), *exports.MASTER_COLUMNS[1:])


# Of the titles the first and third are internships; of the places all but London, Berlin, Oslo and New York may
# stay; the second text asks for Italian.
JOBS = f"""j AS (SELECT o_orderkey AS job_id, (o_orderkey * 37 % 101)::INT AS total_score, {_LIST(TITLES)}[o_orderkey % 4 + 1] AS title, c_name AS company, {_LIST(PLACES)}[o_orderkey % 10 + 1] AS location,
  {_LIST(LABELS)}[o_orderkey % 10 + 1] AS country, o_orderkey // 8 % 4 AS t, o_orderdate::DATE AS fetched_date, c_mktsegment AS role_category, ['Likely', 'No', 'Unknown'][o_orderkey % 3 + 1] AS sponsorship,
  o_orderkey // 4 % 3 AS risk, 'http://x/' || o_orderkey AS url, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT *, row_number() OVER (ORDER BY total_score DESC, fetched_date DESC, job_id DESC) AS rank FROM j WHERE o_kept)"""
KEPT = "o_orderkey % 4 IN (0, 2) AND o_orderkey % 10 NOT IN (1, 2, 5, 8) AND o_orderkey // 8 % 4 <> 1 AND o_orderkey // 4 % 3 <> 2"
JOBS = JOBS.replace("o_orderpriority FROM orders", f"o_orderpriority, {KEPT} AS o_kept FROM orders")
BANDS = "CASE WHEN total_score >= 90 THEN 'Apply Now' WHEN total_score >= 80 THEN 'This Week' WHEN total_score >= 70 THEN 'Good Match' ELSE 'Low Priority' END"
MODE = "CASE WHEN t = 0 THEN 'Hybrid' WHEN t = 3 OR location LIKE '%Remote%' THEN 'Remote' ELSE 'On-site' END"
MASTER = f"""WITH {JOBS} SELECT rank, total_score, {BANDS} AS application_priority, company, title, location, country, {MODE} AS work_mode, sponsorship, role_category,
  CASE WHEN job_id % 3 = 0 THEN o_orderstatus ELSE 'Not Started' END AS application_status, fetched_date, url, CASE WHEN job_id % 3 = 0 THEN o_orderpriority ELSE '' END AS notes FROM m"""


def report_sheets(spark, sf_dir):
    """The sheets of the report by name, with what they hold: rows, the sum of their scores or counts."""
    tables = _tables(spark, sf_dir)
    out = None
    for name, df in tables.items():
        number = "n" if "n" in df.columns else "total_score"
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col(number).cast("long")), F.lit(0)).alias("total")).select(F.lit(name).alias("sheet"), "rows", "total")
        out = one if out is None else out.unionByName(one)
    return out


SHEETS = f"""WITH {JOBS}, a AS (SELECT * FROM j WHERE job_id % 3 = 0)
SELECT 'scored_jobs' AS sheet, count(*) AS rows, sum(total_score)::BIGINT AS total FROM j UNION ALL SELECT 'jobs_master', count(*), sum(total_score)::BIGINT FROM m
UNION ALL SELECT 'apply_now', count(*), sum(total_score)::BIGINT FROM m WHERE total_score >= 90 UNION ALL SELECT 'this_week', count(*), sum(total_score)::BIGINT FROM m WHERE total_score BETWEEN 80 AND 89
UNION ALL SELECT 'applications', count(*), sum(total_score)::BIGINT FROM a
UNION ALL SELECT 'analytics', (SELECT count(DISTINCT o_orderstatus) FROM a) + (SELECT count(DISTINCT country) FROM m), (SELECT count(*) FROM a) + (SELECT count(*) FROM m)
UNION ALL SELECT 'summary', 7, 2 * count(*) FROM j"""


def acquisition_gates(spark, sf_dir):
    """The search agent's chain over titles, places and texts: the first gate that stops a posting, else the key that
    knows it, else that it is inserted."""
    j = _jobs(spark, sf_dir)
    senior = gates.seniority(F.col("title"), F.col("description"))
    place = gates.geography(F.col("location"))
    language = gates.language_gate(F.col("description"))
    judged = j.withColumns({"s": senior, "g": place, "l": language})
    reasons = [("excluded", gates.excluded_keyword(F.col("title"), ["director"]).isNotNull()), ("seniority", ~F.col("s.ok")), ("geography", ~F.col("g.ok")), ("language", ~F.col("l.ok"))]
    hashed = text.fingerprint(text.norm_token(F.col("company")), text.norm_token(F.col("title")), exports.country_code(F.col("location")))
    return compose.acquire(judged, reasons, [("duplicate", hashed)], "job_id").select("job_id", "outcome")


# Directors are excluded; of the other titles engineers have no sign of a junior post. Of the places Nowhere and New
# York are rejected (a blank one stays); the second text asks for Italian.
ACQUIRE = f"""WITH j AS (SELECT o_orderkey AS job_id, c_name, o_orderkey % 4 AS t, {_LIST(CODES)}[o_orderkey % 10 + 1] AS code, o_orderkey % 10 AS p, o_orderkey // 8 % 4 AS x FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT *, CASE WHEN t = 1 THEN 'excluded' WHEN t = 3 THEN 'seniority' WHEN p IN (3, 6, 8) THEN 'geography' WHEN x = 1 THEN 'language' END AS stopped FROM j),
f AS (SELECT c_name, t, code, min(job_id) AS first FROM r WHERE stopped IS NULL GROUP BY ALL)
SELECT job_id, coalesce(stopped, CASE WHEN job_id > first THEN 'duplicate' END, 'inserted') AS outcome FROM r LEFT JOIN f USING (c_name, t, code)"""


def score_offenders(spark, sf_dir):
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", (k % 120).alias("total_score"), (k % 103 - 1).alias("role_fit"), F.when(k % 50 > 0, 5).alias("skills_match"), F.lit(100).alias("location_fit"), F.lit(0).alias("seniority_fit"))
    return exports.score_offenders(o, "o_orderkey", exports.SCORES)


OFFENDERS = """SELECT o_orderkey, concat_ws(', ', CASE WHEN o_orderkey % 120 > 100 THEN 'total_score=' || o_orderkey % 120 END, CASE WHEN o_orderkey % 103 - 1 NOT BETWEEN 0 AND 100 THEN 'role_fit=' || (o_orderkey % 103 - 1) END,
  CASE WHEN o_orderkey % 50 = 0 THEN 'skills_match=null' END) AS offenders FROM orders WHERE o_orderkey % 120 > 100 OR o_orderkey % 103 - 1 NOT BETWEEN 0 AND 100 OR o_orderkey % 50 = 0"""


def geography_audit(spark, sf_dir):
    return exports.geography_audit(_jobs(spark, sf_dir)).drop("company")


AUDIT = f"""WITH {JOBS} SELECT job_id, title, location, CASE WHEN total_score >= 85 THEN 'Apply Immediately' WHEN total_score >= 70 THEN 'High Priority' WHEN total_score >= 50 THEN 'Medium Priority' WHEN total_score >= 35 THEN 'Low Priority' ELSE 'Ignore' END AS current_bucket,
  CASE location WHEN 'New York, USA' THEN 'non_eu' ELSE 'unknown_reject' END AS rejection_reason, total_score FROM j WHERE location IN ('Duke Street 1', 'Nowhere', 'New York, USA')"""


def run_statistics(spark, sf_dir):
    j = _jobs(spark, sf_dir).withColumn("reason", gates.geography(F.col("location"))["reason"])
    return exports.run_statistics(j, ["reason", "role_category", "priority_bucket"], "total_score")


STATISTICS = f"""WITH {JOBS}, s AS (SELECT total_score AS s, role_category, ['eu', 'eu', 'eu', 'unknown_reject', 'eu', 'eu', 'unknown_reject', 'no_location', 'non_eu', 'eu'][job_id % 10 + 1] AS reason,
  CASE WHEN total_score >= 85 THEN 'Apply Immediately' WHEN total_score >= 70 THEN 'High Priority' WHEN total_score >= 50 THEN 'Medium Priority' WHEN total_score >= 35 THEN 'Low Priority' ELSE 'Ignore' END AS bucket FROM j)
SELECT 'reason' AS dimension, reason AS value, count(*) AS n, floor(avg(s))::BIGINT AS mean_score FROM s GROUP BY 2 UNION ALL SELECT 'role_category', role_category, count(*), floor(avg(s))::BIGINT FROM s GROUP BY 2
UNION ALL SELECT 'priority_bucket', bucket, count(*), floor(avg(s))::BIGINT FROM s GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*), floor(avg(s))::BIGINT FROM s"""


def document_metrics(spark, sf_dir):
    """Lines as generated documents: their type by the return flag, their version by the line."""
    return exports.document_metrics(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", {"resumes_generated": "R", "cover_letters_generated": "A"})


DOCUMENTS = """SELECT 'resumes_generated' AS metric, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'cover_letters_generated', count(*) FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT 'total', count(*) FROM lineitem UNION ALL SELECT 'reused_versions', count(*) FROM lineitem WHERE l_linenumber > 1"""


def watchlist_flags(spark, sf_dir):
    """Customers whose name, with a legal suffix, is on the list of those with a good balance."""
    c = read(spark, sf_dir, "customer")
    watched = c.where("c_acctbal > 5000").select(F.concat("c_name", F.lit(" GmbH")).alias("name"))
    return exports.on_watchlist(c.select("c_custkey", F.upper("c_name").alias("company")), "company", watched, "name").select("c_custkey", "watched")


WATCHED = "SELECT c_custkey, lower(c_name) IN (SELECT lower(c_name) FROM customer WHERE c_acctbal > 5000) AS watched FROM customer"

def match_explanations(spark, sf_dir):
    """Parts as matches: reasons by their coverage, demand and gaps."""
    k = F.col("p_partkey")
    gaps = F.slice(F.array(*[F.lit(x) for x in ("sql", "go", "rust", "excel", "r")]), 1, (k % 6).cast("int"))
    reasons = F.when(k % 7 > 0, sentences.match_reasons((k % 201) / 200, k % 4, gaps))
    return read(spark, sf_dir, "part").select("p_partkey", sentences.explain(reasons, F.col("p_name"), (k % 201) / 2).alias("explanation"))


EXPLAIN = """WITH p AS (SELECT p_partkey AS k, p_name, ['sql', 'go', 'rust', 'excel', 'r'][1:p_partkey % 6] AS g FROM part)
SELECT k AS p_partkey, CASE WHEN k % 7 = 0 THEN 'Recommended ' || p_name || ' (score ' || round_even(k % 201 / 2.0::DOUBLE, 0)::INT || '/100).' ELSE
  concat_ws(' ', round_even(k % 201 / 200.0::DOUBLE * 100, 0)::INT || '% skill-match with the role.', CASE WHEN k % 4 > 0 THEN 'Strong market demand (' || k % 4 || ' recent postings).' END,
  CASE WHEN k % 6 = 0 THEN 'No remaining skill gaps — apply-ready.' ELSE k % 6 || ' skill gap(s) to close: ' || array_to_string(g[1:3], ', ') || '.' END) END AS explanation FROM p"""


def plan_summary(spark, sf_dir):
    """Orders as recommendations, customers as prioritised roles, parts as planned ones."""
    kinds = sentences.KINDS + ["OTHER"]
    r = read(spark, sf_dir, "orders").select(_pick(kinds, F.col("o_orderkey")).alias("kind"))
    p = read(spark, sf_dir, "customer").select((1 + F.col("c_custkey") % 4).alias("tier"))
    w = read(spark, sf_dir, "part").select(_pick(["this_week", "next_week", "later"], F.col("p_partkey")).alias("slot"))
    return sentences.plan_summary(r, p, w)


SUMMARY = """WITH o AS (SELECT o_orderkey % 6 AS k FROM orders), c AS (SELECT c_custkey % 4 AS t FROM customer), p AS (SELECT p_partkey % 3 AS s FROM part)
SELECT (SELECT count(*) FROM o) || ' recommendations: ' || (SELECT count(*) FROM c WHERE t = 0) || ' Tier-1, ' || (SELECT count(*) FROM c WHERE t = 1) || ' Tier-2, ' || (SELECT count(*) FROM c WHERE t > 1) || ' Tier-3. '
  || (SELECT count(*) FROM p WHERE s = 0) || ' role(s) planned this week, ' || (SELECT count(*) FROM p WHERE s = 1) || ' next week.' AS application_status,
  'Focus: ' || (SELECT count(*) FROM o WHERE k = 0) || ' apply-immediately, ' || (SELECT count(*) FROM o WHERE k = 1) || ' apply-this-week, ' || (SELECT count(*) FROM o WHERE k = 2) || ' stretch, ' || (SELECT count(*) FROM o WHERE k = 3) || ' monitor.' AS recommended_focus"""


def tenant_writes(spark, sf_dir):
    """Two tenants' orders written under their name, one of them twice: what the first one reads."""
    o, path = read(spark, sf_dir, "orders").select("o_orderkey", F.lit("other").alias("tenant_id")), _folder(spark, "tenants")
    for tenant, rows in (("a", o.where("o_orderkey % 2 = 0")), ("b", o), ("a", o.where("o_orderkey % 5 = 0"))):
        lifecycle.write_scoped(rows, path, tenant)
    return lifecycle.read_scoped(spark, path, "a").unionByName(lifecycle.read_scoped(spark, path, "b").where("o_orderkey % 100 = 1"))


TENANTS = "SELECT o_orderkey, 'a' AS tenant_id FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'b' FROM orders WHERE o_orderkey % 100 = 1"


def recorded_migration(spark, sf_dir):
    """Customers through three recorded versions: a column more, its values, a column less; run twice."""
    path = _folder(spark, "migrated")
    read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name").write.parquet(f"{path}/v=0")
    steps = [
        (1, "expand", lambda df: df.withColumn("tier", F.lit(None).cast("int"))), (2, "backfill", lambda df: df.withColumn("tier", F.when(F.col("c_acctbal") > 5000, 1).otherwise(2))), (3, "contract", lambda df: df.drop("c_acctbal")),
    ]
    lifecycle.migrate(spark, path, steps[:2])
    lifecycle.migrate(spark, path, steps)
    versions = lifecycle.migrate(spark, path, steps).agg(F.count(F.lit(1)).alias("versions"))  # one row
    return lifecycle.latest(spark, path).crossJoin(F.broadcast(versions)).select("c_custkey", "c_name", F.col("tier").cast("long").alias("tier"), "versions")


MIGRATED = "SELECT c_custkey, c_name, (CASE WHEN c_acctbal > 5000 THEN 1 ELSE 2 END)::BIGINT AS tier, 3::BIGINT AS versions FROM customer"


def flag_upserts(spark, sf_dir):
    """Flags by segment and nation, some set anew and some added: a conflict of both keys updates."""
    c = read(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    old, new = c.where("c_nationkey < 15").withColumn("flag", F.lit("old")), c.where("c_nationkey % 2 = 0").withColumn("flag", F.lit("new"))
    return merge.upsert(old, new.withColumn("n", F.col("n") + 1), ["c_mktsegment", "c_nationkey"])


FLAGS = """WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_mktsegment, c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN n + 1 ELSE n END AS n, CASE WHEN c_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS flag FROM c WHERE c_nationkey < 15 OR c_nationkey % 2 = 0"""

QUERIES = {
    "match_explanations": (match_explanations, EXPLAIN), "plan_summary": (plan_summary, SUMMARY), "tenant_writes": (tenant_writes, TENANTS), "recorded_migration": (recorded_migration, MIGRATED), "flag_upserts": (flag_upserts, FLAGS),
    "country_fields": (country_fields, COUNTRIES), "jobs_master": (jobs_master, MASTER), "report_sheets": (report_sheets, SHEETS), "acquisition_gates": (acquisition_gates, ACQUIRE),
    "score_offenders": (score_offenders, OFFENDERS), "geography_audit": (geography_audit, AUDIT), "run_statistics": (run_statistics, STATISTICS), "document_metrics": (document_metrics, DOCUMENTS),
    "watchlist_flags": (watchlist_flags, WATCHED),
}
