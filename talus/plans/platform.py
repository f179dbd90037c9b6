"""Driver queries of alerts, arm selection, key scans, table functions, lifecycle and gates
over the driver's tables, with their SQL (survey A7, A8, A17, A18, A21, B3, B4, B7, B19, D10,
G13, H10, J5, J7, J12, K6, L2, L3, M3)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from talus.functions import gates, tables
from talus.operators import bandits, intelligence, lifecycle, views
from talus.operators.graph import checkpoint_dir
from talus.plans.ranked import read
from talus.plans.reports import HASH
from talus.sources import keyset, postings
from talus.streaming import alerts, events


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ alerts and arms
def status_alerts(spark, sf_dir):
    """Users as postings: events move their status, values are scores, purchases are offers."""
    e = read(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "Offer").otherwise(F.col("event_type")))
    return alerts.alerts(alerts.updates(e, "user_id", "event_id", "ts", "status", "value"), 80.0).select("key", "seq", "event", "message", "level")


ALERTS = """
WITH e AS (SELECT user_id::VARCHAR AS key, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'Offer' ELSE event_type END AS status, value AS score FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT *, last_value(score IGNORE NULLS) OVER w AS old_score, last_value(status IGNORE NULLS) OVER w AS old_status FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, seq, 'new_high_scoring_job' AS event, key || ' scored ' || floor(score)::BIGINT AS message, 'INFO' AS level FROM p WHERE score >= 80 AND NOT coalesce(old_score >= 80, false)
UNION ALL SELECT key, seq, 'interview_status_change', key || ' → ' || status, 'INFO' FROM p WHERE status <> 'Offer' AND old_status <> status
UNION ALL SELECT key, seq, 'offer_received', 'Offer received: ' || key, 'INFO' FROM p WHERE status = 'Offer' AND old_status IS DISTINCT FROM 'Offer'"""


def _arms(spark, sf_dir):
    """Event types as arms; a value of 50 or more is won."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("value") >= 50).cast("double").alias("reward"))
    return bandits.arm_posteriors(e, "arm", "reward")


def epsilon_greedy_arms(spark, sf_dir):
    return bandits.epsilon_greedy(read(spark, sf_dir, "orders"), "o_orderkey", _arms(spark, sf_dir), 0.1, "exp1").select(F.col("unit").alias("o_orderkey"), "arm", "explored")


EPSILON = f"""
WITH a AS (SELECT event_type AS arm, coalesce(avg((value >= 50)::INT), 0) AS mean FROM events GROUP BY 1), l AS (SELECT list(arm ORDER BY arm) AS arms, arg_max(arm, struct_pack(m := mean, n := -r)) AS best FROM (SELECT *, row_number() OVER (ORDER BY arm) AS r FROM a)),
u AS (SELECT o_orderkey, {HASH.format("'exp1/explore:' || o_orderkey::VARCHAR")} / 4294967296.0::DOUBLE < 0.1 AS explored, floor({HASH.format("'exp1/arm:' || o_orderkey::VARCHAR")} / 4294967296.0::DOUBLE * len(arms))::INT AS place, arms, best FROM orders, l)
SELECT o_orderkey, CASE WHEN explored THEN arms[place + 1] ELSE best END AS arm, explored FROM u"""


def thompson_arms(spark, sf_dir):
    """An arm for every order, drawn from the arms' posteriors with a fixed seed."""
    return bandits.thompson(read(spark, sf_dir, "orders"), "o_orderkey", _arms(spark, sf_dir), 7).select(F.col("unit").alias("o_orderkey"), "arm")


# ------------------------------------------------------------------ scans and table functions
def keyset_scan(spark, sf_dir):
    """All orders above a key, read in key ranges of about 2,000 rows."""
    return keyset.read_keys(spark, f"{sf_dir}/orders.parquet", "o_orderkey", 2000).where("o_orderkey > 100").select("o_orderkey", "o_custkey", "o_totalprice")


KEYS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 100"


def json_leaves(spark, sf_dir):
    """The leaves of the events' properties, called laterally from SQL."""
    tables.register(spark)
    read(spark, sf_dir, "events").createOrReplaceTempView("json_leaves_events")
    return spark.sql("SELECT event_id, j.path, j.kind, j.value FROM json_leaves_events, LATERAL json_leaves(props) AS j")


LEAVES = "SELECT event_id, path, CASE json_type(props, path) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, props ->> path AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events WHERE json_valid(props))"


def geo_tokens(spark, sf_dir):
    """Where customers look: a nested value of their nation, region and segment, as a set of tokens."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # two tables of fixed size
    doc = F.to_json(F.struct(F.array(F.concat(F.lit(" "), "n_name"), F.lower("n_name")).alias("countries"), F.struct("r_name", F.lit("").alias("none"), F.col("c_custkey").alias("n")).alias("region"), "c_mktsegment"))
    return tables.token_sets(joined.select("c_custkey", doc.alias("doc")), "c_custkey", "doc").select("c_custkey", F.array_join("tokens", "|").alias("tokens"))


TOKENS = "SELECT c_custkey, array_to_string(list_sort(list_distinct([lower(n_name), lower(r_name), lower(c_mktsegment)])), '|') AS tokens FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def linked_postings(spark, sf_dir):
    """Parts as postings in the linked data of a page: one by itself, one in a graph."""
    p = read(spark, sf_dir, "part")
    posting = lambda title: F.struct(F.lit("JobPosting").alias("@type"), title.alias("title"), F.struct(F.col("p_brand").alias("name")).alias("hiringOrganization"), F.struct(F.struct(F.col("p_type").alias("addressLocality"), F.lit("DE").alias("addressCountry")).alias("address")).alias("jobLocation"))
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    graph = F.to_json(F.struct(F.array(posting(F.upper("p_name"))).alias("@graph")))
    page = F.concat(F.lit("<html>"), script(F.to_json(posting(F.col("p_name")))), script(F.lit("{broken")), script(graph), F.lit("</html>"))
    rows = p.select("p_partkey", page.alias("html"))
    return rows.lateralJoin(tables.JsonLdPostings(F.col("html").outer())).select("p_partkey", "at", "title", "company", "location")


LINKED = """SELECT p_partkey, i::INT AS "at", CASE i WHEN 0 THEN p_name ELSE upper(p_name) END AS title, p_brand AS company, p_type || ', DE' AS location FROM part, range(0, 2) t(i)"""


def feed_postings(spark, sf_dir):
    """Parts as feeds: an RSS item and an Atom entry each, and a broken document."""
    p = read(spark, sf_dir, "part")
    rss = F.concat(F.lit("<rss><channel><item><title>"), "p_name", F.lit("</title><link>http://x/"), F.col("p_partkey").cast("string"), F.lit("</link><pubDate>2026-01-05</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), F.upper("p_name"), F.lit('</title><link href="http://y/'), F.col("p_partkey").cast("string"), F.lit('"/></entry></feed>'))
    feeds = p.select(F.explode(F.array(rss, atom, F.lit("<rss><broken"))).alias("xml"))
    return postings.feed_items(feeds, "Acme").select("title", "company", "url", "job_board", "posted_date")


FEEDS = """SELECT p_name AS title, 'Acme' AS company, 'http://x/' || p_partkey AS url, 'career_site_rss' AS job_board, DATE '2026-01-05' AS posted_date FROM part
UNION ALL SELECT upper(p_name), 'Acme', 'http://y/' || p_partkey, 'career_site_rss', NULL FROM part"""


def placeholder_audit(spark, sf_dir):
    """Customers as profiles, some of whose fields still wait to be filled in."""
    k = F.col("c_custkey")
    doc = F.to_json(F.struct(F.when(k % 3 == 0, "FILL_IN name").otherwise(F.col("c_name")).alias("name"), F.struct(F.array(F.lit("x"), F.when(k % 5 == 0, "FILL_IN").otherwise("y")).alias("list")).alias("in")))
    return postings.placeholders(read(spark, sf_dir, "customer").select("c_custkey", doc.alias("doc")), "c_custkey", "doc").select(F.col("id").alias("c_custkey"), "path")


PLACEHOLDERS = "SELECT c_custkey, 'name' AS path FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'in.list[1]' FROM customer WHERE c_custkey % 5 = 0"


# ------------------------------------------------------------------ lifecycle
def month_expiry(spark, sf_dir):
    """Orders as a table of months; those before 48 whole months ago leave, with an audit."""
    path, audit = _folder(spark, "months"), _folder(spark, "audit")
    lifecycle.write_months(read(spark, sf_dir, "orders"), path, "o_orderdate")
    return lifecycle.expire_months(spark, path, dt.date(2001, 8, 15), 48, audit).select("year", "month", "action", "rows")


EXPIRY = """SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, 'dropped' AS action, count(*) AS rows FROM orders WHERE o_orderdate < DATE '1997-08-01' GROUP BY 1, 2"""


def backfill_batches(spark, sf_dir):
    """Open orders copied in batches by key, as the copy holds them."""
    o, target = read(spark, sf_dir, "orders"), _folder(spark, "copy")
    lifecycle.backfill(o, target, _folder(spark, "state"), "o_orderkey", ["o_custkey", "o_totalprice"], F.col("o_orderstatus") == "O", batch_rows=max(1000, o.count() // 8))
    return spark.read.parquet(target).select("o_orderkey", "o_custkey", "o_totalprice")


BACKFILL = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'"


def ingest_once(spark, sf_dir):
    """Two runs over the orders' customers, the first one twice: what each added to the log."""
    o, target, markers = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), _folder(spark, "log"), _folder(spark, "markers")
    for run, rows in (("first", o.where("o_orderkey % 2 = 0")), ("first", o.where("o_orderkey % 2 = 0")), ("second", o)):
        lifecycle.append_once(rows, target, markers, run, ["o_custkey"], "o_orderkey")
    return spark.read.schema(lifecycle.MARKERS).parquet(markers).select("run_id", "fetched", "accepted")


INGEST = """SELECT 'first' AS run_id, count(*) AS fetched, count(DISTINCT o_custkey) AS accepted FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'second', count(*), count(DISTINCT o_custkey) - (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 2 = 0) FROM orders"""


# ------------------------------------------------------------------ events
def event_replay(spark, sf_dir):
    """Past clicks and errors from an event on."""
    return events.replay(read(spark, sf_dir, "events"), ["click", "error"], 100).select("event_id", "event_type", "user_id")


REPLAY = "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('click', 'error') AND event_id > 100"


def event_poll(spark, sf_dir):
    """The next events of each user's log behind a committed offset, at most five of each and 1,000 in all."""
    e = read(spark, sf_dir, "events").where("user_id is not null").select("event_id", (F.col("user_id") % 16).alias("partition"), F.floor(F.col("event_id") / 16).cast("long").alias("offset"))
    commits = e.groupBy("partition").agg(F.floor(F.max("offset") / 2).cast("long").alias("committed")).where("partition <> 3")
    return events.poll(e, commits, 5, 1_000_000).select("event_id", "partition", "offset")


POLL = """WITH e AS (SELECT event_id, user_id % 16 AS partition, event_id // 16 AS "offset" FROM events WHERE user_id IS NOT NULL), c AS (SELECT partition, max("offset") // 2 AS committed FROM e WHERE partition <> 3 GROUP BY 1)
SELECT event_id, e.partition, e."offset" FROM e LEFT JOIN c ON e.partition = c.partition WHERE e."offset" >= coalesce(committed, 0) AND e."offset" < coalesce(committed, 0) + 5"""


# ------------------------------------------------------------------ gates and joins
def track_language(spark, sf_dir):
    """Documents by language, with a category and a confidence by key: the language rule of their track."""
    d = read(spark, sf_dir, "documents")
    category = F.element_at(F.array(*[F.lit(x) for x in ("product_management", "hr_analytics", "other")]), (F.col("doc_id") % 3).cast("int") + 1)
    lang = F.when(F.col("lang") == "es", "it").otherwise(F.col("lang"))
    rule = gates.language_rule(lang, F.when(F.col("doc_id") % 7 == 0, 0.5).otherwise(0.9), category)
    return d.select("doc_id", gates.track(category).alias("track"), rule.alias("r")).select("doc_id", "track", "r.ok", "r.reason")


TRACK = """WITH d AS (SELECT doc_id, CASE lang WHEN 'es' THEN 'it' ELSE lang END AS lang, ['A', 'B', 'unclassified'][doc_id % 3 + 1] AS track, doc_id % 7 = 0 AS unsure FROM documents)
SELECT doc_id, track, unsure OR lang = 'en' OR track <> 'A' AS ok, CASE WHEN unsure THEN 'low_confidence' WHEN lang = 'en' THEN 'english' WHEN lang = 'it' AND track = 'B' THEN 'italian_track_b'
  WHEN track = 'A' THEN 'non_en_track_a:' || lang ELSE 'default_accept' END AS reason FROM d"""


def role_filter(spark, sf_dir):
    """Parts' names as titles, some with a role: which hold none of the wanted words, and which are senior."""
    k = F.col("p_partkey")
    title = F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ("Senior", "Junior", "Intern,", "VP")]), (k % 4).cast("int") + 1), "p_name", F.when(k % 3 == 0, "Analytics Lead"))
    judged = gates.seniority(title, F.lit(None).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", title.alias("title"), judged.alias("s")).select("p_partkey", gates.role_rejected(F.col("title")).alias("rejected"), gates.is_intern(F.col("title")).alias("intern"), "s.ok")


ROLES = r"""WITH t AS (SELECT p_partkey, concat_ws(' ', ['Senior', 'Junior', 'Intern,', 'VP'][p_partkey % 4 + 1], p_name, CASE WHEN p_partkey % 3 = 0 THEN 'Analytics Lead' END) AS title FROM part)
SELECT p_partkey, NOT regexp_matches(lower(title), 'ai|artificial intelligence|machine learning|product|strategy|transformation|analytics|data|innovation') AS rejected, p_partkey % 4 = 2 AS intern, p_partkey % 4 IN (1, 2) AS ok FROM t"""


def stage_rows(spark, sf_dir):
    """Orders that have lines and a customer, with what is known of their customer's nation."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), "o_custkey")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    late = read(spark, sf_dir, "lineitem").where("l_shipdate > '2000-06-01'").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_shipdate").cast("date").alias("late"))
    return views.stage_join(o, [lines], "job_id", [late])


STAGES = """SELECT o_orderkey AS job_id, o_custkey, n_lines, late FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
LEFT JOIN (SELECT l_orderkey AS k, max(l_shipdate)::DATE AS late FROM lineitem WHERE l_shipdate > DATE '2000-06-01' GROUP BY 1) ON o_orderkey = k"""


def score_explanation(spark, sf_dir):
    """Orders with score components by key, and their sentence."""
    k = F.col("o_orderkey")
    parts = {"track_alignment": k % 30, "skill_match": k % 20, "mba_relevance": k % 15, "company_quality": k % 16, "pivot_bonus": k % 6}
    rows = read(spark, sf_dir, "orders").select("o_orderkey", *[v.cast("int").alias(n) for n, v in parts.items()])
    return rows.select("o_orderkey", intelligence.explanation(rows).alias("explanation"))


EXPLANATION = """SELECT o_orderkey, concat_ws('. ', CASE WHEN o_orderkey % 30 >= 24 THEN 'Strong primary track alignment (AI/Product/Strategy)' WHEN o_orderkey % 30 >= 10 THEN 'Secondary track alignment' ELSE 'Unclassified role' END,
  CASE WHEN o_orderkey % 20 >= 15 THEN 'strong skill keyword overlap' WHEN o_orderkey % 20 >= 8 THEN 'moderate skill overlap' END, CASE WHEN o_orderkey % 15 >= 10 THEN 'MBA-caliber opportunity signals present' END,
  CASE WHEN o_orderkey % 16 >= 13 THEN 'Tier 1 company' WHEN o_orderkey % 16 >= 11 THEN 'Tier 2 company' END, CASE WHEN o_orderkey % 6 >= 4 THEN 'explicit AI × strategy intersection in JD' END) || '.' AS explanation FROM orders"""

QUERIES = {
    "status_alerts": (status_alerts, ALERTS), "epsilon_greedy_arms": (epsilon_greedy_arms, EPSILON), "thompson_arms": (thompson_arms, None), "keyset_scan": (keyset_scan, KEYS), "json_leaves": (json_leaves, LEAVES),
    "geo_tokens": (geo_tokens, TOKENS), "linked_postings": (linked_postings, LINKED), "feed_postings": (feed_postings, FEEDS), "placeholder_audit": (placeholder_audit, PLACEHOLDERS), "month_expiry": (month_expiry, EXPIRY),
    "backfill_batches": (backfill_batches, BACKFILL), "ingest_once": (ingest_once, INGEST), "event_replay": (event_replay, REPLAY), "event_poll": (event_poll, POLL), "track_language": (track_language, TRACK),
    "role_filter": (role_filter, ROLES), "stage_rows": (stage_rows, STAGES), "score_explanation": (score_explanation, EXPLANATION),
}
