"""Driver queries over the composed operators: gates in a row, report filters, reviews and
outcomes, rankings, market and cost reports, events, loads, profiles and score parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import gates, scoring, text
from talus.operators import compose, graph, intelligence, lookup, merge, metrics, ranking, views
from talus.plans.ranked import read
from talus.sources import postings as sources

#: Locations of customers by the key of their nation.
PLACES = ["Milan", "Remote", "New York", "Berlin", None]


def _jobs(spark, sf_dir):
    """Orders with their customers as postings."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (F.col("c_nationkey") % len(PLACES)).cast("int") + 1)
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("category"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") * 7 % 101).alias("score"), place.alias("location"),
    )


J = """j AS (SELECT o_orderkey AS job_id, c_name AS company, c_mktsegment AS category, o_orderpriority AS priority, o_orderstatus AS status, o_orderdate::DATE AS day, o_totalprice AS price,
  o_orderkey * 7 % 101 AS score, ['Milan', 'Remote', 'New York', 'Berlin', NULL][c_nationkey % 5 + 1] AS location FROM orders JOIN customer ON o_custkey = c_custkey)"""


# ------------------------------------------------------------------ gates
def acquisition_chain(spark, sf_dir):
    """Keyword, seniority, place and language reasons, then duplicates by content and by address."""
    j = _jobs(spark, sf_dir)
    reasons = [
        ("incomplete", F.col("company").isNull()), ("keyword", gates.excluded_keyword(F.col("category"), ["MACHINERY"]).isNotNull()), ("seniority", F.col("priority").startswith("1")),
        ("geography", ~gates.geography(F.col("location"))["ok"]), ("language", F.col("status") == "P"),
    ]
    keys = [("duplicate_content", text.fingerprint("company", "category", "location")), ("duplicate_address", F.concat_ws("/", "category", (F.col("job_id") % 997).cast("string")))]
    return compose.acquire(j, reasons, keys, "job_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("job_id").alias("first_job"))


ACQUISITION = f"""WITH {J}, r AS (SELECT *, CASE WHEN company IS NULL THEN 'incomplete' WHEN category = 'MACHINERY' THEN 'keyword' WHEN priority[1:1] = '1' THEN 'seniority' WHEN location = 'New York' THEN 'geography'
  WHEN status = 'P' THEN 'language' END AS o, company || '|' || category || '|' || coalesce(location, '') AS k, category || '/' || (job_id % 997) AS u FROM j),
a AS (SELECT *, o IS NULL AND row_number() OVER (PARTITION BY o IS NULL, k ORDER BY job_id) > 1 AS d FROM r),
b AS (SELECT *, o IS NULL AND NOT d AND row_number() OVER (PARTITION BY o IS NULL AND NOT d, u ORDER BY job_id) > 1 AS e FROM a),
c AS (SELECT job_id, CASE WHEN o IS NOT NULL THEN o WHEN d THEN 'duplicate_content' WHEN e THEN 'duplicate_address' ELSE 'inserted' END AS outcome FROM b)
SELECT outcome, count(*) AS n, min(job_id) AS first_job FROM c GROUP BY 1"""


def ingestion_gate(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    out = compose.ingestion_gate(
        j, gates.geography(F.col("location"))["ok"], F.col("status") == "P", F.col("priority").startswith("2"), F.when(F.col("score") < 10, "REJECTED"), F.col("category") == "BUILDING", F.col("category") == "FURNITURE"
    )
    return out.select("job_id", "eligible", "reason")


INGESTION = f"""WITH {J} SELECT job_id, r IS NULL AS eligible, r AS reason FROM (SELECT job_id, CASE WHEN location = 'New York' THEN 'non_eu' WHEN status = 'P' THEN 'language' WHEN priority[1:1] = '2' THEN 'visa'
  WHEN category = 'BUILDING' THEN 'seniority' WHEN category = 'FURNITURE' THEN 'non_intern' WHEN score < 10 THEN 'eligibility' END AS r FROM j)"""


def _track(category: str):
    return gates.track(F.when(F.col(category) == "BUILDING", "ai_strategy").when(F.col(category) == "MACHINERY", "hr_analytics").otherwise(F.lower(category)))


def report_filters(spark, sf_dir):
    """Rows of the report: in the focus or not clearly outside of it, and not of high language risk."""
    j = _jobs(spark, sf_dir).where(~gates.outside_focus(F.col("location"), ["it", "nl"])).where(F.coalesce(F.when(F.col("status") == "O", "HIGH"), F.lit("LOW")) != "HIGH")
    return j.select("job_id", "location", _track("category").alias("track"))


REPORT = f"""WITH {J} SELECT job_id, location, CASE category WHEN 'BUILDING' THEN 'A' WHEN 'MACHINERY' THEN 'B' ELSE 'unclassified' END AS track FROM j
WHERE coalesce(location, '') NOT IN ('New York', 'Berlin') AND status <> 'O'"""


def above_threshold(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return compose.above_threshold(j.drop("score"), j.select("job_id", "score"), "job_id", "score", 70, F.col("day") < "1996-01-01").select("job_id", "score")


ABOVE = f"WITH {J} SELECT job_id, score FROM j WHERE score >= 70 AND NOT day < DATE '1996-01-01'"


def status_view(spark, sf_dir):
    """Applications of one status with the number of all, as a page of the view."""
    j = _jobs(spark, sf_dir)
    return views.list_view(j, [F.col("status") == "F"], "score", ["score", "day"], tie="job_id", limit=50).select("job_id", "status", "score", "total")


STATUS = f"WITH {J} SELECT job_id, status, score, (SELECT count(*) FROM j WHERE status = 'F') AS total FROM j WHERE status = 'F' ORDER BY score DESC, job_id LIMIT 50"


def unscored_open(spark, sf_dir):
    j = _jobs(spark, sf_dir).withColumns({"gate": F.when(F.col("category") == "BUILDING", "REJECTED"), "risk": F.when(F.col("priority") == "5-LOW", "HIGH")})
    return compose.unscored_open(j, j.where("job_id % 3 <> 0").select("job_id"), "job_id", "gate", "risk").select("job_id")


UNSCORED_OPEN = f"WITH {J} SELECT job_id FROM j WHERE job_id % 3 = 0 AND category <> 'BUILDING' AND priority <> '5-LOW'"


# ------------------------------------------------------------------ joins and rankings
def outcomes_join(spark, sf_dir):
    """Applications with work mode and score of their posting."""
    j = _jobs(spark, sf_dir)
    jobs = j.select("job_id", "company", text.work_mode(F.col("location"), F.lit("")).alias("work_mode"))
    return compose.outcomes(j.where("job_id % 4 = 0").select("job_id", "status"), jobs, j.where("job_id % 3 <> 0").select("job_id", "score"), "job_id")


OUTCOMES = f"WITH {J} SELECT job_id, status, company, CASE WHEN location = 'Remote' THEN 'Remote' ELSE 'On-site' END AS work_mode, CASE WHEN job_id % 3 <> 0 THEN score END AS score FROM j WHERE job_id % 4 = 0"


def reviews_join(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    queue = j.where("job_id % 5 = 0").select("job_id", F.when(F.col("job_id") % 2 == 0, "pending").otherwise("done").alias("state"), F.col("day").alias("created"))
    return compose.reviews(queue, j.select("job_id", "company", "score"), "job_id", "created", "pending")


REVIEWS = f"WITH {J} SELECT job_id, 'pending' AS state, day AS created, company, score FROM j WHERE job_id % 10 = 0"


def feedback_rank(spark, sf_dir):
    """Customers as targets: postings by score and the feedback on their customer's events."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("company"), "event_type", "value")
    weights = metrics.feedback_weights(e, "company", "event_type", ["purchase", "signup"], ["error"], weight=F.when(F.col("value") > 50, 2.0).otherwise(1.0))
    out = compose.feedback_rank(_jobs(spark, sf_dir).select("job_id", "company", "score"), weights, "company", "score", "job_id")
    return out.select("job_id", "adjusted", F.col("rank").cast("long").alias("rank"))


FEEDBACK = f"""WITH {J}, w AS (SELECT 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS company, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 5.0::DOUBLE WHEN event_type = 'error' THEN -5.0::DOUBLE ELSE 0 END
  * CASE WHEN value > 50 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM events GROUP BY 1), r AS (SELECT job_id, round_even(score + coalesce(weight, 0), 4) AS adjusted FROM j LEFT JOIN w ON j.company = w.company)
SELECT job_id, adjusted, row_number() OVER (ORDER BY adjusted DESC, job_id) AS rank FROM r"""


def top_opportunities(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    ranked = ranking.global_rank(j.select("job_id", "score"), [F.desc("score"), F.asc("job_id")], 16)
    out = compose.top_opportunities(ranked, j.where("job_id % 3 <> 0").select("job_id", F.lower("category").alias("kind")), j.where("job_id % 2 = 0").select("job_id", "price"), "job_id", 25)
    return out.select("job_id", F.col("rank").cast("long").alias("rank"), "kind", "price")


OPPORTUNITIES = f"""WITH {J}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, job_id) AS rank FROM j)
SELECT job_id, rank, lower(category) AS kind, price FROM r WHERE job_id % 3 <> 0 AND job_id % 2 = 0 ORDER BY rank LIMIT 25"""


def top_recommendations(spark, sf_dir):
    """The best postings from a least score on, with an application status for all of them."""
    j = _jobs(spark, sf_dir).where("score >= 60").withColumn("status", F.coalesce(F.when(F.col("job_id") % 4 == 0, F.col("status")), F.lit("Not Started")))
    return ranking.top(j, [F.desc("score"), F.desc("day"), F.asc("job_id")], 40).select("job_id", "score", "status")


RECOMMENDATIONS = f"WITH {J} SELECT job_id, score, CASE WHEN job_id % 4 = 0 THEN status ELSE 'Not Started' END AS status FROM j WHERE score >= 60 ORDER BY score DESC, day DESC, job_id LIMIT 40"


def best_match_coverage(spark, sf_dir):
    """Required words of a part's type against the words of its name: the most alike, and if it is near."""
    p = read(spark, sf_dir, "part")
    need = p.select("p_partkey", F.explode(F.array(F.lower("p_type"), F.lit("ring"))).alias("need"))
    have = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("have"))
    alike = 1 - F.levenshtein("need", "have") / F.greatest(F.char_length("need"), F.char_length("have"))
    out = lookup.best_matches(need.distinct(), have.distinct(), ["p_partkey"], "need", "have", F.bround(alike, 4))
    return out.select("p_partkey", "need", "match", "similarity", "is_match")


BEST_MATCH = """WITH n AS (SELECT DISTINCT p_partkey, unnest([lower(p_type), 'ring']) AS need FROM part), h AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS have FROM part),
s AS (SELECT p_partkey, need, have, round_even(1 - levenshtein(need, have) / greatest(length(need), length(have))::DOUBLE, 4) AS similarity FROM n JOIN h USING (p_partkey))
SELECT p_partkey, need, have AS match, similarity, similarity >= 0.6 AS is_match FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey, need ORDER BY similarity DESC, have) = 1"""


# ------------------------------------------------------------------ market and cost
def document_counts(spark, sf_dir):
    """Documents by language, and how many of them a source has more than one text of."""
    d = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("lang").agg(F.sum("n").alias("documents"), F.sum((F.col("n") > 1).cast("long")).alias("sources_with_several"))


DOCUMENT_COUNTS = "SELECT lang, sum(n)::BIGINT AS documents, sum((n > 1)::INT)::BIGINT AS sources_with_several FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1"


def source_performance(spark, sf_dir):
    """Postings and their average score by board, the boards with most first."""
    return _jobs(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("score"), 1).alias("average")).orderBy(F.desc("n"), "category")


PERFORMANCE = f"WITH {J} SELECT category, count(*) AS n, round_even(avg(score), 1) AS average FROM j GROUP BY 1"


def demand_sets(spark, sf_dir):
    return compose.demand_sets(_jobs(spark, sf_dir), ["category", "location", "priority"])


DEMAND_SETS = f"""WITH {J} SELECT 'category' AS dimension, category AS value, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'location', location, count(*) FROM j WHERE location IS NOT NULL GROUP BY 2
UNION ALL SELECT 'priority', priority, count(*) FROM j GROUP BY 2"""


def latest_benchmark(spark, sf_dir):
    j = _jobs(spark, sf_dir).withColumn("captured", F.struct("day", "job_id"))
    out = compose.latest_benchmark(j.select("category", F.coalesce("location", F.lit("all")).alias("place"), "captured", "price"), ["category", "place"], "captured")
    return out.select("category", "place", F.col("captured.job_id").alias("job_id"), "price")


LATEST_BENCHMARK = f"WITH {J} SELECT category, coalesce(location, 'all') AS place, job_id, price FROM j QUALIFY row_number() OVER (PARTITION BY category, location ORDER BY day DESC, job_id DESC) = 1"


def demand_snapshot(spark, sf_dir):
    """Demand by category with its places and skills (here the words of the priority) as lists of counts."""
    out = compose.demand_snapshot(_jobs(spark, sf_dir), "category", "location", F.split(F.lower("priority"), "[- ]"), F.lit("2024-06-01").cast("date"))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("category", "demand", flat("places").alias("places"), flat("skills").alias("skills"), "captured_at")


SNAPSHOT = f"""WITH {J}, p AS (SELECT category, string_agg(x || '=' || n, ',' ORDER BY x) AS places FROM (SELECT category, location AS x, count(*) AS n FROM j WHERE location IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT category, string_agg(x || '=' || n, ',' ORDER BY x) AS skills FROM (SELECT category, x, count(*) AS n FROM (SELECT category, unnest(regexp_split_to_array(lower(priority), '[- ]')) AS x FROM j) WHERE x <> '' GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT category, count(*) AS demand FROM j GROUP BY 1) SELECT category, demand, places, skills, DATE '2024-06-01' AS captured_at FROM t LEFT JOIN p USING (category) LEFT JOIN s USING (category)"""


def cost_daily(spark, sf_dir):
    """Cost and calls of each day at prices per million tokens."""
    lines = read(spark, sf_dir, "lineitem")
    price = scoring.cost(F.lit(3.0), F.lit(15.0), F.col("l_extendedprice"), F.col("l_quantity") * 1000)
    return lines.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.bround(F.sum(price), 3).alias("cost"))


DAILY = "SELECT l_shipdate::DATE AS day, count(*) AS calls, round_even(sum(round_even(l_extendedprice / 1e6::DOUBLE * 3 + l_quantity * 1000 / 1e6::DOUBLE * 15, 6)), 3) AS cost FROM lineitem GROUP BY 1"


def provider_window(spark, sf_dir):
    """Users as providers: error rate, failover, and calls within the last hour of the log."""
    return compose.provider_health(read(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error", "ts", seconds=3600, threshold=0.25)


WINDOW = """SELECT user_id, count(*) AS calls, sum((event_type = 'error')::INT)::BIGINT AS errors, sum((ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)::INT)::BIGINT AS throughput,
  round_even(avg((event_type = 'error')::INT), 4) AS error_rate, round_even(avg((event_type = 'error')::INT), 4) >= 0.25 AS failover FROM events GROUP BY 1"""


# ------------------------------------------------------------------ graph
def _prerequisites(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    return part.where("src > 1").select("src", F.floor(F.col("src") / (2 + F.col("src") % 3)).cast("long").alias("dst")).where("dst >= 1 and dst < src")


PREREQ = "e AS (SELECT p_partkey AS src, p_partkey // (2 + p_partkey % 3) AS dst FROM part WHERE p_partkey > 1 AND p_partkey // (2 + p_partkey % 3) >= 1)"


def gap_analysis(spark, sf_dir):
    """Suppliers need the parts of their lines and hold those that they often sell."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("profile"), F.col("l_partkey").alias("skill"))
    held = lines.groupBy("profile", "skill").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = compose.skill_gaps(lines, held, graph.closure(_prerequisites(spark, sf_dir)), "profile", "skill")
    return out.select("profile", "skill", "priority", F.coalesce(F.array_join("prerequisites", ","), F.lit("")).alias("prerequisites"), F.col("place").cast("long").alias("place"))


GAPS = f"""WITH RECURSIVE {PREREQ}, c(node, reaches, depth) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT node, dst, depth + 1 FROM c JOIN e ON reaches = src),
p AS (SELECT node, string_agg(reaches::VARCHAR, ',' ORDER BY depth, reaches) AS chain FROM c GROUP BY 1),
m AS (SELECT l_suppkey AS profile, l_partkey AS skill FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1)
SELECT profile, skill, CASE WHEN chain IS NULL THEN 'high' ELSE 'foundational' END AS priority, coalesce(chain, '') AS prerequisites,
  row_number() OVER (PARTITION BY profile ORDER BY chain IS NULL, skill) AS place FROM m LEFT JOIN p ON skill = node"""


def graph_neighbours(spark, sf_dir):
    edges = _prerequisites(spark, sf_dir).withColumn("relation", F.when(F.col("src") % 2 == 0, "needs").otherwise("helps"))
    return graph.neighbours(edges, read(spark, sf_dir, "supplier").select("s_suppkey"), "needs").select("src", "dst")


NEIGHBOURS = f"WITH {PREREQ} SELECT src, dst FROM e WHERE src % 2 = 0 AND src IN (SELECT s_suppkey FROM supplier)"


def learning_path(spark, sf_dir):
    gaps = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("profile"), (F.col("s_suppkey") * 13 + 5).alias("skill"))
    return graph.learning_path(gaps, graph.closure(_prerequisites(spark, sf_dir))).select("profile", F.col("step").cast("long").alias("step"), "skill")


LEARNING = f"""WITH RECURSIVE {PREREQ}, c(node, reaches, depth) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT node, dst, depth + 1 FROM c JOIN e ON reaches = src),
g AS (SELECT s_suppkey AS profile, s_suppkey * 13 + 5 AS skill FROM supplier), s AS (SELECT profile, reaches AS skill, depth FROM g JOIN c ON node = skill UNION ALL SELECT profile, skill, 0 FROM g)
SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY depth DESC, skill) AS step, skill FROM s"""


# ------------------------------------------------------------------ events, runs and loads
def publish_history(spark, sf_dir):
    """Events of the second half of the log that the first half and the batch itself don't know."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("user_id") % 5 != 0, F.concat_ws(":", "user_id", (F.col("event_id") % 700).cast("string"))).alias("key"))
    last = e.agg(F.max("event_id").alias("m"))
    split = e.crossJoin(F.broadcast(last)).withColumn("new", F.col("event_id") * 2 > F.col("m")).drop("m")  # one row
    old = split.where("not new").drop("new")
    again = split.where("new").drop("new").unionByName(old.where("event_id % 10 = 0"))
    return compose.publish_once(again, old, "event_id", "event_type", "key", "event_id")


HISTORY = """WITH e AS (SELECT event_id, event_type, CASE WHEN user_id % 5 <> 0 THEN user_id || ':' || event_id % 700 END AS key, event_id * 2 > (SELECT max(event_id) FROM events) AS new FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type, key ORDER BY event_id) AS r FROM e WHERE new)
SELECT event_id, event_type, key FROM f WHERE key IS NULL OR (r = 1 AND NOT EXISTS (SELECT 1 FROM e o WHERE NOT o.new AND o.event_type = f.event_type AND o.key = f.key))"""


def retry_split(spark, sf_dir):
    """Events whose handler succeeds at a try by their value, at most three tries each."""
    e = read(spark, sf_dir, "events")
    tries = F.when(F.col("event_type") != "error", 1 + F.floor(F.col("value") / 30).cast("int"))
    return compose.with_retries(e.select("event_id", "event_type", "value"), tries, 3).select("event_id", "attempts", "topic")


RETRIES = """WITH t AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN 1 + floor(value / 30)::INT END AS n FROM events)
SELECT event_id, CASE WHEN n <= 3 THEN n ELSE 3 END::BIGINT AS attempts, CASE WHEN n <= 3 THEN 'done' ELSE 'dlq' END AS topic FROM t"""


def audit_trail(spark, sf_dir):
    """The newest audit rows of one tenant: the trail's own limit."""
    return compose.trail(read(spark, sf_dir, "events"), "purchase", F.col("event_type"), "event_id", 50, 10).select("event_id", "user_id")


TRAIL = "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 50 OFFSET 10"


def run_record(spark, sf_dir):
    """Orders as runs that started open and recorded what they ended with, where they did."""
    j = _jobs(spark, sf_dir)
    started = j.select("job_id", F.lit("running").alias("status"), F.lit(0.0).alias("price"))
    ended = j.where("status = 'F'").select("job_id", F.lit("done").alias("status"), F.when(F.col("job_id") % 2 == 0, F.col("price")).alias("price"))
    return compose.run_record(ended, started, "job_id", ["status", "price"])


RUN_RECORD = f"WITH {J} SELECT job_id, CASE WHEN status = 'F' THEN 'done' ELSE 'running' END AS status, CASE WHEN status = 'F' AND job_id % 2 = 0 THEN price ELSE 0.0::DOUBLE END AS price FROM j"


def filtered_backfill(spark, sf_dir):
    j = _jobs(spark, sf_dir).select("job_id", "day", "status")
    once = compose.backfill(j, F.col("day") >= "1997-01-01", j.where("job_id % 10 = 0"), "job_id")
    return compose.backfill(j, F.col("day") >= "1997-01-01", once, "job_id")


FILTERED = f"WITH {J} SELECT job_id, day, status FROM j WHERE job_id % 10 = 0 OR day >= DATE '1997-01-01'"


def load_rollback(spark, sf_dir):
    j = _jobs(spark, sf_dir).select("job_id", F.when(F.col("job_id") % 3 > 0, F.col("job_id") % 3).alias("load"))
    return compose.roll_back(j, "load", 2)


ROLLBACK = f"WITH {J} SELECT job_id, CASE WHEN job_id % 3 > 0 THEN job_id % 3 END AS load FROM j WHERE job_id % 3 <> 2"


def vectors_retained(spark, sf_dir):
    """Vectors worth keeping: not of ignored labels, of the current version and young enough."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(F.lit("v"), F.col("vec_id") % 3).alias("version"), F.date_sub(F.lit("2024-06-01").cast("date"), (F.col("vec_id") % 200).cast("int")).cast("timestamp").alias("at"))
    return views.keep_vectors(e.where("label <> 3"), "version", "v1", "at", F.lit("2024-06-01").cast("timestamp"), 90).select("vec_id")


RETAINED = "SELECT vec_id FROM embeddings WHERE label <> 3 AND vec_id % 3 = 1 AND vec_id % 200 <= 90"


def search_log(spark, sf_dir):
    """Every search term with every country, appended to the log of earlier searches."""
    terms = sources.search_terms(spark, [["analyst", "planner"], ["analyst", "engineer"]], ["it", "nl"], 3)
    found = _jobs(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    fresh = found.crossJoin(F.broadcast(terms)).select(F.concat_ws(" ", "term", F.lower("category")).alias("query"), F.col("country").alias("board"), F.col("n").alias("jobs_found"))  # six rows
    return fresh.where("jobs_found > 0")


SEARCH_LOG = f"""WITH {J} SELECT role || ' ' || lower(category) AS query, country AS board, n AS jobs_found FROM (SELECT category, count(*) AS n FROM j GROUP BY 1),
(VALUES ('analyst'), ('planner'), ('engineer')) r(role), (VALUES ('it'), ('nl')) c(country)"""


def position_upsert(spark, sf_dir):
    """Rows replaced at their place, new ones after the last."""
    j = _jobs(spark, sf_dir).select("job_id", "status", F.col("job_id").alias("place"))
    new = j.where("job_id % 5 = 0").select(F.when(F.col("job_id") % 2 == 0, F.col("job_id")).otherwise(-F.col("job_id")).alias("job_id"), F.lit("X").alias("status"))
    return compose.upsert_in_place(j, new, "job_id", "place").select("job_id", "status", F.col("place").cast("long").alias("place"))


UPSERT = f"""WITH {J}, n AS (SELECT CASE WHEN job_id % 2 = 0 THEN job_id ELSE -job_id END AS job_id FROM j WHERE job_id % 5 = 0)
SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM n) THEN 'X' ELSE status END AS status, job_id AS place FROM j
UNION ALL SELECT job_id, 'X', (SELECT max(job_id) FROM j) + row_number() OVER (ORDER BY job_id) FROM n WHERE job_id < 0"""


def conflicts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("version"))
    changes = o.select("o_orderkey", (F.col("o_orderkey") % 3).alias("expected"))
    return merge.conflicts(changes, o, "o_orderkey", "expected", "version").select("o_orderkey")


CONFLICTS = "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> o_orderkey % 4"


def output_invariants(spark, sf_dir):
    j = _jobs(spark, sf_dir).select("job_id", (1 + F.col("job_id") % 4).alias("tier"))
    return intelligence.invariants(j.where("job_id % 7 <> 0"), j.where("job_id % 3 = 0"), j.where("job_id % 6 = 1"), "job_id", "tier")


INVARIANTS = """SELECT 'recommended' AS "check", count(*) AS bad FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 = 0 UNION ALL
SELECT 'top', count(*) FROM orders WHERE o_orderkey % 6 = 1 AND o_orderkey % 3 <> 0 UNION ALL SELECT 'tiers', count(*) FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 4 = 3"""


def evolve_table(spark, sf_dir):
    """A column added with a default, filled where it is null, and another dropped; twice is once."""
    j = _jobs(spark, sf_dir).select("job_id", "location", "priority")
    step = lambda df: views.evolve(df, {"location": F.lit("Unknown"), "mode": F.lit("full")}, ["priority"])
    return step(step(j))


EVOLVE = f"WITH {J} SELECT job_id, coalesce(location, 'Unknown') AS location, 'full' AS mode FROM j"


def batch_signature(spark, sf_dir):
    """Batches by day whose signature stays the same when their rows come in another order."""
    j = _jobs(spark, sf_dir)
    a, b = (views.batch_signature(x, ["company", "category", "day"]) for x in (j, j.repartition(5, "price")))
    twice = views.batch_signature(j.unionByName(j), ["company", "category", "day"])
    return a.join(b, "n").join(twice.select(F.col("signature").alias("t"))).select("n", (a["signature"] == b["signature"]).alias("same"), (a["signature"] == F.col("t")).alias("same_twice"))


SIGNATURE = "SELECT count(*) AS n, true AS same, false AS same_twice FROM orders JOIN customer ON o_custkey = c_custkey"


# ------------------------------------------------------------------ profiles and dictionaries
def profile_phrases(spark, sf_dir):
    """Parts as profiles: name, words of the name, type; types of one kind stand for placeholders."""
    p = read(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("FILL_IN_"), "p_type")).otherwise(F.col("p_type"))
    return compose.profile_phrases(p, "p_partkey", [F.array("p_name"), F.split("p_name", " "), F.array(kind, F.lit(" "))]).select("p_partkey", F.col("place").cast("long").alias("place"), "phrase")


PHRASES = """WITH p AS (SELECT p_partkey, [p_name] || string_split(p_name, ' ') || CASE WHEN p_size % 7 = 0 THEN [] ELSE [p_type] END AS x FROM part)
SELECT p_partkey, unnest(range(0, len(x))) AS place, unnest(x) AS phrase FROM p"""


def profile_chunks(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return compose.profile_chunks(p, "p_partkey", [("name", F.col("p_brand"), F.split("p_name", " ")), ("kind", F.lit("Type"), F.array("p_type"))])


CHUNKS = """SELECT p_partkey, 'name' AS source, p_brand || ': ' || unnest(string_split(p_name, ' ')) AS text FROM part UNION ALL SELECT p_partkey, 'kind', 'Type: ' || p_type FROM part"""


def profile_mapping(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    flat = F.create_map(F.lit("track_1_b"), F.array("p_brand"), F.lit("track_1_a"), F.split("p_name", " "), F.lit("track_2"), F.array("p_type"))
    nested = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("second"), F.array(F.lit("nested")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    rows = p.select("p_partkey", flat.alias("m"), nested.alias("nested"))
    out = compose.profile_mapping(rows, "p_partkey", "m", F.col("nested"), {"first": "track_1", "second": "track_2"})
    return out.select("p_partkey", F.array_join("first", ",").alias("first"), F.array_join("second", ",").alias("second"))


MAPPING = "SELECT p_partkey, replace(p_name, ' ', ',') || ',' || p_brand AS first, CASE WHEN p_size % 2 = 0 THEN 'nested' ELSE p_type END AS second FROM part"


def company_seeds(spark, sf_dir):
    """Suppliers as seeds, eight of which share a name, of a company table that has some of the
    names; rows with a bad balance are passed over, the first of a name counts."""
    name = F.concat(F.lit("Supplier "), (F.col("s_suppkey") % 13).cast("string"), F.lit(" Inc"))
    s = read(spark, sf_dir, "supplier").select(text.norm_company(name).alias("name"), F.col("s_acctbal").alias("tier"), "s_suppkey")
    return compose.seed_missing(s.where("tier > 9500"), s, "name", F.col("tier") >= 0, "s_suppkey").select("name", "tier")


SEEDS = """WITH s AS (SELECT 'supplier ' || s_suppkey % 13 AS name, s_acctbal AS tier, s_suppkey FROM supplier)
SELECT name, arg_min(tier, s_suppkey) AS tier FROM s WHERE tier >= 0 AND name NOT IN (SELECT name FROM s WHERE tier > 9500) GROUP BY name"""


def category_weights(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.lower("p_type").alias("role"), F.split("p_name", " ").alias("primary"), F.slice(F.split("p_name", " "), 2, 1).alias("secondary")).where("role <> 'promo'")
    return compose.category_weights(p, "role", "primary", "secondary")


WEIGHTS = """WITH w AS (SELECT lower(p_type) AS role, unnest(string_split(p_name, ' ')) AS category, 'primary' AS weight FROM part UNION ALL SELECT lower(p_type), string_split(p_name, ' ')[2], 'secondary' FROM part)
SELECT role, category, max(weight) AS weight FROM w WHERE role <> 'promo' AND category IS NOT NULL GROUP BY 1, 2"""


def raw_enrichment(spark, sf_dir):
    """Fields added to the raw JSON of events, and read back."""
    e = read(spark, sf_dir, "events")
    raw = compose.enrich_json(F.when(F.col("event_id") % 9 != 0, F.col("props")), {"language": F.lit("en"), "too_short": F.col("value") < 10})
    return e.select("event_id", F.get_json_object(raw, "$.k").alias("k"), F.get_json_object(raw, "$.language").alias("language"), F.get_json_object(raw, "$.too_short").alias("too_short"))


ENRICH = "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN props->>'k' END AS k, 'en' AS language, (value < 10)::VARCHAR AS too_short FROM events"


def isolated_parse(spark, sf_dir):
    """Numbers read from texts of which some are none: a bad one carries its error."""
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 8 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k")).alias("raw"))
    r = compose.isolated(F.expr("try_cast(raw as bigint)"), F.concat(F.lit("no number: "), F.coalesce("raw", F.lit("null"))))
    return compose.with_hook(e.select("event_id", r.alias("r")), lambda x: x["ok"], "r", name="ok").select("event_id", "ok", F.col("r.value").alias("value"), F.col("r.error").alias("error"))


ISOLATED = """WITH e AS (SELECT event_id, CASE WHEN event_id % 8 = 0 THEN event_type ELSE props->>'k' END AS raw FROM events)
SELECT event_id, try_cast(raw AS BIGINT) IS NOT NULL AS ok, try_cast(raw AS BIGINT) AS value, CASE WHEN try_cast(raw AS BIGINT) IS NULL THEN 'no number: ' || coalesce(raw, 'null') END AS error FROM e"""


def content_hashes(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("text_hash"), F.substring(F.md5("text"), 1, 8).alias("prompt_hash"), F.substring(F.sha2(F.concat_ws("|", "lang", "source"), 256), 1, 12).alias("template_hash"))


HASHES = "SELECT doc_id, sha256(text)[1:16] AS text_hash, md5(text)[1:8] AS prompt_hash, sha256(lang || '|' || source)[1:12] AS template_hash FROM documents"


def ordered_unique(spark, sf_dir):
    """Words of a part in the order of their first mention."""
    p = read(spark, sf_dir, "part")
    words = F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.element_at(F.split("p_name", " "), 1))))
    return p.select("p_partkey", F.array_join(words, " ").alias("words"))


UNIQUE = """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ') || [lower(p_type), string_split(p_name, ' ')[1]]) AS w, unnest(range(0, len(string_split(p_name, ' ')) + 2)) AS i FROM part),
f AS (SELECT p_partkey, w, min(i) AS i FROM w GROUP BY 1, 2) SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY 1"""


# ------------------------------------------------------------------ parts of the score
def score_parts(spark, sf_dir):
    """Alignment, keyword and skill points, total, adjusted total, proficiency and tier of postings."""
    j = _jobs(spark, sf_dir)
    n = F.col("job_id") % 8
    near = F.when(F.col("job_id") % 3 > 0, F.col("job_id") % 26)
    kind = F.when(F.col("category") == "BUILDING", "ai_strategy").when(F.col("category") == "MACHINERY", "hr_analytics").otherwise("unknown")
    track, skill = scoring.track_alignment(kind), scoring.skill_score(n, near)
    total = scoring.total_score(track, skill, F.col("score"))
    return j.select(
        "job_id", track.cast("long").alias("track"), scoring.keyword_score(n).cast("long").alias("keywords"), skill.cast("long").alias("skills"), total.cast("long").alias("total"),
        scoring.adjusted(total, F.col("score") - 50).cast("long").alias("adjusted"), F.bround(scoring.proficiency(n, F.col("score") / 10, F.lit(0.5)), 4).alias("proficiency"),
        scoring.quality_tier(n + 1).alias("tier"), scoring.company_quality((1 + F.col("job_id") % 6).cast("int"), n == 0, n).cast("long").alias("company"),
    )


_TIERS = ", ".join(f"({k}, {v})" for k, v in scoring.TIER_POINTS.items())
SCORE_PARTS = f"""WITH {J}, t(tier, points) AS (VALUES {_TIERS}), b AS (SELECT job_id, score, job_id % 8 AS n, CASE WHEN job_id % 3 > 0 THEN job_id % 26 END AS near,
  CASE category WHEN 'BUILDING' THEN {scoring.TRACK_POINTS["ai_strategy"]} WHEN 'MACHINERY' THEN {scoring.TRACK_POINTS["hr_analytics"]} ELSE 0 END AS track, 1 + job_id % 6 AS tier FROM j),
s AS (SELECT *, least(25, 5 * n) AS keywords, CASE WHEN n = 0 THEN 0 WHEN near IS NULL THEN least(25, 5 * n) ELSE greatest(0, least(25, round_even(0.4::DOUBLE * least(25, 5 * n) + 0.6::DOUBLE * near, 0))) END::BIGINT AS skills FROM b),
u AS (SELECT *, greatest(0, least(100, track + skills + score)) AS total FROM s)
SELECT job_id, track::BIGINT AS track, keywords::BIGINT AS keywords, skills, total::BIGINT AS total, greatest(0, least(100, total + greatest(-10, least(10, score - 50))))::BIGINT AS adjusted,
  round_even(least(100.0::DOUBLE, least(40.0::DOUBLE, 12.0::DOUBLE * n) + least(40.0::DOUBLE, 8.0::DOUBLE * score / 10) + 10), 4) AS proficiency,
  CASE WHEN least(10, n + 1) <= 3 THEN 'Poor' WHEN least(10, n + 1) <= 6 THEN 'Moderate' ELSE 'Strong' END AS tier,
  least(15, coalesce(points, 4) + CASE WHEN n = 0 THEN 2 ELSE 0 END + CASE WHEN n >= 8 THEN 2 WHEN n >= 6 THEN 1 ELSE 0 END)::BIGINT AS company FROM u LEFT JOIN t ON u.tier = t.tier"""


def _sql_has(column: str, words: str) -> str:
    return f"regexp_matches({column}, '\\b(?:{words.replace(chr(39), chr(39) * 2)})\\b', 'i')"


def mba_points(spark, sf_dir):
    """Programme phrases in all documents, each with a phrase of its own by key."""
    d = read(spark, sf_dir, "documents")
    said = F.element_at(F.array(*[F.lit(x) for x in MBA_TEXTS]), (F.col("doc_id") % len(MBA_TEXTS)).cast("int") + 1)
    return d.select("doc_id", scoring.mba_relevance(F.concat_ws(" ", "text", said), F.col("lang") == "fr").cast("long").alias("points"))


MBA_TEXTS = ["An MBA rotation", "our graduate programme and c-suite", "leadership development, strategic project", "high-impact work", "nothing", "MBA graduate program leadership academy board level"]
MBA = f"""WITH d AS (SELECT doc_id, lang, text || ' ' || [{", ".join(f"'{x}'" for x in MBA_TEXTS)}][doc_id % {len(MBA_TEXTS)} + 1] AS t FROM documents)
SELECT doc_id, least(15, (lang = 'fr')::INT * 3 + {" + ".join(f"{_sql_has('t', p)}::INT * {n}" for n, p in scoring.MBA_PHRASES)})::BIGINT AS points FROM d"""


def visa_points(spark, sf_dir):
    """Visa phrases and places of postings, raised by what is known of the company."""
    c = read(spark, sf_dir, "customer")
    said = F.element_at(F.array(*[F.lit(x) for x in VISA_TEXTS]), (F.col("c_custkey") % len(VISA_TEXTS)).cast("int") + 1)
    place = F.element_at(F.array(*[F.lit(x) for x in VISA_PLACES]), (F.col("c_nationkey") % len(VISA_PLACES)).cast("int") + 1)
    known = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 11)
    return c.select("c_custkey", scoring.international_friendliness(said, place, known, known + 1).cast("long").alias("points"))


VISA_TEXTS = ["We offer visa sponsorship.", "A relocation package helps", "EU Blue Card", "international team", "fully remote", "plain words"]
VISA_PLACES = ["Milan, Italy", "Remote", "Lyon", ""]
VISA = f"""WITH c AS (SELECT c_custkey, [{", ".join(f"'{x}'" for x in VISA_TEXTS)}][c_custkey % {len(VISA_TEXTS)} + 1] AS t, [{", ".join(f"'{x}'" for x in VISA_PLACES)}][c_nationkey % {len(VISA_PLACES)} + 1] AS p,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 11 END AS k FROM customer),
s AS (SELECT c_custkey, k, least(10, greatest({", ".join(f"CASE WHEN {_sql_has('t', w)} THEN {n} ELSE 0 END" for n, w in scoring.VISA_PHRASES)}) + CASE WHEN contains(lower(p), 'milan') THEN 2 WHEN p = 'Remote' THEN 1 ELSE 0 END) AS s FROM c)
SELECT c_custkey, greatest(CASE WHEN s = 0 THEN 2 ELSE s END, coalesce(least(round_even((k + k + 1) / 2.0::DOUBLE, 0), 10), 0))::BIGINT AS points FROM s"""


def pivot_points(spark, sf_dir):
    """Phrases of a change of career in titles and texts by key."""
    c = read(spark, sf_dir, "customer")
    title, body = (F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("c_custkey") % len(xs)).cast("int") + 1) for xs in (PIVOT_TITLES, PIVOT_BODIES))
    kind = F.when(F.col("c_custkey") % 4 == 0, "ai_strategy").otherwise("unknown")
    return c.select("c_custkey", scoring.pivot_bonus(title, body, kind).cast("long").alias("points"))


PIVOT_TITLES = ["AI Product Lead", "Data strategy analyst", "Clerk", "Digital work on product management", "Baker"]
PIVOT_BODIES = ["We build an AI based product", "a technology strategy for banks", "AI for MBA graduates", "nothing of the kind", "strategy with AI", "bread", "tea"]
_TITLE, _BODY = (f"[{', '.join(repr(x) for x in xs)}][c_custkey % {len(xs)} + 1]" for xs in (PIVOT_TITLES, PIVOT_BODIES))
PIVOT = f"""WITH c AS (SELECT c_custkey, {_TITLE} AS t, {_BODY} AS b FROM customer)
SELECT c_custkey, greatest(CASE WHEN {_sql_has("t", scoring.PIVOT_TITLE)} THEN 5 WHEN {_sql_has("b", scoring.PIVOT_TEXT)} THEN 3 ELSE 0 END, CASE WHEN {_sql_has("t", scoring.TECH_TITLE)} THEN 4 WHEN {_sql_has("b", scoring.TECH_TEXT)} THEN 2 ELSE 0 END,
  CASE WHEN {_sql_has("b", scoring.BRIDGE_TEXT)} THEN 3 ELSE 0 END, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END)::BIGINT AS points FROM c"""


def skill_profile(spark, sf_dir):
    """Parts as profiles: proficiency of each word of their name by confidence and months."""
    p = read(spark, sf_dir, "part")
    word = lambda x: F.struct(x.alias("skill"), F.lit("name").alias("category"), (F.char_length(x) % 4 / 4).alias("confidence"))
    rows = p.select("p_partkey", F.transform(F.array_distinct(F.split("p_name", " ")), word).alias("skills"), F.col("p_size").alias("months"))
    return intelligence.skill_profiles(rows, "p_partkey", "skills", "months").select("p_partkey", "skill", "category", "proficiency")


SKILL_PROFILE = """WITH s AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS skill, p_size AS m FROM part), c AS (SELECT *, length(skill) % 4 / 4::DOUBLE AS c FROM s)
SELECT p_partkey, skill, 'name' AS category, round_even(least(100.0::DOUBLE, least(40.0::DOUBLE, 12.0::DOUBLE * greatest(1, round_even(c * 3, 0))) + least(40.0::DOUBLE, 8.0::DOUBLE * m / 12.0::DOUBLE) + 20.0::DOUBLE * c), 2) AS proficiency FROM c"""


def sources_union(spark, sf_dir):
    """Orders as raw objects of four boards, each through its own reader, as one posting table."""
    j, day = _jobs(spark, sf_dir), F.lit("2024-01-01").cast("date")
    text_id = F.col("job_id").cast("string")
    of = lambda k: j.where(F.col("job_id") % 4 == k)
    made = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T10:00:00Z"))
    green = of(0).select(text_id.alias("title"), F.col("company").alias("_company_name"), F.struct(F.col("location").alias("name")).alias("location"), F.concat(F.lit("g/"), text_id).alias("absolute_url"), F.lit("<p>Tea &amp; cake</p>").alias("content"), made.alias("updated_at"))
    ash = of(1).select(text_id.alias("title"), F.col("location"), F.concat(F.lit("a/"), text_id).alias("jobUrl"), F.col("category").alias("descriptionHtml"), F.lit(None).cast("string").alias("publishedDate"))
    smart = of(2).select(text_id.alias("name"), F.struct(F.col("location").alias("city"), F.lit("it").alias("country")).alias("location"), F.concat(F.lit("s/"), text_id).alias("ref"), made.alias("releasedDate"))
    adz = of(3).select(F.when(F.col("job_id") % 8 == 3, F.lit(" ")).otherwise(text_id).alias("title"), F.struct(F.col("company").alias("display_name")).alias("company"), F.concat(F.lit("z/"), text_id).alias("redirect_url"), F.col("priority").alias("description"), made.alias("created"))
    every = sources.union_sources(sources.greenhouse(green, day), sources.ashby(ash, F.lit("Ash"), day), sources.smartrecruiters(smart, F.lit("Smart"), day), sources.aggregator(adz, "nl", day))
    return sources.required_fields(every).select("title", "company", "location", "job_board", "url", "description", "posted_date")


UNION = f"""WITH {J} SELECT job_id::VARCHAR AS title, company, coalesce(location, '') AS location, 'greenhouse' AS job_board, 'g/' || job_id AS url, 'Tea & cake' AS description, day AS posted_date FROM j WHERE job_id % 4 = 0
UNION ALL SELECT job_id::VARCHAR, 'Ash', coalesce(location, ''), 'ashby', 'a/' || job_id, category, DATE '2024-01-01' FROM j WHERE job_id % 4 = 1
UNION ALL SELECT job_id::VARCHAR, 'Smart', concat_ws(', ', location, 'it'), 'smartrecruiters', 's/' || job_id, '', day FROM j WHERE job_id % 4 = 2
UNION ALL SELECT job_id::VARCHAR, company, 'NL', 'adzuna', 'z/' || job_id, priority, day FROM j WHERE job_id % 4 = 3 AND job_id % 8 <> 3"""


def keyset_page(spark, sf_dir):
    """The page after a key, and the open postings of a scan: both have the operator's limit."""
    j = _jobs(spark, sf_dir).select(F.col("job_id").alias("id"), (F.col("status") == "F").alias("is_expired"))
    return sources.keyset_page(j, "id", 500, 100).withColumn("scan", F.lit("page")).unionByName(sources.open_postings(j, 100).withColumn("scan", F.lit("open")))


KEYSET = f"""WITH {J} (SELECT job_id AS id, status = 'F' AS is_expired, 'page' AS scan FROM j WHERE job_id > 500 ORDER BY job_id LIMIT 100)
UNION ALL (SELECT job_id, false, 'open' FROM j WHERE status <> 'F' ORDER BY job_id LIMIT 100)"""


def unexpired_events(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("expires"))
    return views.unexpired(e, "expires", F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")


UNEXPIRED = "SELECT event_id FROM events WHERE event_id % 3 = 0 OR ts > TIMESTAMP '2024-01-15'"


def feature_sets(spark, sf_dir):
    """Labelled documents with the columns of the newest version of a feature set."""
    versions = read(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "base").otherwise("wide").alias("name"), F.col("n_nationkey").alias("version"))
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return views.materialise_features(versions, docs, "base", ["doc_id", "n_chars", "quality"])


FEATURE_SETS = "SELECT doc_id, n_chars, quality, (SELECT max(n_nationkey) FROM nation WHERE n_nationkey % 2 = 0) AS version FROM documents JOIN labels USING (doc_id)"


def promote_model(spark, sf_dir):
    r = read(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), F.col("s_nationkey") % 3).alias("name"), F.col("s_suppkey").alias("version"), F.when(F.col("s_suppkey") % 10 == 0, "production").otherwise("staging").alias("stage"))
    return views.promote(r, "m1", 7)


PROMOTE = """SELECT 'm' || s_nationkey % 3 AS name, s_suppkey AS version, CASE WHEN s_nationkey % 3 = 1 AND s_suppkey = 7 THEN 'production' WHEN s_nationkey % 3 = 1 AND s_suppkey % 10 = 0 THEN 'archived'
  WHEN s_suppkey % 10 = 0 THEN 'production' ELSE 'staging' END AS stage FROM supplier"""


def conversation_context(spark, sf_dir):
    """What the next turn should know: a summary, remembered texts and the last turns."""
    c = read(spark, sf_dir, "conversations")
    recent = ranking.recent(c.select("conv_id", "turn", "text"), ["conv_id"], "turn", 2)
    memories = c.where("role = 'user'").select("conv_id", F.col("turn").alias("rank"), F.substring(F.sha2("text", 256), 1, 8).alias("text"))
    summaries = c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("string").alias("summary"))
    out = views.context(recent, memories, summaries, "conv_id")
    return out.select("conv_id", "summary", F.array_join("memories", ",").alias("memories"), F.sha2(F.array_join("messages", "|"), 256).alias("messages_sha256"))


CONTEXT = """WITH m AS (SELECT conv_id, string_agg(sha256(text)[1:8], ',' ORDER BY turn) AS memories FROM conversations WHERE role = 'user' GROUP BY 1),
r AS (SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS t FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY 1),
s AS (SELECT conv_id, count(*)::VARCHAR AS summary FROM conversations GROUP BY 1)
SELECT conv_id, summary, coalesce(memories, '') AS memories, sha256(coalesce(t, '')) AS messages_sha256 FROM s LEFT JOIN m USING (conv_id) LEFT JOIN r USING (conv_id)"""


def role_demand(spark, sf_dir):
    """Every supplier with every nation as a role, and what customers there ask for."""
    roles = read(spark, sf_dir, "nation").select(F.col("n_name").alias("role"), "n_nationkey")
    demand = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("demand")).join(roles, F.col("c_nationkey") == F.col("n_nationkey")).select("role", "demand")
    return views.role_scores(read(spark, sf_dir, "supplier").select("s_suppkey"), roles.select("role"), demand).select("s_suppkey", "role", "demand")


ROLE_DEMAND = """SELECT s_suppkey, n_name AS role, coalesce(demand, 0) AS demand FROM supplier CROSS JOIN nation
LEFT JOIN (SELECT c_nationkey, count(*) AS demand FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) ON c_nationkey = n_nationkey"""


def slug_registry(spark, sf_dir):
    """Slugs of part names and compressed texts of suppliers' names."""
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", text.slugify(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"), text.head_tail(F.concat_ws(" ", "p_name", "p_brand", "p_type"), 12).alias("short"))


SLUGS = r"""WITH p AS (SELECT p_partkey, p_name || ' & ' || p_brand AS s, p_name || ' ' || p_brand || ' ' || p_type AS t FROM part)
SELECT p_partkey, trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN length(t) <= 12 THEN t ELSE t[1:4] || ' ... ' || right(t, 8) END AS short FROM p"""

QUERIES = {
    "acquisition_chain": (acquisition_chain, ACQUISITION), "ingestion_gate": (ingestion_gate, INGESTION), "report_filters": (report_filters, REPORT), "above_threshold": (above_threshold, ABOVE),
    "status_view": (status_view, STATUS), "unscored_open": (unscored_open, UNSCORED_OPEN), "outcomes_join": (outcomes_join, OUTCOMES), "reviews_join": (reviews_join, REVIEWS),
    "feedback_rank": (feedback_rank, FEEDBACK), "top_opportunities": (top_opportunities, OPPORTUNITIES), "top_recommendations": (top_recommendations, RECOMMENDATIONS),
    "best_match_coverage": (best_match_coverage, BEST_MATCH), "document_counts": (document_counts, DOCUMENT_COUNTS), "source_performance": (source_performance, PERFORMANCE),
    "demand_sets": (demand_sets, DEMAND_SETS), "latest_benchmark": (latest_benchmark, LATEST_BENCHMARK), "demand_snapshot": (demand_snapshot, SNAPSHOT), "cost_daily": (cost_daily, DAILY),
    "provider_window": (provider_window, WINDOW), "gap_analysis": (gap_analysis, GAPS), "graph_neighbours": (graph_neighbours, NEIGHBOURS), "learning_path": (learning_path, LEARNING),
    "publish_history": (publish_history, HISTORY), "retry_split": (retry_split, RETRIES), "audit_trail": (audit_trail, TRAIL), "run_record": (run_record, RUN_RECORD),
    "filtered_backfill": (filtered_backfill, FILTERED), "load_rollback": (load_rollback, ROLLBACK), "vectors_retained": (vectors_retained, RETAINED), "search_log": (search_log, SEARCH_LOG),
    "position_upsert": (position_upsert, UPSERT), "conflicts": (conflicts, CONFLICTS), "output_invariants": (output_invariants, INVARIANTS), "evolve_table": (evolve_table, EVOLVE), "batch_signature": (batch_signature, SIGNATURE),
    "profile_phrases": (profile_phrases, PHRASES), "profile_chunks": (profile_chunks, CHUNKS), "profile_mapping": (profile_mapping, MAPPING), "company_seeds": (company_seeds, SEEDS),
    "category_weights": (category_weights, WEIGHTS), "raw_enrichment": (raw_enrichment, ENRICH), "isolated_parse": (isolated_parse, ISOLATED), "content_hashes": (content_hashes, HASHES),
    "ordered_unique": (ordered_unique, UNIQUE), "score_parts": (score_parts, SCORE_PARTS), "mba_points": (mba_points, MBA), "visa_points": (visa_points, VISA), "pivot_points": (pivot_points, PIVOT), "skill_profile": (skill_profile, SKILL_PROFILE),
    "sources_union": (sources_union, UNION), "keyset_page": (keyset_page, KEYSET), "unexpired_events": (unexpired_events, UNEXPIRED), "feature_sets": (feature_sets, FEATURE_SETS), "promote_model": (promote_model, PROMOTE),
    "conversation_context": (conversation_context, CONTEXT), "role_demand": (role_demand, ROLE_DEMAND), "slug_registry": (slug_registry, SLUGS),
}
