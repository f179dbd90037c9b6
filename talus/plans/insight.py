"""Driver queries over resumes, memory, runs and costs, on tables that Spark derives from the
driver's (survey C19-C22, D16, E16, E26, E30, E34, H7, I6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import intelligence, vectors
from talus.operators.lookup import small
from talus.plans.ranked import read


def eligibility_scores(spark, sf_dir):
    """Orders as postings whose text names a rule by their key."""
    said = ["Working language is English in an international team.", "German preferred. Relocation package.", "Italian required.", "EU citizenship preferred at a global company.", "No visa sponsorship.", "Plain text only here."]
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(s) for s in said]), (F.col("o_orderkey") % len(said)).cast("int") + 1).alias("t"))
    out = intelligence.eligibility(o, "t")
    return out.select("o_orderkey", "language_accessibility", "visa_accessibility", "english_environment", "international_signals", "eligibility_score", "eligibility_status")


ELIGIBILITY = """
WITH v(k, la, va, en, sig, st) AS (VALUES (0, 40, 28, 10, 5, 'ELIGIBLE'), (1, 26, 35, 0, 0, 'ELIGIBLE'), (2, 0, 0, 0, 0, 'REJECTED'), (3, 30, 18, 0, 8, 'ELIGIBLE'), (4, 0, 0, 0, 0, 'REJECTED'), (5, 30, 28, 0, 0, 'ELIGIBLE'))
SELECT o_orderkey, la AS language_accessibility, va AS visa_accessibility, en AS english_environment, sig AS international_signals, la + va + en + sig AS eligibility_score, st AS eligibility_status
FROM orders JOIN v ON o_orderkey % 6 = k"""


def resume_tenure(spark, sf_dir):
    """Customers as resumes with a closed and an open range."""
    c = read(spark, sf_dir, "customer")
    start, end = 2000 + F.col("c_custkey") % 10, 2010 + F.col("c_custkey") % 7
    text = F.concat(F.lit("Mar "), start, F.lit(" - Jun "), end, F.lit("\nMBA, Python and SQL, python\n"), end, F.lit(" - present\nPMP certified"))
    rows = intelligence.normalise_resumes(c.select("c_custkey", text.alias("text"), F.lit("English").alias("language")), "text", "language", 2026)
    return rows.select("c_custkey", F.col("experience_months").cast("long").alias("months"), F.size("skills").cast("long").alias("n_skills"), F.array_join("education", ",").alias("education"), F.size("certifications").cast("long").alias("n_certifications"))


TENURE = """SELECT c_custkey, ((2010 + c_custkey % 7 - 2000 - c_custkey % 10) * 12 + 3 + (2026 - 2010 - c_custkey % 7) * 12)::BIGINT AS months, 2::BIGINT AS n_skills, 'MBA' AS education, 1::BIGINT AS n_certifications FROM customer"""


def memory_topk(spark, sf_dir):
    """Turns of every hundredth conversation as queries against all turns of all."""
    c = read(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    q = c.where("conv_id % 100 = 0").select(F.col("id").alias("query_id"), F.lit("t").alias("tenant"), "text")
    m = c.select(F.col("id").alias("memory_id"), F.lit("t").alias("tenant"), "text", F.when(F.col("conv_id") % 7 == 0, F.lit("2024-01-01")).cast("timestamp").alias("expires_at"))
    return intelligence.remember(q, m, "tenant", F.lit("2024-06-01").cast("timestamp"), 3, 0.05).select("query_id", "memory_id", "similarity", F.col("rank").cast("long").alias("rank"))


MEMORY = """
WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id % 100 = 0 AS q, conv_id % 7 <> 0 AS m, text FROM conversations),
w AS (SELECT id, q, m, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS token FROM c),
t AS (SELECT id, q, m, token, count(*) AS tf FROM w WHERE token <> '' GROUP BY ALL), n AS (SELECT id, sqrt(sum(tf * tf)) AS l FROM t GROUP BY 1),
d AS (SELECT a.id AS query_id, b.id AS memory_id, sum(a.tf * b.tf) AS d FROM t a JOIN t b ON a.q AND b.m AND a.token = b.token GROUP BY 1, 2),
s AS (SELECT query_id, memory_id, round_even(d / (x.l * y.l), 6) AS similarity FROM d JOIN n x ON x.id = query_id JOIN n y ON y.id = memory_id)
SELECT * FROM (SELECT query_id, memory_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS rank FROM s WHERE similarity >= 0.05) WHERE rank <= 3"""


def run_rates(spark, sf_dir):
    """Orders as runs with a JSON detail."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    detail = F.to_json(F.struct((k % 5).alias("research_researched"), (k % 3).alias("research_cached"), (k % 4).alias("documents_generated"), (k % 2).alias("documents_reused"), F.when(k % 10 == 0, F.array(F.lit("e"))).alias("errors")))
    return intelligence.run_rates(o.select("o_orderkey", detail.alias("detail"), (F.col("o_totalprice") / 1000).alias("seconds")), "detail", "seconds", "o_orderkey")


RATES = """WITH r AS (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 200), s AS (SELECT count(*) AS runs, sum(o_orderkey % 5) AS a, sum(o_orderkey % 3) AS b, sum(o_orderkey % 4) AS g, sum(o_orderkey % 2) AS r, avg(o_totalprice / 1000) AS d, sum((o_orderkey % 10 = 0)::INT) AS f FROM r)
SELECT runs, round_even(100.0::DOUBLE * b / (a + b), 1) AS cache_hit_rate, round_even(100.0::DOUBLE * r / (g + r), 1) AS reuse_rate, round_even(d, 1) AS avg_duration, f::BIGINT AS failures FROM s"""


def spend_advice(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    cost = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") * 10).otherwise(F.col("l_extendedprice"))
    rows = lines.select(F.col("l_returnflag").alias("model"), cost.alias("cost"), (F.col("l_discount") > 0.09).alias("cached"), F.when(F.col("l_discount") > 0.09, F.col("l_tax")).otherwise(0.0).alias("saved"))
    return intelligence.spend_advice(rows, "model", "cost", "cached", "saved")


ADVICE = """
WITH m AS (SELECT l_returnflag AS model, sum(CASE l_returnflag WHEN 'R' THEN l_extendedprice * 10 ELSE l_extendedprice END) AS c FROM lineitem GROUP BY 1),
t AS (SELECT arg_max(model, c) AS model, max(c) / sum(c) AS share FROM m), h AS (SELECT avg((l_discount > 0.09)::INT) AS rate, sum(CASE WHEN l_discount > 0.09 THEN l_tax ELSE 0 END) AS saved FROM lineitem)
SELECT unnest(list_filter([CASE WHEN rate < 0.2 THEN 'Low cache hit rate (' || round_even(rate * 100, 0)::INT || '%)' END, CASE WHEN share > 0.6 THEN model || ' drives ' || round_even(share * 100, 0)::INT || '% of spend' END,
  CASE WHEN saved > 0 THEN 'Caching already saves cost' END], lambda x: x IS NOT NULL)) AS advice FROM t, h"""


def model_benchmarks(spark, sf_dir):
    return intelligence.model_benchmarks(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")


BENCHMARKS = """WITH g AS (SELECT l_suppkey, round_even(avg(l_quantity), 4) AS latency, round_even(avg(l_extendedprice), 4) AS cost, round_even(avg(l_discount), 4) AS quality FROM lineitem GROUP BY 1)
SELECT l_suppkey, latency, cost, quality, row_number() OVER (ORDER BY latency, l_suppkey) = 1 AS fastest, row_number() OVER (ORDER BY cost, l_suppkey) = 1 AS cheapest, row_number() OVER (ORDER BY quality DESC, l_suppkey DESC) = 1 AS best FROM g"""


def metric_rollup(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value is not null")
    kind = F.when(F.col("event_type").isin("view", "click"), "counter").when(F.col("event_type") == "error", "gauge").otherwise("histogram")
    rows = e.select("event_type", kind.alias("kind"), (F.col("user_id") % 3).alias("shard"), "value", F.struct("ts", "event_id").alias("at"))
    return intelligence.metric_rollup(rows, "event_type", "kind", ["shard"], "value", "at")


ROLLUP = """WITH e AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'counter' WHEN event_type = 'error' THEN 'gauge' ELSE 'histogram' END AS kind, user_id % 3 AS shard FROM events WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, shard ORDER BY ts DESC, event_id DESC) AS r FROM e)
SELECT event_type, kind, shard, round_even(CASE WHEN kind = 'gauge' THEN max(value) FILTER (r = 1) ELSE sum(value) END, 4) AS value, count(*) AS n, CASE WHEN kind = 'histogram' THEN round_even(avg(value), 4) END AS mean FROM r GROUP BY 1, 2, 3"""


def label_clusters(spark, sf_dir):
    """Labels whose centroids are alike, clustered around leaders by one greedy pass."""
    c = vectors.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding")  # a row per label
    other = c.select(F.col("label").alias("b"), F.col("centroid").alias("cb"))
    pairs = c.join(small(other), (F.col("label") < F.col("b")) & (vectors.cosine(F.col("centroid"), F.col("cb")) >= 0.05)).select(F.col("label").alias("a"), "b")
    return intelligence.clusters(pairs, c.select("label"))


CLUSTERS = """
WITH RECURSIVE u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
p AS (SELECT label, unnest(range(0, 64)) AS i, unnest(v) AS x FROM u), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1),
e AS (SELECT a.label AS a, b.label AS b FROM c a JOIN c b ON a.label <> b.label WHERE list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c) * list_dot_product(b.c, b.c)) >= 0.05),
n AS (SELECT row_number() OVER (ORDER BY label) AS pos, label, (SELECT coalesce(list(b), []) FROM e WHERE a = label) AS near FROM c),
g AS (SELECT 0::BIGINT AS pos, []::INT[] AS leaders, NULL::INT AS name, NULL::INT AS cluster
  UNION ALL SELECT pos, CASE WHEN hit IS NULL THEN list_append(leaders, label) ELSE leaders END, label, coalesce(hit, label)
  FROM (SELECT n.pos, leaders, label, list_filter(leaders, lambda x: list_contains(near, x))[1] AS hit FROM g JOIN n ON n.pos = g.pos + 1))
SELECT name, cluster FROM g WHERE name IS NOT NULL"""

QUERIES = {
    "eligibility_scores": (eligibility_scores, ELIGIBILITY), "resume_tenure": (resume_tenure, TENURE), "memory_topk": (memory_topk, MEMORY), "run_rates": (run_rates, RATES),
    "spend_advice": (spend_advice, ADVICE), "model_benchmarks": (model_benchmarks, BENCHMARKS), "metric_rollup": (metric_rollup, ROLLUP), "label_clusters": (label_clusters, CLUSTERS),
}
