"""The posting chain end to end, and readers and language queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import gates, scoring, text
from talus.operators import language, merge, ranking, vectors
from talus.operators.graph import cut
from talus.operators.lookup import small
from talus.plans.ranked import read
from talus.sources import postings as sources


def posting_pipeline(spark, sf_dir):
    """Documents as postings: fingerprint, dedupe, reasons, score, bucket, rank, action."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = cut(docs.select("doc_id", "source", "lang", "n_chars", text.fingerprint(F.lower("text"), F.col("lang")).alias("fp")))  # texts are hashed once
    reason = F.when(F.col("n_chars") < 100, "too_short").when(F.col("lang") == "es", "language")
    kept = rows.join(merge.first_per_key(rows.select("fp", "doc_id"), ["fp"], "doc_id").select("doc_id"), "doc_id", "left_semi").where(reason.isNull())
    marked = kept.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    score = F.least(F.floor(F.col("n_chars") / 60), F.lit(60)) + F.coalesce(F.col("quality") * 40, F.lit(20)) - F.coalesce(F.col("toxic") * 30, F.lit(0))
    scored = marked.select(F.col("doc_id").alias("id"), scoring.clamp(score, 0, 100).cast("long").alias("total_score"), F.lit(None).cast("date").alias("fetched_date"), "source", "lang")
    ranked = ranking.rank_jobs(scored)
    jobs = ranked.withColumns({
        "application_status": F.lit("Not Started"), "sponsorship": F.when(F.col("lang") == "en", "Likely").otherwise("Unknown"), "has_research": F.col("id") % 2 == 0,
        "role_category": F.lit("unknown"), "work_mode": F.lit("Remote"),
    })
    out = scoring.recommend(jobs).withColumn("bucket", text.band(F.col("total_score"), text.STRATEGIC_BUCKETS))
    return out.select("id", "source", "total_score", F.col("rank").cast("long").alias("rank"), "band", "bucket", "recommendation")


POSTING_PIPELINE = """
WITH f AS (SELECT doc_id, source, lang, n_chars, sha256(lower(text) || '|' || lang)[1:16] AS fp FROM documents), k AS (SELECT fp, min(doc_id) AS doc_id FROM f GROUP BY fp),
l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
s AS (SELECT f.doc_id AS id, source, lang, greatest(0, least(100, least(floor(n_chars / 60), 60) + coalesce(q * 40, 20) - coalesce(t * 30, 0)))::BIGINT AS total_score
  FROM f JOIN k ON f.doc_id = k.doc_id LEFT JOIN l ON f.doc_id = l.doc_id WHERE NOT (n_chars < 100) AND lang <> 'es')
SELECT id, source, total_score, row_number() OVER (ORDER BY total_score DESC, id DESC)::BIGINT AS rank,
  CASE WHEN total_score >= 90 THEN 'Apply Now' WHEN total_score >= 80 THEN 'This Week' WHEN total_score >= 70 THEN 'Good Match' ELSE 'Low Priority' END AS band,
  CASE WHEN total_score >= 85 THEN 'Apply Immediately' WHEN total_score >= 70 THEN 'High Priority' WHEN total_score >= 50 THEN 'Medium Priority' WHEN total_score >= 35 THEN 'Low Priority' ELSE 'Ignore' END AS bucket,
  CASE WHEN total_score < 50 THEN 'Skip' WHEN total_score < 70 THEN 'Save For Later' WHEN id % 2 = 1 AND total_score >= 80 THEN 'Research Company' WHEN total_score >= 90 THEN 'Apply Immediately' ELSE 'Apply This Week' END AS recommendation
FROM s"""


def language_id(spark, sf_dir):
    """The language of every document, by a profile fitted on the other half of them."""
    docs = read(spark, sf_dir, "documents")
    out = None
    for half in (0, 1):
        model = language.fit_profiles(docs.where(F.col("doc_id") % 2 == 1 - half), "text", "lang")
        found = language.detect(docs.where(F.col("doc_id") % 2 == half), model, "doc_id", "text")
        out = found if out is None else out.unionByName(found)
    # Ids may repeat, and those without a half (null or negative odd ones) have no profile.
    joined = docs.select("doc_id", "lang").join(out.dropDuplicates(["doc_id"]), "doc_id", "left").withColumn("detected", F.coalesce("language", F.lit("Unknown")))
    return joined.select("doc_id", "lang", "detected", language.risk(F.col("detected")).alias("risk"))


LANGUAGE = r"""
WITH c AS (SELECT doc_id, lang, doc_id % 2 AS half, text, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents),
g AS (SELECT doc_id, lang, half, text, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) AS gram FROM c),
n AS (SELECT half, lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL), s AS (SELECT half, lang, sum(n) AS total FROM n GROUP BY ALL),
p AS (SELECT n.half, n.lang, gram, ln(n * 400 * 10 / total::DOUBLE + 1) AS weight FROM n JOIN s ON n.half = s.half AND n.lang = s.lang
  QUALIFY row_number() OVER (PARTITION BY n.half, n.lang ORDER BY n DESC, gram) <= 400),
x AS (SELECT doc_id, p.lang AS detected, round(sum(weight), 9) AS s FROM g JOIN p ON p.half = 1 - g.half AND p.gram = g.gram WHERE length(trim(g.text)) >= 50 GROUP BY ALL),
b AS (SELECT doc_id, detected FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, detected DESC) = 1)
SELECT d.doc_id, lang, coalesce(detected, 'Unknown') AS detected, CASE WHEN coalesce(detected, 'Unknown') IN ('en', 'Unknown') THEN 'LOW' ELSE 'HIGH' END AS risk FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id"""


def ats_normalise(spark, sf_dir):
    """Customers and orders as raw ATS objects, read back through the normaliser."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    raw = o.select(
        F.concat(F.lit(" Order "), "o_orderkey", F.lit(" ")).alias("text"), F.col("c_name").alias("_company_name"),
        F.concat(F.lit("https://jobs.example.com/"), "o_orderkey").alias("hostedUrl"), (F.unix_timestamp("o_orderdate") * 1000).alias("createdAt"),
        F.struct(F.array("c_mktsegment", "o_orderstatus").alias("location")).alias("categories"), F.col("o_orderpriority").alias("descriptionPlain"),
    )
    return sources.lever(raw, F.lit("2024-01-01").cast("date")).select("title", "company", "location", "job_board", "url", "description", "posted_date")


ATS = """SELECT 'Order ' || o_orderkey AS title, c_name AS company, c_mktsegment || ', ' || o_orderstatus AS location, 'lever' AS job_board, 'https://jobs.example.com/' || o_orderkey AS url,
  o_orderpriority AS description, o_orderdate::DATE AS posted_date FROM orders JOIN customer ON o_custkey = c_custkey"""


def bulk_similarity(spark, sf_dir):
    """Similarity of every vector to the centroid of its label."""
    e = read(spark, sf_dir, "embeddings")
    c = vectors.centroids(e, "label", "embedding")
    return e.join(small(c), "label").select("vec_id", F.bround(vectors.cosine(F.col("embedding"), F.col("centroid")), 5).alias("similarity"))


BULK = """
WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
p AS (SELECT label, unnest(range(0, 64)) AS i, unnest(v) AS x FROM u), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1)
SELECT vec_id, round_even(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 5) AS similarity FROM u JOIN c USING (label)"""


#: Locations as postings write them; customers have one each.
LOCATIONS = [
    "Milan, Italy", "Remote", "New York", "Berlin", "Tilburg", "Remote - Europe", "Anywhere, US", "Padova", "Riga", "", "Toronto (hybrid)", "Breda, Nederland",
    "Home office, Paris", "Bengaluru", "Valletta", "Atlantis", "Remote, Athens", "London or Rotterdam",
]


def geography_report(spark, sf_dir):
    """Customers at locations by key: strict and coarse geography gates, wide and in focus."""
    c = read(spark, sf_dir, "customer")
    place = F.element_at(F.array(*[F.lit(x) for x in LOCATIONS]), (F.col("c_custkey") % len(LOCATIONS)).cast("int") + 1)
    rows = c.select("c_custkey", place.alias("place"))
    g = rows.select("c_custkey", gates.geography(F.col("place")).alias("g"), gates.outside_focus(F.col("place"), ["it", "nl"]).alias("away"), gates.geography(F.col("place"), ["it", "nl"]).alias("f"))
    return g.select("c_custkey", F.col("g.ok").alias("ok"), F.col("g.reason").alias("reason"), F.col("f.ok").alias("focus_ok"), F.col("f.reason").alias("focus_reason"), "away")


def _matches(words: str) -> str:
    return f"regexp_matches(place, '\\b(?:{words.replace(chr(39), chr(39) * 2)})\\b', 'i')"


_OTHERS = _matches("|".join(v for k, v in gates.PLACES.items() if k not in ("it", "nl")))
_FOCUS, _AWAY, _ANYWHERE = _matches(gates.PLACES["it"] + "|" + gates.PLACES["nl"]), _matches(gates.NOT_EUROPE), _matches("anywhere|worldwide")
_REMOTE, _EUROPE = _matches(gates.GENERIC_REMOTE), _matches(gates.EUROPE)
GEOGRAPHY = f"""
WITH p AS (SELECT c_custkey, [{", ".join(f"'{x}'" for x in LOCATIONS)}][c_custkey % {len(LOCATIONS)} + 1] AS place FROM customer),
r AS (SELECT c_custkey, place, CASE WHEN place = '' THEN 'no_location' WHEN {_AWAY} AND {_ANYWHERE} THEN 'remote_worldwide' WHEN {_AWAY} THEN 'non_eu' WHEN {_EUROPE} THEN 'eu' ELSE 'unknown_reject' END AS reason,
  CASE WHEN place = '' THEN 'no_location' WHEN {_FOCUS} THEN 'in_focus' WHEN {_REMOTE} AND NOT {_OTHERS} AND NOT {_AWAY} THEN 'remote_in_focus' ELSE 'outside_focus' END AS focus_reason,
  place <> '' AND NOT {_FOCUS} AND ({_OTHERS} OR ({_AWAY} AND NOT {_REMOTE})) AS away FROM p)
SELECT c_custkey, reason NOT IN ('non_eu', 'unknown_reject') AS ok, reason, focus_reason <> 'outside_focus' AS focus_ok, focus_reason, away FROM r"""

QUERIES = {
    "posting_pipeline": (posting_pipeline, POSTING_PIPELINE), "language_id": (language_id, LANGUAGE), "ats_normalise": (ats_normalise, ATS), "bulk_similarity": (bulk_similarity, BULK),
    "geography_report": (geography_report, GEOGRAPHY),
}
