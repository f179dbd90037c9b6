"""Driver queries: ranking, scoring formulas, gates and text (survey groups B, C, F, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import gates, scoring, text
from talus.operators.graph import cut
from talus.operators import lookup, ranking


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _scored_orders(spark, sf_dir) -> DataFrame:
    score = F.least(F.lit(100), F.floor(F.col("o_totalprice") / 5000)).cast("long")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), score.alias("total_score"), F.col("o_orderdate").cast("date").alias("fetched_date"))


def rank_bands(spark, sf_dir):
    return ranking.rank_jobs(_scored_orders(spark, sf_dir)).select("id", "total_score", F.col("rank").cast("long").alias("rank"), "band")


RANK_BANDS = """
WITH s AS (SELECT o_orderkey AS id, least(100, floor(o_totalprice / 5000))::BIGINT AS total_score, o_orderdate::DATE AS d FROM orders)
SELECT id, total_score, row_number() OVER (ORDER BY total_score DESC, d DESC NULLS LAST, id DESC)::BIGINT AS rank,
  CASE WHEN total_score >= 90 THEN 'Apply Now' WHEN total_score >= 80 THEN 'This Week' WHEN total_score >= 70 THEN 'Good Match' ELSE 'Low Priority' END AS band
FROM s"""


def topk_per_group(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    return ranking.top_per_group(parts, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


TOPK = """
SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3"""


def latest_order(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return ranking.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


LATEST = """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""


def bucket_order_export(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "source", "n_chars").join(labels, "doc_id")
    bucket = F.when(F.col("toxic") == 1, "Rejected").otherwise(text.band(F.least(F.lit(100), F.floor(F.col("n_chars") / 50)), text.STRATEGIC_BUCKETS))
    place = F.array_position(F.array(*[F.lit(b) for b in text.BUCKET_ORDER]), F.col("bucket")).cast("long")
    return rows.withColumn("bucket", bucket).select("doc_id", "source", "bucket", place.alias("bucket_order"))


BUCKETS = """
WITH b AS (SELECT d.doc_id, d.source, CASE WHEN toxic = 1 THEN 'Rejected' ELSE CASE WHEN s >= 85 THEN 'Apply Immediately' WHEN s >= 70 THEN 'High Priority'
  WHEN s >= 50 THEN 'Medium Priority' WHEN s >= 35 THEN 'Low Priority' ELSE 'Ignore' END END AS bucket
  FROM (SELECT doc_id, source, least(100, floor(n_chars / 50)) AS s FROM documents) d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, source, bucket, list_position(['Apply Immediately', 'High Priority', 'Medium Priority', 'Low Priority', 'Ignore', 'Rejected'], bucket)::BIGINT AS bucket_order FROM b"""


def _jobs(spark, sf_dir) -> DataFrame:
    """Orders as postings: a score, a visa gate, a status and a research flag."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7 % 101).alias("total_score"),
        F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FAIL").alias("visa_gate"),
        F.when(F.col("o_orderkey") % 11 == 0, "Applied").otherwise("Not Started").alias("application_status"),
        (F.col("o_orderkey") % 3 == 0).alias("has_research"),
        F.when(F.col("o_orderkey") % 4 == 0, "ai_strategy").when(F.col("o_orderkey") % 4 == 1, "business_strategy").otherwise("unknown").alias("role_category"),
        F.when(F.col("o_orderkey") % 5 == 0, "Remote").otherwise("On-site").alias("work_mode"),
    )


def dashboard_order(spark, sf_dir):
    out = scoring.recommend(_jobs(spark, sf_dir).withColumn("sponsorship", gates.sponsorship(F.col("visa_gate"))))
    return out.select("id", "recommendation", F.array_join("recommendation_reason", "; ").alias("reasons"), F.col("recommendation_rank").cast("long").alias("recommendation_rank"))


DASHBOARD = """
WITH j AS (SELECT o_orderkey AS id, o_orderkey * 7 % 101 AS s, CASE o_orderstatus WHEN 'F' THEN 'Likely' WHEN 'O' THEN 'No' ELSE 'Unknown' END AS sp,
  o_orderkey % 11 = 0 AS applied, o_orderkey % 3 = 0 AS researched, CASE o_orderkey % 4 WHEN 0 THEN 'ai_strategy' WHEN 1 THEN 'business_strategy' ELSE 'unknown' END AS role,
  o_orderkey % 5 = 0 AS remote FROM orders),
g AS (SELECT *, list_filter([CASE WHEN s >= 80 OR role IN ('ai_strategy', 'business_strategy') THEN 'Strong role fit' END,
  CASE WHEN sp = 'Likely' THEN 'High sponsorship likelihood' END, CASE WHEN role = 'ai_strategy' THEN 'AI initiatives align with MBA specialization' END,
  CASE WHEN remote THEN 'Flexible work mode' END], lambda x: x IS NOT NULL) AS sig FROM j),
r AS (SELECT id, CASE WHEN applied THEN 'Skip' WHEN s < 50 THEN 'Skip' WHEN s < 70 THEN 'Save For Later' WHEN sp = 'No' THEN 'Find Referral First'
  WHEN NOT researched AND s >= 80 THEN 'Research Company' WHEN s >= 90 THEN 'Apply Immediately' ELSE 'Apply This Week' END AS recommendation,
  CASE WHEN applied THEN ['Already in pipeline (Applied)'] WHEN s < 50 THEN ['Score below strategic threshold'] WHEN s < 70 THEN ['Moderate fit — revisit if capacity allows']
  WHEN sp = 'No' THEN list_concat(['Sponsorship unlikely — secure a referral to strengthen the case'], sig)
  WHEN NOT researched AND s >= 80 THEN list_concat(['High-fit role — research the company before applying'], sig)
  WHEN len(sig) > 0 THEN sig WHEN s >= 90 THEN ['Top-tier match'] ELSE ['Strong match'] END AS rs FROM g)
SELECT id, recommendation, array_to_string(rs, '; ') AS reasons,
  (list_position(['Apply Immediately', 'Apply This Week', 'Find Referral First', 'Research Company', 'Save For Later', 'Skip'], recommendation) - 1)::BIGINT AS recommendation_rank FROM r"""


def _components(spark, sf_dir) -> DataFrame:
    """Parts as postings with the score components that the metrics need."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("job_id"), (k % 16).alias("mba_relevance"), (k % 31).alias("track_alignment"), (k * 3 % 16).alias("company_quality"),
        (k % 11).alias("intl_friendliness"), (k * 7 % 101).alias("total_score"), (k * 5 % 41).alias("visa_accessibility"),
        F.when(k % 3 == 0, k % 11).alias("visa_friendliness"), F.col("p_type").alias("role_category"), F.col("p_brand").alias("company"),
    )


METRIC_SQL = """
c AS (SELECT p_partkey AS job_id, p_partkey % 16 AS mba, p_partkey % 31 AS tr, p_partkey * 3 % 16 AS cq, p_partkey % 11 AS intl, p_partkey * 7 % 101 AS total,
  p_partkey * 5 % 41 AS va, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 11 END, 5) AS vf, p_type, p_brand FROM part),
m AS (SELECT *, round_even(mba / 15.0::DOUBLE * 100, 0)::INT AS mba_fit, round_even(tr / 30.0::DOUBLE * 100, 0)::INT AS ai_dt_fit, round_even(cq / 15.0::DOUBLE * 100, 0)::INT AS brand,
  total::INT AS interview_prob, (100 - total)::INT AS effort,
  round_even(0.5::DOUBLE * (va / 40.0::DOUBLE * 100) + 0.3::DOUBLE * (vf / 10.0::DOUBLE * 100) + 0.2::DOUBLE * (intl / 10.0::DOUBLE * 100), 0)::INT AS sponsorship_prob FROM c),
oi AS (SELECT *, ai_dt_fit AS pivot_value, round_even((0.5::DOUBLE * interview_prob + 0.3::DOUBLE * ai_dt_fit + 0.2::DOUBLE * sponsorship_prob) * (1 - 0.3::DOUBLE * effort / 100), 0)::INT AS roi FROM m),
cs AS (SELECT *, round_even(0.3::DOUBLE * interview_prob + 0.2::DOUBLE * mba_fit + 0.2::DOUBLE * ai_dt_fit + 0.15::DOUBLE * sponsorship_prob + 0.1::DOUBLE * brand + 0.05::DOUBLE * pivot_value, 2) AS composite FROM oi),
t AS (SELECT *, CASE WHEN composite >= 65 THEN 1 WHEN composite >= 50 THEN 2 ELSE 3 END AS tier FROM cs)"""


def eight_metrics(spark, sf_dir):
    return scoring.eight_metrics(_components(spark, sf_dir)).select("job_id", *scoring.METRICS)


EIGHT = f"WITH {METRIC_SQL} SELECT job_id, mba_fit, ai_dt_fit, brand, interview_prob, sponsorship_prob, pivot_value, effort, roi FROM t"


def weekly_plan(spark, sf_dir):
    rows = scoring.composite(scoring.eight_metrics(_components(spark, sf_dir)))
    order = [F.desc("composite"), F.desc("interview_prob"), F.desc("total_score"), F.asc("job_id")]
    ranked = ranking.global_rank(rows, order, buckets=16)
    return ranking.plan_slots(ranked).select("job_id", "composite", F.col("place").cast("long").alias("place"), "slot")


WEEKLY = f"""WITH {METRIC_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY composite DESC, interview_prob DESC, total DESC, job_id) AS rank FROM t),
e AS (SELECT *, row_number() OVER (ORDER BY rank) AS place FROM r WHERE tier <= 2)
SELECT job_id, composite, place::BIGINT AS place, CASE WHEN place <= 5 THEN 'today' ELSE 'this_week' END AS slot FROM e WHERE place <= 10"""


def recommend_v2(spark, sf_dir):
    rows = scoring.recommend_by_metrics(scoring.composite(scoring.eight_metrics(_components(spark, sf_dir))))
    return rows.select("job_id", "tier", "recommendation_type", F.size("strengths").cast("long").alias("n_strengths"), F.size("risks").cast("long").alias("n_risks"))


RECOMMEND2 = f"""WITH {METRIC_SQL} SELECT job_id, tier::INT AS tier, CASE WHEN tier = 1 THEN 'APPLY_IMMEDIATELY' WHEN tier = 3 THEN 'MONITOR'
  WHEN interview_prob <= 40 AND ai_dt_fit >= 70 THEN 'STRETCH_ROLE' WHEN roi >= 60 THEN 'APPLY_THIS_WEEK' ELSE 'MONITOR' END AS recommendation_type,
  ((mba_fit >= 70)::INT + (ai_dt_fit >= 70)::INT + (brand >= 70)::INT + (interview_prob >= 60)::INT + (sponsorship_prob >= 60)::INT)::BIGINT AS n_strengths,
  ((interview_prob <= 40)::INT + (sponsorship_prob <= 40)::INT + (effort >= 60)::INT + (roi <= 40)::INT)::BIGINT AS n_risks FROM t"""


TITLES = {"metal_work": ["steel", "brushed nickel", "copper", "tin"], "treatment": ["polished", "anodized", "plated", "burnished", "brushed"], "size": ["small", "medium", "large", "economy", "promo"]}


def title_classify(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("title"))
    out = lookup.classify_titles(parts, "title", lookup.flatten_dictionary(spark, TITLES))
    return out.select("p_partkey", "category", gates.track(F.col("category")).alias("track"))


_TERMS = ", ".join(f"('{t}', '{c}', {i * 10000 + j})" for i, (c, ts) in enumerate(TITLES.items()) for j, t in enumerate(ts))
TITLE_SQL = f"""
WITH d(term, category, pos) AS (VALUES {_TERMS}),
m AS (SELECT p_partkey, category, row_number() OVER (PARTITION BY p_partkey ORDER BY length(term) DESC, pos) AS r FROM part JOIN d ON contains(lower(trim(p_type)), term))
SELECT p.p_partkey, coalesce(m.category, 'unknown') AS category, 'unclassified' AS track FROM part p LEFT JOIN m ON p.p_partkey = m.p_partkey AND m.r = 1"""

KEYWORDS = {"licence": ["license", "licensed under", "mit"], "articles": ["the ", "of ", "der ", "la "], "markup": ["|||", "&&& ", "$$$ "]}


def keyword_categories(spark, sf_dir):
    rows = lookup.keyword_categories(read(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS)
    n = F.size("categories")
    found = F.array_join(F.array_sort(F.map_keys("categories")), ",")
    return rows.select("doc_id", found.alias("found"), scoring.keyword_score(n).cast("long").alias("keyword_score"))


KEYWORD_SQL = """
WITH l AS (SELECT doc_id, lower(text) AS t FROM documents),
c AS (SELECT doc_id, list_filter([CASE WHEN contains(t, 'the ') OR contains(t, 'of ') OR contains(t, 'der ') OR contains(t, 'la ') THEN 'articles' END,
  CASE WHEN contains(t, 'license') OR contains(t, 'licensed under') OR regexp_matches(t, '(^|[^\\p{L}\\p{N}_])mit($|[^\\p{L}\\p{N}_])') THEN 'licence' END,
  CASE WHEN contains(t, '|||') OR contains(t, '&&& ') OR contains(t, '$$$ ') THEN 'markup' END], lambda x: x IS NOT NULL) AS f FROM l)
SELECT doc_id, array_to_string(f, ',') AS found, least(25, 5 * len(f))::BIGINT AS keyword_score FROM c"""

PROFILES = [("bright", 9, 1), ("supplier#000000001", 7, 2), ("000000005", 3, 3), ("", 1, 4)]


def lookup_join_default(spark, sf_dir):
    profiles = spark.createDataFrame(PROFILES, "profile string, visa int, pos int")
    sup = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    out = lookup.lookup_join(sup, text.norm_company(F.col("s_name")), profiles, "profile", F.col("pos"), {"visa": F.lit(5)})
    return out.select("s_suppkey", "visa", "is_fallback")


LOOKUP_SQL = """
WITH p(profile, visa, pos) AS (VALUES ('bright', 9, 1), ('supplier#000000001', 7, 2), ('000000005', 3, 3)),
m AS (SELECT s_suppkey, visa, row_number() OVER (PARTITION BY s_suppkey ORDER BY (lower(s_name) = profile) DESC, pos) AS r
  FROM supplier JOIN p ON contains(lower(s_name), profile) OR contains(profile, lower(s_name)))
SELECT s.s_suppkey, coalesce(m.visa, 5)::INT AS visa, m.visa IS NULL AS is_fallback FROM supplier s LEFT JOIN m ON s.s_suppkey = m.s_suppkey AND m.r = 1"""

HOSTS = [("spam", "spam"), (".com", "commercial"), (".net", "network"), ("/de/", "german")]


def first_containment_label(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.first_label(F.col("url"), HOSTS, "other").alias("label"))


LABEL_SQL = """SELECT page_id, CASE WHEN contains(lower(url), 'spam') THEN 'spam' WHEN contains(lower(url), '.com') THEN 'commercial'
  WHEN contains(lower(url), '.net') THEN 'network' WHEN contains(lower(url), '/de/') THEN 'german' ELSE 'other' END AS label FROM pages"""


def pii_mask_email(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.mask_email(F.col("text")), 256).alias("masked_sha256"))


EMAIL_SQL = r"""SELECT doc_id, sha256(regexp_replace(text, '([A-Za-z0-9])[A-Za-z0-9._%+\-]*(@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', '\1***\2', 'g')) AS masked_sha256
FROM documents"""


def pii_mask_phone(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.mask_phone(text.mask_email(F.col("text"))), 256).alias("masked_sha256"))


# Each match is cut into its pieces of digits to find its last two; matches are put back from the last piece to the first.
PHONE_SQL = r"""
WITH m AS (SELECT doc_id, regexp_replace(text, '([A-Za-z0-9])[A-Za-z0-9._%+\-]*(@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', '\1***\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, regexp_split_to_array(t, '\+?[0-9][0-9\s().\-]{6,}[0-9]') AS parts, regexp_extract_all(t, '\+?[0-9][0-9\s().\-]{6,}[0-9]') AS hits FROM m)
SELECT doc_id, sha256(array_to_string(list_transform(parts, lambda x, i: x || CASE WHEN i <= len(hits) THEN '***' || right(regexp_replace(hits[i], '[^0-9]', '', 'g'), 2) ELSE '' END), '')) AS masked_sha256 FROM p"""


def skill_mentions(spark, sf_dir):
    return lookup.term_mentions(read(spark, sf_dir, "documents"), "doc_id", "text", ["license", "that", "idiot", "$$$"])


MENTION_SQL = """
WITH t(term) AS (VALUES ('license'), ('that'), ('idiot'), ('$$$')),
c AS (SELECT doc_id, term, ((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term))::BIGINT AS mentions FROM documents, t)
SELECT doc_id, term, mentions, least(1.0, round_even(0.6::DOUBLE + 0.2::DOUBLE * mentions, 2))::DOUBLE AS confidence FROM c WHERE mentions > 0"""


def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"), F.sha2(text.head_tail(F.col("text"), 60), 256).alias("compressed_sha256"))


TOKEN_SQL = """SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens,
  sha256(CASE WHEN length(text) <= 60 THEN text ELSE text[1:20] || ' ... ' || right(text, 40) END) AS compressed_sha256 FROM conversations"""


def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_tags(F.col("html")), 256).alias("text_sha256"))


STRIP_SQL = """SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_sha256 FROM pages"""


def relative_date(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat((k % 40).cast("string"), F.lit(" days ago"))).when(k % 4 == 1, F.concat((k % 5).cast("string"), F.lit(" weeks ago")))
    raw = raw.when(k % 4 == 2, F.concat((k % 9).cast("string"), F.lit(" months ago"))).otherwise(F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    return rows.select("o_orderkey", text.posted_date(raw, F.col("d")).alias("posted"))


DATE_SQL = """SELECT o_orderkey, (o_orderdate::DATE - (CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 40 WHEN 1 THEN 7 * (o_orderkey % 5) WHEN 2 THEN 30 * (o_orderkey % 9) ELSE 0 END)::INT)::DATE AS posted FROM orders"""


def gate_report(spark, sf_dir):
    """Both gates over all documents, each with a phrase of its own appended by id."""
    phrases = ["Italian required for this role.", "German is a plus, fluent in German would be an asset.", "No visa sponsorship.", "We offer visa sponsorship.", "Native speaker of English."]
    docs = read(spark, sf_dir, "documents")
    phrase = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("doc_id") % len(phrases)).cast("int") + 1)
    rows = docs.select("doc_id", F.concat_ws(" ", "text", phrase).alias("t"))
    judged = rows.select("doc_id", gates.language_gate("t").alias("l"), gates.visa_gate("t").alias("v"))
    return judged.select("doc_id", F.col("l.ok").alias("language_ok"), F.col("l.label").alias("language_label"), F.col("v.ok").alias("visa_ok"), F.col("v.label").alias("visa_label"))


GATE_SQL = """SELECT doc_id, doc_id % 5 <> 0 AS language_ok, CASE WHEN doc_id % 5 = 0 THEN 'language_required' END AS language_label,
  doc_id % 5 <> 2 AS visa_ok, CASE WHEN doc_id % 5 = 2 THEN 'no_visa_sponsorship' END AS visa_label FROM documents"""


def prefilter_reasons(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    key = F.sha2(text.natural_key(F.col("text"), F.col("lang")), 256)
    reasons = [("expired", F.col("doc_id") % 17 == 0), ("geo_rejected", F.col("lang") == "es"), ("role_rejected", F.col("n_chars") < 200), ("seniority_rejected", F.col("source") == "src3")]
    # Keys of whole texts are hashed once: both sides of the join read them from a table.
    rows = cut(docs.select("doc_id", "lang", "n_chars", "source", key.alias("key")))
    return lookup.prefilter(rows, F.col("key"), "doc_id", reasons).select("doc_id", "reason")


PREFILTER_SQL = """
WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) || '|' || lang) AS key, doc_id % 17 = 0 AS expired,
  CASE WHEN lang = 'es' THEN 'geo_rejected' WHEN n_chars < 200 THEN 'role_rejected' WHEN source = 'src3' THEN 'seniority_rejected' END AS other FROM documents),
f AS (SELECT key, min(doc_id) AS first_kept FROM k WHERE NOT expired AND other IS NULL GROUP BY key)
SELECT k.doc_id, CASE WHEN k.expired THEN 'expired' WHEN coalesce(k.doc_id > f.first_kept, false) THEN 'duplicate' ELSE coalesce(k.other, 'kept') END AS reason
FROM k LEFT JOIN f ON k.key = f.key"""


def opportunity_score(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("words"), F.col("p_size").alias("demand"))
    rows = lookup.coverage(parts, "words", ["STEEL", "POLISHED", "LARGE", "BRASS"])
    return scoring.opportunity(rows, "coverage", "demand").select("p_partkey", "coverage", "opportunity", "confidence")


OPPORTUNITY_SQL = """
WITH c AS (SELECT p_partkey, p_size AS d, round_even(len(list_filter(['STEEL', 'POLISHED', 'LARGE', 'BRASS'], lambda w: list_contains(string_split(p_type, ' '), w))) / 4.0::DOUBLE, 4) AS coverage FROM part),
m AS (SELECT greatest(1, max(d)) AS dm FROM c)
SELECT p_partkey, coverage, round_even(100 * (0.55::DOUBLE * coverage + 0.3::DOUBLE * least(1.0::DOUBLE, d / dm::DOUBLE) + 0.15::DOUBLE * 0.5), 2) AS opportunity, least(1.0::DOUBLE, round_even(0.4::DOUBLE + 0.6::DOUBLE * coverage, 4)) AS confidence FROM c, m"""

QUERIES = {
    "rank_bands": (rank_bands, RANK_BANDS), "topk_per_group": (topk_per_group, TOPK), "latest_per_key": (latest_order, LATEST), "bucket_order_export": (bucket_order_export, BUCKETS),
    "dashboard_order": (dashboard_order, DASHBOARD), "eight_metrics": (eight_metrics, EIGHT), "weekly_plan": (weekly_plan, WEEKLY), "recommend_v2": (recommend_v2, RECOMMEND2),
    "title_classify": (title_classify, TITLE_SQL), "keyword_categories": (keyword_categories, KEYWORD_SQL), "lookup_join_default": (lookup_join_default, LOOKUP_SQL),
    "first_containment_label": (first_containment_label, LABEL_SQL), "pii_mask_email": (pii_mask_email, EMAIL_SQL), "pii_mask_phone": (pii_mask_phone, PHONE_SQL),
    "skill_mentions": (skill_mentions, MENTION_SQL), "token_estimate": (token_estimate, TOKEN_SQL), "html_strip": (html_strip, STRIP_SQL), "relative_date": (relative_date, DATE_SQL),
    "gate_report": (gate_report, GATE_SQL), "prefilter_reasons": (prefilter_reasons, PREFILTER_SQL), "opportunity_score": (opportunity_score, OPPORTUNITY_SQL),
}
