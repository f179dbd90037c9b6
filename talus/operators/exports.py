"""Report tables with fixed columns, the filters and derived fields of the dashboard, and the
checks and audits around them (survey A19, B14, B22, C6, C7, D3, E13, E37, L14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import gates
from talus.functions.text import BUCKET_ORDER, PRIORITY_BANDS, band, first_label, norm_company, work_mode
from talus.operators.ranking import rank_jobs

# Words of a location and their country codes, the first that it contains counts.
COUNTRY_CODES = [
    ("italy", "it"), ("italia", "it"), ("milan", "it"), ("milano", "it"), ("rome", "it"), ("roma", "it"), ("turin", "it"),
    ("uk", "gb"), ("united kingdom", "gb"), ("england", "gb"), ("london", "gb"),
    ("germany", "de"), ("deutschland", "de"), ("berlin", "de"), ("munich", "de"),
    ("france", "fr"), ("paris", "fr"), ("lyon", "fr"),
    ("netherlands", "nl"), ("amsterdam", "nl"),
    ("spain", "es"), ("barcelona", "es"), ("madrid", "es"),
    ("ireland", "ie"), ("dublin", "ie"),
    ("switzerland", "ch"), ("zurich", "ch"),
    ("sweden", "se"), ("stockholm", "se"),
    ("belgium", "be"), ("brussels", "be"),
    ("austria", "at"), ("vienna", "at"),
    ("remote", "eu"), ("europe", "eu"), ("european", "eu"),
]
# Words of a location and their country labels, the first that it contains counts.
COUNTRY_LABELS = [
    ("italy", "Italy"), ("italia", "Italy"), ("milan", "Italy"), ("milano", "Italy"), ("rome", "Italy"), ("roma", "Italy"), ("turin", "Italy"), ("torino", "Italy"), ("bologna", "Italy"),
    ("florence", "Italy"),
    ("united kingdom", "United Kingdom"), ("london", "United Kingdom"), ("england", "United Kingdom"), ("manchester", "United Kingdom"), ("edinburgh", "United Kingdom"),
    ("glasgow", "United Kingdom"), ("uk", "United Kingdom"),
    ("germany", "Germany"), ("deutschland", "Germany"), ("berlin", "Germany"), ("munich", "Germany"), ("münchen", "Germany"), ("frankfurt", "Germany"), ("hamburg", "Germany"),
    ("cologne", "Germany"), ("köln", "Germany"),
    ("france", "France"), ("paris", "France"), ("lyon", "France"), ("toulouse", "France"),
    ("netherlands", "Netherlands"), ("amsterdam", "Netherlands"), ("rotterdam", "Netherlands"), ("the hague", "Netherlands"), ("utrecht", "Netherlands"),
    ("spain", "Spain"), ("madrid", "Spain"), ("barcelona", "Spain"), ("valencia", "Spain"),
    ("ireland", "Ireland"), ("dublin", "Ireland"),
    ("switzerland", "Switzerland"), ("zurich", "Switzerland"), ("zürich", "Switzerland"), ("geneva", "Switzerland"), ("basel", "Switzerland"),
    ("sweden", "Sweden"), ("stockholm", "Sweden"), ("gothenburg", "Sweden"),
    ("belgium", "Belgium"), ("brussels", "Belgium"), ("antwerp", "Belgium"),
    ("austria", "Austria"), ("vienna", "Austria"), ("wien", "Austria"),
    ("portugal", "Portugal"), ("lisbon", "Portugal"), ("porto", "Portugal"),
    ("denmark", "Denmark"), ("copenhagen", "Denmark"),
    ("norway", "Norway"), ("oslo", "Norway"),
    ("finland", "Finland"), ("helsinki", "Finland"),
    ("poland", "Poland"), ("warsaw", "Poland"), ("kraków", "Poland"), ("krakow", "Poland"),
]
# The columns of the report tables, in their order.
SCORED_COLUMNS = [
    "priority_bucket", "total_score", "eligibility_score", "title", "company", "location", "posted_date", "role_category", "track", "language_gate", "visa_gate", "detected_language",
    "language_risk", "eligibility_status", "track_alignment_score", "skill_match", "mba_relevance_score", "company_quality_score", "intl_friendliness_score", "pivot_bonus_score",
    "explanation", "url",
]
MASTER_COLUMNS = [
    "rank", "total_score", "application_priority", "company", "title", "location", "country", "work_mode", "sponsorship", "role_category", "application_status", "fetched_date", "url", "notes",
]
PRIORITY_COLUMNS = ["rank", "total_score", "recommendation", "company", "title", "location", "sponsorship", "application_status", "url"]
APPLICATION_COLUMNS = ["job_id", "total_score", "status", "company", "title", "location", "notes", "last_updated"]
SCORES = ["total_score", "role_fit", "skills_match", "location_fit", "seniority_fit"]


# ------------------------------------------------------------------ derived fields
def country_code(location: Column) -> Column:
    """Code of the first word that the location contains; eu for others and none."""
    return first_label(location, COUNTRY_CODES, "eu")


def country_label(location: Column) -> Column:
    """Country of the first word that the location contains, Remote/EU for remote places, else
    the trimmed location; Unknown for a blank one."""
    bare = F.regexp_replace(F.coalesce(location, F.lit("")), r"^\s+|\s+$", "")
    remote = F.lower(bare).rlike(r"\b(?:remote|anywhere|europe|european)\b")
    return F.when(bare == "", "Unknown").otherwise(first_label(bare, COUNTRY_LABELS, F.when(remote, "Remote/EU").otherwise(bare)))


def report_rows(jobs: DataFrame, focus: list[str] | None = None, interns_only: bool = False, reject_non_english: bool = False) -> DataFrame:
    """The jobs of the dashboard: internships only if asked for, not clearly outside the
    focus, whose description passes the language gate now, and not of HIGH language risk
    if other languages are rejected."""
    kept = jobs.where(gates.is_intern(F.col("title"))) if interns_only else jobs
    if focus:
        kept = kept.where(~gates.outside_focus(F.col("location"), focus))
    if reject_non_english:
        kept = kept.where(F.coalesce("language_risk", F.lit("LOW")) != "HIGH")
    # The gate reads texts in Python workers: it comes last, on the rows that are left.
    gated = kept.withColumn("__gate", gates.language_gate(F.col("description")))
    return gated.where("__gate.ok").drop("__gate")


def master_rows(ranked: DataFrame, applications: DataFrame) -> DataFrame:
    """The dashboard's table: ranked rows with their country, work mode, sponsorship and application."""
    state = applications.groupBy("job_id").agg(F.max(F.struct("last_updated", "status", "notes")).alias("a"))
    rows = ranked.join(state, "job_id", "left").withColumns({
        "application_priority": band(F.col("total_score"), PRIORITY_BANDS), "country": country_label(F.col("location")), "work_mode": work_mode(F.col("location"), F.col("description")),
        "sponsorship": gates.sponsorship(F.col("visa_gate")), "application_status": F.coalesce("a.status", F.lit("Not Started")), "notes": F.coalesce("a.notes", F.lit("")),
    })
    return rows.drop("a")


# ------------------------------------------------------------------ report tables
def bucket_summary(jobs: DataFrame, bucket: str = "priority_bucket") -> DataFrame:
    """(pos, bucket, n) of every bucket in its order, zero if absent, and the total at the end;
    rows without a bucket count as Ignore."""
    spark = jobs.sparkSession
    order = spark.createDataFrame(list(enumerate(BUCKET_ORDER)), "pos int, bucket string")
    counts = jobs.groupBy(F.coalesce(bucket, F.lit("Ignore")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    known = order.join(counts, "bucket", "left").select("pos", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = jobs.agg(F.count(F.lit(1)).alias("n")).select(F.lit(len(BUCKET_ORDER)).alias("pos"), F.lit("Total").alias("bucket"), "n")
    return known.unionByName(total)


def report_tables(
    jobs: DataFrame, applications: DataFrame, recommended: DataFrame, focus: list[str] | None = None, interns_only: bool = False, reject_non_english: bool = False
) -> dict[str, DataFrame]:
    """The seven tables of a report. jobs: scored rows with the columns of SCORED_COLUMNS, job_id,
    description and fetched_date; applications: (job_id, status, notes, last_updated);
    recommended: (job_id, recommendation, place), place the order of the dashboard."""
    ranked = rank_jobs(report_rows(jobs, focus, interns_only, reject_non_english).withColumn("id", F.col("job_id")), id_col="id")
    master = master_rows(ranked, applications)
    placed = master.join(recommended, "job_id")
    applied = applications.join(jobs.select("job_id", "total_score", "company", "title", "location"), "job_id")
    states = applications.groupBy(F.col("status").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("section"), "item", "n")
    places = master.groupBy(F.col("country").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("country").alias("section"), "item", "n")
    of = lambda name: placed.where(F.col("application_priority") == name).select(*PRIORITY_COLUMNS, "place")
    return {
        "scored_jobs": jobs.select(*SCORED_COLUMNS), "jobs_master": master.select(*MASTER_COLUMNS), "apply_now": of("Apply Now"), "this_week": of("This Week"),
        "applications": applied.select(*APPLICATION_COLUMNS), "analytics": states.unionByName(places), "summary": bucket_summary(jobs),
    }


def write_reports(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Each table at folder/name, ordered as the report shows it; writing again replaces it."""
    position = F.coalesce(*[F.when(F.col("priority_bucket") == b, i) for i, b in enumerate(BUCKET_ORDER)], F.lit(BUCKET_ORDER.index("Ignore"))) if "scored_jobs" in tables else F.lit(0)
    orders = {
        "scored_jobs": [position, F.desc("total_score"), F.asc("url")], "jobs_master": [F.asc("rank")], "apply_now": [F.asc("place")], "this_week": [F.asc("place")],
        "applications": [F.asc("job_id")], "analytics": [F.asc("section"), F.desc("n"), F.asc("item")], "summary": [F.asc("pos")],
    }
    for name, df in tables.items():
        writer = df.orderBy(*orders[name]).write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{folder}/{name}")


# ------------------------------------------------------------------ checks and audits
def score_offenders(df: DataFrame, key: str, columns: list[str], low: int = 0, high: int = 100) -> DataFrame:
    """(key, offenders) of the rows with a score that is null, no whole number or outside the range, each as name=value."""
    bad = lambda c: F.coalesce((F.col(c) != F.floor(c)) | (F.col(c) < low) | (F.col(c) > high), F.lit(True))
    said = F.array_compact(F.array(*[F.when(bad(c), F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null")))) for c in columns]))
    return df.select(key, said.alias("offenders")).where(F.size("offenders") > 0).select(key, F.array_join("offenders", ", ").alias("offenders"))


def geography_audit(jobs: DataFrame, focus: list[str] | None = None) -> DataFrame:
    """(job_id, company, title, location, current_bucket, rejection_reason, total_score) of the
    jobs that the geography gate would reject now."""
    judged = jobs.withColumn("__g", gates.geography(F.col("location"), focus)).where("not __g.ok")
    return judged.select("job_id", "company", "title", "location", F.col("priority_bucket").alias("current_bucket"), F.col("__g.reason").alias("rejection_reason"), "total_score")


def run_statistics(audit: DataFrame, dimensions: list[str], score: str) -> DataFrame:
    """(dimension, value, n, mean_score) over one audit table: a counter for each value of
    each dimension and for the whole, from one pass; means are whole numbers, rounded down."""
    named = audit.select(*[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in dimensions], F.col(score).alias("__s"))
    g = named.groupingSets([*[[F.col(c)] for c in dimensions], []], *[F.col(c) for c in dimensions]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.floor(F.avg("__s")).alias("mean_score"))
    full = (1 << len(dimensions)) - 1
    dimension, value = F.lit("all"), F.lit("all")
    for i, c in enumerate(dimensions):
        here = F.col("g") == full - (1 << (len(dimensions) - 1 - i))
        dimension, value = F.when(here, F.lit(c)).otherwise(dimension), F.when(here, F.col(c)).otherwise(value)
    return g.select(dimension.alias("dimension"), value.alias("value"), "n", "mean_score")


def document_metrics(documents: DataFrame, kind: str, version: str, types: dict[str, str]) -> DataFrame:
    """(metric, n): documents of each named type, all documents, and those of a later version."""
    counts = [F.count(F.when(F.col(kind) == value, 1)).alias(name) for name, value in types.items()]
    one = documents.agg(*counts, F.count(F.lit(1)).alias("total"), F.count(F.when(F.col(version) > 1, 1)).alias("reused_versions"))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in (*types, "total", "reused_versions")])
    return one.select(F.explode(pairs).alias("p")).select("p.metric", "p.n")


def on_watchlist(jobs: DataFrame, company: str, watched: DataFrame, name: str) -> DataFrame:
    """`jobs` with `watched`: is the company, without legal suffixes, on the list. Names that reduce to nothing are not."""
    keys = watched.select(norm_company(F.col(name)).alias("__w")).where("__w <> ''").distinct().withColumn("__on", F.lit(True))
    keyed = jobs.withColumn("__w", norm_company(F.col(company)))
    return keyed.join(keys, "__w", "left").withColumn("watched", F.coalesce("__on", F.lit(False))).drop("__w", "__on")
