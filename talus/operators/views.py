"""Composed read views and table jobs: joins of postings with scores, applications and
reviews, list filters, counts, registries, envelopes and column evolution (survey groups B,
D, E, F, G, J, K, L)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.merge import latest_version


# ------------------------------------------------------------------ joins
def ranked_jobs(jobs: DataFrame, scores: DataFrame, applications: DataFrame, key: str = "job_id") -> DataFrame:
    """Scored jobs with the application where there is one."""
    return jobs.join(scores, key).join(applications, key, "left")


def applications_overview(applications: DataFrame, jobs: DataFrame, scores: DataFrame, key: str = "job_id", score: str = "total_score") -> DataFrame:
    """Applications with their job, and the score where there is one (0 without)."""
    joined = applications.join(jobs, key).join(scores.select(key, score), key, "left")
    return joined.withColumn(score, F.coalesce(score, F.lit(0)))


def stage_join(base: DataFrame, others: Iterable[DataFrame], key: str = "job_id", optional: Iterable[DataFrame] = ()) -> DataFrame:
    """Rows that every stage has, with the optional stages where they are there."""
    for other in others:
        base = base.join(other, key)
    for other in optional:
        base = base.join(other, key, "left")
    return base


def role_scores(profiles: DataFrame, roles: DataFrame, demand: DataFrame, role: str = "role") -> DataFrame:
    """Every profile with every role of a dictionary and the role's demand, 0 if unknown.
    The dictionary is counted before it is broadcast."""
    from talus.operators.lookup import small

    known = roles.join(small(demand.select(role, "demand")), role, "left").withColumn("demand", F.coalesce("demand", F.lit(0)))
    return profiles.join(small(known))


# ------------------------------------------------------------------ list views
def list_view(
    df: DataFrame, conditions: list[Column], sort: str, allowed: list[str], descending: bool = True, tie: str = "id", offset: int = 0, limit: int | None = None
) -> DataFrame:
    """Rows that meet all conditions, by a sort column of a fixed list with nulls last, and
    the number of all that match as `total`."""
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    rows = df
    for c in conditions:
        rows = rows.where(c)
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    ordered = rows.orderBy(F.col(sort).isNull(), F.desc(sort) if descending else F.asc(sort), tie).offset(offset)
    return (ordered if limit is None else ordered.limit(limit)).crossJoin(F.broadcast(total))


def headline_counts(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(name, n): rows of each table, or its distinct values of a column."""
    counts = [t.agg((F.count(F.lit(1)) if c is None else F.countDistinct(c)).alias("n")).select(F.lit(n).alias("name"), "n") for n, (t, c) in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def best_per_key(df: DataFrame, key: str, score: str, limit: int) -> DataFrame:
    """Keys by their best score, the first `limit`."""
    return df.groupBy(key).agg(F.max(score).alias("best"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("best"), key).limit(limit)


def stale_research(jobs: DataFrame, research: DataFrame, as_of: Column, days: int = 30, key: str = "job_id", time: str = "ts") -> DataFrame:
    """Jobs whose latest research is missing or older than `days`."""
    latest = research.groupBy(key).agg(F.max(time).alias("__at"))
    old = F.col("__at").isNull() | (F.col("__at") < as_of - F.expr(f"interval {days} days"))
    return jobs.join(latest, key, "left").where(old).drop("__at")


def batch_signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, signature): an order-free mark of a batch that any number of tasks can add up.
    Rows count as often as they come: two sums of hashes, in decimals that hold any table's."""
    line = F.concat_ws("|", *columns)
    half = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.concat_ws("-", half(F.xxhash64(line)), half(F.xxhash64(F.lit(1), line))), F.lit("")).alias("signature"))


def once_per_signature(batch: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `batch` whose run and signature have no marker yet."""
    return batch.join(markers.select(*keys).distinct(), keys, "left_anti")


def context(recent: DataFrame, memories: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """(key, summary, memories, messages): what a conversation's next turn should know.
    recent: (key, turn, text); memories: (key, rank, text)."""
    ordered = lambda t, o, name: t.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(o, "text"))), lambda x: x["text"]).alias(name))
    out = summaries.join(ordered(memories, "rank", "memories"), key, "left").join(ordered(recent, "turn", "messages"), key, "left")
    return out.select(key, "summary", F.coalesce("memories", F.array().cast("array<string>")).alias("memories"), F.coalesce("messages", F.array().cast("array<string>")).alias("messages"))


def learned_rank(df: DataFrame, weights: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """(id, score): the weighted sum of the features, rounded to 4 places. weights: (feature,
    weight), one row per feature."""
    one = weights.groupBy().pivot("feature", features).agg(F.first("weight"))
    renamed = one.select(*[F.coalesce(F.col(f), F.lit(0.0)).alias(f"__w_{f}") for f in features])
    total = F.lit(0.0)
    for f in features:
        total = total + F.col(f).cast("double") * F.col(f"__w_{f}")
    return df.crossJoin(F.broadcast(renamed)).select(id_col, F.bround(total, 4).alias("score"))


# ------------------------------------------------------------------ reducers and registries
def last_non_null(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Per key, the last value of each column that isn't null."""
    rest = [c for c in df.columns if c not in (*keys, seq)]
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest])


def merge_maps(df: DataFrame, keys: list[str], seq: str, column: str) -> DataFrame:
    """Per key, the maps of all rows in order, later values in place of earlier ones."""
    entries = df.select(*keys, seq, F.explode(column).alias("k", "v"))
    last = entries.groupBy(*keys, "k").agg(F.max_by("v", seq).alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(column))


def promote(registry: DataFrame, name: str, version: int) -> DataFrame:
    """The registry with one version of a model in production and its former one archived."""
    mine = F.col("name") == name
    stage = F.when(mine & (F.col("version") == version), "production").when(mine & (F.col("stage") == "production"), "archived").otherwise(F.col("stage"))
    return registry.withColumn("stage", stage)


def materialise_features(sets: DataFrame, rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of the latest version of a feature set, and that version."""
    version = latest_version(sets.where(F.col("name") == name), ["name"], "version").select("version")
    return rows.select(*columns).crossJoin(F.broadcast(version))  # one row


# ------------------------------------------------------------------ events and evolution
def envelopes(df: DataFrame, kind: Column, key: Column, tenant: Column, time: str) -> DataFrame:
    """Rows as event envelopes; event_id follows from type and key, so that a rerun makes
    the same envelopes."""
    payload = F.to_json(F.struct(*df.columns))
    event = F.substring(F.sha2(F.concat_ws(":", kind, key), 256), 1, 32)
    return df.select(event.alias("event_id"), kind.alias("type"), F.lit(1).alias("version"), tenant.alias("tenant_id"), key.alias("idempotency_key"), payload.alias("payload"), F.col(time).alias("created_at"))


def unexpired(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    return df.where(F.col(expires).isNull() | (F.col(expires) > as_of))


def evolve(df: DataFrame, add: dict[str, Column], drop: list[str] = ()) -> DataFrame:
    """Columns are added where they are missing or null, then others dropped; running it
    again changes nothing."""
    filled = {c: (F.coalesce(F.col(c), v) if c in df.columns else v) for c, v in add.items()}
    return df.withColumns(filled).drop(*drop)


def keep_vectors(df: DataFrame, version: str, current: str, time: str, as_of: Column, days: int = 90) -> DataFrame:
    """Vectors of the current version that are not older than `days`."""
    return df.where((F.col(version) == current) & (F.col(time) >= as_of - F.expr(f"interval {days} days")))


def status_history(df: DataFrame, key: str, time: str, status: str) -> DataFrame:
    """Each change of status with the one before it and the seconds it lasted."""
    w = Window.partitionBy(key).orderBy(time)
    rows = df.withColumn("__p", F.lag(status).over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.col(status)))
    seconds = F.unix_timestamp(F.lead(time).over(w)) - F.unix_timestamp(time)
    return rows.select(key, time, status, F.col("__p").alias("previous"), seconds.alias("lasted"))
