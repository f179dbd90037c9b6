"""Dedupe, upsert and lifecycle operators on plain tables (survey groups G and L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by `seq`: one aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(seq, *[c for c in rest if c != seq])).alias("__b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__b.{c}").alias(c) for c in df.columns])


def insert_or_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The rows of `incoming` that an insert adds: first of their key, key not in `target`."""
    return first_per_key(incoming, keys, seq).join(target.select(*keys).distinct(), keys, "left_anti")


def two_key_duplicates(incoming: DataFrame, existing: DataFrame, first_key: str, second_key: str, id_col: str) -> DataFrame:
    """(incoming id, existing_id): a match by the first key, else by the second."""
    one = existing.groupBy(first_key).agg(F.min(id_col).alias("e1"))
    two = existing.groupBy(second_key).agg(F.min(id_col).alias("e2"))
    joined = incoming.join(one, first_key, "left").join(two, second_key, "left")
    return joined.select(F.col(id_col), F.coalesce("e1", "e2").alias("existing_id")).where("existing_id is not null")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """`target` with the rows of `source` in place of those with equal keys; new keys are
    added. Repeated source keys keep the greatest row."""
    columns = target.columns
    rest = [c for c in columns if c not in keys]
    new = source.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])
    return target.join(new.select(*keys), keys, "left_anti").select(columns).unionByName(new.select(columns))


def coalesce_update(target: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of the patch replace those of equal keys unless they are null."""
    changed = [c for c in patch.columns if c not in keys]
    renamed = patch.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in changed])
    joined = target.join(renamed, keys, "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in changed else F.col(c) for c in target.columns])


def ensure_rows(tracked: DataFrame, wanted: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """`tracked` with a default row for each wanted key that it lacks."""
    missing = wanted.select(key).distinct().join(tracked.select(key), key, "left_anti").withColumns(defaults)
    return tracked.unionByName(missing.select(tracked.columns))


def reject_backfill(rows: DataFrame, scored: DataFrame, key: str, reasons: list[str], default: str) -> DataFrame:
    """Rejected rows without a score, with the first reason that isn't null."""
    return rows.join(scored.select(key).distinct(), key, "left_anti").withColumn("explanation", F.coalesce(*reasons, F.lit(default)))


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def publish_version(published: DataFrame, changed: DataFrame, keys: list[str], content: str) -> DataFrame:
    """The rows of `changed` that differ from the latest version, as its next version."""
    latest = latest_version(published.select(*keys, "version", content), keys, "version").withColumnRenamed(content, "__old").withColumnRenamed("version", "__v")
    joined = changed.join(latest, keys, "left").where(~F.col(content).eqNullSafe(F.col("__old")) | F.col("__v").isNull())
    return joined.withColumn("version", F.coalesce("__v", F.lit(0)) + 1).drop("__v", "__old")


def validated_changes(changes: DataFrame, target: DataFrame, key: str, status: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): changes with a known status and row; the others with their error."""
    known = target.select(key, F.lit(True).alias("__known")).distinct()
    error = F.when(~F.coalesce(F.col(status).isin(allowed), F.lit(False)), "unknown status").when(F.col("__known").isNull(), "unknown id")
    marked = changes.join(known, key, "left").withColumn("error", error).drop("__known")
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def conflicts(changes: DataFrame, target: DataFrame, key: str, expected: str, version: str) -> DataFrame:
    """Changes whose expected version isn't the target's."""
    return changes.join(target.select(key, F.col(version).alias("found")), key).where(~F.col(expected).eqNullSafe(F.col("found")))


# ------------------------------------------------------------------ lifecycle
def month_partitions(df: DataFrame, date: str, ahead: int = 1) -> DataFrame:
    """(year, month, name): every month from the first to the last date, and `ahead` more."""
    span = df.agg(F.trunc(F.min(date), "month").alias("a"), F.add_months(F.trunc(F.max(date), "month"), ahead).alias("b"))
    months = span.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return months.select(F.year("m").alias("year"), F.month("m").alias("month"), F.date_format("m", "'p'yyyy_MM").alias("name"))


def expired_partitions(parts: DataFrame, as_of: Column, keep_months: int) -> DataFrame:
    cutoff = F.add_months(F.trunc(as_of, "month"), -keep_months)
    return parts.where(F.make_date("year", "month", F.lit(1)) < cutoff)


def retention(df: DataFrame, time: str, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows not older than `days`, and how many stay and go."""
    old = F.col(time) < as_of - F.expr(f"interval {days} days")
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce(old, F.lit(False)).cast("long")).alias("deleted"))
    return df.where(~F.coalesce(old, F.lit(False))), counts.select((F.col("total") - F.coalesce("deleted", F.lit(0))).alias("kept"), F.coalesce("deleted", F.lit(0)).alias("deleted"))


def erase_tenant(tables: dict[str, DataFrame], column: str, tenant) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the tenant's rows, and (table, deleted)."""
    kept = {n: t.where(~F.col(column).eqNullSafe(F.lit(tenant))) for n, t in tables.items()}
    counts = [t.where(F.col(column) == tenant).agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(n).alias("table"), "deleted") for n, t in tables.items()]
    return kept, reduce(DataFrame.unionByName, counts)


def checksum(df: DataFrame) -> DataFrame:
    """(n, mark): count and order-free checksum of the rows: a sum of their hashes in 38 digits,
    which 10 ** 19 rows and more can't overflow and repeated rows can't cancel."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("mark"))


def verify_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    a, b = checksum(source), checksum(copy.select(source.columns))
    both = a.select(F.col("n").alias("n_source"), F.col("mark").alias("m1")).crossJoin(b.select(F.col("n").alias("n_copy"), F.col("mark").alias("m2")))  # a row each
    return both.select("n_source", "n_copy", (F.col("n_source") == F.col("n_copy")).alias("same_count"), F.col("m1").eqNullSafe(F.col("m2")).alias("same_rows"))


def scoped(df: DataFrame, tenant, column: str = "tenant_id") -> DataFrame:
    return df.where(F.col(column) == tenant)


def rank_in_partitions(df: DataFrame, key: Column, seq: str, partitions: int) -> DataFrame:
    """(…, partition, offset): contiguous places by `seq` within the key's partition, in more
    tasks than there are partitions."""
    from talus.operators.ranking import global_rank

    placed = global_rank(df.withColumn("partition", key % partitions), [F.asc(seq)], 64, "offset", "partition")
    return placed.withColumn("offset", F.col("offset") - 1)
