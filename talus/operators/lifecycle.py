"""Tables on disk through their life: months as partitions that a load replaces, expired
months dropped or archived with an audit row, loads in batches that resume, and runs that
count once (survey L2, L3, G13, A22)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.views import batch_signature

AUDIT = "year int, month int, action string, rows bigint, as_of date"
BATCHES = "batch int, after bigint, until bigint"
DONE = "batch int, rows bigint"
MARKERS = "run_id string, signature string, fetched bigint, accepted bigint"


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows at `path`; none where nothing was written yet."""
    jpath, fs = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(jpath) else spark.createDataFrame([], schema)


# ------------------------------------------------------------------ months
def write_months(df: DataFrame, path: str, time: str) -> None:
    """Rows by year=/month= of `time`. A load replaces the months that it holds and leaves the
    others; rows without a time go to the default partition."""
    named = df.withColumns({"year": F.year(time), "month": F.month(time)})
    # Rows of a month meet in a few tasks, a large month in more of them, so that a month has few files.
    dealt = named.hint("rebalance", "year", "month")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def read_months(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """The table, or the months from that of `first` to that of `last`; others aren't listed in the scan."""
    df = spark.read.parquet(path)
    number = F.col("year") * 12 + F.col("month")
    if first is not None:
        df = df.where(number >= first.year * 12 + first.month)
    return df if last is None else df.where(number <= last.year * 12 + last.month)


def expire_months(spark: SparkSession, path: str, as_of: date, keep_months: int, audit: str, archive: str | None = None) -> DataFrame:
    """Drop, or move to `archive`, the months before `keep_months` whole months ago, with a row
    for each in the table at `audit` that is written first: a run that dies after it is
    finished by the next one. Returns this run's audit rows; a second run has none."""
    if keep_months < 0:
        raise ValueError("keep_months is 0 or more")
    first_kept = as_of.year * 12 + as_of.month - 1 - keep_months
    jpath, fs = _fs(spark, path)
    old = []
    for year in fs.globStatus(_fs(spark, f"{path}/year=[0-9]*")[0]) or []:
        for month in fs.listStatus(year.getPath()):
            name = month.getPath().getName()
            y, m = year.getPath().getName().removeprefix("year="), name.removeprefix("month=")
            if name.startswith("month=") and m.isdigit() and int(y) * 12 + int(m) - 1 < first_kept:
                old.append((int(y), int(m), month.getPath()))
    if not old:
        return spark.createDataFrame([], AUDIT)
    months = [(y, m) for y, m, _ in old]
    listed = spark.createDataFrame(months, "year int, month int")  # a row per expired folder
    counts = spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"))
    action = "archived" if archive else "dropped"
    rows = listed.join(counts, ["year", "month"], "left").select("year", "month", F.lit(action).alias("action"), F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(as_of).alias("as_of"))
    done = rows.collect()
    spark.createDataFrame(done, AUDIT).coalesce(1).write.mode("append").parquet(audit)
    for y, m, folder in old:
        if archive:
            target = _fs(spark, f"{archive}/year={y}/month={m}")[0]
            fs.mkdirs(target.getParent())
            if not fs.exists(target):
                fs.rename(folder, target)
        else:
            fs.delete(folder, True)
    return spark.createDataFrame(done, AUDIT)


# ------------------------------------------------------------------ loads in batches
def plan_batches(source: DataFrame, key: str, batch_rows: int) -> DataFrame:
    """(batch, after, until): ranges of the key with about `batch_rows` rows each; the first is
    open below, and together they hold every key."""
    n, most = source.agg(F.count(key), F.max(key).cast("long")).first()
    parts = max(1, -(-n // batch_rows)) if n else 0
    spark = source.sparkSession
    if not parts:
        return spark.createDataFrame([], BATCHES)
    shares = [i / parts for i in range(1, parts)]
    cuts = source.agg(F.percentile_approx(F.col(key).cast("long"), F.array(*[F.lit(s) for s in shares]), max(10_000, 20 * parts))).first()[0] if shares else []
    edges = sorted({c for c in cuts if c < most})
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip([None, *edges], [*edges, most]))], BATCHES)


def backfill(source: DataFrame, target: str, state: str, key: str, columns: list[str], where: Column | None = None, batch_rows: int = 5_000_000, after_batch: Callable[[int], None] | None = None) -> DataFrame:
    """Copy `columns` and the key of the rows that meet `where` to the table at `target`, in
    batches by ranges of the key, and return (batch, rows) of all batches.

    The batches are planned once and kept at `state`. Each is one folder of the target, which
    a repeated batch replaces, and a marker, written behind it: a load that broke goes on
    with the batches that have no marker, so that nothing is copied twice and nothing is left out.
    Rows without a key are not copied; keys that come later than the plan need a new load.
    """
    spark = source.sparkSession
    plan_path, done_path = f"{state}/plan", f"{state}/done"
    rows = source.where(F.col(key).isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))).select(*dict.fromkeys([key, *columns]))
    jpath, fs = _fs(spark, f"{plan_path}/_SUCCESS")
    if not fs.exists(jpath):
        plan_batches(rows, key, batch_rows).coalesce(1).write.mode("overwrite").parquet(plan_path)
    planned = spark.read.schema(BATCHES).parquet(plan_path).orderBy("batch").collect()  # a row per batch
    finished = {r.batch for r in _table(spark, done_path, DONE).collect()}
    for b in planned:
        if b.batch in finished:
            continue
        part = rows.where(F.col(key) <= b.until)
        part = part if b.after is None else part.where(F.col(key) > b.after)
        folder = f"{target}/batch={b.batch}"
        part.write.mode("overwrite").parquet(folder)
        copied = spark.read.schema(part.schema).parquet(folder).count()
        spark.createDataFrame([(b.batch, copied)], DONE).coalesce(1).write.mode("append").parquet(done_path)
        if after_batch is not None:
            after_batch(b.batch)
    return _table(spark, done_path, DONE).dropDuplicates(["batch"])


# ------------------------------------------------------------------ runs that count once
def append_once(batch: DataFrame, target: str, markers: str, run_id: str, keys: list[str], seq: str) -> tuple[bool, DataFrame]:
    """(added, marker): the rows of `batch` with a key that the table at `target` lacks, the
    first of each by `seq`, appended once for each run and signature of the batch.

    The folder that the rows go to is named by run and signature, so that a run that broke
    before its marker replaces what it wrote. A batch that was seen adds nothing.
    """
    from talus.operators.merge import first_per_key

    spark = batch.sparkSession
    fetched, signature = batch_signature(batch, keys).first()
    seen = _table(spark, markers, MARKERS).where((F.col("run_id") == run_id) & (F.col("signature") == signature))
    if not seen.isEmpty():
        return False, seen
    name = f"run-{hashlib.sha256(f'{run_id}/{signature}'.encode()).hexdigest()[:32]}"
    jpath, fs = _fs(spark, target)
    new = first_per_key(batch, keys, seq)
    if fs.exists(jpath):
        known = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(target).where(~F.contains(F.col("_metadata.file_path"), F.lit(name)))
        new = new.join(known.select(*keys).distinct(), keys, "left_anti").select(batch.columns)
    new.write.mode("overwrite").parquet(f"{target}/{name}")
    accepted = spark.read.schema(batch.schema).parquet(f"{target}/{name}").count()
    spark.createDataFrame([(run_id, signature, fetched, accepted)], MARKERS).coalesce(1).write.mode("append").parquet(markers)
    return True, _table(spark, markers, MARKERS).where((F.col("run_id") == run_id) & (F.col("signature") == signature))


# ------------------------------------------------------------------ versions of a table
VERSIONS = "version int, name string, rows bigint"


def migrate(spark: SparkSession, path: str, steps: list[tuple[int, str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Bring the table at `path`, whose first state is path/v=0, through the steps (version,
    name, change) in the order of their versions, each into a folder v=version, and return
    (version, name, rows) of all recorded ones.

    A step is recorded behind its folder: one that broke runs again and replaces what it
    wrote, one that is recorded never does, and a step below the last recorded version is an error.
    """
    log = f"{path}/versions"
    done = {r.version for r in _table(spark, log, VERSIONS).collect()}
    last = max(done, default=0)
    for version, name, change in sorted(steps, key=lambda s: s[0]):
        if version in done:
            continue
        if version <= last:
            raise ValueError(f"version {version} comes after {last}, which is recorded")
        out = change(spark.read.parquet(f"{path}/v={last}"))
        out.write.mode("overwrite").parquet(f"{path}/v={version}")
        rows = spark.read.parquet(f"{path}/v={version}").count()
        spark.createDataFrame([(version, name, rows)], VERSIONS).coalesce(1).write.mode("append").parquet(log)
        last = version
    return _table(spark, log, VERSIONS)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table at `path` in its last recorded version."""
    last = _table(spark, f"{path}/versions", VERSIONS).agg(F.max("version")).first()[0] or 0
    return spark.read.parquet(f"{path}/v={last}")


# ------------------------------------------------------------------ tenants
def write_scoped(df: DataFrame, path: str, tenant: str, column: str = "tenant_id") -> None:
    """Replace the tenant's rows of the table at `path`. Every row is written as the tenant's,
    whatever its own column says; other tenants' rows are not touched."""
    named = df.withColumn(column, F.lit(tenant))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_scoped(spark: SparkSession, path: str, tenant: str, column: str = "tenant_id") -> DataFrame:
    """The tenant's rows; the scan lists no other tenant's folder."""
    return spark.read.parquet(path).where(F.col(column) == tenant)
