"""Months on disk, expiry with audit, loads that break and resume, runs that count once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talus.operators import lifecycle


def days(spark, first, n, tag):
    return spark.range(n).select("id", F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"), F.lit(tag).alias("tag"))


def test_a_load_replaces_its_months_only(spark, tmp_path):
    path = str(tmp_path / "t")
    lifecycle.write_months(days(spark, dt.date(2026, 1, 1), 90, "old"), path, "day")
    lifecycle.write_months(days(spark, dt.date(2026, 2, 10), 5, "new"), path, "day")
    got = {(r.year, r.month, r.tag): r["count"] for r in spark.read.parquet(path).groupBy("year", "month", "tag").count().collect()}
    assert got == {(2026, 1, "old"): 31, (2026, 2, "new"): 5, (2026, 3, "old"): 31}
    part = lifecycle.read_months(spark, path, dt.date(2026, 2, 1), dt.date(2026, 2, 28))
    assert part.count() == 5 and "PartitionFilters: [" in part._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("archive", [False, True])
def test_expired_months_leave_with_an_audit(spark, tmp_path, archive):
    path, audit, store = str(tmp_path / "t"), str(tmp_path / "audit"), str(tmp_path / "store") if archive else None
    lifecycle.write_months(days(spark, dt.date(2025, 9, 1), 170, "x"), path, "day")
    got = lifecycle.expire_months(spark, path, dt.date(2026, 2, 15), 3, audit, store).orderBy("year", "month").collect()
    assert [(r.year, r.month, r.action, r.rows) for r in got] == [(2025, 9, "archived" if archive else "dropped", 30), (2025, 10, "archived" if archive else "dropped", 31)]
    assert spark.read.parquet(path).agg(F.min("day")).first()[0] == dt.date(2025, 11, 1)
    assert lifecycle.expire_months(spark, path, dt.date(2026, 2, 15), 3, audit, store).count() == 0
    assert spark.read.parquet(audit).count() == 2
    if archive:
        assert spark.read.parquet(store).count() == 61


def test_a_broken_load_resumes(spark, tmp_path):
    source = spark.range(2500).select((F.col("id") * 7 % 2503).alias("k"), F.concat(F.lit("t"), F.col("id") % 2).alias("tenant"), F.lit("x").alias("extra"))
    source = source.unionByName(spark.createDataFrame([(None, "t0", "x")], source.schema))
    target, state, ran = str(tmp_path / "target"), str(tmp_path / "state"), []

    def dies(batch):
        ran.append(batch)
        if len(ran) == 2:
            raise RuntimeError("killed")

    load = lambda hook: lifecycle.backfill(source, target, state, "k", ["tenant"], F.col("tenant") == "t0", 300, hook)
    with pytest.raises(RuntimeError, match="killed"):
        load(dies)
    # A half-written batch of the killed run is replaced.
    source.where("k < 5").select("k", "tenant").write.mode("append").parquet(f"{target}/batch=2")
    done = load(ran.append).orderBy("batch").collect()
    assert ran == list(range(len(done))) and len(done) == 5 and sum(r.rows for r in done) == 1250
    got = spark.read.parquet(target).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted((r.k, r.tenant) for r in source.where("tenant = 't0' and k is not null").collect())
    assert load(lambda b: pytest.fail("ran again")).count() == 5
    assert lifecycle.backfill(source.limit(0), str(tmp_path / "none"), str(tmp_path / "s2"), "k", ["tenant"]).count() == 0


def test_a_run_counts_once(spark, tmp_path):
    target, markers = str(tmp_path / "log"), str(tmp_path / "markers")
    one = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2)], "k string, seq int")
    two = spark.createDataFrame([("b", 5), ("c", 6)], "k string, seq int")
    run = lambda batch, run_id: lifecycle.append_once(batch, target, markers, run_id, ["k"], "seq")
    added, marker = run(one, "r1")
    assert added and (marker.first().fetched, marker.first().accepted) == (3, 2)
    assert run(one.repartition(3), "r1")[0] is False
    assert run(two, "r1")[1].first().accepted == 1
    assert run(one, "r2")[1].first().accepted == 0  # another run of the same rows adds nothing new
    rows = spark.read.option("recursiveFileLookup", "true").schema(one.schema).parquet(target)
    assert sorted(map(tuple, rows.collect())) == [("a", 0), ("b", 2), ("c", 6)]


def test_versions_are_recorded_and_run_once(spark, tmp_path):
    path, ran = str(tmp_path / "t"), []
    spark.range(5).write.parquet(f"{path}/v=0")

    def step(version, fails=False):
        def change(df):
            ran.append(version)
            if fails and ran.count(version) == 1:
                raise RuntimeError("broke")
            return df.withColumn(f"c{version}", F.lit(version))

        return (version, f"step {version}", change)

    steps = [step(2, fails=True), step(1)]
    with pytest.raises(RuntimeError, match="broke"):
        lifecycle.migrate(spark, path, steps)
    assert [r.version for r in lifecycle.migrate(spark, path, steps).orderBy("version").collect()] == [1, 2]
    assert ran == [1, 2, 2] and lifecycle.latest(spark, path).columns == ["id", "c1", "c2"]
    lifecycle.migrate(spark, path, [*steps, step(5)])
    with pytest.raises(ValueError):
        lifecycle.migrate(spark, path, [step(3)])


def test_a_tenant_writes_and_reads_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "b"), (2, None)], "k int, tenant_id string")
    lifecycle.write_scoped(df, path, "a")
    lifecycle.write_scoped(df.where("k = 1"), path, "b")
    lifecycle.write_scoped(df.where("k = 2"), path, "a")
    assert [tuple(r) for r in lifecycle.read_scoped(spark, path, "a").collect()] == [(2, "a")]
    assert [tuple(r) for r in lifecycle.read_scoped(spark, path, "b").collect()] == [(1, "b")]
