"""The keyset source: batch rows, pushed key bounds, partitions and a restarted stream."""

import pytest
from pyspark.sql import functions as F

from talus.sources import keyset
from talus.streaming import events


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(-50, 1950).select((F.col("id") * 3).alias("k"), F.concat(F.lit("v"), "id").alias("v")).repartitionByRange(5, "k").write.parquet(path)
    spark.createDataFrame([(None, "no key"), (10_000, "far")], "k long, v string").coalesce(1).write.mode("append").parquet(path)
    return path


def test_batch_reads_every_keyed_row_once(spark, table):
    want = {tuple(r) for r in spark.read.parquet(table).where("k is not null").collect()}
    for rows in (100, 777, 10**6):
        df = keyset.read_keys(spark, table, "k", rows)
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
        assert df.rdd.getNumPartitions() >= len(want) // rows // 2
    sizes = keyset.read_keys(spark, table, "k", 100).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 250


def test_key_bounds_narrow_the_ranges(spark, table):
    df = keyset.read_keys(spark, table, "k", 100)
    for condition in ("k > 300", "k >= 300 and k < 330", "k = 303", "k > 10000", "k < -1000", "k > 5 and v like 'v9%'"):
        assert {r.k for r in df.where(condition).collect()} == {r.k for r in spark.read.parquet(table).where(condition).collect()}


def test_a_restarted_stream_reads_nothing_twice(spark, table, tmp_path):
    def run():
        stream = keyset.stream_keys(spark, table, "k", 500)
        events.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect())

    keys = sorted(r.k for r in spark.read.parquet(table).where("k is not null").collect())
    assert run() == keys and run() == keys
    spark.createDataFrame([(10_001, "new"), (20_000, "new")], "k long, v string").coalesce(1).write.mode("append").parquet(table)
    assert run() == [*keys, 10_001, 20_000]


def test_empty_tables_and_options(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([], "k long, v string").write.parquet(path)
    assert keyset.read_keys(spark, path, "k").count() == 0
    with pytest.raises(Exception, match="path and key"):
        spark.read.format("keyset").option("path", path).load()


def test_the_number_of_partitions_is_bounded(spark, tmp_path):
    """A range reads whole row groups: short ranges of a long table would read each of them often."""
    spark.range(100_000).withColumnRenamed("id", "k").coalesce(1).write.parquet(str(tmp_path / "long"))
    df = keyset.read_keys(spark, str(tmp_path / "long"), "k", 20)
    assert df.rdd.getNumPartitions() <= 256 and df.agg({"k": "sum"}).first()[0] == 99_999 * 50_000
