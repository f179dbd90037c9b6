from pyspark.sql import functions as F

from talus.llm import components


def test_a_million_edges(spark):
    n = 1_200_000
    edges = spark.range(n).select(F.col("id").alias("u"), F.when(F.col("id") % 3 > 0, F.col("id") - 1).otherwise(F.col("id") + 1).alias("v"))
    assert len(set(components._mark(edges))) == 3
    got = components.connected_components(edges)
    assert got.agg(F.count(F.lit(1)), F.sum((F.col("component") == F.col("node") - F.col("node") % 3).cast("long"))).first() == (n, n)
