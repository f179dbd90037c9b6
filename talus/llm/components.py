"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import SharedTable


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Large-star and small-star rounds: each round links every neighbour of a node to the
    smallest one, so chains shrink by a constant factor. The minimum per node is an
    aggregate with map-side combine followed by a join that Spark may split when a hub is
    hot; no neighbour list is gathered. Each round is a table in the shared folder. Null
    ends and self-loops are ignored; an empty edge table gives no rows.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    now = SharedTable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges"
    )
    mark = _mark(now.df)
    while mark[0]:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = SharedTable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now.drop()
        now, before = after, mark
        mark = _mark(now.df)
        if mark == before:
            break
    stars = now.df.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum: equal marks mean that a round changed nothing. The
    edges are distinct; exclusive or of two hashes cannot overflow, as a sum does."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first())
