"""Exact quantiles of all groups at once by range refinement: no buffer and no window ever
holds a group (survey E9, E18, E36)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.graph import cut
from talus.operators.lookup import small

#: Ranges that a round cuts a group into, about, and rows of a range that is ranked as it is.
RANGES, RANKED = 128, 65_536


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Column, ranges: int = RANGES, ranked: int = RANKED) -> DataFrame:
    """(keys, n, picks): the number of values that aren't null and, for each group, a map from
    each rank (from 0) in `ranks`, an array that may use the column `n`, to the value with that
    rank. Group keys may be null; without keys there is one group, if it has a value.

    A round cuts each range by approximate quantiles of its own values, a mergeable sketch of
    bounded size, counts the values between and at the cuts, and goes on with the
    ranges that hold a wanted rank only. Values at a cut are a range of their own, so that a value
    that repeats is found at once. A range of at most `ranked` values is ranked as it is.
    """
    v = "__v"
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__one")).alias("g"), F.col(value).alias(v))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= ranked:
        group = Window.partitionBy("g")  # `ranked` rows at most
        placed = rows.withColumns({"n": F.count(F.lit(1)).over(group), "rank": (F.row_number().over(group.orderBy(v)) - 1).cast("long")}).withColumn("wanted", ranks.cast("array<long>"))
        few = placed.groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.when(F.array_contains("wanted", F.col("rank")), F.struct("rank", v)))).alias("picks"))
        return few.select(*[F.col(f"g.{k}").alias(k) for k in keys], "n", "picks")
    sizes = cut(sizes)
    wanted = sizes.select("g", "n", F.explode(F.array_distinct(ranks)).alias("rank")).where("rank >= 0 and rank < n").select("g", "rank")
    # What is open: ranges named by r, their values' number and bounds, and the ranks wanted in them.
    state = cut(rows.withColumn("r", F.lit("")))
    open_ = sizes.select("g", F.lit("").alias("r"), "n", "lo", "hi").join(wanted, "g").select("g", "r", "n", "lo", "hi", "rank", F.col("rank").alias("left"))
    found = []
    while True:
        open_ = cut(open_)
        found.append(open_.where("lo = hi").select("g", "rank", F.col("lo").alias("v")))
        short = open_.where((F.col("lo") != F.col("hi")) & (F.col("n") <= ranked))
        long = open_.where((F.col("lo") != F.col("hi")) & (F.col("n") > ranked))
        place = F.row_number().over(Window.partitionBy("g", "r").orderBy(v)) - 1  # `ranked` rows at most
        few = state.join(small(short.select("g", "r").distinct()), ["g", "r"], "left_semi").withColumn("left", place)
        found.append(few.join(short.select("g", "r", "left", "rank"), ["g", "r", "left"]).select("g", "rank", v).withColumnRenamed(v, "v"))
        if long.isEmpty():
            break
        spans = long.select("g", "r").distinct()
        held = cut(state.join(small(spans), ["g", "r"], "left_semi"))
        shares = F.array(*[F.lit(i / ranges) for i in range(ranges + 1)])
        cuts = cut(held.groupBy("g", "r").agg(F.array_sort(F.array_distinct(F.percentile_approx(v, shares, 20 * ranges))).alias("cuts")))
        below = F.size(F.filter("cuts", lambda c: c < F.col(v)))
        ranged = held.join(small(cuts), ["g", "r"]).withColumn("at", 2 * below + F.array_contains("cuts", F.col(v)).cast("int")).drop("cuts")
        counts = ranged.groupBy("g", "r", "at").agg(F.count(F.lit(1)).alias("m"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        before = Window.partitionBy("g", "r").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the cuts
        counts = counts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
        held_by = long.select("g", "r", "rank", "left").join(counts, ["g", "r"]).where((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("m")))
        name = F.concat_ws(".", "r", F.col("at").cast("string"))
        open_ = cut(held_by.select("g", name.alias("r"), F.col("m").alias("n"), "lo", "hi", "rank", (F.col("left") - F.col("before")).alias("left")))
        state = ranged.select("g", name.alias("r"), v).join(small(open_.where("lo <> hi").select("g", "r").distinct()), ["g", "r"], "left_semi")
    picks = reduce(DataFrame.unionByName, found).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("picks"))  # as many as ranks
    out = sizes.join(picks, "g", "left")
    return out.select(*[F.col(f"g.{k}").alias(k) for k in keys], "n", "picks")


def linear_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, a column per share): linear interpolation between the two nearest ranks."""
    at = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    ranks = F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)])
    got = order_statistics(df.withColumn(value, F.col(value).cast("double")), keys, value, ranks)
    low = lambda x: F.element_at("picks", F.floor(x).cast("long"))
    high = lambda x: F.element_at("picks", F.ceil(x).cast("long"))
    between = {name: F.when(F.floor(x) == F.ceil(x), low(x)).otherwise((F.ceil(x) - x) * low(x) + (x - F.floor(x)) * high(x)) for name, x in at.items()}
    return got.select(*keys, "n", *[c.alias(name) for name, c in between.items()])


def nearest_rank_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, a column per share): the value with rank round(q * (n - 1)), half to even."""
    at = {name: F.bround(F.lit(q) * (F.col("n") - 1)).cast("long") for name, q in shares.items()}
    got = order_statistics(df, keys, value, F.array(*at.values()))
    return got.select(*keys, "n", *[F.element_at("picks", x).alias(name) for name, x in at.items()])
