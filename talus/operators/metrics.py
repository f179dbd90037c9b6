"""Aggregate reports: funnels, conversions, calibration, demand, cost, feedback, budgets
(survey groups E and K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.operators.lookup import small
from talus.operators.quantiles import linear_quantiles

from talus.functions.text import hash_bucket, percent


def zero_filled_counts(df: DataFrame, status: str, known: list[str]) -> DataFrame:
    """(status, n) of every known status, zero if absent, and of others that occur."""
    spark = df.sparkSession
    table = spark.createDataFrame([(s,) for s in known], "status string")
    counts = df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return table.join(counts, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def funnel(df: DataFrame, stage: str, stages: list[str], count: Column | None = None) -> DataFrame:
    """(stage, pos, n, reached, pct_of_first, pct_of_previous): reached counts what is at the
    stage or beyond it; the previous stage is the last one that isn't empty."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(stages)), "pos int, stage string")
    counts = df.groupBy(F.col(stage).alias("stage")).agg((count if count is not None else F.count(F.lit(1))).alias("n"))
    rows = F.broadcast(table).join(counts, "stage", "left").select("stage", "pos", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    one = Window.partitionBy()  # a row per stage of the fixed list
    up = one.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reached", F.sum("n").over(up))
    before = one.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("reached").over(one.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    previous = F.last(F.when(F.col("reached") > 0, F.col("reached")), ignorenulls=True).over(before)
    return rows.withColumns({"pct_of_first": percent(F.col("reached"), first), "pct_of_previous": F.when(F.col("pos") == 0, F.lit(100.0)).otherwise(percent(F.col("reached"), F.coalesce(previous, F.lit(0))))})


def conversion_sets(df: DataFrame, sets: list[str], flags: dict[str, Column]) -> DataFrame:
    """(dimension, value, n, <flag>, <flag>_rate ...) of several dimensions in one pass by
    grouping sets; a null value is 'Unknown'."""
    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in sets], *[c.cast("int").alias(f) for f, c in flags.items()])
    grouped = named.groupingSets([[F.col(c)] for c in sets], *[F.col(c) for c in sets]).agg(
        F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("n"), *[F.sum(f).cast("long").alias(f) for f in flags]
    )
    full = (1 << len(sets)) - 1
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(sets):
        here = F.col("__g") == full - (1 << (len(sets) - 1 - i))
        dimension, value = F.when(here, F.lit(c)).otherwise(dimension), F.when(here, F.col(c)).otherwise(value)
    rates = [percent(F.col(f), F.col("n")).alias(f"{f}_rate") for f in flags]
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n", *flags, *rates)


def feature_importance(df: DataFrame, features: list[str], flag: Column) -> DataFrame:
    """(feature, n_values, importance): the spread of the flag's rate over the values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("string"), F.lit("Unknown")).alias("value")) for f in features])
    rows = df.select(F.explode(pairs).alias("p"), flag.cast("double").alias("flag")).select("p.*", "flag")
    rates = rows.groupBy("feature", "value").agg(F.avg("flag").alias("rate"))
    return rates.groupBy("feature").agg(F.count(F.lit(1)).alias("n_values"), F.bround(F.max("rate") - F.min("rate"), 4).alias("importance"))


def calibration(df: DataFrame, score: str, outcome: str, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """Bands (band, n, midpoint, observed) and their expected calibration error."""
    start = F.least(F.floor(F.col(score) / width) * width, F.lit(100 - width)).cast("long")
    bands = df.groupBy(start.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(outcome).cast("double")).alias("observed"))
    bands = bands.withColumn("midpoint", (F.col("band") + width / 2.0) / 100)
    error = bands.agg(F.bround(F.sum(F.col("n") * F.abs(F.col("observed") - F.col("midpoint"))) / F.sum("n"), 4).alias("ece"), F.sum("n").alias("n"))
    return bands.select("band", "n", "midpoint", F.bround("observed", 4).alias("observed")), error


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n) of the values in [edge, next edge), the last bin open; empty bins are 0."""
    spark = df.sparkSession
    table = spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "bin int, low double")
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(value))) - 1
    counts = df.where(F.col(value) >= edges[0]).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(table).join(counts, "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ------------------------------------------------------------------ market
def benchmark(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, p25, p50, p75): linear percentiles of positive values."""
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    out = linear_quantiles(df.where(F.col(value) > 0).select(*keys, value), keys, value, shares)
    return out.select(*keys, "n", *[F.bround(p, 4).alias(p) for p in shares])


def growth(snapshots: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, first, last, growth) between the first and the last snapshot of each key: the
    relative change, the last value if the first is 0, 0 for a single snapshot."""
    g = snapshots.groupBy(*keys).agg(F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"), F.count(F.lit(1)).alias("n"))
    rate = F.when(F.col("n") < 2, F.lit(0.0)).when(F.col("first") == 0, F.col("last").cast("double")).otherwise((F.col("last") - F.col("first")) / F.col("first"))
    return g.select(*keys, "first", "last", F.bround(rate, 4).alias("growth"))


def emerging(snapshots: DataFrame, time: str, item: str, value: str, least: float) -> DataFrame:
    """Items of the last snapshot whose growth since the first one reaches `least`; an item
    that the first lacks grows by its whole value."""
    ends = snapshots.agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    marked = snapshots.join(F.broadcast(ends), (F.col(time) == F.col("t0")) | (F.col(time) == F.col("t1")))
    both = marked.groupBy(item).agg(
        F.sum(F.when(F.col(time) == F.col("t0"), F.col(value))).alias("first"), F.sum(F.when(F.col(time) == F.col("t1"), F.col(value))).alias("last")
    )
    start = F.coalesce("first", F.lit(0))
    rate = F.when(start == 0, F.col("last").cast("double")).otherwise((F.col("last") - start) / start)
    return both.where("last is not null").select(item, start.cast("long").alias("first"), "last", F.bround(rate, 4).alias("growth")).where(F.col("growth") >= least)


# ------------------------------------------------------------------ cost and quotas
def cost_rollup(df: DataFrame, dimensions: list[str], cost: str, tokens: str) -> DataFrame:
    """(dimension, value, calls, tokens, cost) of each dimension and of the total."""
    named = df.select(*[F.col(c).cast("string").alias(c) for c in dimensions], F.col(cost).alias("c"), F.col(tokens).alias("t"))
    g = named.groupingSets([*[[F.col(c)] for c in dimensions], []], *[F.col(c) for c in dimensions]).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("calls"), F.bround(F.sum("t"), 2).alias("tokens"), F.bround(F.sum("c"), 2).alias("cost")
    )
    full = (1 << len(dimensions)) - 1
    dimension, value = F.lit("total"), F.lit("all")
    for i, c in enumerate(dimensions):
        here = F.col("g") == full - (1 << (len(dimensions) - 1 - i))
        dimension, value = F.when(here, F.lit(c)).otherwise(dimension), F.when(here, F.col(c)).otherwise(value)
    return g.select(dimension.alias("dimension"), value.alias("value"), "calls", "tokens", "cost")


def quota_check(usage: DataFrame, quotas: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """(keys, used, limit, allowed): allowed without a limit or below it."""
    used = usage.groupBy(*keys).agg(F.sum(amount).alias("used"))
    return used.join(small(quotas), keys, "left").withColumn("allowed", F.col("limit").isNull() | (F.col("used") < F.col("limit")))


def running_budget(df: DataFrame, key: str, order: list[str], amount: str, budget: float, warn: float = 0.8) -> DataFrame:
    """Running total per key, its share of the budget, and whether it warns or exceeds."""
    total = F.sum(amount).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    share = F.bround(total / budget, 6)
    return df.withColumns({"spent": F.bround(total, 2), "utilisation": share, "state": F.when(share >= 1, "exceeded").when(share >= warn, "warn").otherwise("ok")})


# ------------------------------------------------------------------ feedback and experiments
def acceptance(df: DataFrame, key: str, signal: str, positive: list[str], negative: list[str]) -> DataFrame:
    yes, no = F.sum(F.col(signal).isin(positive).cast("int")), F.sum(F.col(signal).isin(negative).cast("int"))
    g = df.groupBy(key).agg(yes.alias("positives"), no.alias("negatives"))
    total = F.col("positives") + F.col("negatives")
    return g.select(key, "positives", "negatives", F.when(total > 0, F.bround(F.col("positives") / total, 4)).otherwise(F.lit(0.0)).alias("rate"))


def feedback_weights(df: DataFrame, target: str, signal: str, positive: list[str], negative: list[str], step: float = 5.0, weight: Column | None = None) -> DataFrame:
    """(target, weight): steps up and down by signal, each times the weight of its row (1 if
    there is none)."""
    sign = F.when(F.col(signal).isin(positive), step).when(F.col(signal).isin(negative), -step).otherwise(0.0)
    own = F.lit(1.0) if weight is None else F.coalesce(weight, F.lit(1.0))
    return df.groupBy(target).agg(F.bround(F.sum(sign * own), 4).alias("weight"))


def assign_scaled(unit: Column, experiment: str, variants: list[str]) -> Column:
    """Variant by the hash scaled to [0, n)."""
    at = F.least(F.floor(hash_bucket(F.lit(experiment), unit) / 0xFFFFFFFF * len(variants)), F.lit(len(variants) - 1)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in variants]), at + 1)


def assign_modulo(unit: Column, experiment: str, variants: list[str]) -> Column:
    """Variant by the hash modulo n; not the same as assign_scaled."""
    return F.element_at(F.array(*[F.lit(v) for v in variants]), (hash_bucket(F.lit(experiment), unit) % len(variants)).cast("int") + 1)


def rollout(unit: Column, flags: DataFrame, df: DataFrame, name: str = "unit") -> DataFrame:
    """(unit, flag, enabled): kill switch, then override, then percentage, then default."""
    rows = df.select(unit.cast("string").alias(name)).crossJoin(small(flags))
    inside = (hash_bucket(F.col("flag"), F.col(name)) % 100) < F.col("rollout")
    return rows.select(name, "flag", F.when(F.col("killed"), F.lit(False)).otherwise(F.coalesce("forced", inside)).alias("enabled"))


def experiment_results(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum(value), 4).alias("total"), F.bround(F.avg(value), 4).alias("mean"))


def winner(results: DataFrame, experiment: str, variant: str, least: int) -> DataFrame:
    """Best variant with enough samples and its lift over the worst; null if that is 0."""
    g = results.where(F.col("n") >= least).groupBy(experiment).agg(
        F.max(F.struct("mean", variant)).alias("b"), F.min(F.struct("mean", variant)).alias("w"), F.count(F.lit(1)).alias("variants")
    )
    lift = F.when(F.col("w.mean") != 0, F.bround((F.col("b.mean") - F.col("w.mean")) / F.col("w.mean"), 4))
    return g.select(experiment, F.col(f"b.{variant}").alias("winner"), F.col("b.mean").alias("rate"), lift.alias("lift"), "variants")


def bandit_posteriors(df: DataFrame, arm: str, reward: str) -> DataFrame:
    g = df.groupBy(arm).agg(F.count(F.lit(1)).alias("pulls"), F.sum(reward).alias("wins"))
    return g.select(arm, "pulls", F.bround(F.col("wins") / F.col("pulls"), 4).alias("mean"), (1 + F.col("wins")).alias("alpha"), (1 + F.col("pulls") - F.col("wins")).alias("beta"))


def correlation_weights(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, weight): Pearson correlation with the label, 0 where it has no variance."""
    y = F.col(label).cast("double")
    both = lambda f: F.try_divide(F.covar_pop(f, y), F.stddev_pop(f) * F.stddev_pop(y))
    one = df.agg(*[both(F.col(f).cast("double")).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.bround(F.coalesce(F.nanvl(F.col(f), F.lit(0.0)), F.lit(0.0)), 4).alias("weight")) for f in features])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def below_counts(df: DataFrame, key: str, count: str, ranges: int = 256) -> DataFrame:
    """`df` with `below`: the sum of `count` over smaller values of `key`, in ranges of it,
    each summed for itself and moved by what the ranges before it hold."""
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), shares, 100 * ranges).alias("__cuts"))  # one row
    ranged = df.crossJoin(F.broadcast(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(key)))).drop("__cuts")
    sums = ranged.groupBy("__range").agg(F.sum(count).alias("__n"))  # at most `ranges` rows
    before = sums.select("__range", F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum(count).over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn("below", F.col("__own") + F.col("__before")).drop("__own", "__before", "__range")


def pairwise_accuracy(df: DataFrame, score: str, label: str) -> DataFrame:
    """Share of (positive, negative) pairs whose positive scores higher; ties are wrong.
    Counts per distinct score replace the pairs."""
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("q"))
    t = below_counts(g, "s", "q").agg(F.sum(F.col("p") * F.col("below")).alias("good"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    pairs = F.col("p") * F.col("q")
    return t.select(F.when(pairs > 0, F.bround(F.col("good") / pairs, 4)).otherwise(F.lit(0.0)).alias("accuracy"), pairs.alias("pairs"))


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
