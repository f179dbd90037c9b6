"""Ranking, top-k, latest-per-key and other ordered operators (survey group F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.text import PRIORITY_BANDS, band
from talus.operators.graph import cut


def row_numbers(df: DataFrame, order: list[Column], partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Contiguous numbers by `order` within each partition. Without a partition Spark ranks
    in one task: use it for bounded frames, and global_rank for tables of any size."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(*order)))


def global_rank(df: DataFrame, order: list[Column], buckets: int = 256, name: str = "rank", within: str | None = None) -> DataFrame:
    """Contiguous numbers over a table of any size, or over each value of the column `within`
    however many rows it has, ties by the rest of `order`.

    Rows are range-partitioned by the whole of `order`, so that rows of one first value split
    as well, numbered in each part, and
    moved by what lies in the parts before. The parts are written once, in the checkpoint
    folder; what is counted and what is numbered are the same rows.
    """
    group = [] if within is None else [within]
    parts = cut(df.repartitionByRange(buckets, *group, *order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows of a group
    starts = sizes.select("__part", *group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order))
    # Without groups there are at most `buckets` rows to broadcast.
    joined = parts.withColumn("__own", own).join(F.broadcast(starts) if within is None else starts, ["__part", *group])
    return joined.withColumn(name, F.col("__own") + F.col("__start")).drop("__own", "__start", "__part")


def rank_jobs(df: DataFrame, score: str = "total_score", date: str = "fetched_date", id_col: str = "id", buckets: int = 64) -> DataFrame:
    """Score down (null as 0), date down (nulls last), id down; rank and priority band."""
    value = F.coalesce(F.col(score), F.lit(0))
    ranked = global_rank(df, [value.desc(), F.desc_nulls_last(date), F.desc(id_col)], buckets)
    return ranked.withColumn("band", band(F.col(score), PRIORITY_BANDS))


def top(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first `limit` rows; all for null or negative limits."""
    ordered = df.orderBy(*order)
    return ordered if limit is None or limit < 0 else ordered.limit(limit)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return row_numbers(df, order, keys, name).where(F.col(name) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest `order` of each key, as one aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def recent(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    return row_numbers(df, [F.desc(order)], keys, "__r").where(F.col("__r") <= n).drop("__r")


def compress_history(turns: DataFrame, key: str, order: str, role: str, text: str, keep: int = 6, over: int = 20, limit: int = 500) -> DataFrame:
    """(key, n, summary): conversations of more than `over` turns get the turns before the
    last `keep`, one `role: text` after another, cut at `limit` characters with an ellipsis."""
    w = Window.partitionBy(key)
    marked = turns.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc(order))))
    old = F.sort_array(F.collect_list(F.when((F.col("__n") > over) & (F.col("__r") > keep), F.struct(F.col(order).alias("o"), F.concat_ws(": ", role, text).alias("t")))))
    joined = F.array_join(F.transform(old, lambda x: x["t"]), " ")
    out = marked.groupBy(key).agg(F.max("__n").alias("n"), joined.alias("all"))
    return out.select(key, "n", F.when(F.char_length("all") > limit, F.concat(F.substring("all", 1, limit), F.lit("…"))).otherwise(F.col("all")).alias("summary"))


def plan_slots(df: DataFrame, rank: str = "rank", tier: str = "tier", today: int = 5, week: int = 10, max_tier: int = 2) -> DataFrame:
    """Weekly plan: ranked rows of tier <= max_tier; the first `today` rows, then up to `week`."""
    eligible = row_numbers(df.where(F.col(tier) <= max_tier).orderBy(rank).limit(week), [F.col(rank)], name="place")
    return eligible.withColumn("slot", F.when(F.col("place") <= today, "today").otherwise("this_week"))


def precision_ndcg(df: DataFrame, group: str, rank: str, relevant: str, k: int) -> DataFrame:
    """precision@k and NDCG@k of ranked rows by group; relevant is boolean."""
    gain = F.when(F.col(relevant) & (F.col(rank) <= k), 1 / F.log2(F.col(rank) + 1)).otherwise(0.0)
    got = df.groupBy(group).agg(
        F.sum((F.col(relevant) & (F.col(rank) <= k)).cast("int")).alias("hits"), F.sum(gain).alias("dcg"), F.sum(F.col(relevant).cast("int")).alias("n_relevant"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int"))), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1))
    ideal = F.when(F.col("n_relevant") > 0, best)
    return got.select(group, F.bround(F.col("hits") / F.lit(float(k)), 4).alias("precision_at_k"), F.bround(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 4).alias("ndcg_at_k"))


def precision_ndcg_at(df: DataFrame, group: str, order: list[Column], relevant: str, k: int) -> DataFrame:
    """precision_ndcg of the rows in `order`. Only the first k of a group are ranked, by a
    partial ranking in each task; what is relevant is counted by an aggregate."""
    first = top_per_group(df, [group], order, k)
    gain = F.when(F.col(relevant), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    got = first.groupBy(group).agg(F.sum(F.col(relevant).cast("int")).alias("hits"), F.sum(gain).alias("dcg"))
    counts = df.groupBy(F.col(group).alias("__g")).agg(F.sum(F.col(relevant).cast("int")).alias("n_relevant"))
    both = got.join(counts, F.col(group).eqNullSafe(F.col("__g")))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int"))), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1))
    ideal = F.when(F.col("n_relevant") > 0, best)
    return both.select(group, F.bround(F.col("hits") / F.lit(float(k)), 4).alias("precision_at_k"), F.bround(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 4).alias("ndcg_at_k"))
