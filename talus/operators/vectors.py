"""Dense and sparse vectors: cosine, centroids, top-k against a bounded query set, token
joins and similarity calibration (survey D15-D17, E35, E36, H4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): the mean of the unit vectors, scaled to length 1. Components are
    averaged one by one, so a hot key combines before it is shuffled."""
    unit = df.where(norm(F.col(vector)) > 0).select(key, F.transform(vector, lambda x: x.cast("double") / norm(F.col(vector))).alias("u"))
    parts = unit.select(key, F.posexplode("u").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    mean = parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return mean.select(key, F.transform("m", lambda x: x / norm(F.col("m"))).alias("centroid"))


def top_k(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, vector: str, k: int) -> DataFrame:
    """(query, id, similarity, rank): a query set of any size against all rows. Up to
    QUERY_BLOCK queries are broadcast and read the corpus once, the k best per query kept by a
    partial ranking in each task; more go through the cluster-pruned index, which gives the
    same rows without comparing all pairs. Null vectors have similarity 0."""
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        from talus.operators.similarity import dense_top_k

        return dense_top_k(queries, corpus, query_id, corpus_id, vector, k)[0]
    q = queries.select(F.col(query_id).alias("query"), F.col(vector).alias("__q"), norm(F.col(vector)).alias("__ql"))
    c = corpus.select(F.col(corpus_id).alias("id"), F.col(vector).alias("__v"), norm(F.col(vector)).alias("__vl"))
    scored = c.join(F.broadcast(q), F.col("id") != F.col("query"))
    both = F.col("__ql") * F.col("__vl")
    alike = F.when(both > 0, dot(F.col("__q"), F.col("__v")) / both).otherwise(F.lit(0.0))
    scored = scored.select("query", "id", F.bround(alike, 6).alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")  # Spark keeps k rows per task before the shuffle
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity_bounds(df: DataFrame, value: str, fallback: tuple[float, float] = (0.30, 0.82), least: int = 20, spread: float = 0.05) -> DataFrame:
    """(floor, ceil, n): P10 and P90, or the fallback for few or flat samples."""
    from talus.operators.quantiles import linear_quantiles

    p = linear_quantiles(df.select(value), [], value, {"lo": 0.1, "hi": 0.9})
    g = df.sparkSession.range(1).join(p, F.lit(True), "left")  # one row, with or without a value
    good = F.coalesce((F.col("n") >= least) & (F.col("hi") - F.col("lo") >= spread), F.lit(False))
    return g.select(F.when(good, F.col("lo")).otherwise(fallback[0]).alias("floor"), F.when(good, F.col("hi")).otherwise(fallback[1]).alias("ceil"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def similarity_score(value: Column, floor: Column, ceil: Column, top: int = 25) -> Column:
    clamped = F.least(F.greatest(value, floor), ceil)
    return F.when(ceil > floor, F.bround((clamped - floor) / (ceil - floor) * top)).otherwise(F.lit(0.0)).cast("int")


def token_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, token, tf) of lower-case words."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    return df.select(*keys, F.explode(words).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))


def bow_neighbours(df: DataFrame, group: str, order: str, text: str, least: float = 0.0) -> DataFrame:
    """(group, order, best, similarity): the earlier row of the group whose bag of words is
    most alike, the latest one on ties; rows without one at `least` are left out. Pairs
    exist only inside a group and where rows share a token."""
    tokens = token_counts(df, [group, order], text)
    norms = tokens.groupBy(group, order).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("len"))
    a = tokens.select(group, F.col(order).alias("o1"), "token", F.col("tf").alias("t1"))
    b = tokens.select(group, F.col(order).alias("o2"), "token", F.col("tf").alias("t2"))
    dots = a.join(b, [group, "token"]).where("o2 < o1").groupBy(group, "o1", "o2").agg(F.sum(F.col("t1") * F.col("t2")).alias("d"))
    n1, n2 = norms.select(group, F.col(order).alias("o1"), F.col("len").alias("l1")), norms.select(group, F.col(order).alias("o2"), F.col("len").alias("l2"))
    scored = dots.join(n1, [group, "o1"]).join(n2, [group, "o2"]).withColumn("similarity", F.bround(F.col("d") / (F.col("l1") * F.col("l2")), 6)).where(F.col("similarity") >= least)
    best = scored.groupBy(group, "o1").agg(F.max(F.struct("similarity", "o2")).alias("m"))
    return best.select(group, F.col("o1").alias(order), F.col("m.o2").alias("best"), F.col("m.similarity").alias("similarity"))
