"""Graph operators over edge tables: relaxation of paths, closures and levels, as rounds of
joins whose state is cut by checkpoints (survey group I). They run until nothing is left to
do; `rounds` is a guard for runaway input, and passing it is an error, never an end."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark) -> str:
    """The folder in spark.checkpoint.dir; a temporary one in local mode where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a table in the shared checkpoint folder: what is read from
    it again was computed once, has a known size, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _unfinished(rounds: int) -> RuntimeError:
    return RuntimeError(f"not done after {rounds} rounds")


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int = 10_000, src: str = "src", dst: str = "dst", cost: str = "cost") -> DataFrame:
    """(source, node, cost, path): cheapest paths from each source; negative costs count as
    0, ties take the smallest path. Only nodes that a round improved are joined again."""
    e = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.greatest(F.col(cost), F.lit(0)).cast("double").alias("w")).groupBy("a", "b").agg(F.min("w").alias("w")))
    start = sources.select(F.col(sources.columns[0]).alias("source")).distinct()
    best = cut(start.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.array("source").alias("path")))
    frontier = best
    for _ in range(rounds):
        step = frontier.join(e, frontier["node"] == e["a"]).where(~F.array_contains("path", F.col("b")))
        step = step.select("source", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("b")).alias("path"))
        found = step.groupBy("source", "node").agg(F.min(F.struct("cost", "path")).alias("n"))
        old = best.select("source", "node", F.struct("cost", "path").alias("o"))
        merged = cut(old.join(found, ["source", "node"], "full_outer").select("source", "node", "o", "n"))
        better = F.col("o").isNull() | (F.col("n.cost") < F.col("o.cost"))
        frontier = merged.where(F.col("n").isNotNull() & better).select("source", "node", "n.cost", "n.path")
        if frontier.isEmpty():
            return best
        best = merged.select("source", "node", F.when(F.col("n").isNotNull() & better, F.col("n")).otherwise(F.col("o")).alias("x")).select("source", "node", "x.cost", "x.path")
    raise _unfinished(rounds)


def closure(edges: DataFrame, rounds: int = 40, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, reaches, depth): everything reachable along edges, with the least number of
    steps; a node on a cycle doesn't reach itself.

    Path doubling: round i finds the pairs that are more than 2 ** (i - 1) and at most 2 ** i
    steps apart, as those that lie exactly 2 ** (i - 1) apart followed by any known pair. A
    chain of n nodes takes log2(n) rounds, and the pairs of a round are written once, beside
    those of the rounds before.
    """
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("reaches")).where("node <> reaches").distinct()
    known = [cut(e.withColumn("depth", F.lit(1)))]
    reach = 1
    for _ in range(rounds):
        all_known = reduce(DataFrame.unionByName, known)
        ends = known[-1].where(F.col("depth") == reach).select("node", F.col("reaches").alias("mid"))
        step = ends.join(all_known.select(F.col("node").alias("mid"), "reaches", "depth"), "mid").where("node <> reaches")
        found = step.groupBy("node", "reaches").agg((F.min("depth") + reach).alias("depth"))
        new = cut(found.join(all_known.select("node", "reaches"), ["node", "reaches"], "left_anti"))
        if new.isEmpty():
            return all_known
        known.append(new)
        reach *= 2
    raise _unfinished(rounds)


def levels(edges: DataFrame, rounds: int = 40, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """(levels, cyclic): src depends on dst. Level 0 has no dependency; others are one above
    their highest. What has no level lies on or behind a cycle.

    A level is the length of the longest walk. Walks of exactly 1, 2, 4, ... steps are the
    relation joined with itself; a walk of as many steps as there are nodes means a cycle. The binary
    digits of each level then follow from the longest walks down, each kept where one more of
    its length can be walked. Both halves take log2(depth) rounds.
    """
    e = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct())
    nodes = cut(e.select(F.col("a").alias("node")).union(e.select("b")).distinct())
    n = nodes.count()
    walks, length = [e], 1
    for _ in range(rounds):
        if length >= n or walks[-1].isEmpty():
            break
        last = walks[-1]
        walks.append(cut(last.select("a", F.col("b").alias("m")).join(last.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()))
        length *= 2
    else:
        raise _unfinished(rounds)
    cyclic = cut(walks[-1].select(F.col("a").alias("node")).distinct()) if length >= n else nodes.limit(0)
    at = cut(nodes.join(cyclic, "node", "left_anti").select("node", F.col("node").alias("at"), F.lit(0).alias("level")))
    for i in reversed(range(len(walks))):
        moved = cut(at.join(walks[i].select(F.col("a").alias("at"), "b"), "at").select("node", F.col("b").alias("at"), (F.col("level") + 2**i).alias("level")).distinct())
        at = cut(moved.unionByName(at.join(moved.select("node").distinct(), "node", "left_anti")))
    return at.groupBy("node").agg(F.max("level").alias("level")), cyclic


def neighbours(edges: DataFrame, nodes: DataFrame, relation: str | None = None) -> DataFrame:
    kept = edges if relation is None else edges.where(F.col("relation") == relation)
    return kept.join(nodes.select(F.col(nodes.columns[0]).alias("src")).distinct(), "src")


def learning_path(gaps: DataFrame, prerequisites: DataFrame, profile: str = "profile", skill: str = "skill") -> DataFrame:
    """(profile, step, skill): the prerequisites of each missing skill, deepest first, then
    the skill itself, numbered once per profile. prerequisites: (node, reaches, depth)."""
    up = gaps.join(prerequisites, gaps[skill] == prerequisites["node"], "left")
    steps = up.select(profile, F.col("reaches").alias("s"), F.col("depth").alias("d")).where("s is not null").unionByName(gaps.select(profile, F.col(skill).alias("s"), F.lit(0).alias("d")))
    once = steps.groupBy(profile, "s").agg(F.max("d").alias("d"))
    place = F.row_number().over(Window.partitionBy(profile).orderBy(F.desc("d"), "s"))
    return once.select(profile, place.alias("step"), F.col("s").alias("skill"))
