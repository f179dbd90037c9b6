"""Bandits: the same arms under any partitioning; shares as a numeric integral has them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import bandits


def best_shares(params):
    """P(arm is the greatest) by integrating its density times the others' distributions."""
    x = np.linspace(0, 1, 20_001)[1:-1]
    dens, dist = [], []
    for a, b in params:
        logs = (a - 1) * np.log(x) + (b - 1) * np.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        dens.append(np.exp(logs))
        dist.append(np.cumsum(np.exp(logs)) * (x[1] - x[0]))
    return [float(np.sum(d * np.prod([c for j, c in enumerate(dist) if j != i], axis=0)) * (x[1] - x[0])) for i, d in enumerate(dens)]


@pytest.mark.parametrize("params", [[(1, 1), (1, 1), (1, 1)], [(30, 70), (35, 65), (5, 5)], [(0.5, 0.5), (2, 3)], [(900, 100), (880, 120)]])
def test_thompson_shares(spark, params):
    arms = spark.createDataFrame([(f"arm{i}", float(a), float(b)) for i, (a, b) in enumerate(params)], "arm string, alpha double, beta double")
    n = 40_000
    got = {r.arm: r.n for r in bandits.selection_shares(bandits.thompson(spark.range(n), "id", arms, 7)).collect()}
    for i, p in enumerate(best_shares(params)):
        assert abs(got.get(f"arm{i}", 0) / n - p) < 4 * math.sqrt(0.25 / n) + 0.002


def test_choices_do_not_depend_on_partitioning(spark):
    arms = spark.createDataFrame([("b", 3.0, 4.0), ("a", 2.0, 2.0)], "arm string, alpha double, beta double").withColumn("mean", F.col("alpha") / 10)
    units = spark.range(500).select(F.when(F.col("id") % 50 > 0, F.col("id").cast("string")).alias("u"))
    for choose in (lambda u: bandits.thompson(u, "u", arms, 3), lambda u: bandits.epsilon_greedy(u, "u", arms, 0.3, "s")):
        a = sorted(map(tuple, choose(units.coalesce(1)).collect()), key=repr)
        assert a == sorted(map(tuple, choose(units.repartition(7)).collect()), key=repr)
    other = bandits.thompson(units, "u", arms, 4).join(bandits.thompson(units, "u", arms, 3), ["unit", "arm"]).count()
    assert other < 500  # another seed, other arms


def test_epsilon_greedy(spark):
    arms = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "arm string, mean double")
    got = bandits.epsilon_greedy(spark.range(20_000), "id", arms, 0.2, "x")
    explored = got.where("explored").count()
    assert abs(explored / 20_000 - 0.2) < 0.012
    assert got.where("not explored and arm <> 'a'").count() == 0  # the first of equal means
    for r in got.where("explored").groupBy("arm").count().collect():
        assert abs(r["count"] / explored - 1 / 3) < 0.03


def test_posteriors_and_bounds(spark):
    rows = [("a", 1.0), ("a", 0.0), ("a", None), ("b", 0.25), ("c", None)]
    got = {r.arm: tuple(r)[1:] for r in bandits.arm_posteriors(spark.createDataFrame(rows, "arm string, r double"), "arm", "r").collect()}
    assert got == {"a": (2, 0.5, 2.0, 2.0), "b": (1, 0.25, 1.25, 1.75), "c": (0, 0.0, 1.0, 1.0)}
    empty = spark.createDataFrame([], "arm string, alpha double, beta double, mean double")
    with pytest.raises(ValueError):
        bandits.thompson(spark.range(1), "id", empty, 1)
