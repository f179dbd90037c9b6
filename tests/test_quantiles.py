"""Exact quantiles against numpy: one group of all rows, ties, nulls, many rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import quantiles, vectors

SHARES = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}


def values(rng, kind, n):
    if kind == "ties":
        return [float(rng.choice([1, 2, 2, 2, 2, 7])) for _ in range(n)]
    if kind == "mostly one":
        return [5.0 if rng.random() < 0.97 else rng.gauss(0, 100) for _ in range(n)]
    if kind == "wide":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(n)]
    return [rng.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("ranges,ranked", [(128, 65_536), (16, 100), (4, 10)])
def test_quantiles_of_all_groups(spark, monkeypatch, ranges, ranked):
    monkeypatch.setattr(quantiles.order_statistics, "__defaults__", (ranges, ranked))
    rng = random.Random(ranges)
    groups = {("a", 1): values(rng, "normal", 700), ("a", None): values(rng, "ties", 300), (None, 2): values(rng, "mostly one", 900), ("b", 1): values(rng, "wide", 250), ("c", 3): [4.0], ("d", 4): [1.0, 2.0]}
    rows = [(g, h, v) for (g, h), vs in groups.items() for v in vs] + [("a", 1, None), ("none", 9, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(6)
    got = {(r.g, r.h): r for r in quantiles.linear_quantiles(df, ["g", "h"], "v", SHARES).collect()}
    near = {(r.g, r.h): r for r in quantiles.nearest_rank_quantiles(df, ["g", "h"], "v", SHARES).collect()}
    assert got.keys() == near.keys() == groups.keys()
    for k, vs in groups.items():
        for name, q in SHARES.items():
            assert got[k][name] == pytest.approx(float(np.quantile(vs, q)), rel=1e-9, abs=1e-12), (k, name)
            assert near[k][name] == sorted(vs)[round(q * (len(vs) - 1))], (k, name)
        assert got[k].n == near[k].n == len(vs)


def test_one_group_of_all_rows_is_never_one_task(spark):
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % n).cast("double")).alias("v"))
    (r,) = quantiles.linear_quantiles(df, [], "v", SHARES).collect()
    vs = [7.0 if i % 3 == 0 else float(i * 7919 % n) for i in range(n)]
    assert [r[k] for k in SHARES] == pytest.approx([float(np.quantile(vs, q)) for q in SHARES.values()])
    assert quantiles.linear_quantiles(df.limit(0), [], "v", SHARES).count() == 0


def test_similarity_bounds_fall_back(spark):
    flat = spark.range(50).select(F.lit(0.5).alias("s"))
    wide = spark.range(50).select((F.col("id") / 49).alias("s"))
    assert tuple(vectors.similarity_bounds(flat, "s").first()) == (0.30, 0.82, 50)
    assert tuple(vectors.similarity_bounds(wide, "s").first()) == pytest.approx((0.1, 0.9, 50))
    assert tuple(vectors.similarity_bounds(wide.limit(0), "s").first()) == (0.30, 0.82, 0)
    assert tuple(vectors.similarity_bounds(wide.limit(19), "s").first()) == (0.30, 0.82, 19)
