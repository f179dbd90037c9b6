"""Arm selection by bandits whose draws depend on (seed, unit, arm) alone, so that any
partitioning, retry or rerun chooses the same arms (survey K6)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.text import hash_bucket

#: Greatest number of arms: their counters go to every task.
MAX_ARMS = 10_000


def arm_posteriors(rewards: DataFrame, arm: str, reward: str) -> DataFrame:
    """(arm, pulls, mean, alpha, beta): rewards of 0 to 1 add to alpha, what is missing to 1 adds
    to beta. A null reward is no pull; an arm without pulls has mean 0 and a flat posterior."""
    g = rewards.groupBy(F.col(arm).alias("arm")).agg(F.count(reward).alias("pulls"), F.coalesce(F.sum(F.col(reward).cast("double")), F.lit(0.0)).alias("won"))
    mean = F.when(F.col("pulls") > 0, F.col("won") / F.col("pulls")).otherwise(0.0)
    return g.select("arm", "pulls", mean.alias("mean"), (1 + F.col("won")).alias("alpha"), (1 + F.col("pulls") - F.col("won")).alias("beta"))


def _bounded(arms: DataFrame) -> list:
    rows = arms.orderBy("arm").limit(MAX_ARMS + 1).collect()
    if not rows or len(rows) > MAX_ARMS:
        raise ValueError(f"1 to {MAX_ARMS} arms")
    return rows


def unit_uniform(seed: str, purpose: str, unit: Column) -> Column:
    """A number in [0, 1) by the first 32 bits of a hash of seed, purpose and unit."""
    return hash_bucket(F.lit(f"{seed}/{purpose}"), unit.cast("string")) / F.lit(4294967296.0)


def epsilon_greedy(units: DataFrame, unit: str, posteriors: DataFrame, epsilon: float, seed: str) -> DataFrame:
    """(unit, arm, explored): a share `epsilon` of the units takes an arm at random, the others
    that with the best mean; the first by name on ties."""
    arms = _bounded(posteriors.select("arm", "mean"))
    best = max(arms, key=lambda r: r["mean"])["arm"]
    names = F.array(*[F.lit(r["arm"]) for r in arms])
    explore = unit_uniform(seed, "explore", F.col(unit)) < epsilon
    at = F.floor(unit_uniform(seed, "arm", F.col(unit)) * len(arms)).cast("int")
    return units.select(F.col(unit).alias("unit"), F.when(explore, F.get(names, at)).otherwise(F.lit(best)).alias("arm"), explore.alias("explored"))


# ------------------------------------------------------------------ Thompson sampling
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Uniforms:
    """Counter-based uniform numbers in (0, 1): the next draw of each row."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.n = keys, 0

    def draw(self, rows: np.ndarray) -> np.ndarray:
        self.n += 1
        bits = _mix(self.keys[rows] + np.uint64((self.n * 0x9E3779B97F4A7C15) % (1 << 64)))
        return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def gamma_draws(shape: float, keys: np.ndarray) -> np.ndarray:
    """One Gamma(shape, 1) draw for each key, by Marsaglia and Tsang's squeeze. A key that is
    not accepted takes its own next numbers, whatever other keys do."""
    n, uniforms = len(keys), _Uniforms(keys)
    boost = shape < 1
    d = (shape + 1 if boost else shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, open_ = np.zeros(n), np.arange(n)
    while len(open_):
        a, b, u = (uniforms.draw(open_) for _ in range(3))
        x = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = (1 + c * x) ** 3
        ok = v > 0
        ok[ok] = np.log(u[ok]) < 0.5 * x[ok] ** 2 + d - d * v[ok] + d * np.log(v[ok])
        out[open_[ok]] = d * v[ok]
        open_ = open_[~ok]
    if boost:
        out *= _Uniforms(_mix(keys + np.uint64(3))).draw(np.arange(n)) ** (1 / shape)
    return out


def thompson(units: DataFrame, unit: str, posteriors: DataFrame, seed: int) -> DataFrame:
    """(unit, arm): each unit draws from every arm's Beta(alpha, beta) and takes the greatest.
    The draws of a unit and an arm follow from the seed, the unit's text and the arm's name; a
    null unit has the draws of the empty text."""
    rows = _bounded(posteriors.select("arm", "alpha", "beta"))
    arms, names = [(str(r["arm"]), float(r["alpha"]), float(r["beta"])) for r in rows], [r["arm"] for r in rows]
    kinds = dict(posteriors.dtypes)["arm"]
    salts = np.frombuffer(b"".join(_arm_salt(seed, name) for name, _, _ in arms), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices = pa.array(names)
        for batch in batches:
            n = batch.num_rows
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            best, pick = np.full(n, -1.0), np.zeros(n, np.int64)
            for i, (_, alpha, beta) in enumerate(arms):
                own = _mix(keys ^ salts[i])
                won = gamma_draws(alpha, own)
                draw = won / (won + gamma_draws(beta, _mix(own + np.uint64(1))))
                better = draw > best
                best[better], pick[better] = draw[better], i
            yield pa.RecordBatch.from_arrays([batch.column(0), choices.take(pa.array(pick))], ["unit", "arm"])

    keyed = units.select(F.col(unit).alias("unit"), F.xxhash64(F.coalesce(F.col(unit).cast("string"), F.lit(""))).alias("key"))
    return keyed.mapInArrow(run, f"unit {dict(units.dtypes)[unit]}, arm {kinds}")


def _arm_salt(seed: int, name: str) -> bytes:
    return hashlib.sha256(f"{seed}/{name}".encode()).digest()[:8]


def selection_shares(choices: DataFrame) -> DataFrame:
    """(arm, n, share) of the arms that were chosen."""
    g = choices.groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # a row per arm, MAX_ARMS at most
