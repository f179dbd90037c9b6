"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on random directions; quantised projections of one table,
taken together, are its bucket. Two unit vectors with cosine c are sqrt(2 - 2c) apart, so
near ones share most quantised projections. Every pair that meets in a bucket is compared in
single precision, and in double precision where rounding could decide. A pair counts in the
first table in which it meets, which both sides can tell from their own bucket numbers, so
that nothing has to be deduplicated. Buckets yield numbers of links and spanning links, never
all their pairs. Hot buckets are split in blocks of bounded size, and every two blocks of one
bucket meet in a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import SharedTable, count_rows
from talus.llm.components import connected_components

#: Width of a quantised step, and the share of linked pairs that the tables miss at most.
WIDTH, MISSED = 2.2, 0.005
#: Unrelated vectors that share a bucket at most on average; vectors in a block of a bucket,
#: rows of a block that are compared at once, and rows of a slot of buckets on average.
BUCKET, BLOCK, STRIP, SLOT_ROWS = 1000, 4096, 512, 8192
#: Large buckets whose numbers are broadcast at most, and groups that are hot at most.
LARGE_BUCKETS, HOT_GROUPS = 100_000, 2000


def agreement(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection is equal for vectors `distance` apart."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, min_cosine: float, width: float = WIDTH) -> tuple[int, int]:
    """(tables, projections in each): projections grow with the logarithm of the number of
    vectors, so that unrelated ones keep sharing buckets of the same size; tables follow so
    that a pair at min_cosine meets in one of them but for MISSED."""
    near, far = agreement(math.sqrt(2 - 2 * min(min_cosine, 0.999)), width), agreement(math.sqrt(2), width)
    projections = max(6, math.ceil(math.log(max(n, 2) / BUCKET) / -math.log(far)))
    return math.ceil(math.log(MISSED) / math.log(1 - near**projections)), projections


def _family(dim: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)


def _hash(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """Bucket numbers of 32 bits, a row per vector and a column per table."""
    a, b = _family(unit.shape[1], tables, projections, width, seed)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, projections)
    out = np.zeros((len(unit), tables), np.uint64)
    for k in range(projections):
        out = (out ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, digest, vec): rows that can be compared, with the components as bytes of floats
    (doubles where the column has wider numbers) and 128 bits of their BLAKE2 digest. Vectors
    that are null, empty or zero or hold null or non-finite components, and rows without an
    id, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pc.list_flatten(batch.column(1))
            flat = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False) + 0  # -0.0 becomes 0.0
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))))
            bad, some = (np.concatenate(([0], np.cumsum(x)))[ends] for x in (~np.isfinite(flat), flat != 0))
            at = np.flatnonzero((np.diff(bad) == 0) & (np.diff(some) > 0))
            vecs = [flat[ends[i] : ends[i + 1]].tobytes() for i in at]
            digests = [hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(digests, pa.binary()), pa.array(vecs, pa.binary())], ["id", "digest", "vec"])

    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("vec")).where("id is not null")
    return rows.mapInArrow(run, "id bigint, digest binary, vec binary")


def _units(vecs: list[bytes], kind: type) -> np.ndarray:
    """Unit vectors in double precision, of vectors of one length."""
    v = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(float)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares of tiny or huge numbers stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _bucketed(items: DataFrame, kind: type, tables: int, projections: int, width: float, seed: int) -> DataFrame:
    """(node, n, digest, vec, packed, keys): items with their bucket numbers in all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(3).to_pylist()
            sizes = np.array([len(v) for v in vecs])
            keys = np.zeros((len(vecs), tables), np.int32)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                unit = _units([vecs[i] for i in at], kind)
                keys[at] = _hash(unit, tables, projections, width, seed + unit.shape[1])
            packed = pa.array([k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(list(keys), pa.list_(pa.int32()))], [*batch.schema.names, "packed", "keys"])

    items = items.select("node", "n", "digest", "vec")
    return items.mapInArrow(run, "node bigint, n bigint, digest binary, vec binary, packed binary, keys array<int>")


def _near(u: np.ndarray, v: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in u, in v) of the pairs with cosine >= min_cosine in double precision. Single
    precision decides where its rounding, at most `slack`, cannot matter."""
    rough = u.astype(np.float32) @ v.astype(np.float32).T
    slack = np.float32((u.shape[1] + 8) * 2.0**-22)
    rows, cols = np.nonzero(rough >= min_cosine - slack)
    unsure = np.flatnonzero(rough[rows, cols] <= min_cosine + slack)
    ok = np.ones(len(rows), bool)
    for i in range(0, len(unsure), 4096):
        at = unsure[i : i + 4096]
        ok[at] = (u[rows[at]] * v[cols[at]]).sum(axis=1) >= min_cosine
    return rows[ok], cols[ok]


def _meet(kind: type, min_cosine: float):
    """Links in all blocks of a slot: blocks with themselves, and two blocks of one bucket."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", "bucket", "one", "two", "block"], kind="stable")
        key = group[["t", "bucket", "one", "two"]].to_numpy(np.int64)
        block, node, n, vec, packed = (group[c].to_numpy() for c in ("block", "node", "n", "vec", "packed"))
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        nodes, links, others = [], [], []

        def count(at: np.ndarray, weights: np.ndarray, size: int, base: int) -> None:
            found = np.bincount(at, weights=weights, minlength=size).astype(np.int64)
            some = np.flatnonzero(found)
            nodes.append(node[base + some])
            links.append(found[some])
            others.append(np.full(len(some), -1))

        for at, to in zip(starts, [*starts[1:], len(key)]):
            table, _, one, two = key[at]
            same = one == two
            cut = at if same else at + int(np.searchsorted(block[at:to], two))  # rows of `one` come first
            if to - at < 2 or (not same and cut in (at, to)):
                continue
            unit = _units(list(vec[at:to]), kind)
            keys = np.frombuffer(b"".join(packed[at:to]), np.int32).reshape(to - at, table)
            end = (to if same else cut) - at
            for low in range(0, end, STRIP):
                high = min(low + STRIP, end)
                right = low if same else end
                rows, cols = _near(unit[low:high], unit[right:], min_cosine)
                rows, cols = rows + low, cols + right
                new = rows < cols  # each pair once, and no vector with itself
                for t in range(table):  # a pair that has met in an earlier table counted there
                    new &= keys[rows, t] != keys[cols, t]
                rows, cols = rows[new], cols[new]
                if len(rows):
                    count(rows, n[at + cols], to - at, at)
                    count(cols, n[at + rows], to - at, at)
                    a, b = _spanning(node[at + rows], node[at + cols])
                    nodes.append(a)
                    links.append(np.zeros(len(a), np.int64))
                    others.append(b)
        one_array = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        return pd.DataFrame({"node": one_array(nodes), "links": one_array(links), "other": one_array(others)})

    return run


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the links a-b connect: each node with its smallest."""
    if not len(a):
        return a, b
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def embedding_components(
    vectors: DataFrame, min_cosine: float = 0.9, id_col: str = "vec_id", vector: str = "embedding",
    width: float = WIDTH, seed: int = 7,
) -> DataFrame:
    """(id, n_links, component_id, kept), a row per row of `vectors`.

    Links are pairs of different rows with cosine >= min_cosine that meet in a bucket; none
    below it. Equal vectors are one node with a number of rows, and link with each other.
    Vectors that cannot be compared, and rows without an id, have no links and are kept.
    Rows that repeat an id have the most links and the smallest component of their vectors.
    Vectors of different lengths don't link. An empty table gives no rows.

    A vector travels once to its node and once for each table; all other joins carry numbers.
    """
    kind = np.float32 if dict(vectors.dtypes)[vector] == "array<float>" else np.float64
    marked = SharedTable(usable(vectors, id_col, vector), "vectors")
    total = count_rows(marked.df)
    nodes = marked.df.groupBy("digest", "vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    tables, projections = plan_tables(total, min_cosine, width)
    nodes = SharedTable(_bucketed(nodes, kind, tables, projections, width, seed), "bucketed").df
    # Vectors of other lengths never meet: the length is a part of the bucket.
    bucket = F.xxhash64("key", F.octet_length("vec")).alias("bucket")
    spread = nodes.select("node", "n", "vec", "packed", F.posexplode("keys").alias("t", "key"))
    # A table needs the bucket numbers of the tables before it only.
    posts = spread.select("node", "n", "vec", F.substring("packed", F.lit(1), 4 * F.col("t")).alias("packed"), "t", bucket)
    # A bucket of one block meets itself; a larger one is dealt to blocks, each pair of which
    # meets once: block i goes to the tasks (i, j) and (j, i) of all blocks j.
    large = posts.groupBy("t", "bucket").count().where(F.col("count") > BLOCK)
    large = SharedTable(large.select("t", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-buckets").df
    posts = posts.join(F.broadcast(large) if count_rows(large) <= LARGE_BUCKETS else large, ["t", "bucket"], "left")
    posts = posts.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    posts = posts.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.select("t", "bucket", F.least("block", "j").alias("one"), F.greatest("block", "j").alias("two"), "block", "node", "n", "vec", "packed")
    # Many small buckets go to one slot; the number of slots follows the number of vectors,
    # so that a slot's rows stay bounded.
    slots = max(1, -(-total * tables // SLOT_ROWS))
    posts = posts.withColumn("slot", F.pmod(F.xxhash64("t", "bucket", "one", "two"), F.lit(slots)))
    met = posts.groupBy("slot").applyInPandas(_meet(kind, min_cosine), "node bigint, links bigint, other bigint")
    met = SharedTable(met, "links").df
    links = met.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(met.where("links = 0").select(F.col("node").alias("u"), F.col("other").alias("v")))
    known = nodes.select("node", "n", "digest").join(links, "node", "left").join(parts, "node", "left")
    n_links = (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    known = known.select("digest", "n", n_links, F.coalesce("component", "node").alias("component_id"))
    # Fewer than HOT_GROUPS vectors can have more than that part of all rows each: they are
    # broadcast, so that no task gets all rows of a hot one.
    rows, is_hot = marked.df.select("id", "digest"), F.col("n") * HOT_GROUPS > total
    hot, cold = known.where(is_hot).drop("n"), known.where(~is_hot).drop("n")
    of_hot = rows.join(F.broadcast(hot), "digest")
    of_cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest")
    rows = of_hot.unionByName(of_cold).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    every = vectors.select(F.col(id_col).cast("long").alias("__id"))
    out = every.join(rows, every["__id"] == rows["id"], "left")
    component = F.coalesce("component_id", "__id")
    return out.select(F.col("__id").alias("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(True)).alias("kept"))
