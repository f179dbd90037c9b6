"""Similarity joins that compare only what can matter: cosine joins by prefix filtering,
exact sparse top-k with score bounds over an impact-ordered index, exact dense top-k over
a cluster-pruned index, and greedy leader clusters (survey D15-D17, I6)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.graph import cut
from talus.operators.lookup import small

#: Slack under a bound, above what single roundings and six digits can move.
SLACK = 2e-6
#: Rows of one posting block, and impact classes per halving of the weight.
BLOCK, CLASSES = 4096, 2
#: Rows of a side of a block of dense vectors at most, and cells of a product of matrices at a time.
TOP_BLOCK, CELLS = 65_536, 1 << 21
#: Pairs by common words that are always joined, and products of rows that cost as much as one of a key and one of a posting.
KEY_PAIRS, KEY_COST, POSTING_COST = 1_000_000, 500, 50
#: Edges that one task decides in a single pass over the names.
LEADER_EDGES = 100_000
#: Words and rows of a table in which products look up their partners' words.
TABLE_WORDS, TABLE_ROWS = 8192, 256
#: Rows of a side of a tile of bags, dimensions of its two screens and of that of searches, and what single precision may lose.
TILE, ASK_TILE, ROUGH, DIMS, ASK_DIMS, SCREEN_SLACK = 49_152, 32_768, 128, 256, 768, 1e-4
#: Rows of which the cost of keys and the common words are taken, how many words have numbers, and parts of a side with their directions.
PLAN_ROWS, KNOWN, PARTS, AXES = 50_000, 65_536, 256, 4


# ------------------------------------------------------------------ bags of words
def bags(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, bag): each row's lower-case words [a-z0-9]+ as a map from word to weight, tf / length;
    rows without a word are left out. Nothing is shuffled."""
    split = df.select(*keys, F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9]+").alias("__w"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__w")
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary
            by = pc.sort_indices(words).to_numpy()
            place = np.empty(len(words), np.int64)
            place[by] = np.arange(len(words))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            code = place[coded.indices.to_numpy()]
            word = np.asarray(pc.not_equal(words, ""))[by][code]  # the ends of a text
            pairs, tf = np.unique(row[word] * max(1, len(words)) + code[word], return_counts=True)
            row, code = np.divmod(pairs, max(1, len(words)))
            lengths = np.sqrt(np.bincount(row, tf * tf, len(lists)))
            n = np.bincount(row, minlength=len(lists))
            some = np.flatnonzero(n)
            ends = pa.array(np.r_[0, np.cumsum(n[some])].astype(np.int32))
            kept = [batch.column(c).take(pa.array(some)) for c in keys]
            bag = [pa.ListArray.from_arrays(ends, words.take(pa.array(by[code]))), pa.ListArray.from_arrays(ends, pa.array(tf / lengths[row]))]
            yield pa.RecordBatch.from_arrays([*kept, *bag], [*keys, "__d", "__x"])

    kinds = dict(split.dtypes)
    counted = split.mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", __d array<string>, __x array<double>")
    return counted.select(*keys, F.map_from_arrays("__d", "__x").alias("bag"))


def overlap(a: Column, b: Column) -> Column:
    """Scalar product of two bags."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def _rare_first(rows: DataFrame, key: str) -> DataFrame:
    """(key, rest, token): the tokens of each bag, the rarest first, with the norm of what
    follows each of them, itself included."""
    tokens = rows.select(key, F.explode("bag").alias("token", "w"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    common_first = Window.partitionBy(key).orderBy(F.desc("df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)  # a bag's own tokens
    return tokens.join(counts, "token").select(key, "token", F.sqrt(F.sum(F.col("w") * F.col("w")).over(common_first)).alias("rest"))


def cosine_pairs(rows: DataFrame, key: str, least: float) -> DataFrame:
    """(a, b, similarity) with a < b of all rows of `rows` (key, bag), whose bags are distinct,
    with a cosine of `least` or more, to six digits.

    Prefix filtering: a bag's tokens are keys, the rarest first, as long as the norm of the
    tokens not yet taken can reach `least`. Two bags without a common key have all their common
    words in the rest of one of them, whose product stays below `least`. Where words are so
    common that keys would join to too many pairs, which is counted, blocks of rows are
    multiplied in tasks instead, in bounded memory.
    """
    bagged, keys, n = _keyed(rows, key, least)
    if keys is None:
        return _paired_in_tiles(bagged, key, least, n)
    pairs = keys.select(F.col(key).alias("a"), "token").join(keys.select(F.col(key).alias("b"), "token"), "token").where("a < b").select("a", "b").distinct()
    left, right = bagged.select(F.col(key).alias("a"), F.col("bag").alias("x")), bagged.select(F.col(key).alias("b"), F.col("bag").alias("y"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", F.bround(overlap(F.col("x"), F.col("y")), 6).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def nearest_smaller(rows: DataFrame, key: str, least: float) -> DataFrame:
    """(b, a, similarity, same): for each row b of cosine_pairs its best a, the smallest of equal ones, and the
    smallest a at 1. Pairs found in tiles leave a row for each b and tile, not one for each pair."""
    bagged, keys, n = _keyed(rows, key, least)
    if keys is None:
        found = _paired_in_tiles(bagged, key, least, n, nearest=True)
    else:
        found = cosine_pairs(bagged, key, least).withColumn("same", F.when(F.col("similarity") == 1, F.col("a")))
    return found.groupBy("b").agg(F.max("similarity").alias("similarity"), F.min_by("a", F.struct(-F.col("similarity"), "a")).alias("a"), F.min("same").alias("same")).select("b", "a", "similarity", "same")


def _keyed(rows: DataFrame, key: str, least: float) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows of cosine_pairs, their keys, and their number; no keys if they would join to too many pairs. Of
    more than PLAN_ROWS rows this is first told by some of them, so that keys are made only to be used."""
    if not 0 < least <= 1:
        raise ValueError("least lies above 0 and is at most 1")
    bagged = cut(rows.select(key, "bag"))
    n = bagged.count()

    def keys_of(some: DataFrame, share: int) -> DataFrame | None:
        keys = cut(_rare_first(some, key).where(F.col("rest") >= least - SLACK).select(key, "token"))
        alike = keys.groupBy("token").count().agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).first()[0]
        return keys if (alike or 0) * share**2 <= max(KEY_PAIRS, n * (n - 1) / 2 / KEY_COST) else None

    share = -(-n // PLAN_ROWS)
    if share > 1 and keys_of(_some(bagged, key, share), share) is None:
        return bagged, None, n
    return bagged, keys_of(bagged, 1), n


def _some(rows: DataFrame, key: str, share: int) -> DataFrame:
    """One of `share` rows."""
    return rows.where(F.pmod(F.xxhash64(F.lit("some"), key), F.lit(share)) == 0)


def _paired_in_tiles(bagged: DataFrame, key: str, least: float, n: int, nearest: bool = False) -> DataFrame:
    """cosine_pairs of the n rows of `bagged`, found block against block; a pair is a row only if its
    product reaches `least`. With `nearest` a tile has one row (a, b, similarity, same) for each b instead."""
    blocks = max(1, min(8, n // 500), -(-n // TILE))
    place = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    coded = _numbered(bagged, [F.col(key).alias("key"), place.alias("blk")], "bag", _known(_some(bagged, key, -(-n // PLAN_ROWS)), "bag"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = cut(_packed(coded, "blk")).withColumn("other", other).select("*", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi")).drop("other")

    def pair(rows: pa.Table) -> pa.Table:
        lo, hi, blk = (rows.column(c).to_numpy() for c in ("lo", "hi", "blk"))
        one = lo[0] == hi[0]
        left = _unpacked(rows.column("rows").filter(pa.array(blk == lo)))
        right = left if one else _unpacked(rows.column("rows").filter(pa.array(blk == hi)))
        x, y = _bags_of(left, right)
        if nearest:
            return _nearest_in_tile(x, y, left.column("key"), right.column("key"), least, one)
        a, b, d = [], [], []
        for i, j, _ in _hopeful(x, y, least, one):
            product = _products(x, i, y, j)
            reached = product >= least - SLACK
            a, b, d = [*a, i[reached]], [*b, j[reached]], [*d, product[reached]]
        i, j, product = (np.concatenate(z) if z else np.zeros(0, t) for z, t in ((a, np.int64), (b, np.int64), (d, np.float64)))
        return pa.table({"a": left.column("key").combine_chunks().take(pa.array(i)), "b": right.column("key").combine_chunks().take(pa.array(j)), "similarity": pa.array(product)})

    kind = dict(bagged.dtypes)[key]
    tiles = sent.repartition(blocks * (blocks + 1), "lo", "hi").groupBy("lo", "hi")  # a number of tasks that Spark leaves as it is
    found = tiles.applyInArrow(pair, f"a {kind}, b {kind}, similarity double" + (f", same {kind}" if nearest else ""))
    if nearest:
        return cut(found)
    return cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.bround("similarity", 6).alias("similarity")).where(F.col("similarity") >= least))


# ------------------------------------------------------------------ bags in tasks
def _known(some: DataFrame, bag: str) -> pa.Array:
    """The words with the greatest weights in some bags, at most KNOWN, the greatest first. They are numbers in
    what is sent to tasks; which ones they are changes no result."""
    words = cut(some.select(F.explode(bag).alias("token", "w")).groupBy("token").agg(F.sum(F.col("w") * F.col("w")).alias("m")).withColumn("cls", F.floor(F.log2("m") * 64)))
    taken, least = 0, None
    for cls, n in words.groupBy("cls").count().orderBy(F.desc("cls")).collect():  # 64 rows per power of two
        if taken + n > KNOWN:
            break
        taken, least = taken + n, cls
    held = words.where(F.col("cls") >= F.lit(least)).select("token", "m").collect() if taken else words.orderBy(F.desc("m"), "token").limit(DIMS).collect()  # KNOWN rows
    return pa.array([r.token for r in sorted(held, key=lambda r: (-r.m, r.token))], pa.string())


def _numbered(rows: DataFrame, keys: list[Column | str], bag: str, known: pa.Array) -> DataFrame:
    """(keys, t, rest, w, c): the bags as lists: the numbers of known words, the other words, the different weights, and
    which of these the ones and then the others have (at most 65,536, as a text has fewer different counts of words)."""
    listed = rows.select(*keys, F.map_keys(bag).alias("t"), F.map_values(bag).alias("w"))
    names = listed.columns[:-2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lengths = batch.column("t").flatten(), batch.column("t").value_lengths().to_numpy()
            w, _ = _lists(batch.column("w"))
            number = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
            row, new = np.repeat(np.arange(len(lengths)), lengths), number < 0
            by = np.lexsort((np.where(new, len(known), number), row))  # the others keep their order
            cuts = lambda mask: pa.array(np.r_[0, np.cumsum(np.bincount(row[mask], minlength=len(lengths)))].astype(np.int32))
            number, fresh = number[by], new[by]
            t = pa.ListArray.from_arrays(cuts(~new), pa.array(number[~fresh].astype(np.uint16).view(np.int16)))
            rest = pa.ListArray.from_arrays(cuts(new), words.take(pa.array(by[fresh])))
            w = w[by]
            up = np.lexsort((w, row))
            least = np.r_[True, (w[up][1:] != w[up][:-1]) | (row[1:] != row[:-1])][: len(row)]  # of the equal weights of a row
            weights = pa.ListArray.from_arrays(cuts(least), pa.array(w[up][least]))
            code = np.empty(len(row), np.uint16)
            code[up] = np.cumsum(least) - 1 - weights.offsets.to_numpy()[row]
            codes = pa.ListArray.from_arrays(cuts(np.ones(len(row), bool)), pa.array(code.view(np.int16)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), t, rest, weights, codes], [*names, "t", "rest", "w", "c"])

    kinds = dict(listed.dtypes)
    return listed.mapInArrow(code, ", ".join(f"{c} {kinds[c]}" for c in names) + ", t array<smallint>, rest array<string>, w array<double>, c array<smallint>")


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """(block, rows): the rows of a block as compressed Arrow tables of as many rows as meet in a batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blk = batch.column(block).to_numpy()
            by = np.argsort(blk, kind="stable")
            tables, starts = [], np.flatnonzero(np.r_[True, blk[by][1:] != blk[by][:-1]][: len(by)])
            for rows in np.split(by, starts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.take(pa.array(rows)))
                tables.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(blk[by][starts]), pa.array(tables[: len(starts)], pa.binary())], [block, "rows"])

    return rows.mapInArrow(pack, f"{block} int, rows binary")


def _unpacked(tables: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(t.as_buffer()).read_all() for t in tables])


class _Bags:
    """Bags of one side of a tile, with numbers for words, the smallest for those of the greatest weights."""

    def __init__(self, rows: pa.Table, words: np.ndarray):
        self.t, self.n = words, rows.num_rows
        code, self.lengths = _lists(rows.column("c"))
        weights, n = _lists(rows.column("w"))
        self.w = weights[np.repeat(np.cumsum(n) - n, self.lengths) + code.view(np.uint16)]
        self.starts = np.r_[0, np.cumsum(self.lengths)]

    def screen(self, width: int) -> np.ndarray:
        """The rows' words in `width` dimensions, the first words in one each, the others by their number in the second half: the
        norm of a row's words in each. By Cauchy and Schwarz in each dimension, no product of two bags exceeds that of their rows here."""
        out, own = np.empty((self.n, width), np.float32), width // 2
        for at in range(0, self.n, 4096):
            to = min(at + 4096, self.n)
            t, w = self.t[self.starts[at] : self.starts[to]], self.w[self.starts[at] : self.starts[to]]
            row = np.repeat(np.arange(to - at), self.lengths[at:to])
            out[at:to] = np.sqrt(np.bincount(row * width + np.where(t < own, t, own + t % (width - own)), w * w, (to - at) * width)).reshape(-1, width)
        return out


def _bags_of(left: pa.Table, right: pa.Table) -> tuple[_Bags, _Bags]:
    """Both sides of a tile, whose words have the same numbers."""
    rest = [rows.column("rest").combine_chunks().flatten() for rows in ((left,) if left is right else (left, right))]
    codes = pa.concat_arrays(rest).dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def side(rows: pa.Table, others: np.ndarray) -> _Bags:
        number, known = _lists(rows.column("t"))
        _, lengths = _lists(rows.column("c"))
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        words, first = np.empty(len(place), np.int32), place < np.repeat(known, lengths)
        words[first], words[~first] = number.view(np.uint16), others + KNOWN
        return _Bags(rows, words)

    x = side(left, codes[: len(rest[0])])
    return x, x if left is right else side(right, codes[len(rest[0]) :])


def _products(x: _Bags, i: np.ndarray, y: _Bags, j: np.ndarray) -> np.ndarray:
    """Scalar products of rows i of x with rows j of y, in double precision. A few rows of x at a time are a
    table by their own words, in which the words of their partners are looked up."""
    out = np.zeros(len(i))
    by = np.argsort(i, kind="stable")
    rows, starts = np.unique(i[by], return_index=True)
    starts, sizes = np.r_[starts, len(i)], np.cumsum(x.lengths[rows])
    local = np.zeros(1 + max(x.t.max(initial=0), y.t.max(initial=0)), np.int32)
    at = 0
    while at < len(rows):
        to = min(at + TABLE_ROWS, max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TABLE_WORDS, side="right"))))
        n = x.lengths[rows[at:to]]
        words = np.arange(n.sum()) + np.repeat(x.starts[rows[at:to]] - np.cumsum(n) + n, n)
        own, place = np.unique(x.t[words], return_inverse=True)
        local[own] = np.arange(1, len(own) + 1)
        width = len(own) + 1  # the first column is for words that none of these rows has
        table = np.zeros((to - at) * width)
        table[np.repeat(np.arange(to - at), n) * width + place + 1] = x.w[words]
        pairs = by[starts[at] : starts[to]]
        base, other = np.repeat(np.arange(to - at) * width, np.diff(starts[at : to + 1])), j[pairs]
        ends, low = np.cumsum(y.lengths[other]), 0
        while low < len(pairs):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS // 8, side="right")))
            n = y.lengths[other[low:high]]
            first = np.cumsum(n) - n
            words = np.arange(n.sum()) + np.repeat(y.starts[other[low:high]] - first, n)
            out[pairs[low:high]] = np.add.reduceat(table[np.repeat(base[low:high], n) + local[y.t[words]]] * y.w[words], first)
            low = high
        local[own] = 0
        at = to
    return out


def _parts(x: _Bags, y: _Bags, heavy: list[np.ndarray], least: float) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Both sides' rows in the order of their parts, where parts begin, and which parts can hold pairs of `least`.

    Rows are seen along the AXES main directions of the heavy words, and by the norm of all that is left: vectors of length 1, whose products
    are no smaller than those of the bags. So their angles are no greater, and obey the triangle inequality.
    """
    some = np.concatenate([h[:: max(1, len(h) // 2048)] for h in heavy]).astype(np.float64)
    axes = np.linalg.eigh(some.T @ some)[1][:, -AXES:]

    def seen(h: np.ndarray) -> np.ndarray:
        along = h @ axes
        flat = np.c_[along, np.sqrt(np.maximum(0.0, 1 - (along * along).sum(1)))]
        return flat / np.linalg.norm(flat, axis=1, keepdims=True)

    points = seen(some)
    centres = points[np.random.default_rng(0).permutation(len(points))[: max(1, min(PARTS, max(x.n, y.n) // 128))]]
    for _ in range(5):
        part = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, points)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    centres = centres[np.argsort(centres[:, np.argmax(np.var(centres, axis=0))])]
    orders, starts, far = [], [], []
    for h in heavy:
        part, angle = np.empty(len(h), np.int64), np.empty(len(h))
        for at in range(0, len(h), 8192):
            alike = seen(h[at : at + 8192].astype(np.float64)) @ centres.T
            part[at : at + 8192], angle[at : at + 8192] = np.argmax(alike, axis=1), np.arccos(np.clip(alike.max(axis=1), -1, 1))
        reach = np.zeros(len(centres))
        np.maximum.at(reach, part, angle)
        orders.append(np.argsort(part, kind="stable"))
        starts.append(np.r_[0, np.cumsum(np.bincount(part, minlength=len(centres)))])
        far.append(reach)
    near = np.arccos(np.clip(centres @ centres.T, -1, 1)) - far[0][:, None] - far[-1][None] <= np.arccos(least) + 1e-3
    return orders, starts, near


def _hopeful(x: _Bags, y: _Bags, least: float, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, upper) in lots: the pairs of rows whose products may reach `least`, with a bound of the product. If
    both sides are `one`, each pair comes once. Parts are multiplied in ROUGH dimensions, and what is left in DIMS."""
    if not x.n or not y.n:
        return
    bar = least - SCREEN_SLACK
    fine = [x.screen(DIMS)] if one else [x.screen(DIMS), y.screen(DIMS)]
    orders, starts, near = _parts(x, y, [f[:, : DIMS // 2] for f in fine], least)
    rough = [b.screen(ROUGH)[o] for b, o in zip((x, y), orders)]
    held, many = [], 0

    def finer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = orders[0][np.concatenate([h[0] for h in held])], orders[-1][np.concatenate([h[1] for h in held])]
        upper = np.concatenate([np.einsum("ij,ij->i", fine[0][i[at : at + 4096]], fine[-1][j[at : at + 4096]]) for at in range(0, len(i), 4096)])
        kept = upper >= bar
        return i[kept], j[kept], upper[kept]

    for part in range(len(near)):
        runs = np.flatnonzero(np.diff(np.r_[False, near[part], False])).reshape(-1, 2)
        for at in range(starts[0][part], starts[0][part + 1], 512):
            mine = rough[0][at : min(at + 512, starts[0][part + 1])]
            for low, high in starts[-1][runs]:
                for col in range(max(low, at) if one else low, high, 2048):
                    those = rough[-1][col : min(col + 2048, high)]
                    cells = np.flatnonzero(mine @ those.T >= bar)
                    if len(cells):
                        i, j = cells // len(those) + at, cells % len(those) + col
                        if one:
                            i, j = i[i < j], j[i < j]
                        held.append((i, j))
                        many += len(i)
            if many > CELLS // 2:
                yield finer()
                held, many = [], 0
    if held:
        yield finer()


def _nearest_in_tile(x: _Bags, y: _Bags, names: pa.ChunkedArray, others: pa.ChunkedArray, least: float, one: bool) -> pa.Table:
    """(a, b, similarity, same): for each row b of either side the best a < b of the other one, the smallest of equal ones, and the smallest
    one at 1. What a row has found is a bound for its other partners."""
    ids = names.combine_chunks() if one else pa.concat_arrays([names.combine_chunks(), others.combine_chunks()])
    rank = _order(ids)
    top, best, same = np.full(len(ids), -1.0), np.full(len(ids), len(ids)), np.full(len(ids), len(ids))
    for i, j, upper in _hopeful(x, y, least, one):
        p, q = rank[i], rank[j if one else j + x.n]
        late, early = np.maximum(p, q), np.minimum(p, q)  # as ranks
        by = np.lexsort((-upper, late))
        first = np.zeros(len(by), bool)
        first[by[np.r_[True, late[by][1:] != late[by][:-1]]] if len(by) else by] = True
        for now in (first, ~first):  # the most hopeful partner of each row, then those that may be better
            some = np.flatnonzero(now & (upper >= np.maximum(least, top[late] / 1e6) - SCREEN_SLACK))
            digits = np.rint(_products(x, i[some], y, j[some]) * 1e6)
            some, digits = some[digits / 1e6 >= least], digits[digits / 1e6 >= least]
            row, place = late[some], early[some]
            np.minimum.at(same, row[digits >= 1e6], place[digits >= 1e6])
            order = np.lexsort((place, -digits, row))
            lead = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
            row, place, digits = row[lead], place[lead], digits[lead]
            better = (digits > top[row]) | ((digits == top[row]) & (place < best[row]))
            top[row[better]], best[row[better]] = digits[better], place[better]
    at = np.empty(len(ids), np.int64)
    at[rank] = np.arange(len(ids))
    found = np.flatnonzero(top >= 0)
    none = same[found] == len(ids)
    return pa.table({
        "a": ids.take(pa.array(at[best[found]])), "b": ids.take(pa.array(at[found])), "similarity": pa.array(top[found] / 1e6),
        "same": ids.take(pa.array(at[np.where(none, 0, same[found])] if len(found) else at[:0], mask=none)),
    })


# ------------------------------------------------------------------ semantic cache
def cache_lookups(df: DataFrame, order: str, text: str, least: float = 0.9) -> DataFrame:
    """(order, hit, best, similarity) for every row as a prompt that meets the earlier ones:
    the earlier row with the greatest cosine, the earliest of equal ones, if it reaches
    `least`; a miss has nulls. `order` is unique and not null; a text without words misses.

    Equal bags are one class, of which only the first row can be found: pairs are made
    between classes, so that a group of copies costs one row.
    """
    bagged = bags(df, [order], text)
    rows = cut(bagged.select(order, F.xxhash64(F.to_json("bag")).alias("h1"), F.sha2(F.to_json("bag"), 256).alias("h2"), "bag"))
    classes = cut(rows.groupBy("h1", "h2").agg(F.min(order).alias("first")))
    firsts = rows.select(F.col(order).alias("first"), "bag").join(small(rows.select(F.col(order).alias("first")).join(classes, "first", "left_anti")), "first", "left_anti")
    # The first row of a class looks for classes that began before it. Later rows meet their class at 1, and what began still earlier at 1.
    earlier = cut(nearest_smaller(firsts, "first", least).select(F.col("b").alias("first"), F.col("a").alias("near"), F.col("similarity").alias("s"), "same"))
    found = classes.join(earlier, "first", "left").select("h1", "h2", "first", "near", "s", F.coalesce("same", "first").alias("older"))
    # Classes are one row each on their side, so that Spark can split the rows of a hot one.
    placed = rows.select(order, "h1", "h2").join(found, ["h1", "h2"])
    later = F.col(order) > F.col("first")
    best = placed.select(order, F.when(later, F.col("older")).otherwise(F.col("near")).alias("best"), F.when(later, F.lit(1.0)).otherwise(F.col("s")).alias("similarity"))
    wordless = df.select(order).join(rows.select(order), order, "left_anti").select(order, F.lit(None).cast(dict(df.dtypes)[order]).alias("best"), F.lit(None).cast("double").alias("similarity"))
    return best.unionByName(wordless).select(order, F.col("best").isNotNull().alias("hit"), "best", "similarity")


def hit_ratio(lookups: DataFrame) -> DataFrame:
    """(entries, hits, misses, hit_ratio) of all lookups; the ratio is 0 without any."""
    g = lookups.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"))
    ratio = F.when(F.col("entries") > 0, F.bround(F.col("hits") / F.col("entries"), 4)).otherwise(0.0)
    return g.select("entries", "hits", (F.col("entries") - F.col("hits")).alias("misses"), ratio.alias("hit_ratio"))


# ------------------------------------------------------------------ greedy leaders
def _followers(edges: DataFrame) -> DataFrame:
    """(name): the names that follow another one, by one pass over few edges (low, high).
    Names are compared by their places in Spark's order."""

    def follow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("l", "ascending")])
        found: dict[int, int] = {}
        for k, (low, high) in enumerate(zip(rows.column("l").to_pylist(), rows.column("h").to_pylist())):
            if low not in found:
                found.setdefault(high, k)
        return pa.table({"name": rows.column("high").combine_chunks().take(pa.array(list(found.values()), pa.int64()))})

    names = edges.select(F.col("low").alias("n")).union(edges.select("high")).distinct().select("n", F.row_number().over(Window.orderBy("n")).alias("i"))  # at most two for an edge
    placed = edges.join(names.select(F.col("n").alias("low"), F.col("i").alias("l")), "low").join(names.select(F.col("n").alias("high"), F.col("i").alias("h")), "high")
    return placed.select("high", "l", "h", F.lit(0).alias("all")).groupBy("all").applyInArrow(follow, f"name {dict(edges.dtypes)['high']}")


def greedy_leaders(pairs: DataFrame, names: DataFrame, rounds: int = 10_000, at_once: int = 0) -> DataFrame:
    """(name, leader): what one pass over the names in order gives, where each name joins the
    first earlier leader that it is similar to, or else leads. pairs: (a, b), similar names in
    either order; names: one column, whose order is the order of the pass.

    The leaders are the lexicographically first maximal independent set of the graph. In each
    round a name leads when no undecided smaller neighbour is left, and its other neighbours
    follow; edges of decided names go, so that rounds shrink. Once at most `at_once` of them are
    left, which is counted, one task does the rest of the pass. A chain in order that is longer
    needs as many rounds as it has leaders before.
    """
    name = names.columns[0]
    known = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    both = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct()
    edges = cut(both.join(known.select(F.col("name").alias("low")), "low", "left_semi").join(known.select(F.col("name").alias("high")), "high", "left_semi"))
    left, followers = edges, []
    for _ in range(rounds):
        few = left.limit(at_once + 1).count()
        if few <= at_once:
            if few:
                followers.append(cut(_followers(left)))
            break
        leads = left.select("low").distinct().join(left.select(F.col("high").alias("low")).distinct(), "low", "left_anti")
        follow = cut(left.join(leads, "low", "left_semi").select(F.col("high").alias("name")).distinct())
        followers.append(follow)
        gone = follow.select(F.col("name").alias("low"))
        left = cut(left.join(leads, "low", "left_anti").join(gone, "low", "left_anti").join(gone.withColumnRenamed("low", "high"), "high", "left_anti"))
    else:
        raise RuntimeError(f"not done after {rounds} rounds")
    if not followers:
        return known.select("name", F.col("name").alias("leader"))
    follows = reduce(DataFrame.unionByName, followers)
    leaders = known.join(follows, "name", "left_anti")
    joined = edges.join(leaders.select(F.col("name").alias("low")), "low", "left_semi").groupBy(F.col("high").alias("name")).agg(F.min("low").alias("leader"))
    return leaders.select("name", F.col("name").alias("leader")).unionByName(joined.join(follows, "name", "left_semi"))


# ------------------------------------------------------------------ sparse top-k
def sparse_top_k(queries: DataFrame, memories: DataFrame, query_id: str, memory_id: str, tenant: str, k: int, least: float, block: int = BLOCK) -> DataFrame:
    """(query, memory, similarity, rank): the k memories of the query's tenant with the
    greatest cosine of `least` > 0 or more, to six digits, ties by the memory's id. Both sides
    have their id, the tenant and `bag` (see bags); ids are unique.

    Postings are ordered by impact: those of a token fall into classes of about equal weight,
    and classes into blocks of about `block` rows, so that a token that every memory holds is
    dealt out. A first round scores each query's memories in its most selective blocks; the
    k-th best score, or `least`, is then a bound. Tokens whose greatest impacts together stay
    below the bound are never joined, nor are classes that can't reach it with all that the
    other tokens can add. Pairs whose bound holds are scored in full. Where tokens are so
    common that postings would join to too many pairs, which is counted, blocks of queries and
    memories are multiplied in tasks instead (see _topped_in_tiles).
    """
    if not least > 0:
        raise ValueError("least lies above 0")
    mem = cut(memories.select(F.col(memory_id).alias("memory"), F.col(tenant).alias("tenant"), F.col("bag").alias("mbag")).where("tenant is not null"))
    asked = cut(queries.select(F.col(query_id).alias("query"), F.col(tenant).alias("tenant"), F.col("bag").alias("qbag")).where("tenant is not null"))
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "memory")  # Spark keeps k rows per task before the shuffle
    of = lambda df, bag, n: df.select("tenant", F.explode(F.map_keys(bag)).alias("token")).groupBy("tenant", "token").agg(F.count(F.lit(1)).cast("double").alias(n))
    met = of(asked, "qbag", "a").join(of(mem, "mbag", "b"), ["tenant", "token"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    per = lambda df, n: df.groupBy("tenant").agg(F.count(F.lit(1)).cast("double").alias(n))
    cells = per(asked, "a").join(per(mem, "b"), "tenant").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    if (met or 0) > max(KEY_PAIRS, (cells or 0) / POSTING_COST):
        return _topped_in_tiles(asked, mem, k, least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # Only tokens that some query has are indexed.
    wanted = asked.select("tenant", F.explode(F.map_keys("qbag")).alias("token")).distinct()
    raw = mem.select("tenant", "memory", F.explode("mbag").alias("token", "w")).withColumn("cls", F.floor(-F.log2("w") * CLASSES).cast("int"))
    held = raw.join(wanted, ["tenant", "token"], "left_semi")
    directory = cut(held.groupBy("tenant", "token", "cls").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("top")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    many = directory.where("blocks > 1").select("tenant", "token", "cls", "blocks")
    postings = cut(held.join(small(many), ["tenant", "token", "cls"], "left").select(
        "tenant", "token", "cls", F.pmod(F.xxhash64("memory"), F.coalesce("blocks", F.lit(1))).cast("int").alias("blk"), "memory", "w"))
    terms = cut(asked.select("query", "tenant", F.explode("qbag").alias("token", "q")).join(directory, ["tenant", "token"]))
    place = ["tenant", "token", "cls", "blk"]

    def score(pairs: DataFrame) -> DataFrame:
        full = pairs.join(asked.select("query", "qbag"), "query").join(mem.select("memory", "mbag"), "memory")
        return full.select("query", "memory", F.bround(overlap(F.col("qbag"), F.col("mbag")), 6).alias("similarity")).where(F.col("similarity") >= least)

    # First round: the first blocks of the classes with the greatest impact for their length.
    by_gain = Window.partitionBy("query").orderBy(F.desc(F.col("q") * F.col("top") / F.least("n", F.lit(block))), "token", "cls")
    before = F.coalesce(F.sum(F.least("n", F.lit(block))).over(by_gain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tried = terms.withColumn("before", before).where(F.col("before") < 4 * k).select("query", "tenant", "token", "cls", F.lit(0).alias("blk"))
    first = cut(score(tried.join(postings, place).select("query", "memory").distinct()).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    bound = asked.select("query").join(first.where(F.col("rank") == k).select("query", F.col("similarity").alias("b")), "query", "left").select("query", F.coalesce("b", F.lit(least)).alias("bound"))
    # Second round: tokens from the weakest up, as long as together they stay below the bound.
    token_top = terms.groupBy("query", "token").agg(F.max(F.col("q") * F.col("top")).alias("most"))
    weak_first = Window.partitionBy("query").orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("query")
    bounded = token_top.join(bound, "query").withColumns({"upto": F.sum("most").over(weak_first), "all": F.sum("most").over(whole)})
    essential = bounded.where(F.col("upto") >= F.col("bound") - SLACK)
    weak = bounded.groupBy("query").agg(F.coalesce(F.sum(F.when(F.col("upto") < F.col("bound") - SLACK, F.col("most"))), F.lit(0.0)).alias("weak"))
    classes = terms.join(essential.select("query", "token", "most", "all", "bound"), ["query", "token"])
    able = F.col("q") * F.col("top") + F.col("all") - F.col("most") >= F.col("bound") - SLACK
    skipped = classes.where(~able).groupBy("query", "token").agg(F.max(F.col("q") * F.col("top")).alias("x")).groupBy("query").agg(F.sum("x").alias("skipped"))
    joined = classes.where(able).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("query", *place, "q").join(postings, place)
    partial = joined.groupBy("query", "memory").agg(F.sum(F.col("q") * F.col("w")).alias("part"))
    rest = bound.join(weak, "query", "left").join(skipped, "query", "left").select("query", "bound", (F.coalesce("weak", F.lit(0.0)) + F.coalesce("skipped", F.lit(0.0))).alias("more"))
    hopeful = partial.join(rest, "query").where(F.col("part") + F.col("more") >= F.col("bound") - SLACK).select("query", "memory")
    return score(hopeful).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _topped_in_tiles(asked: DataFrame, mem: DataFrame, k: int, least: float) -> DataFrame:
    """(query, memory, similarity): at least the k memories of sparse_top_k, found block against block (see _best_in_tile)."""
    n, asking = mem.count(), asked.count()
    blocks = max(1, min(16, n // 500), -(-n // ASK_TILE))
    parts = max(1, -(-asking * 4 // ASK_TILE))
    known = _known(_some(mem, "memory", -(-n // PLAN_ROWS)), "mbag")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = _numbered(asked, ["query", "tenant"], "qbag", known).select("*", dealt("query", parts).alias("part"), every(blocks).alias("blk"))
    right = _numbered(mem, ["memory", "tenant"], "mbag", known).select("*", dealt("memory", blocks).alias("blk"), every(parts).alias("part"))

    def compare(asks: pa.Table, rows: pa.Table) -> pa.Table:
        x, y = _bags_of(asks, rows)
        ids, names = rows.column("memory").combine_chunks(), asks.column("query").combine_chunks()
        q, p, digits = _best_in_tile(x, y, _order(ids), k, least)
        return pa.table({"query": names.take(pa.array(q)), "memory": ids.take(pa.array(p)), "similarity": pa.array(digits / 1e6)})

    tasks = 2 * blocks * parts
    sides = [df.repartition(tasks, "tenant", "blk", "part").groupBy("tenant", "blk", "part") for df in (left, right)]  # a number of tasks that Spark leaves as it is
    found = sides[0].cogroup(sides[1]).applyInArrow(compare, f"query {dict(asked.dtypes)['query']}, memory {dict(mem.dtypes)['memory']}, similarity double")
    return cut(found)


def _best_in_tile(x: _Bags, y: _Bags, order: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, digits): for each row i of x the k rows of y with the greatest products of `least` or more, in six digits, ties by order[j].

    The screen bounds all products of a few rows of x. The most hopeful row of each of the most hopeful groups of rows is scored first;
    the k-th best of these is the bound for the others. The other rows are scored in lots, by their bounds, each lot with a better bound.
    """
    q, p, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if not x.n or not y.n:
        return q[0], p[0], d[0]
    mine, columns = x.screen(ASK_DIMS), y.screen(ASK_DIMS)
    starts = np.arange(0, y.n, max(1, min(64, y.n // (4 * k + 64))))
    for at in range(0, x.n, 256):
        upper = np.concatenate([mine[at : at + 256] @ columns[c : c + 4096].T for c in range(0, y.n, 4096)], axis=1)
        group = np.maximum.reduceat(upper, starts, axis=1)
        tries = min(len(starts), 2 * k + 24)
        first = np.argpartition(-group, tries - 1, axis=1)[:, :tries]
        found = [z[:0] for z in (q[0], p[0], d[0])]
        floor = np.full(len(upper), least)

        def score(i: np.ndarray, j: np.ndarray, found: list[np.ndarray], floor: np.ndarray) -> list[np.ndarray]:
            """The best of what was found and of these pairs; `floor` rises to the k-th best."""
            digits = np.rint(_products(x, i + at, y, j) * 1e6)
            good = digits / 1e6 >= least
            found = [np.r_[a, b[good]] for a, b in zip(found, (i, j, digits))]
            kept = _best(found[0], found[2], found[1], order, k)
            found = [c[kept] for c in found]
            full = np.flatnonzero(np.bincount(found[0], minlength=len(floor)) == k)
            worst = np.full(len(floor), np.inf)
            np.minimum.at(worst, found[0], found[2])
            floor[full] = np.maximum(floor[full], worst[full] / 1e6)
            return found

        # The best row of a group, by its place in the group of the greatest bounds.
        ends = np.r_[starts[1:], y.n]
        width = int((ends - starts).max())
        inside = starts[first][:, :, None] + np.arange(width)
        values = np.where(inside < ends[first][:, :, None], np.take_along_axis(upper, np.minimum(inside, y.n - 1).reshape(len(upper), -1), axis=1).reshape(inside.shape), -1.0)
        lead = starts[first] + values.argmax(axis=2)
        found = score(np.repeat(np.arange(len(lead)), tries), lead.ravel(), found, floor)
        done = np.zeros(upper.shape, bool)
        np.put_along_axis(done, lead, True, axis=1)
        upper[done] = -1.0
        cells = np.flatnonzero(upper >= floor[:, None] - SCREEN_SLACK)
        cells = cells[np.argsort(-upper.ravel()[cells], kind="stable")]
        lot = 8192
        while len(cells):
            i, j = np.divmod(cells[:lot], y.n)
            found = score(i, j, found, floor)
            cells = cells[lot:]
            cells = cells[upper.ravel()[cells] >= floor[cells // y.n] - SCREEN_SLACK]
            lot *= 2
        q, p, d = [*q, found[0] + at], [*p, found[1]], [*d, found[2]]
    return tuple(np.concatenate(c) for c in (q, p, d))


# ------------------------------------------------------------------ dense top-k
def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists without nulls, one after another, and the length of each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors with a direction, scaled to length 1 in double precision."""
    flat, lengths = _lists(column)
    rows = flat.astype(np.float64).reshape(len(lengths), -1) if len(lengths) else np.zeros((0, 0))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True) if len(rows) else rows


def usable(v: Column) -> Column:
    """True for vectors with a direction: not null, finite in all components, not all zero."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def cluster_index(vectors: DataFrame, id_col: str, vector: str, clusters: int, sample: int = 20_000, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """((id, v, cluster, angle), centroids): each vector with a direction, with its nearest
    centroid and the angle to it. Centroids are `clusters` vectors of a bounded sample (the
    smallest hashes of the ids), moved by a few steps of k-means on that sample."""
    good = vectors.where(usable(F.col(vector))).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    rows = good.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("v").collect()
    points = np.array([r.v for r in rows], np.float64)
    if not len(points):
        return good.select("*", F.lit(0).alias("cluster"), F.lit(0.0).alias("angle")), points
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres = points[:clusters].copy()
    for _ in range(5):
        near = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                alike = _units(part.column("v")) @ centres.T
                near = np.argmax(alike, axis=1)
                angle = np.arccos(np.clip(alike[np.arange(len(near)), near], -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(angle)], ["id", "v", "cluster", "angle"])

    kinds = dict(good.dtypes)
    return good.mapInArrow(assign, f"id {kinds['id']}, v {kinds['v']}, cluster int, angle double"), centres


def _best(q: np.ndarray, digits: np.ndarray, place: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of scored pairs, the places of the k of each q with the most digits, ties by order[place]."""
    by = np.lexsort((order[place], -digits, q))
    starts = np.flatnonzero(np.r_[True, q[by][1:] != q[by][:-1]]) if len(by) else np.zeros(0, np.int64)
    rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    return by[rank < k]


def _order(ids: pa.Array) -> np.ndarray:
    """Each row's place in the order of the ids, nulls first, as Spark sorts them."""
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return order


def _codes(ids: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where ids of the two sides are, nulls too."""
    held = pc.unique(ids)
    code = lambda c: pc.fill_null(pc.index_in(c, value_set=held), -1).to_numpy(zero_copy_only=False)
    return code(ids), code(others)


def dense_top_k(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, vector: str, k: int, clusters: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((query, id, similarity, rank), (compared, pairs)): exactly the k rows of the corpus with
    the greatest cosine to six digits, ties by id, a row's own id left out; and how many pairs
    were compared, of how many. Vectors of one table have one length. Those without a direction
    (null, zero, null or non-finite components) have similarity 0 with everything.

    The corpus is split by its nearest centroids (at most 4,096, sent to all tasks). Each query
    first meets clusters next to it with k rows or more; its k-th best angle then bounds, by the triangle
    inequality, which other clusters can hold better ones. Clusters lie in blocks of `block`
    rows or a sixty-fourth of the corpus (at most TOP_BLOCK); larger ones are dealt out over several. A query
    travels once to each block that it needs, and a task multiplies a block with its queries as
    matrices: where nothing can be pruned, all pairs are compared, in bounded memory.
    """
    spark = corpus.sparkSession
    n, asking = corpus.count(), queries.count()
    clusters = clusters or int(min(4096, max(1, n**0.5 / 2)))
    indexed, centres = cluster_index(corpus, corpus_id, vector, clusters)
    held = cut(indexed)
    per = min(TOP_BLOCK, max(block, -(-n // 64)))
    start, pieces, near, far, size = (np.zeros(max(1, len(centres)), t) for t in (np.int64, np.int64, np.float64, np.float64, np.int64))
    blocks, fill = 0, per
    bounds = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far")).orderBy("cluster").collect()  # a row per cluster
    for c, rows, low, high in bounds:
        if fill + rows > per:
            blocks, fill = blocks + 1, 0
        start[c], pieces[c], near[c], far[c], size[c] = blocks - 1, -(-rows // per), low, high, rows
        blocks, fill = blocks + pieces[c] - 1, fill + rows if pieces[c] == 1 else per
    places = spark.createDataFrame([(c, int(start[c]), int(pieces[c])) for c, *_ in bounds], "cluster int, start int, pieces int")
    parts = max(1, -(-asking // TOP_BLOCK))  # of the queries
    placed = held.join(F.broadcast(places), "cluster").select("id", "v", "cluster", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).alias("blk"))
    dealt = cut(placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    kinds = dict(queries.select(F.col(query_id).alias("query"), F.col(vector).alias("v")).dtypes)
    asked = queries.select(F.col(query_id).alias("query"), F.col(vector).alias("v")).withColumn("good", usable(F.col("v")))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query, v, least) -> a row for each block that holds clusters to compare with, and these."""
        for batch in batches:
            for at in range(0, batch.num_rows if len(centres) else 0, 512):
                part = batch.slice(at, 512)
                to = np.arccos(np.clip(_units(part.column("v")) @ centres.T, -1, 1))
                least = part.column("least").to_numpy(zero_copy_only=False)
                if "first" in part.schema.names:  # the closest clusters, until they hold more than k rows
                    closest = np.argsort(to, axis=1, kind="stable")
                    before = np.cumsum(size[closest], axis=1) - size[closest]
                    can = np.zeros(to.shape, bool)
                    np.put_along_axis(can, closest, before <= k, axis=1)
                else:
                    within = np.where(np.isnan(least), 4.0, np.arccos(np.clip(least, -1, 1))) + 1e-7
                    can = np.maximum(to - far, near - to) <= within[:, None]
                q, c = np.nonzero(can & (size > 0))
                again = pieces[c]
                q, c, piece = np.repeat(q, again), np.repeat(c, again), np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                blk = start[c] + piece
                by = np.lexsort((c, blk, q))
                q, c, blk = q[by], c[by], blk[by]
                if len(q):
                    new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (blk[1:] != blk[:-1])])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(q)].astype(np.int32)), pa.array(c.astype(np.int32)))
                    rows = pa.array(q[new])
                    yield pa.RecordBatch.from_arrays([part.column("query").take(rows), part.column("v").take(rows), part.column("least").take(rows), pa.array(blk[new].astype(np.int32)), lists], ["query", "v", "least", "blk", "clusters"])

    def tile(values: bool):
        """The k best of a block for each of its queries: similarities only, or ids with them."""

        def compare(rows: pa.Table, asks: pa.Table) -> pa.Table:
            ids, names = rows.column("id").combine_chunks(), asks.column("query").combine_chunks()
            code, own = _codes(ids, names)
            order, v, u = _order(ids), _units(rows.column("v")), _units(asks.column("v"))
            cluster = rows.column("cluster").to_numpy()
            floor = np.nan_to_num(asks.column("least").to_numpy(), nan=-2.0)
            wanted, each = _lists(asks.column("clusters"))
            asker = np.repeat(np.arange(len(each)), each)
            q, d, p, done, held = [], [], [], 0, 0
            for c in np.unique(cluster) if len(names) else []:
                mine, those = np.flatnonzero(cluster == c), asker[wanted == c]
                step = max(1, CELLS // len(mine))
                for at in range(0, len(those), step):
                    some = those[at : at + step]
                    alike = u[some] @ v[mine].T
                    done += alike.size
                    if values:
                        alike[own[some][:, None] == code[mine][None]] = -2.0
                        kept = np.partition(alike, -k, axis=1)[:, -k:] if len(mine) > k else alike
                        i, j = np.nonzero(kept > -2.0)
                        q, d, p = [*q, some[i]], [*d, kept[i, j]], [*p, np.zeros(len(i), np.int64)]
                        continue
                    i, j = np.nonzero(alike >= floor[some][:, None])
                    other = own[some[i]] != code[mine[j]]
                    i, j = i[other], j[other]
                    q, d, p, held = [*q, some[i]], [*d, np.rint(alike[i, j] * 1e6)], [*p, mine[j]], held + len(i)
                    if held > CELLS:
                        q, d, p = ([np.concatenate(x)] for x in (q, d, p))
                        top = _best(q[0], d[0], p[0], order, k)
                        q, d, p, held = [q[0][top]], [d[0][top]], [p[0][top]], 0
            q, d, p = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((q, np.int64), (d, np.float64), (p, np.int64)))
            top = _best(q, d, p if not values else np.zeros(len(p), np.int64), order if len(order) else np.zeros(1, np.int64), k)
            # The last row has the number of compared pairs only.
            q, p = (pa.array(np.r_[x[top], 0], mask=np.r_[np.zeros(len(top), bool), True]) for x in (q, p))
            d = pa.array(np.r_[d[top] if values else d[top] / 1e6, 0.0], mask=np.r_[np.zeros(len(top), bool), True])
            return pa.table({"query": names.take(q), "id": ids.take(p), "similarity": d, "compared": pa.array([0] * len(top) + [done], pa.int64())})

        return compare

    def compare(asks: DataFrame, values: bool) -> DataFrame:
        tasks = 2 * max(1, int(blocks)) * parts
        sent = asks.mapInArrow(reach, f"query {kinds['query']}, v {kinds['v']}, least double, blk int, clusters array<int>").withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
        sides = [df.repartition(tasks, "blk", "part").groupBy("blk", "part") for df in (dealt, sent)]  # a number of tasks that Spark leaves as it is
        found = sides[0].cogroup(sides[1]).applyInArrow(tile(values), f"query {kinds['query']}, id {dict(dealt.dtypes)['id']}, similarity double, compared long")
        return cut(found)

    good = asked.where("good").select("query", "v")
    first = compare(good.select("*", F.lit(None).cast("double").alias("least"), F.lit(True).alias("first")), True)
    kth = first.where("similarity is not null").groupBy("query").agg(F.get(F.sort_array(F.collect_list("similarity"), asc=False), F.lit(k - 1)).alias("b"))  # k a block
    second = compare(good.join(kth, good["query"].eqNullSafe(kth["query"]), "left").select(good["query"], "v", (F.col("b") - SLACK).alias("least")), False)
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # What has no direction has similarity 0: only its smallest ids can matter.
    flat = corpus.where(~usable(F.col(vector))).select(F.col(corpus_id).alias("id")).orderBy("id").limit(k + 1)  # k + 1 rows
    lone = corpus.select(F.col(corpus_id).alias("id")).orderBy("id").limit(k + 1)  # k + 1 rows
    zero = lambda q, ids: q.select("query").join(F.broadcast(ids), ~F.col("id").eqNullSafe(F.col("query"))).select("query", "id", F.lit(0.0).alias("similarity"))
    scored = second.where("similarity is not null").select("query", "id", "similarity")
    found = reduce(DataFrame.unionByName, [scored, zero(good, flat), zero(asked.where("not good"), lone)])
    compared = first.select("compared").unionByName(second.select("compared")).agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared")).withColumn("pairs", F.lit(n).cast("long") * F.lit(asking))
    return top(found), compared
