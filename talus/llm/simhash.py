"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most `max_bits` <= 4 bits
share at least 8 - max_bits >= 4 bytes at their positions. Posting lists of single bytes
would be 1/256 of the corpus long, so the index is refined: its keys are groups of byte
positions chosen so that any four positions contain one whole group. Within a posting list
the shared positional bytes of each pair are tallied, pairs below the guaranteed minimum
are left out, and the rest are verified by their exact Hamming distance. Only the links of
a spanning forest leave a list, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import LOWER, SharedTable, count_rows, spread, text_chunks, words_of
from talus.llm.components import connected_components

BYTES = 8
#: Shingles whose bits are counted in one numpy step.
COUNTED_SHINGLES = 1 << 15
#: Posting lists with more distinct fingerprints than this are resolved by bit variants.
HOT_LIST = 16_384
#: Distinct fingerprints from which keys of four bytes are used: lists of three grow long.
FOUR_BYTE_KEYS_FROM = 50_000_000
#: A fingerprint with more than one in HOT_GROUPS of all rows is hot; fewer than HOT_GROUPS are.
HOT_GROUPS = 2000


# ------------------------------------------------------------------ fingerprints
def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp): the SimHash of each whole text as a signed 64-bit number.

    Texts are lower-cased in A-Z; shingles are `shingle` words joined by one space, repeats
    included; fewer words make one shingle of the whole sequence; none (null or empty text)
    gives 0. A bit is 1 if it is set in more than half of the shingles' XXH64 (seed 42).
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in text_chunks(batches, text):
            ids = c.batch.column(c.batch.schema.get_field_index(id_col))
            yield pa.RecordBatch.from_arrays([ids, pa.array(_fingerprints(c.data, c.offsets, shingle).view(np.int64))], ["id", "fp"])

    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, fp bigint")


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    w = words_of(data, offsets)
    n_docs, counts = len(offsets) - 1, w.counts()
    out = np.zeros(n_docs, np.uint64)
    if not len(w.starts):
        return out
    # The words in lower case with one space before each but a document's first one.
    first_word = np.zeros(len(w.starts), bool)
    first_word[w.first[:-1][counts > 0]] = True
    keep = np.zeros(len(data) + 1, np.int8)
    keep[w.starts] += 1
    keep[w.ends] -= 1
    keep = np.cumsum(keep[:-1]).astype(bool)
    joins = w.starts[~first_word] - 1
    keep[joins] = True
    low = LOWER[data]
    low[joins] = 0x20
    place = np.concatenate(([0], np.cumsum(keep)))
    text = low[keep].tobytes()
    starts, ends = place[w.starts], place[w.ends]
    # Shingle i of a document runs from its word i to word i + shingle - 1.
    per_doc = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    at = np.concatenate(([0], np.cumsum(per_doc)))
    doc = spread(at)
    lead = np.arange(at[-1]) - at[doc] + w.first[doc]
    last = np.minimum(lead + shingle, w.first[doc + 1]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], 42) for a, b in zip(starts[lead].tolist(), ends[last].tolist())), np.uint64, len(lead))
    full = np.flatnonzero(per_doc)
    # Bits are counted for some documents at a time: 64 bytes for each shingle.
    step = COUNTED_SHINGLES
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(at[full + 1], at[full[a]] + step, side="right")))
        lo, hi = at[full[a]], at[full[b - 1] + 1]
        sums = np.zeros((b - a, 64), np.int64)
        for s in range(lo, hi, step):  # one very long document is summed in parts
            e = min(s + step, hi)
            bits = np.unpackbits(hashes[s:e].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if b > a + 1:
                sums += np.add.reduceat(bits, at[full[a:b]] - lo, axis=0, dtype=np.int64)
            else:
                sums[0] += bits.sum(axis=0, dtype=np.int64)
        ones = 2 * sums > per_doc[full[a:b], None]
        out[full[a:b]] = np.packbits(ones, axis=1, bitorder="little").reshape(-1).view(np.uint64)
        a = b
    return out


# ------------------------------------------------------------------ index
@lru_cache
def key_positions(size: int) -> list[tuple[int, ...]]:
    """Groups of `size` (3 or 4) byte positions; any four positions contain one whole group.

    Four: all seventy groups. Three: positions in three rings; groups inside one ring, or
    two of a ring with one of the next ring (Turan's covering by twenty triples).
    """
    if size == 4:
        return list(combinations(range(BYTES), 4))
    rings = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [r for r in rings if len(r) == 3]
    for i, ring in enumerate(rings):
        out += [(*two, one) for two in combinations(ring, 2) for one in rings[(i + 1) % 3]]
    return out


def _keyed(fps: DataFrame, size: int) -> DataFrame:
    """(list_id, key, fp, node): one posting for each group of positions."""
    masks = [sum(0xFF << 8 * p for p in group) for group in key_positions(size)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    entries = F.array(*[F.struct(F.lit(i).cast("int").alias("list_id"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return fps.select(F.explode(entries).alias("e"), "fp", "node").select("e.list_id", "e.key", "fp", "node")


def _count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _near(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification: enough equal positional bytes, then few bits."""
    diff = x ^ y
    out = np.zeros(len(diff), bool)
    shared = (diff.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    at = np.flatnonzero(shared >= BYTES - max_bits)
    out[at] = _count_bits(diff[at]) <= max_bits
    return out


def _short_lists(fp: np.ndarray, node: np.ndarray, run: np.ndarray, size: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """All pairs of short posting lists, by a step of one, two ... places."""
    found, place = [], np.arange(len(fp))
    for step in range(1, int(size.max(initial=1))):
        i = place[: len(fp) - step]
        i = i[run[i] == run[i + step]]
        if not len(i):
            break
        i = i[_near(fp[i], fp[i + step], max_bits)]
        found.append(np.stack((node[i], node[i + step])))
    return found


def _long_list(fp: np.ndarray, node: np.ndarray, max_bits: int) -> Iterator[np.ndarray]:
    """A spanning forest of one posting list. What a reached fingerprint has reached isn't
    compared again, so that a dense group of near copies costs a few passes, not all pairs."""
    left = np.arange(len(fp))
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            at, wave = wave[0], wave[1:]
            near = _near(np.full(len(left), fp[at]), fp[left], max_bits)
            reached = left[near]
            if len(reached):
                yield np.stack((np.full(len(reached), node[at]), node[reached]))
                left, wave = left[~near], np.concatenate((wave, reached))


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the list that is still being read

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            lists, key, fp, node = rows[0], rows[1], rows[2].view(np.uint64), rows[3]
            new = np.concatenate(([True], (lists[1:] != lists[:-1]) | (key[1:] != key[:-1])))
            run_of = np.cumsum(new) - 1
            size = np.bincount(run_of)
            at = np.flatnonzero(new)
            short = (size[run_of] > 1) & (size[run_of] <= 48)
            found = _short_lists(fp[short], node[short], run_of[short], size[size <= 48], max_bits)
            for r in np.flatnonzero(size > 48):
                part = slice(at[r], at[r] + size[r])
                found += _long_list(fp[part], node[part], max_bits)
            if found:
                pairs = np.concatenate(found, axis=1)
                pairs = np.unique(np.sort(pairs, axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array(pairs[0])], ["u", "v"])

        for batch in batches:
            rows = np.stack([np.ascontiguousarray(c.to_numpy(zero_copy_only=False)).astype(np.int64) for c in batch.columns])
            if not rows.shape[1]:
                continue
            if held:
                rows = np.concatenate((held.pop(), rows), axis=1)
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            begin = int(np.argmax(last))
            if begin:
                yield from solve(rows[:, :begin])
            held.append(rows[:, begin:])
        for rows in held:
            yield from solve(rows)

    return run


def _variant_links(postings: DataFrame, max_bits: int) -> DataFrame:
    """Links of hot posting lists, in work that grows with their length: fingerprints within
    2 * k bits share a variant at k flipped bits of each (2,081 variants for k = 2), and all
    that share one are within 2 * k bits of each other. The smallest member of a variant is
    a partial aggregate, and the others link to it."""
    bit = lambda i: F.expr(f"if({i} < 64, shiftleft(1L, {i}), 0L)")  # noqa: E731  64: no flip
    first = F.sequence(F.lit(0 if max_bits == 4 else 64), F.lit(64))
    second = F.sequence(F.col("i"), F.lit(64)) if max_bits == 4 else F.sequence(F.lit(0 if max_bits else 64), F.lit(64))
    flips = postings.select("fp", "node").distinct().withColumn("i", F.explode(first)).withColumn("j", F.explode(second))
    varied = flips.where("i < j or j = 64").select(F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("variant"), "node")
    low = varied.groupBy("variant").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w").select("variant", "v")
    return varied.join(low, "variant").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def near_links(fps: DataFrame, max_bits: int = 4, hot_list: int = HOT_LIST) -> DataFrame:
    """Edges (u, v) over `fps` (fp distinct, node) that connect just what Hamming distance
    <= max_bits connects. Two fingerprints that share a variant of max_bits / 2 flipped bits
    are within max_bits, so both ways give true links only.

    Two choices follow the size and change the cost, never the links: keys of three byte
    positions below FOUR_BYTE_KEYS_FROM fingerprints and of four from there on, and lists of
    more than `hot_list` fingerprints by shared variants. Tests cover both sides of each."""
    if not 0 <= max_bits <= 4 or max_bits % 2:
        raise ValueError("max_bits must be 0, 2 or 4")
    size = 3 if count_rows(fps) < FOUR_BYTE_KEYS_FROM else 4
    keyed = _keyed(fps, size)
    hot = SharedTable(keyed.groupBy("list_id", "key").count().where(F.col("count") > hot_list).select("list_id", "key"), "hot-lists")
    extra = None
    if count_rows(hot.df):
        extra = _variant_links(keyed.join(hot.df, ["list_id", "key"], "left_semi"), max_bits)
        keyed = keyed.join(hot.df, ["list_id", "key"], "left_anti")
    sorted_lists = keyed.repartition("list_id", "key").sortWithinPartitions("list_id", "key", "fp").select("list_id", "key", "fp", "node")
    links = sorted_lists.mapInArrow(_links(max_bits), "u bigint, v bigint")
    return links if extra is None else links.unionByName(extra)


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) for every document; component_id is the smallest id reachable.

    Equal fingerprints are one node (a group of copies is one row from then on). Null or
    empty texts have fingerprint 0 and link like any other; repeated ids keep their rows; a
    null id stays with its own text and never names a component that has another id; an
    empty table gives no rows. Extra columns are not read.
    """
    marked = SharedTable(fingerprints(docs, shingle, text, id_col), "fingerprints").df
    fps = SharedTable(marked.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes").df
    named = fps.where("node is not null").select("fp", "node")
    parts = connected_components(near_links(named, max_bits)).select("node", "component")
    place = fps.join(parts, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    # Hot fingerprints are broadcast, so that no task gets all rows of one.
    is_hot = F.col("n") * HOT_GROUPS > (fps.agg(F.sum("n")).first()[0] or 0)
    of_hot = marked.join(F.broadcast(place.where(is_hot).drop("n")), "fp")
    cold = marked.join(F.broadcast(fps.where(is_hot).select("fp")), "fp", "left_anti")
    of_cold = cold.join(place.where(~is_hot).drop("n"), "fp")
    return of_hot.unionByName(of_cold).select("id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
