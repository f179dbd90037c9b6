"""Phrase collocation mining: Misra-Gries summaries per hash partition find every n-gram
that can be frequent, a second pass counts just those, and DataFrame joins score them.

First pass: tasks count the n-grams of some text exactly (a summary whose capacity was never
reached, with error zero) and send the counters packed by hash partition. Each partition
merges its summaries with a capacity above its mass divided by the threshold, so that the
counters taken off a phrase, at most mass / (capacity + 1), stay below the threshold and
every frequent n-gram survives. N-grams travel as 40-bit hashes here; equal hashes of
different n-grams only let more of them survive.

Second pass: n-grams that meet a survivor's hash are counted by their texts, packed by the
same hash partitions, which add them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import LOWER, SharedTable, Words, count_rows, joined_words, mix64, spread, string_array, text_chunks, word_hashes, words_of
from talus.operators.ranking import global_rank

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: White space inside a piece, and the characters that end one.
BETWEEN, BREAKS = " \t", ".,;:!?\n\x0b\x0c\r"
#: N-grams that a task counts at a time.
COUNTED = 2_000_000
#: A hash partition gets the n-grams of about so many bytes of text; there are MIN_PARTS at least.
PART_BYTES, MIN_PARTS = 128 << 20, 64
#: Bits of an n-gram's hash inside its partition.
KEY_BITS = 40
#: Up to so many survivors go to the tasks as a filter of 2 ** (FILTER_BITS + 1) bits (16 MB,
#: whatever the input); more of them meet the n-grams in their hash partition.
FILTER_KEYS, FILTER_BITS = 4_000_000, 26

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in BREAKS]] = True
_SPACE = _BREAK.copy()
_SPACE[[ord(c) for c in BETWEEN]] = True


# ------------------------------------------------------------------ n-grams of a chunk
class _Grams:
    """The words of one chunk and the keys of their n-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.data, self.langs = LOWER[data], langs
        self.w = words_of(self.data, offsets, _SPACE)
        self.doc = spread(self.w.first)
        self.h = word_hashes(self.data, self.w)
        # Neither part ever falls, so that sums are equal only within one piece of one document.
        self.piece = np.cumsum(_BREAK[self.data])[self.w.starts] + self.doc if len(self.h) else self.doc
        codes = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in set(langs)}
        self.lang_hash = np.array([codes[x] for x in langs], np.uint64)

    def keys(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first words, keys) of all n-grams of one to `most` words; a key is a hash of
        the language and the n-gram."""
        n, sums = len(self.h), np.zeros(len(self.h), np.uint64)
        for size in range(1, most + 1):
            if n < size:
                return
            sums = sums[: n - size + 1] + self.h[size - 1 :] * np.uint64(pow(0xD6E8FEB86659FD93, size, 1 << 64))
            at = np.flatnonzero(self.piece[: n - size + 1] == self.piece[size - 1 :])
            yield size, at, mix64(mix64(sums[at]) + self.lang_hash[self.doc[at]])


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


_LOW = np.uint64((1 << KEY_BITS) - 1)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[_Grams]:
    for c in text_chunks(batches, "text"):
        yield _Grams(c.data, c.offsets, c.batch.column(c.batch.schema.get_field_index("lang")).to_pylist())


# ------------------------------------------------------------------ summaries
def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A summary as bytes: differences of its sorted keys and its counters, byte by byte of
    all of them, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (KEY_BITS + 7) // 8]
    numbers = counts.astype("<u8").view(np.uint8).reshape(-1, 8)
    wide = max(1, (int(counts.max()).bit_length() + 7) // 8)
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + steps.T.tobytes() + numbers[:, :wide].T.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    width = (KEY_BITS + 7) // 8
    planes = raw[8:].reshape(-1, n)
    wide = lambda rows: np.ascontiguousarray(np.concatenate((rows, np.zeros((8 - len(rows), n), np.uint8))).T).view("<u8").ravel()
    return np.cumsum(wide(planes[:width]), dtype=np.uint64), wide(planes[width:]).astype(np.int64)


class MisraGries:
    """A mergeable summary: at most `capacity` counters, each at most `error` below the true
    count; keys without a counter occur `error` times at most."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counters; keys may repeat. If too many are left, the greatest counter beyond the
        capacity is taken off all of them."""
        keys, counts = np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        if len(keys) > self.capacity:
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            left = counts > cut
            keys, counts = keys[left], counts[left] - cut
            self.error += cut
        self.keys, self.counts = keys, counts


def _summarise(parts: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.concatenate(held)
            placed = np.sort((_part_of(keys, parts) << np.uint64(KEY_BITS)) | (keys & _LOW))
            at = np.flatnonzero(np.concatenate(([True], placed[1:] != placed[:-1])))
            counts, placed = np.diff(at, append=len(placed)), placed[at]
            part = (placed >> np.uint64(KEY_BITS)).astype(np.int64)
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
            rows = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                p, mass = int(part[a]), int(counts[a:b].sum())
                rows += [(p, mass, None), (p, 0, pack(placed[a:b] & _LOW, counts[a:b]))]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["part", "mass", "summary"])

        held, n = [], 0
        for grams in _tokens(batches):
            for _, _, keys in grams.keys(most):
                held.append(keys)
                n += len(keys)
            if n >= COUNTED:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return run


def _merge_summaries(min_count: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = -1, 0, None
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def merge() -> None:
            nonlocal n
            if waiting:
                summary.merge(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
            waiting.clear()
            n = 0

        def survivors() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                merge()
                left = summary.keys[summary.counts + summary.error >= min_count]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), part, np.int32)), pa.array(left.astype(np.int64))], ["part", "key"])

        for batch in batches:
            for p, m, blob in zip(*[c.to_pylist() for c in batch.columns]):
                if p != part:
                    yield from survivors()
                    part, mass, summary = p, 0, None
                if blob is None:  # the masses of a partition come before its summaries
                    mass += m
                    continue
                if summary is None:
                    summary = MisraGries(mass // min_count + 1)
                waiting.append(unpack(blob))
                n += len(waiting[-1][0])
                if n >= max(summary.capacity, COUNTED // 4):
                    merge()
        yield from survivors()

    return run


def surviving_keys(texts: DataFrame, parts: int, min_count: int = MIN_COUNT, most: int = MAX_WORDS) -> DataFrame:
    """(part, key): hashes among which are those of all n-grams with `min_count` occurrences
    or more in one language. `texts` has lang and text, neither null."""
    sent = texts.select("lang", "text").mapInArrow(_summarise(parts, most), "part int, mass bigint, summary binary")
    by_part = sent.repartition(parts, "part").sortWithinPartitions("part", F.col("summary").isNotNull())
    return by_part.mapInArrow(_merge_summaries(min_count), "part int, key bigint")


# ------------------------------------------------------------------ second pass
def filter_bits(survivors: DataFrame) -> bytes:
    """Two bit maps of 2 ** FILTER_BITS bits, of the low and the high bits of the keys."""
    low, high = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1), F.shiftright("key", KEY_BITS - FILTER_BITS) + (1 << FILTER_BITS)
    places = survivors.select(F.explode(F.array(low, high)).alias("place"))
    maps = places.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))
    out = np.zeros((2 << FILTER_BITS) // 8, np.uint8)
    for r in maps.collect():  # 4,096 maps of 4 KB at most
        begin = (r.bucket - 1) * 4096
        out[begin : begin + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    low = (keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    high = ((keys & _LOW) >> np.uint64(KEY_BITS - FILTER_BITS)).astype(np.int64) + (1 << FILTER_BITS)
    ok = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 != 0
    at = np.flatnonzero(ok)
    ok[at] = (bits[high[at] >> 3] >> (high[at] & 7).astype(np.uint8)) & 1 != 0
    return ok


#: What a task counted of one hash partition, as it travels.
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])


def _count(parts: int, most: int, shipped) -> Callable:
    """Counts by text of the n-grams that pass the filter (all, without one), packed by hash
    partition, and, with a null phrase, of the words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shipped is None else np.frombuffer(shipped.value, np.uint8)
        packer = zstandard.ZstdCompressor(level=1)

        def send(held: list[_Grams]) -> pa.RecordBatch:
            at_byte = np.cumsum([0] + [len(g.data) for g in held])
            at_word = np.cumsum([0] + [len(g.h) for g in held])
            data = np.concatenate([g.data for g in held])
            w = Words(np.concatenate([g.w.starts + b for g, b in zip(held, at_byte)]), np.concatenate([g.w.ends + b for g, b in zip(held, at_byte)]), at_word)
            names: dict[str, int] = {}
            lang_of = np.concatenate([np.array([names.setdefault(x, len(names)) for x in g.langs], np.int64)[g.doc] for g in held])
            firsts, sizes, keys = [], [], []
            for g, b in zip(held, at_word):
                for size, at, k in g.keys(most):
                    if bits is not None:
                        ok = _passes(k, bits)
                        at, k = at[ok], k[ok]
                    firsts.append(at + b)
                    keys.append(k)
                    sizes.append(np.full(len(k), size, np.int8))
            first, size, key = np.concatenate(firsts), np.concatenate(sizes), np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]]))) if len(key) else np.zeros(0, np.int64)
            counts, one = np.diff(new, append=len(key)), order[new]
            first, size, key = first[one], size[one].astype(np.int64), key[one]
            bounds = np.concatenate(([0], np.cumsum(size)))
            text, offsets = joined_words(data, w, np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1]), bounds)
            word = pa.array(list(names), pa.string())
            lang = word.take(pa.array(lang_of[first]))
            grams = pa.RecordBatch.from_arrays([lang, string_array(text, offsets), pa.array(size), pa.array(counts.astype(np.int64)), pa.array((key & _LOW).astype(np.int64))], schema=_COUNTED)
            part = _part_of(key, parts).astype(np.int64)  # never falls: the keys are in order
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
            rows = [(int(part[a]), packer.compress(grams.slice(a, b - a).serialize().to_pybytes())) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            known = np.bincount(lang_of, minlength=len(names)).astype(np.int64)
            nulls, zero = pa.nulls(len(names), pa.string()), pa.array(np.zeros(len(names), np.int64))
            totals = pa.RecordBatch.from_arrays([word, nulls, zero, pa.array(known), pa.nulls(len(names), pa.int64())], schema=_COUNTED)
            rows.append((0, packer.compress(totals.serialize().to_pybytes())))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.nulls(len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "key", "counted"])

        held, n = [], 0
        for grams in _tokens(batches):
            if not len(grams.h):
                continue
            held.append(grams)
            n += len(grams.h) * most
            if n >= COUNTED:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    return run


def _add_up(min_count: int, only_survivors: bool) -> Callable:
    """Sums of the counts of each partition by language and text; with `only_survivors` the
    partition's surviving keys come before its counts, and other keys are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        part, keys, waiting, n = -1, [], [], 0

        def total() -> pa.Table:
            sums = pa.Table.from_batches(waiting, _COUNTED).group_by(["lang", "phrase"]).aggregate([("words", "max"), ("n", "sum"), ("key", "max")])
            return sums.select(["lang", "phrase", "words_max", "n_sum", "key_max"]).rename_columns(_COUNTED.names)

        def done() -> Iterator[pa.RecordBatch]:
            if waiting:
                sums = total()
                often = pc.or_(pc.greater_equal(sums["n"], min_count), pc.is_null(sums["phrase"]))
                yield from sums.filter(often).drop_columns(["key"]).to_batches()

        for batch in batches:
            for p, key, blob in zip(*[c.to_pylist() for c in batch.columns]):
                if p != part:
                    yield from done()
                    part, keys, waiting, n = p, [], [], 0
                if blob is None:
                    keys.append(key)
                    continue
                counted = pa.ipc.read_record_batch(pa.py_buffer(unpacker.decompress(blob)), _COUNTED)
                if only_survivors:
                    if not isinstance(keys, pa.Array):
                        keys = pa.array(keys, pa.int64())
                    counted = counted.filter(pc.or_(pc.is_null(counted["phrase"]), pc.is_in(counted["key"], keys)))
                waiting.append(counted)
                n += counted.num_rows
                if n >= COUNTED:  # sums take less room than what they add up
                    waiting = total().to_batches()
                    n = sum(b.num_rows for b in waiting) // 2
        yield from done()

    return run


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, most: int = MAX_WORDS, text: str = "text", lang: str = "lang", filter_keys: int = FILTER_KEYS) -> DataFrame:
    """(lang, phrase, words, n): all phrases of one to `most` words with `min_count` occurrences
    or more in their language, and a row with a null phrase and words 0 for each language
    that has a word, with the number of its words."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(MIN_PARTS, -(-size // PART_BYTES))
    kept = SharedTable(surviving_keys(texts, parts, min_count, most), "surviving-keys")
    few = count_rows(kept.df) <= filter_keys
    shipped = docs.sparkSession.sparkContext.broadcast(filter_bits(kept.df)) if few else None
    counted = texts.mapInArrow(_count(parts, most, shipped), "part int, key bigint, counted binary")
    if not few:
        counted = counted.unionByName(kept.df.select("part", "key", F.lit(None).cast("binary").alias("counted")))
    by_part = counted.repartition(parts, "part").sortWithinPartitions("part", F.col("counted").isNotNull())
    # All counts of a phrase are in one partition, the totals of the languages in the first.
    out = SharedTable(by_part.mapInArrow(_add_up(min_count, not few), "lang string, phrase string, words bigint, n bigint"), "frequent-phrases")
    kept.drop()
    return out.df


# ------------------------------------------------------------------ scores
def _words_from(phrase: Column, start: Column, n: Column) -> Column:
    """`n` words of the phrase from word `start` (from 1) on."""
    return F.array_join(F.slice(F.split(phrase, " ", -1), start, n), " ")


def score_phrases(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases of two words or more: the cut
    with the lowest floor(1000 * a * n / (l * r)), of equal ones that behind the fewest words.
    Products are decimals of 38 digits, quotients are exact."""
    phrases = frequent.where("phrase is not null")
    totals = frequent.where("phrase is null").select("lang", F.col("n").alias("total"))
    cuts = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": _words_from(F.col("phrase"), F.lit(1), F.col("k")), "tail": _words_from(F.col("phrase"), F.col("k") + 1, F.col("words").cast("int") - F.col("k"))})
    counts = lambda part, n: phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    joined = cuts.join(counts("head", "l"), ["lang", "head"]).join(counts("tail", "r"), ["lang", "tail"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    best = joined.join(totals, "lang").withColumns({"up": F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("total"), "down": exact("l") * exact("r")})
    ranked = F.min(F.struct(F.expr("cast(up div down as bigint)").alias("score"), "k", "l", "r", F.col("total").alias("n")))
    scored = best.groupBy("lang", "phrase", "words", "a").agg(ranked.alias("cut"))
    return scored.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def drop_contained(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Without the phrases that lie in a longer one (dropped itself or not) that occurs at
    least `percent` hundredths as often."""
    long = scored.where("words > 2").select("lang", "phrase", F.col("words").cast("int").alias("m"), "a")
    sizes = long.select("*", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size"))
    inner = sizes.select("lang", "a", "phrase", "size", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("start"))
    held = inner.groupBy("lang", _words_from(F.col("phrase"), F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    left = scored.join(held, ["lang", "phrase"], "left")
    return left.where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * percent)).drop("around")


def mine_collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, most: int = MAX_WORDS, top: int = TOP, percent: int = 100, text: str = "text", lang: str = "lang", filter_keys: int = FILTER_KEYS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score
    down, occurrences down, phrase (in UTF-8 order).

    Texts are lower-cased in A-Z and cut into pieces at BREAKS; a phrase lies within one
    piece. A null language is `und`, and one with a document that says `und`; a null text is
    empty. Repeated rows count as often as they occur, ids aren't read, an empty table and
    tables without a frequent phrase give no rows; extra columns are not read.
    """
    frequent = frequent_phrases(docs, min_count, most, text, lang, filter_keys)
    kept = drop_contained(SharedTable(score_phrases(frequent), "scored-phrases").df, percent)
    ranked = global_rank(kept, [F.desc("score"), F.desc("a"), F.asc("phrase")], 64, "rank", "lang").where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
