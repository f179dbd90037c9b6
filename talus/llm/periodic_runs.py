"""Periodic runs of words: Lyndon arrays of both orders by Baier's grouping, and Lyndon roots
extended into runs through longest common extensions.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends. Every run holds a Lyndon root, for one of the two orders of the words, that is the
longest Lyndon word at its place. Phase one of Baier's suffix sorter groups the suffixes by
just these words: a group's context is the longest Lyndon word at each of its suffixes, so
the second phase (the suffix array) isn't needed.

Only stretches that can hold a run go through the grouping: a run of at least `min_words`
words and `min_periods` periods repeats each of its windows of R words, R = min_words -
min_words // min_periods, and so lies in one stretch that repeated windows cover.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import _BASE, _BASE_INV, TextChunk, Words, _powers, joined_words, mix64, spread, string_array, text_chunks, window_hashes, within_documents, word_hashes, words_of

MIN_WORDS, MIN_PERIODS = 24, 3
#: (id, words) -> (first changed word, period), or None to leave the text as it is.
Alter = Callable[[object, int], "tuple[int, int] | None"]


# ------------------------------------------------------------------ Lyndon arrays
def lyndon_lengths(x: list[int]) -> list[int]:
    """For each place the length of the longest Lyndon word that starts there, by grouping.

    The groups start as the places of one symbol and are taken from the greatest down. Each
    place i of the group taken points to the nearest place on its left whose group is lower;
    a place that k of them point to is followed by k copies of the group's context, and moves
    with all others of its group and k into a new group right above its own. What is left of
    every place in higher or equal groups is skipped by a union-find over neighbours.
    """
    n = len(x)
    context, members, lower, upper = [], [], [], []
    group, of_symbol = [0] * n, {}
    for s in sorted(set(x)):
        of_symbol[s] = g = len(context)
        context.append(1)
        members.append([])
        lower.append(g - 1)
        upper.append(g + 1)
    for i, s in enumerate(x):
        group[i] = of_symbol[s]
        members[group[i]].append(i)
    if not n:
        return []
    upper[-1] = -1
    skip = list(range(n + 1))  # skip[i + 1]: where to look for a lower group from place i on; 0 is none
    out = [1] * n
    g = len(context) - 1
    while g >= 0:
        size = context[g]
        taken = [i for i in members[g] if group[i] == g]
        for i in taken:
            skip[i + 1] = i
            out[i] = size
        pointed: dict[int, int] = {}
        for i in taken:
            top = i
            while skip[top] != top:
                top = skip[top]
            while skip[i] != top and i != top:
                skip[i], i = top, skip[i]
            if top:
                pointed[top - 1] = pointed.get(top - 1, 0) + 1
        if len(pointed) == 1:
            split = [(k, group[j], [j]) for j, k in pointed.items()]
        else:
            parts: dict[tuple[int, int], list[int]] = {}
            for j, k in pointed.items():
                parts.setdefault((k, group[j]), []).append(j)
            split = sorted(((k, h, js) for (k, h), js in parts.items()), key=lambda part: -part[0])
        for k, h, js in split:  # from the most copies down, each right above the old group
            new = len(context)
            context.append(context[h] + k * size)
            members.append(js)
            for j in js:
                group[j] = new
            above = upper[h]
            lower.append(h)
            upper.append(above)
            upper[h] = new
            lower[above] = new
        g = lower[g]
    return out


# ------------------------------------------------------------------ runs
class _Extensions:
    """Longest common extensions by prefix hashes and halving, for many pairs at once."""

    def __init__(self, ranks: np.ndarray):
        self.n = len(ranks)
        mixed = mix64(ranks.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mixed * _powers(_BASE, self.n)[: self.n], out=self.sums[1:])
        self.inverse = _powers(_BASE_INV, self.n + 1)

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        of = lambda s: (self.sums[s + size] - self.sums[s]) * self.inverse[s]
        return of(a) == of(b)

    def _longest(self, most: np.ndarray, fits: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = fits(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._longest(self.n - b, lambda k: self.equal(a, b, k))

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols that end right before a and b, a < b."""
        return self._longest(a.copy(), lambda k: self.equal(a - k, b - k, k))


def _exact(ranks: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """Start and end of the stretch around place i with period p, symbol by symbol."""
    same = ranks[:-p] == ranks[p:]
    before, behind = np.flatnonzero(~same[:i]), np.flatnonzero(~same[i:])
    return int(before[-1]) + 1 if len(before) else 0, (i + int(behind[0]) if len(behind) else len(same)) + p


def find_runs(symbols: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the sequence with at least max(min_words,
    min_periods * period) symbols, by start and period."""
    _, ranks = np.unique(symbols, return_inverse=True)
    n = len(ranks)
    if n < min_words:
        return []
    ext, place, found = _Extensions(ranks), np.arange(n), []
    for order in (ranks, ranks.max() - ranks):
        p = np.array(lyndon_lengths(order.tolist()), np.int64)
        # The first root of such a run is followed by so many symbols that repeat it.
        need = np.maximum(np.maximum(min_words, min_periods * p) - 2 * p + 1, 1)
        i = place[place + p + need <= n]
        i = i[ext.equal(i, i + p[i], need[i])]
        found.append(np.stack((i, p[i])))
    i, p = np.unique(np.concatenate(found, axis=1), axis=1)
    start = i - ext.back(i, i + p)
    end = i + p + ext.ahead(i, i + p)
    ok = end - start >= np.maximum(min_words, min_periods * p)
    runs = set()
    for s, e, q, at in {(s, e, q): (s, e, q, at) for s, e, q, at in zip(start[ok].tolist(), end[ok].tolist(), p[ok].tolist(), i[ok].tolist())}.values():
        if not np.array_equal(ranks[s : e - q], ranks[s + q : e]):  # two different stretches with one hash
            s, e = _exact(ranks, at, q)
            if e - s < max(min_words, min_periods * q):
                continue
        runs.add((s, e - s, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _stretches(x: np.ndarray, w: Words, window: int) -> np.ndarray:
    """(first word, word behind the last, document) of the stretches that repeated windows cover."""
    doc = spread(w.first)
    at = np.flatnonzero(within_documents(w, window)[: max(0, len(x) - window + 1)])
    keys = window_hashes(x, window)[at] + mix64(doc[at].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    edge = np.zeros(len(x) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    covered = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    turn = covered[1:] != covered[:-1]
    first = np.flatnonzero(turn & covered[1:])
    behind = np.flatnonzero(turn & covered[:-1])
    # Neighbouring documents may both be covered up to their border.
    borders = np.unique(w.first[1:-1])
    cut = borders[covered[borders] & covered[borders + 1]] if len(borders) else borders
    first, behind = np.sort(np.concatenate((first, cut))), np.sort(np.concatenate((behind, cut)))
    return np.stack((first, behind, doc[first]), axis=1) if len(first) else np.zeros((0, 3), np.int64)


def _collapse(c: TextChunk, ids: list, alter: Alter | None, min_words: int, min_periods: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], bytes, np.ndarray]:
    w = words_of(c.data, c.offsets)
    counts, source = w.counts(), np.arange(len(w.starts))
    if alter is not None:
        for d in np.flatnonzero(counts):
            change = alter(ids[d], int(counts[d]))
            if change is not None:
                a, p = change
                at = int(w.first[d])
                source[at + a : at + counts[d]] = at + a + np.arange(counts[d] - a) % p
    x = word_hashes(c.data, w)[source]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(c.n)]
    edge = np.zeros(len(x) + 1, np.int64)
    for first, behind, d in _stretches(x, w, min_words - min_words // min_periods).tolist():
        for start, length, period in find_runs(x[first:behind], min_words, min_periods):
            runs[d].append((int(first - w.first[d]) + start, length, period))
            edge[first + start + period] += 1
            edge[first + start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    before = np.concatenate(([0], np.cumsum(kept)))
    text, offsets = joined_words(c.data, w, source[kept], before[w.first])
    return counts.astype(np.int64), runs, text, offsets


def collapse_runs(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", alter: Alter | None = None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """(id, n_words, runs, kept_text) for every row of `docs`: the runs of its words (words are
    [^\\x20\\x09-\\x0D]+) as (start, length, period) by start and period, and the words that no
    run holds behind its first period, joined by one space.

    A null text is an empty one: no words, no runs, an empty text. Rows are judged each by
    itself, so null and repeated ids, equal rows and empty tables need no rule; columns other
    than the two are not read. `alter` may make the words of a text periodic from some word
    on. Nothing is shuffled; a task holds a few times the longest text.
    """
    if min_periods < 2 or min_words < min_periods:
        raise ValueError("a run has two periods or more")
    kind = dict(docs.dtypes)[id_col]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in text_chunks(batches, text):
            ids = c.batch.column(c.batch.schema.get_field_index(id_col))
            counts, runs, kept, offsets = _collapse(c, ids.to_pylist(), alter, min_words, min_periods)
            flat = [r for of in runs for r in of]
            starts = np.concatenate(([0], np.cumsum([len(of) for of in runs]))).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(starts), items).cast(run_type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts), lists, string_array(kept, offsets)], ["id", "n_words", "runs", "kept_text"])

    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept_text string")


def longest_by_exponent(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), lambda best, r: F.when(more(best, r), r).otherwise(best))


def run_lines(runs: Column) -> Column:
    """start,length,period and a line feed for each run."""
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def periodic_tenth(doc_id: object, words: int) -> tuple[int, int] | None:
    """A tenth of the documents, by the CRC-32 of their ids, become periodic from a word on."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % words
    return None if h % 10 else (a, 1 + (words - a) // (3 + g % 8))
