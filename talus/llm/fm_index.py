"""A compressed full-text index over integer symbols: Burrows-Wheeler transform in a wavelet
matrix of packed bits with sampled ranks, and a suffix array of which one place in SAMPLE is
kept. Matching statistics of many sequences are computed by backward search at a time."""

from __future__ import annotations

import numpy as np

WORD = 64
#: One suffix in so many keeps its place; the others find theirs by steps to the left.
SAMPLE = 8


class Bits:
    """A packed bit vector with constant-time rank: one running count for 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(len(bits) // WORD + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        packed.view(np.uint8)[: len(raw)] = raw
        self.words = packed
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        part = self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[at] + np.bitwise_count(part)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Each 0 ends a sequence of at most `longest`
    symbols and is smaller than any 0 after it, so suffixes differ by their first 0."""
    n, ends = len(text), np.cumsum(text == 0)
    rank = np.where(text == 0, ends - 1, ends[-1] + text)
    done = 1
    while done <= longest:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - done)] = rank[done:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([False], key[order[1:]] != key[order[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        done *= 2
        if new[1:].all():
            break
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Index of `text`: symbols from 1, every sequence closed by a 0 (in no pattern)."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.n, self.size = n, int(text.max(initial=0)) + 1
        close = np.flatnonzero(text == 0)
        longest = int(np.diff(close, prepend=-1).max(initial=1))
        order = _suffix_order(text, longest)
        last = text[order - 1]  # the transform: the symbol before each suffix
        kept = (order % SAMPLE == 0) | (last == 0)  # no step ever leaves a sequence
        self.kept, self.places = Bits(kept), order[kept].astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.size))))
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(self.size - 1).bit_length()) - 1, -1, -1):
            bit = (last >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(n - bit.sum())))
            last = np.concatenate((last[~bit], last[bit]))
        self.base = self._descend(np.arange(self.size), np.zeros(self.size, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def _left(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer than each row's."""
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            bit, ones = bits.get(i), bits.rank(i)
            symbol |= bit.astype(np.int64) << shift
            i = np.where(bit, zeros + ones, i - ones)
        return i - self.base[symbol] + self.first[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of the suffix in each row."""
        out = np.zeros(len(rows), np.int64)
        which, steps = np.arange(len(rows)), 0
        while len(which):
            done = self.kept.get(rows)
            out[which[done]] = self.places[self.kept.rank(rows[done])] + steps
            which, rows = which[~done], self._left(rows[~done])
            steps += 1
        return out

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, room: np.ndarray, report: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high) for each end position: the longest match of text[.. end] to the
        left, of at most `room` symbols, that starts two suffixes or more of the index; low and
        high are the interval of its last `report` symbols where it is as long, else 0."""
        length = np.zeros(len(ends), np.int64)
        lows, highs = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        which = np.flatnonzero(room > 0)
        c = text[ends[which]]
        low, high, size = self.first[c], self.first[c + 1], 1
        while True:
            more = high - low > 1
            which, low, high = which[more], low[more], high[more]
            length[which] = size
            if size == report:
                lows[which], highs[which] = low, high
            more = room[which] > size
            which, low, high = which[more], low[more], high[more]
            if not len(which):
                return length, lows, highs
            c = text[ends[which] - size]
            both = self._descend(np.concatenate((c, c)), np.concatenate((low, high)))
            shift = self.first[c] - self.base[c]
            low, high = both[: len(c)] + shift, both[len(c) :] + shift
            size += 1
