import re

import numpy as np
import pytest

from talus.llm import substring_dedup as s
from talus.llm.fm_index import FMIndex


def brute(rows, k):
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - k + 1):
                key = tuple(w[a : a + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for a in range(len(w) - k + 1):
                if first[tuple(w[a : a + k])] < i:
                    gone |= set(range(a, a + k))
        kept = b" ".join(x for a, x in enumerate(w) if a not in gone).decode()
        out.append((i if i is not None else -1, len(w), len(gone), kept))
    return sorted(out)


def test_matching_statistics_and_places():
    rng = np.random.default_rng(0)
    parts = [rng.integers(1, 5, rng.integers(1, 23)) for _ in range(300)]
    text = np.concatenate([np.append(x, 0) for x in parts])
    index = FMIndex(text)
    places = {}
    begin = 0
    ends, room = [], []
    for x in parts:
        for a in range(len(x)):
            ends.append(begin + a)
            room.append(a + 1)
            for b in range(a + 1, len(x) + 1):
                places.setdefault(tuple(x[a:b]), set()).add(begin + a)
        begin += len(x) + 1
    ends, room = np.array(ends), np.array(room)
    length, low, high = index.matching_statistics(text, ends, room, 6)
    for e, r, n, lo, hi in zip(ends, room, length, low, high):
        assert n == max([k for k in range(1, r + 1) if len(places[tuple(text[e - k + 1 : e + 1])]) > 1], default=0)
        want = places[tuple(text[e - 5 : e + 1])] if n >= 6 else set()
        assert set(index.locate(np.arange(lo, hi)).tolist()) == want


@pytest.mark.parametrize(("hot", "shard", "wide"), [(2000, 12_000, 16), (1, 10, 1), (5, 50, 0)])
def test_matches_brute_force(spark, hot, shard, wide, monkeypatch):
    monkeypatch.setattr(s, "WIDE", wide)
    monkeypatch.setattr(s, "HOT_ANCHOR", hot)
    monkeypatch.setattr(s, "SHARD_CONTEXTS", shard)
    rng = np.random.default_rng(hot)
    vocabulary = np.array(["of", "the", "a", "Ünder", "x\ty", "and\n", "w1", "w2", "w3", "字"])
    passages = [list(rng.choice(vocabulary, n)) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in rng.permutation(90).tolist():
        parts = []
        for _ in range(rng.integers(0, 5)):
            parts += list(rng.choice(vocabulary, rng.integers(0, 20))) if rng.random() < 0.5 else passages[rng.integers(0, 5)]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, "one two three four five six seven eight nine ten eleven twelve thirteen" + f" own{i}" * (i % 3)) for i in range(40)]
    rows += [(300, None), (301, ""), (302, "a " * 4000), (303, "a " * 20), (None, rows[0][1]), (5, rows[3][1]), (5, rows[3][1]), (304, " \n")]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, doc int, anchor string")
    got = s.dedup_substrings(frame).collect()
    assert sorted((r["doc"] if r["doc"] is not None else -1, r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute(rows, 13)
    for r in got:
        assert sum(x["words"] for x in r["removed_runs"]) == r["n_removed"]


def test_empty(spark):
    assert s.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_buckets_follow_the_texts():
    """The largest bucket of anchors stays as large from 1 to 8 times the texts."""
    rng = np.random.default_rng(2)
    largest = []
    for times in (1, 2, 4, 8):
        keys = rng.integers(0, 2**47, 40_000 * times)
        buckets = s.bucket_number(4, times * 20 * s.ANCHOR_BYTES, s.ANCHOR_BYTES)
        largest.append(np.bincount(s._bucket(keys, buckets)[0], minlength=buckets).max())
    assert max(largest) < 1.2 * min(largest)
    assert s.bucket_number(50, 0, s.ANCHOR_BYTES) == 50 and s.bucket_number(0, 1, s.ANCHOR_BYTES) == 1


def test_places_in_blocks_equal_a_loop(monkeypatch):
    monkeypatch.setattr(s, "PLACE_BLOCK", 7)
    rng = np.random.default_rng(3)
    size = rng.integers(1, 11, 20)
    cut = np.concatenate(([0], np.cumsum(size)))
    firsts = rng.integers(0, 9, cut[-1])
    which, doc, mark, first = rng.integers(0, 20, 60), rng.integers(0, 9, 60), rng.integers(-5, 5, 60), rng.integers(0, 99, 60)
    want = []
    for c, d, m, f in zip(which, doc, mark, first):
        gone = [firsts[cut[c] + i] < d for i in range(size[c])]
        for i in range(size[c]):
            if gone[i] and not (i and gone[i - 1]):
                n = next((k for k in range(i, size[c]) if not gone[k]), size[c]) - i
                want.append((d, m, f + i, n))
    found = s._covered(firsts, cut, which, doc, mark, first)
    assert [tuple(r[k] for k in ("doc", "mark", "start", "windows")) for r in found.to_pylist()] == want
    none = np.zeros(0, np.int64)
    assert len(s._covered(firsts, cut, none, none, none, none)) == 0
