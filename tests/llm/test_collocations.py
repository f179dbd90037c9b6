"""Collocations against brute force, both second passes; Misra-Gries bounds; odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from talus.llm import collocations as co

UPPER = {c: c + 32 for c in range(65, 91)}


def naive(rows, min_count, most, top, percent=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, most + 1):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    held = {k: a for k, a in f.items() if a >= min_count}
    out = {}
    for (lang, p), a in held.items():
        if len(p) < 2:
            continue
        if any(g == lang and len(q) > len(p) and percent and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in held.items()):
            continue
        score, k = min((1000 * a * n[lang] // (held[lang, p[:k]] * held[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), held[lang, p[:k]], held[lang, p[k:]]))
    return sorted(
        (lang, rank + 1, phrase.decode(), -a, l, r, n[lang], -score) for lang, rows in out.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top])
    )


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "A", "x", "ä", "Ä", "日本", "\x00", "\x85", " ", "new", "york", "city", "is", "big"]
    rows = [(None, None), ("en", ""), ("en", None), ("und", "new york"), (None, "New York"), ("en", ".,;:!?\n\x0b\x0c\r \t"), ("en", "a " * 500), ("en", "q" * 50_000)]
    for _ in range(docs):
        parts = []
        for _ in range(rng.randrange(0, 60)):
            parts.append(rng.choice(["new york city", "New York", "the of a", "a a a", rng.choice(words), rng.choice(words)]))
        text = "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "de", None, ""]), text))
    return rows + rows[20:40]


@pytest.mark.parametrize("filter_keys", [co.FILTER_KEYS, 0])
@pytest.mark.parametrize("min_count,most,top,percent", [(10, 5, 2000, 100), (3, 4, 7, 100), (25, 3, 50, 80)])
def test_equals_brute_force(spark, monkeypatch, filter_keys, min_count, most, top, percent):
    monkeypatch.setattr(co, "COUNTED", 700)  # many summaries for each partition
    rows = corpus(min_count)
    df = spark.createDataFrame([(i % 7 or None, t, lang, 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase int").repartition(6)
    got = sorted(tuple(r) for r in co.mine_collocations(df, min_count, most, top, percent, filter_keys=filter_keys).collect())
    want = naive(rows, min_count, most, top, percent)
    assert got == want and len(got) > 5


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000
    rows = [("en", None, 0, big * 1000), ("en", "a", 1, big * 3 + 1), ("en", "b", 1, big + 7), ("en", "a b", 2, big), ("en", "a b a", 3, big - 1), ("en", "b a", 2, big)]
    got = {r.phrase: r for r in co.score_phrases(spark.createDataFrame(rows, "lang string, phrase string, words long, n long")).collect()}
    n = big * 1000
    assert got["a b"].score == 1000 * big * n // ((big * 3 + 1) * (big + 7))
    cuts = [1000 * (big - 1) * n // ((big * 3 + 1) * big), 1000 * (big - 1) * n // (big * (big * 3 + 1))]
    assert cuts[0] == cuts[1] and (got["a b a"].score, got["a b a"].l, got["a b a"].r) == (cuts[0], big * 3 + 1, big)  # a tie: the first cut


def test_summaries_keep_all_frequent_keys():
    rng = np.random.default_rng(5)
    for threshold in (20, 50, 100):
        stream = np.concatenate((rng.zipf(1.3, 30_000) % 100_000, np.repeat(np.arange(200_000, 200_040), threshold))).astype(np.uint64)
        rng.shuffle(stream)
        truth = Counter(stream.tolist())
        for batches in (3, 40):
            s = co.MisraGries(len(stream) // threshold + 1)
            for part in np.array_split(stream, batches):
                keys, counts = co.unpack(co.pack(*np.unique(part, return_counts=True)))
                s.merge(keys, counts)
            assert len(s.keys) <= s.capacity and s.error < threshold
            have = dict(zip(s.keys.tolist(), s.counts.tolist()))
            for k, n in truth.items():
                assert have.get(k, 0) <= n <= have.get(k, 0) + s.error
            assert all(k in have for k, n in truth.items() if n >= threshold)


def test_packing_round_trip():
    for keys, counts in (([0], [1]), ([0, 1, 2**40 - 1], [1, 255, 256]), ([5, 9], [2**40, 3])):
        k, c = co.unpack(co.pack(np.array(keys, np.uint64), np.array(counts)))
        assert k.tolist() == keys and c.tolist() == counts


def test_empty_tables_and_rare_phrases(spark):
    schema = "text string, lang string"
    assert co.mine_collocations(spark.createDataFrame([], schema)).count() == 0
    assert co.mine_collocations(spark.createDataFrame([("a b c", "en"), (None, None)], schema)).count() == 0
