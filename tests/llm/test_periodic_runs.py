"""Periodic runs against brute force: Lyndon arrays, runs, collapsed texts, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from talus.llm import periodic_runs as pr
from talus.llm.queries import op12_digest


def lyndon_naive(x):
    out = []
    for i in range(len(x)):
        best = 1
        for j in range(i + 1, len(x) + 1):
            word = x[i:j]
            if all(word < word[k:] for k in range(1, len(word))):
                best = j - i
        out.append(best)
    return out


def runs_naive(x, min_words, min_periods):
    out = []
    for p in range(1, len(x) // min_periods + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(min_words, min_periods * p):
                root = x[i : i + p]
                if not any(p % d == 0 and root == root[:d] * (p // d) for d in range(1, p)):
                    out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays_by_grouping():
    for n in range(1, 9):
        for x in itertools.product(range(3 if n < 8 else 2), repeat=n):
            assert pr.lyndon_lengths(list(x)) == lyndon_naive(list(x)), x
    rng = random.Random(3)
    for _ in range(150):
        x = [rng.randrange(rng.choice((2, 3, 9))) for _ in range(rng.randrange(1, 40))]
        assert pr.lyndon_lengths(x) == lyndon_naive(x), x


@pytest.mark.parametrize("min_words,min_periods", [(24, 3), (2, 2), (4, 2), (6, 3), (9, 4)])
def test_runs_equal_brute_force(min_words, min_periods):
    rng = random.Random(min_words)
    for _ in range(300):
        x = []
        while len(x) < rng.randrange(1, 120):
            root = [rng.randrange(rng.choice((1, 2, 3, 30))) for _ in range(rng.randrange(1, 12))]
            x += (root * rng.randrange(1, 8))[: rng.randrange(1, 70)]
        assert pr.find_runs(np.array(x), min_words, min_periods) == runs_naive(x, min_words, min_periods), x


def test_hash_collisions_do_not_make_runs():
    thue = [0]
    while len(thue) < 4096:
        thue += [1 - b for b in thue]
    for x in (thue, thue + thue + thue[:77], (thue[:40] * 9)[:333]):
        assert pr.find_runs(np.array(x)) == runs_naive(x, 24, 3)


def digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_naive(words, 24, 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["a", "bb", "ä", "日本", "x\x00y", " ", "\x85", "w" * 3000, *map(str, range(40))]
    rows = [(None, None, 1), (None, "a " * 30, 2), (-5, "a\x0bb\x0c" * 40, 3), (0, "", 4), (0, "   \n\t ", 5), (7, "only", 6), (7, "only", 6), (8, " ".join("abcabc" * 20), 7), (9, None, 8)]
    for i in range(10, 330):
        words = []
        while len(words) < rng.randrange(1, 200):
            root = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 20))]
            words += (root * rng.randrange(1, 9))[: rng.randrange(1, 90)]
        rows.append((i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\r\n", "  "]).join(words) + rng.choice(["", " "]), i))
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long").repartition(5)
    got = sorted((tuple(r) for r in op12_digest(df).collect()), key=repr)
    assert got == sorted((digest(i, t) for i, t, _ in rows), key=repr)


def test_very_long_text_and_empty_table(spark):
    base = [f"w{i % 977}x{i // 977}" for i in range(60_000)]
    words = base[:10_000] + ["k"] * 100_000 + base[10_000:] + base[:300] * 40
    (row,) = pr.collapse_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert row.n_words == len(words)
    assert [tuple(r) for r in row.runs] == [(10_000, 100_000, 1), (160_000, 12_000, 300)]
    assert row.kept_text.split() == base[:10_000] + ["k"] + base[10_000:] + base[:300]
    assert pr.collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        pr.collapse_runs(spark.createDataFrame([], "doc_id long, text string"), min_periods=1)
