import re

import numpy as np
import pytest
import xxhash

from talus.llm import simhash
from talus.llm.components import connected_components


def brute_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, near):
    parent = {k: k for k, _ in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if near(x, y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: root(k) for k, _ in items}


@pytest.mark.parametrize("hot_groups", [0, 4, 2000])
def test_fingerprints_and_components_match_brute_force(spark, hot_groups, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_GROUPS", hot_groups)  # none, some and all groups are hot
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(["alpha", "Beta", "gam\tma", "de  lta", "é", "x\n", "Z"], 60)) for _ in range(12)]
    texts = [None, "", " \n\t", "one", "Two words", "a b c d", *base, *base[:3]]
    for b in base[:6]:
        w = b.split(" ")
        w[3] = "changed"
        texts.append(" ".join(w))
    texts.append("long " * 50_000 + "tail")
    rows = [(i + 7, t, i, "x") for i, t in enumerate(texts)]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp long, node string")).collect()
    fps = {i: brute_fingerprint(t, 4) for i, t, _, _ in rows}
    assert {r["id"]: r["fp"] % (1 << 64) for r in got} == fps
    assert {r["id"]: r["component_id"] for r in got} == brute_components(list(fps.items()), lambda x, y: bin(x ^ y).count("1") <= 4)


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 17])
def test_fingerprints_do_not_depend_on_the_step(step, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED_SHINGLES", step)
    rng = np.random.default_rng(step)
    texts = [" ".join(rng.choice(["a", "B", "cc", "é"], n)) for n in rng.integers(0, 40, 60)] + ["x y z " * 40, "", "q"]
    raw = [t.encode() for t in texts]
    got = simhash._fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), 4)
    assert got.tolist() == [brute_fingerprint(t, 4) for t in texts]


@pytest.mark.parametrize("hot_list", [1, 50, 10_000])
@pytest.mark.parametrize("size", [3, 4])
def test_links_connect_what_hamming_distance_connects(spark, hot_list, size, monkeypatch):
    monkeypatch.setattr(simhash, "FOUR_BYTE_KEYS_FROM", 10**9 if size == 3 else 0)
    rng = np.random.default_rng(hot_list + size)
    centres = rng.integers(0, 2**63, 6, dtype=np.int64).tolist()
    fps = {c ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for c in centres for _ in range(20)}
    fps |= set(rng.integers(-(2**63), 2**63, 40, dtype=np.int64).tolist())
    items = [(i, f) for i, f in enumerate(sorted(fps))]
    frame = spark.createDataFrame([(f, i) for i, f in items], "fp long, node long")
    parts = {r["node"]: r["component"] for r in connected_components(simhash.near_links(frame, 4, hot_list)).collect()}
    assert {i: parts.get(i, i) for i, _ in items} == brute_components(items, lambda x, y: bin((x ^ y) % (1 << 64)).count("1") <= 4)


def test_key_groups_cover_every_four_positions():
    from itertools import combinations

    for size, n in ((3, 20), (4, 70)):
        groups = simhash.key_positions(size)
        assert len(groups) == n
        assert all(any(set(g) <= set(four) for g in groups) for four in combinations(range(8), 4))


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "q r s")], "doc_id long, text string")
    got = sorted((r["id"] or -1, r["component_id"]) for r in simhash.simhash_components(rows).collect())
    assert got == [(-1, 5), (3, 3), (5, 5), (5, 5)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(99, 98), (None, 4)]])
def test_connected_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    pairs = {frozenset(e) for e in edges if None not in e}
    want = brute_components([(n, n) for n in nodes], lambda x, y: frozenset((x, y)) in pairs)
    assert got == want
