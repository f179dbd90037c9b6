"""Similarity joins against brute force, with hot tokens, copies and odd rows."""

import math
import random
import re
from collections import Counter

import pytest

from talus.operators import similarity as sim


def bag(text):
    c = Counter(re.findall(r"[a-z0-9]+", (text or "").lower()))
    n = math.sqrt(sum(v * v for v in c.values()))
    return {t: v / n for t, v in c.items()}


def cos(a, b):
    return round(sum(w * b.get(t, 0.0) for t, w in a.items()), 6)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    out = [None, "", "?!", "hot", "hot hot", "HOT"]
    while len(out) < n:
        base = ["hot"] * rng.randrange(1, 4) + rng.choices(words, weights=[1 / (i + 1) for i in range(30)], k=rng.randrange(0, 9))
        out.append(" ".join(base))
        if rng.random() < 0.3:
            out.append(" ".join(base[::-1]))
        if rng.random() < 0.2:
            out.append(" ".join(base + rng.choices(words, k=1)))
    return out[:n]


def test_bags(spark):
    rows = [(i, t) for i, t in enumerate(texts(1, 60))]
    got = {r.id: r.bag for r in sim.bags(spark.createDataFrame(rows, "id long, text string"), ["id"], "text").collect()}
    want = {i: bag(t) for i, t in rows if bag(t)}
    assert got.keys() == want.keys()
    for i, b in want.items():
        assert got[i].keys() == b.keys() and all(abs(got[i][t] - w) < 1e-12 for t, w in b.items())


@pytest.mark.parametrize("least", [0.5, 0.9, 1.0])
def test_cosine_pairs_equal_brute_force(spark, least):
    rows = list({str(sorted(bag(t).items())): (i, t) for i, t in enumerate(texts(2, 150))}.values())
    df = sim.bags(spark.createDataFrame(rows, "id long, text string"), ["id"], "text")
    got = {(r.a, r.b): r.similarity for r in sim.cosine_pairs(df, "id", least).collect()}
    bagged = {i: bag(t) for i, t in rows if bag(t)}
    want = {(a, b): cos(bagged[a], bagged[b]) for a in bagged for b in bagged if a < b and cos(bagged[a], bagged[b]) >= least}
    assert got.keys() == want.keys() and all(abs(got[p] - s) < 2e-6 for p, s in want.items())


def test_cache_finds_the_best_earlier_prompt(spark):
    rows = [(3 * i + 1, t) for i, t in enumerate(texts(3, 200))]
    df = spark.createDataFrame(rows, "seq long, text string").repartition(5)
    got = {r.seq: r for r in sim.cache_lookups(df, "seq", "text", 0.9).collect()}
    assert len(got) == len(rows)
    hits = 0
    for at, (seq, t) in enumerate(rows):
        b = bag(t)
        near = max(((cos(b, bag(u)), -s) for s, u in rows[:at] if b and bag(u)), default=(0, 0))
        if near[0] >= 0.9:
            hits += 1
            assert (got[seq].hit, got[seq].best) == (True, -near[1]) and abs(got[seq].similarity - near[0]) < 2e-6
        else:
            assert (got[seq].hit, got[seq].best, got[seq].similarity) == (False, None, None)
    (r,) = sim.hit_ratio(sim.cache_lookups(df, "seq", "text", 0.9)).collect()
    assert (r.entries, r.hits, r.misses, r.hit_ratio) == (len(rows), hits, len(rows) - hits, round(hits / len(rows), 4))
    (r,) = sim.hit_ratio(sim.cache_lookups(df.limit(0), "seq", "text")).collect()
    assert (r.entries, r.hit_ratio) == (0, 0.0)


@pytest.mark.parametrize("k,least,block", [(3, 0.05, 4096), (5, 0.3, 7), (1, 0.9, 3), (50, 0.01, 16)])
def test_sparse_top_k_equals_brute_force(spark, k, least, block):
    rows = [(i, None if i % 17 == 0 else "t" if i % 3 else "u", t) for i, t in enumerate(texts(k, 160))]
    df = sim.bags(spark.createDataFrame(rows, "id long, tenant string, text string"), ["id", "tenant"], "text")
    asked = df.where("id % 4 = 0")
    got = {}
    for r in sim.sparse_top_k(asked, df, "id", "id", "tenant", k, least, block).collect():
        got.setdefault(r.query, []).append((r["rank"], r.memory, r.similarity))
    for q, tenant, t in rows:
        if q % 4 or tenant is None or not bag(t):
            assert q not in got
            continue
        scored = sorted((-cos(bag(t), bag(u)), m) for m, v, u in rows if v == tenant and bag(u))
        want = [(i + 1, m, -s) for i, (s, m) in enumerate([x for x in scored if -x[0] >= least][:k])]
        mine = sorted(got.get(q, []))
        assert [x[2] for x in mine] == pytest.approx([x[2] for x in want], abs=2e-6)
        assert [x[1] for x in mine] == [x[1] for x in want] or any(abs(a[2] - b[2]) < 2e-6 for a, b in zip(want, want[1:]))
    assert got


def test_dense_top_k_equals_brute_force(spark):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.15) for c in centres[i % 12]]) for i in range(400)]
    rows += [(400 + i, centres[3]) for i in range(120)]  # copies
    rows += [(600, None), (601, [0.0] * 8), (602, [float("nan")] + [1.0] * 7), (603, [None] + [1.0] * 7), (604, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    good = {i: v for i, v in rows if v and None not in v and all(map(math.isfinite, v)) and any(v)}

    def alike(a, b):
        if a not in good or b not in good:
            return 0.0
        x, y = good[a], good[b]
        return round(sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)), 6)

    for k, block in ((5, 4096), (3, 16)):
        out, share = sim.dense_top_k(df.where("id % 20 = 0 or id > 598"), df, "id", "id", "v", k, block=block)
        got = {}
        for r in out.collect():
            got.setdefault(r.query, []).append((r["rank"], r.id, r.similarity))
        for q, _ in rows:
            if q % 20 and q <= 598:
                continue
            want = sorted((-alike(q, i), i) for i, _ in rows if i != q)[:k]
            mine = sorted(got[q])
            assert [m[2] for m in mine] == pytest.approx([-s for s, _ in want], abs=2e-6), q
            near = sorted((-alike(q, i), i) for i, _ in rows if i != q)[: k + 1]
            if all(a[0] == b[0] or abs(a[0] - b[0]) > 2e-6 for a, b in zip(near, near[1:])):  # else a last digit may decide
                assert [m[1] for m in mine] == [i for _, i in want], q
        (s,) = share.collect()
        assert 0 < s.compared < s.pairs * 0.6
    out, _ = sim.dense_top_k(df.where("id = 601"), df, "id", "id", "v", 3)
    assert [(r.id, r.similarity) for r in out.orderBy("rank").collect()] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    out, _ = sim.dense_top_k(df.limit(0), df.limit(0), "id", "id", "v", 3)
    assert out.count() == 0


def test_dense_top_k_writes_no_row_for_a_pair(spark, monkeypatch):
    """Vectors without clusters, of which nothing can be pruned: pairs are compared in tasks, not written."""
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(1200)]
    df, written, cut = spark.createDataFrame(rows, "id long, v array<float>"), [], sim.cut

    def counted(table):
        out = cut(table)
        written.append(out.count())
        return out

    monkeypatch.setattr(sim, "cut", counted)
    out, share = sim.dense_top_k(df.where("id % 2 = 0"), df, "id", "id", "v", 3, block=100)
    assert share.first().compared > 600_000 and sum(written) < 60_000  # 3 rows a query and block
    import numpy as np

    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    alike = np.round(v @ v.T, 6)
    np.fill_diagonal(alike, -2)
    got = {(r.query, r["rank"]): r.id for r in out.collect()}
    assert got == {(q, k + 1): i for q in range(0, 1200, 2) for k, i in enumerate(np.argsort(-alike[q], kind="stable")[:3])}


def test_common_words_are_multiplied_in_tiles(spark, monkeypatch):
    """Words that most texts share join to too many pairs: no table of pairs is written, and the rows are the same."""
    written, cut = [], sim.cut

    def counted(table):
        out = cut(table)
        written.append(out.count())
        return out

    monkeypatch.setattr(sim, "cut", counted)
    monkeypatch.setattr(sim, "KEY_PAIRS", 2_000, raising=False)
    monkeypatch.setattr(sim, "TILE", 64, raising=False)
    rng = random.Random(5)
    rows = [(i, "t", " ".join(rng.choices([f"w{j}" for j in range(14)], k=rng.randrange(9, 14)) + [f"x{rng.randrange(9)}"])) for i in range(600)]
    df = sim.bags(spark.createDataFrame(rows, "id long, tenant string, text string"), ["id", "tenant"], "text")
    bagged = {i: bag(t) for i, _, t in rows}
    got = {(r.a, r.b): r.similarity for r in sim.cosine_pairs(df, "id", 0.8).collect()}
    want = {(a, b): cos(bagged[a], bagged[b]) for a in bagged for b in bagged if a < b and cos(bagged[a], bagged[b]) >= 0.8}
    assert got.keys() == want.keys() and all(abs(got[p] - s) < 2e-6 for p, s in want.items())
    top = {(r.query, r["rank"]): r for r in sim.sparse_top_k(df.where("id % 5 = 0"), df, "id", "id", "tenant", 3, 0.05).collect()}
    for q in range(0, 600, 5):
        near = sorted((-cos(bagged[q], b), m) for m, b in bagged.items())[:4]
        assert [top[q, r].similarity for r in (1, 2, 3)] == pytest.approx([-s for s, _ in near[:3]], abs=2e-6)
        if all(a[0] == b[0] or abs(a[0] - b[0]) > 2e-6 for a, b in zip(near, near[1:])):  # else a last digit may decide
            assert [top[q, r].memory for r in (1, 2, 3)] == [m for _, m in near[:3]]
    assert max(written) < 12_000


def test_cache_writes_a_row_for_a_hit_not_for_a_pair(spark, monkeypatch):
    """Texts that are nearly all alike: tiles give the best earlier prompt of a row, not all of them."""
    written, cut = [], sim.cut

    def counted(table):
        out = cut(table)
        written.append(out.count())
        return out

    monkeypatch.setattr(sim, "cut", counted)
    monkeypatch.setattr(sim, "KEY_PAIRS", 2_000)
    monkeypatch.setattr(sim, "TILE", 256)
    rng = random.Random(6)
    base = [f"w{j}" for j in range(25)]
    rows = [(7 * i, " ".join(rng.sample(base, 23) + rng.choices(base + ["x", "y"], k=2) + [f"z{i}"] * (i % 40 == 0))) for i in range(700)]
    rows += [(7 * i + 1, rows[i][1].upper()) for i in range(0, 700, 60)]  # copies
    rows += [(7 * i + 2, "!?") for i in (3, 500)]
    got = {r.seq: r for r in sim.cache_lookups(spark.createDataFrame(rows, "seq long, text string"), "seq", "text", 0.9).collect()}
    assert max(written) < 20_000
    order = sorted((s, bag(t)) for s, t in rows)
    for at, (seq, b) in enumerate(order):
        near = max(((cos(b, c), -s) for s, c in order[:at] if b and c), default=(0, 0))
        if near[0] < 0.9:
            assert (got[seq].hit, got[seq].best) == (False, None)
            continue
        assert abs(got[seq].similarity - near[0]) < 2e-6
        if sum(abs(cos(b, c) - near[0]) < 2e-6 and cos(b, c) != near[0] for s, c in order[:at]) == 0:  # else a last digit may decide
            assert got[seq].best == -near[1]


def test_hit_ratio_writes_no_table_of_words(spark, monkeypatch):
    """Whether words are too common is told by some of the rows: where they are, neither their keys nor their pairs become a table."""
    written, cut = [], sim.cut

    def counted(table):
        out = cut(table)
        written.append(out.count())
        return out

    monkeypatch.setattr(sim, "cut", counted)
    monkeypatch.setattr(sim, "KEY_PAIRS", 2_000)
    monkeypatch.setattr(sim, "TILE", 256)
    monkeypatch.setattr(sim, "PLAN_ROWS", 80, raising=False)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(20)], weights=[1 / (j + 1) for j in range(20)], k=40))) for i in range(800)]
    (r,) = sim.hit_ratio(sim.cache_lookups(spark.createDataFrame(rows, "seq long, text string"), "seq", "text", 0.97)).collect()
    bags = [bag(t) for _, t in rows]
    hits = sum(any(cos(b, c) >= 0.97 for c in bags[:at]) for at, b in enumerate(bags))
    assert 0 < hits < 800 and (r.entries, r.hits, r.misses) == (800, hits, 800 - hits)
    assert max(written) < 2_500


def test_blocks_travel_as_compressed_numbers(spark):
    """What is sent to a tile is an eighth of the bags as words and weights, and holds them all, and of many words also those without a number."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"word{j}" for j in range(300)], weights=[1 / (j + 1) for j in range(300)], k=90) + [f"rare{i}"] * (i % 3))) for i in range(500)]
    df = sim.bags(spark.createDataFrame(rows, "id long, text string"), ["id"], "text")
    known = pa.array([f"word{j}" for j in range(200)])
    from pyspark.sql import functions as F

    sent = sim._packed(sim._numbered(df.coalesce(1), ["id", F.lit(3).cast("int").alias("blk")], "bag", known), "blk").collect()
    table = sim._unpacked(pa.chunked_array([pa.array([bytes(r["rows"]) for r in sent], pa.binary())]))
    assert {r.blk for r in sent} == {3} and sorted(table.column("id").to_pylist()) == [i for i, _ in rows]
    bagged = {i: bag(t) for i, t in rows}
    assert sum(len(r["rows"]) for r in sent) < sum(len(w) + 16 for b in bagged.values() for w in b) / 8
    x, _ = sim._bags_of(table, table)
    ids = table.column("id").to_pylist()
    i, j = np.array([rng.randrange(500) for _ in range(300)]), np.array([rng.randrange(500) for _ in range(300)])
    assert [round(p, 6) for p in sim._products(x, i, x, j)] == pytest.approx([cos(bagged[ids[a]], bagged[ids[b]]) for a, b in zip(i, j)], abs=2e-6)


@pytest.mark.parametrize("k,least,n", [(3, 0.05, 900), (1, 0.6, 900), (50, 0.2, 300), (4, 0.05, 3), (2, 0.05, 1)])
def test_a_tile_scores_few_pairs(spark, monkeypatch, k, least, n):
    """The screen and the best of the most hopeful rows leave few products of a search to take."""
    import numpy as np
    import pyarrow as pa

    taken, products = [0], sim._products

    def counted(x, i, y, j):
        taken[0] += len(i)
        return products(x, i, y, j)

    monkeypatch.setattr(sim, "_products", counted)
    rng = random.Random(8)
    words = [f"w{j}" for j in range(3000)]
    weights = [1 / (j + 3) for j in range(3000)]
    rows = [(i, " ".join(rng.choices(words, weights=weights, k=rng.randrange(4, 90)))) for i in range(n + 70)]
    bagged = {i: bag(t) for i, t in rows}
    df = sim.bags(spark.createDataFrame(rows, "id long, text string"), ["id"], "text").coalesce(1)
    known = pa.array(words[:2000])
    asks, held = (sim._numbered(df.where(c), ["id"], "bag", known).toArrow() for c in (f"id >= {n}", f"id < {n}"))
    x, y = sim._bags_of(asks, held)
    ids = held.column("id").combine_chunks()
    q, p, digits = sim._best_in_tile(x, y, sim._order(ids), k, least)
    got = {}
    for a, b, d in zip(asks.column("id").take(pa.array(q)).to_pylist(), ids.take(pa.array(p)).to_pylist(), digits):
        got.setdefault(a, []).append((-d, b))
    for a in range(n, n + 70):
        want = sorted((-round(cos(bagged[a], bagged[b]) * 1e6), b) for b in range(n) if cos(bagged[a], bagged[b]) >= least)[:k]
        mine = sorted(got.get(a, []))
        assert [d for d, _ in mine] == pytest.approx([d for d, _ in want], abs=2) and len(np.unique([b for _, b in mine])) == len(mine)
    if k < 5 and n > 100:
        assert taken[0] < 0.12 * n * 70


def greedy(names, pairs):
    near = {frozenset(p) for p in pairs}
    leaders, out = [], {}
    for n in sorted(names):
        out[n] = next((x for x in leaders if frozenset((x, n)) in near), n)
        if out[n] == n:
            leaders.append(n)
    return out


def test_greedy_leaders_equal_the_loop(spark):
    rng = random.Random(4)
    for n, share in ((1, 0), (40, 0.05), (60, 0.2), (25, 1.0)):
        names = [f"n{rng.randrange(10**6):06}" for _ in range(n)]
        pairs = [(a, b) if rng.random() < 0.5 else (b, a) for a in names for b in names if a < b and rng.random() < share]
        pairs += [(names[0], names[0]), (names[0], "stranger"), (None, names[0])] + pairs[:3]
        got = sim.greedy_leaders(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame([(x,) for x in names + names[:2]] + [(None,)], "name string"))
        assert {r.name: r.leader for r in got.collect()} == greedy(set(names), [p for p in pairs if None not in p])
    chain = [(i, i + 1) for i in range(12)]
    got = sim.greedy_leaders(spark.createDataFrame(chain, "a long, b long"), spark.range(13))
    assert {r.name: r.leader for r in got.collect()} == greedy(range(13), chain)
    with pytest.raises(RuntimeError):
        sim.greedy_leaders(spark.createDataFrame(chain, "a long, b long"), spark.range(13), rounds=2)


def test_few_edges_are_decided_in_one_pass(spark):
    """With `at_once` the end of the pass needs no rounds; more edges than that go by rounds first."""
    rng = random.Random(5)
    for n, share, at_once in ((40, 0.05, 1000), (60, 0.2, 1000), (60, 0.2, 60)):
        names = [f"{rng.choice('aBß')}{i}" for i in range(n)]
        pairs = [(a, b) for a in names for b in names if a < b and rng.random() < share]
        got = sim.greedy_leaders(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame([(x,) for x in names], "name string"), at_once=at_once)
        assert {r.name: r.leader for r in got.collect()} == greedy(names, pairs)
    chain = [(i, i + 1) for i in range(12)]
    got = sim.greedy_leaders(spark.createDataFrame(chain, "a long, b long"), spark.range(13), rounds=1, at_once=12)
    assert {r.name: r.leader for r in got.collect()} == greedy(range(13), chain)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, tenant string, text string")
    b = sim.bags(none, ["id", "tenant"], "text")
    assert sim.cosine_pairs(b, "id", 0.5).count() == 0 and sim.sparse_top_k(b, b, "id", "id", "tenant", 3, 0.1).count() == 0
    assert sim.greedy_leaders(spark.createDataFrame([], "a long, b long"), spark.range(0)).count() == 0
    for call in (lambda: sim.cosine_pairs(b, "id", 0.0), lambda: sim.sparse_top_k(b, b, "id", "id", "tenant", 3, 0.0)):
        with pytest.raises(ValueError):
            call()
