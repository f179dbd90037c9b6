import numpy as np
import pytest

from talus.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n long"


def brute(rows, c):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)))
    ids = sorted(good)
    near = {i: {j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= c} for i in ids}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("large, hot", [(100_000, 2000), (0, 11)])
def test_matches_brute_force(spark, monkeypatch, large, hot):
    monkeypatch.setattr(e, "BLOCK", 20)  # several blocks in a bucket
    monkeypatch.setattr(e, "STRIP", 7)
    monkeypatch.setattr(e, "LARGE_BUCKETS", large)  # their numbers broadcast, or joined
    monkeypatch.setattr(e, "HOT_GROUPS", hot)  # all vectors hot, or the copies alone
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.standard_normal(16) * (0.05 if i % 3 else 0.25)]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(30)]  # copies
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [None] + [1.0] * 15), (504, [float("nan")] * 16), (505, [float("inf")] + [0.0] * 15)]
    rows += [(506, [1.0, 0.0]), (507, [2.0, 0.0]), (508, [-1.0, 0.0]), (509, [1e-30] * 16), (510, [3e30] * 16)]
    got = e.embedding_components(spark.createDataFrame([(i, v, 0, "x", 5) for i, v in rows], SCHEMA)).collect()
    assert {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute(rows, 0.9)


def test_recall_on_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * side
    rows = [(2 * i + k, [float(x) for x in v], 0, "", 0) for i in range(1500) for k, v in enumerate((a[i], b[i]))]
    got = e.embedding_components(spark.createDataFrame(rows, SCHEMA)).agg({"n_links": "sum"}).first()[0]
    assert got >= 0.99 * 3000


def test_tables_follow_the_number_of_vectors():
    (few, p), (many, q) = e.plan_tables(10_000, 0.9), e.plan_tables(10**9, 0.9)
    assert p < q and few < many
    assert (1 - e.agreement(np.sqrt(0.2)) ** q) ** many <= e.MISSED


def test_empty_and_null_ids(spark):
    assert e.embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(None, [1.0, 2.0], 0, "", 0), (4, [1.0, 2.0], 0, "", 0), (4, [1.0, 2.0], 0, "", 0)], SCHEMA)
    got = sorted((r["id"] or 0, r["component_id"] or 0, r["kept"]) for r in e.embedding_components(frame).collect())
    assert got == [(0, 0, True), (4, 4, True), (4, 4, True)]


def test_repeated_ids_have_one_result(spark):
    rows = [(1, [1.0, 0.0], 0, "", 0), (7, [1.0, 0.01], 0, "", 0), (7, [0.0, 1.0], 0, "", 0), (9, [1.0, 0.02], 0, "", 0)]
    got = sorted((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in e.embedding_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 2, 1, True), (7, 2, 1, False), (7, 2, 1, False), (9, 2, 1, False)]


def test_double_precision_decides_at_the_threshold():
    rng = np.random.default_rng(3)
    u = e._units([rng.standard_normal(48).tobytes() for _ in range(200)], float)
    side = rng.standard_normal(u.shape)
    side -= (side * u).sum(1)[:, None] * u
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = 0.9 + rng.choice([-1, 1], 200) * 10.0 ** rng.integers(-12, -4, 200)
    v = cosine[:, None] * u + np.sqrt(1 - cosine**2)[:, None] * side
    rows, cols = e._near(u, v, 0.9)
    exact = (u[:, None, :] * v[None, :, :]).sum(2) >= 0.9
    assert set(zip(rows.tolist(), cols.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(exact))))
    assert 0 < (rows == cols).sum() < 200


def test_wider_columns_and_null_components(spark):
    rows = [(1, [1e300, 0.0]), (2, [1e-300, 1e-310]), (3, [None, 1.0]), (4, [0.0, -0.0])]
    got = sorted(e.embedding_components(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect())
    assert [(r["id"], r["n_links"], r["component_id"]) for r in got] == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]
