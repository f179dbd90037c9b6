import zlib

import numpy as np

from talus.llm import quality_mil as q


def chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def test_passages_do_not_depend_on_neighbours():
    texts = ["", "a b c " * 100, " ", "Ünïcode, wörds!", "X", "one\ntwo\n" * 64]
    x, doc = q.passages(*chunk(texts))
    assert np.bincount(doc).tolist() == [1, 5, 1, 1, 1, 2]
    for i, t in enumerate(texts):
        alone, _ = q.passages(*chunk([t]))
        np.testing.assert_allclose(x[doc == i], alone, rtol=1e-5, atol=1e-6)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {"w1": rng.standard_normal((5, 4)), "b1": rng.standard_normal(4), "v": rng.standard_normal((4, 3)), "u": rng.standard_normal((4, 3)), "g": rng.standard_normal(3), "c": rng.standard_normal(4), "d": np.zeros(1)}
    x, doc, y = rng.standard_normal((7, 5)), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([0.0, 1.0, 1.0])
    loss = lambda: (lambda s: -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())(q._forward(p, x, doc)["score"])
    got = q._gradients(p, x, doc, y)
    for k in p:
        for i in np.ndindex(p[k].shape):
            p[k][i] += 1e-6
            up = loss()
            p[k][i] -= 2e-6
            slope = (up - loss()) / 2e-6
            p[k][i] += 1e-6
            assert abs(slope - got[k][i]) < 1e-6


def test_held_out_accuracy_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    good = lambda: " ".join(rng.choice(["river", "house", "and", "the", "walked", "slowly."], rng.integers(30, 300)))
    bad = lambda: " ".join(rng.choice(["BUY", "$$$", "NOW!!", "###"], rng.integers(30, 300)))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(400)]
    docs = [(i, t, "en", 9) for i, t, _ in rows] + [(1000, None, "x", 1), (1001, "", "x", 1), (None, good(), "x", 0), (5, rows[5][1], "en", 9), (1002, "word " * 90_000, "x", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, quality int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (7, 5), (9999, 1)], "doc_id long, quality int")
    got = q.quality_scores(frame, labels).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    for r in got:
        if r["id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7)
    wrong = [r for r in got if r["id"] in truth and r["predicted"] != truth[r["id"]]]
    assert len(wrong) <= 4
    assert len({r["score"] for r in got if r["id"] == 5}) == 1
    assert q.quality_scores(spark.createDataFrame([], frame.schema), labels).count() == 0
    none = q.quality_scores(frame, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_scores_match_a_naive_forward_pass():
    rng = np.random.default_rng(4)
    texts = ["", "One, two. " * 90, "BUY!! $$$ " * 40, "x", "Plain words here and there\n" * 70]
    x, doc = q.passages(*chunk(texts))
    model = q.fit(np.concatenate([x] * 3), np.concatenate([doc, doc + 5, doc + 10]), np.array([0, 1, 0, 0, 1] * 3, float))
    score, weight = q.score_passages(model, x, doc)
    p = {k: v.astype(float) for k, v in model.weights.items()}
    for i in range(len(texts)):
        codes, gates = [], []
        for row in x[doc == i]:
            h = np.tanh(np.clip((row - model.mean) / model.scale, -6, 6) @ p["w1"] + p["b1"])
            codes.append(h)
            gates.append(p["g"] @ (np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))))
        a = np.exp(np.array(gates) - max(gates))
        a /= a.sum()
        z = sum(k * h for k, h in zip(a, codes))
        np.testing.assert_allclose(score[i], 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))), rtol=1e-3, atol=1e-4)
        np.testing.assert_allclose(weight[doc == i], a, rtol=1e-3, atol=1e-4)


def test_fit_reads_whole_texts_within_its_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "fit", lambda x, doc, y: seen.append((len(x), np.bincount(doc).tolist(), y.tolist())) or "model")
    sizes = {i: 1 + i % 5 for i in range(40)} | {41: 400}
    docs = spark.createDataFrame([(i, " ".join(["word"] * (n * q.PASSAGE_WORDS - 3))) for i, n in sizes.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in sizes], "doc_id long, quality int")
    assert q.fit_on_labels(docs, labels) == "model"
    assert q.fit_on_labels(docs, labels, fit_total=30) == "model"
    free = [i for i in sizes if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(seen[0][1]) == sorted(sizes[i] for i in free)  # every passage of every document
    assert 25 < seen[1][0] <= 30 and all(n in (1, 2, 3, 4, 5) for n in seen[1][1])  # whole documents, none cut


def test_fit_does_not_depend_on_the_order_of_rows_that_share_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "fit", lambda x, doc, y: seen.append(x.tolist()) or "model")
    rows = [(1, f"text number {i} of one id, " * (i + 1)) for i in range(6)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for order in (rows, rows[::-1]):
        q.fit_on_labels(spark.createDataFrame(order, "doc_id long, text string").repartition(3), labels)
    assert seen[0] == seen[1]
