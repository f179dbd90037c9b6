"""The stages on a small fixture, each held against brute force on its own input."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline as p
from talus.llm import mixing


def fixture(spark, folder):
    rng = np.random.default_rng(12)
    words = ["river", "house", "and", "the", "walked", "slowly", "green", "paper", "seven", "window", "under", "music"]
    line = lambda n: " ".join(rng.choice(words, n)) + f" {rng.integers(1e9)}"
    docs, labels = [], []
    for i in range(240):
        if i % 6 == 0:
            text, good = " ".join(rng.choice(["BUY!!", "$$$", "CHEAP!!", "###"], 60)), 0
        else:
            text, good = "\n".join([line(30), "this line is in every document", line(25)]), 1
        docs.append((i, text, "en", f"s{i % 4 if i % 3 else 0}", len(text)))
        labels.append((i, good, 0))
    copy = "\n".join(line(40) for _ in range(3))
    near = copy.rsplit(" ", 1)[0] + " changed"
    docs += [(300, copy, "en", "s1", len(copy)), (301, near, "en", "s1", len(near)), (302, None, None, None, None)]
    docs += [(303, "x y z " + docs[1][1].split("\n")[0][5:], "fr", "s2", 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return frame


def test_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    monkeypatch.setattr(mixing.mix_sources, "__defaults__", (None, "source", "doc_id", 100, 4))
    docs = fixture(spark, str(tmp_path))
    assert [k for k, _ in p.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    good = p.quality_classifier(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    bad = {i for i in range(0, 240, 6)}
    assert not kept & bad and len(kept & set(range(240))) == 240 - len(bad)

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    lines = p.line_dedup_stage(spark, good, str(tmp_path))
    assert lines.columns == docs.columns
    want, got = brute_lines(rows, 10), {r["doc_id"]: r for r in lines.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i]["text"].count("\n") + 1 == max(1, want[i][0] - want[i][1]) and got[i]["n_chars"] == len(got[i]["text"])
    assert sum("in every document" in r["text"] for r in got.values()) == 1

    single = p.simhash_near_dedup(spark, lines, str(tmp_path))
    assert single.columns == docs.columns
    fps = [(i, brute_fingerprint(r["text"], 4)) for i, r in got.items()]
    parts = brute_components(sorted(fps), lambda x, y: bin(x ^ y).count("1") <= 4)
    assert {r["doc_id"] for r in single.collect()} == set(parts.values())

    mixed = p.source_mixing(spark, single, str(tmp_path))
    assert mixed.columns == docs.columns
    places = {r["id"]: r["position"] for r in mixing.mix_sources(single).collect()}
    ids = [r["doc_id"] for r in mixed.collect()]
    assert ids == sorted(places, key=places.get) and len(set(ids)) == len(ids) > 0

    packed = p.best_fit_packing(spark, mixed, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(ids)
    assert all(r["offset"] + r["length"] <= 2048 for r in packed)
    empty = next((r for r in packed if r["length"] == 1), None)
    assert empty is None or empty["ids_crc32"] == zlib.crc32(b"\0\0\0\0")


def test_run_is_the_stages_one_after_another(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing.mix_sources, "__defaults__", (None, "source", "doc_id", 100, 4))
    docs = fixture(spark, str(tmp_path))
    want = docs
    for _, stage in p.STAGES:
        want = stage(spark, want, str(tmp_path))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = p.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.select(F.countDistinct("doc_id")).first()[0] > 100


def test_empty_tables(spark, tmp_path):
    docs = fixture(spark, str(tmp_path / "full")).where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_mixing_keeps_every_document(spark, tmp_path, monkeypatch):
    """A source of one block does not end the mix, and sources too small for a part of the
    period (more than there are slots) come in their turn."""
    monkeypatch.setattr(mixing.mix_sources, "__defaults__", (None, "source", "doc_id", 10, 4))
    rows = [(i, f"t{i}", "en", "hot" if i < 600 else "mid" if i < 900 else None if i < 910 else f"tiny{i}", 1) for i in range(925)]
    docs = spark.createDataFrame([*rows, (None, "no id", "en", "hot", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix_sources(docs).collect()
    assert sum(r["in_mix"] for r in got) < 926
    mixed = [tuple(r) for r in p.source_mixing(spark, docs, str(tmp_path)).collect()]
    assert sorted(mixed, key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    place = {r["id"]: r["position"] for r in got}
    assert len(set(place.values())) == 926 and [place[r[0]] for r in mixed] == sorted(place.values())
    weights = {"hot": 601**0.7, "mid": 300**0.7, None: 10**0.7}
    early = [r[3] for r in mixed[:400]]
    assert abs(early.count("mid") / early.count("hot") - weights["mid"] / weights["hot"]) < 0.25
    # Sources of one document, each below a part of the period, share its slots in turn, after the three blocks of the null source.
    tiny = sorted(r["slot"] for r in got if r["id"] is not None and r["id"] >= 910)
    assert len(set(tiny)) == 15 and tiny[0] < 40 and max(b - a for a, b in zip(tiny, tiny[1:])) <= 10


def test_columns_may_be_named_like_the_operators_own(spark, tmp_path):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", 1, i, "x", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, row string, slot long")
    assert sorted(map(tuple, p.source_mixing(spark, docs, str(tmp_path)).collect())) == rows


def test_packing_follows_the_mix(spark, tmp_path, monkeypatch):
    """Also after the mix was written in files that Spark reads in another order."""
    monkeypatch.setattr(mixing.mix_sources, "__defaults__", (None, "source", "doc_id", 10, 4))
    monkeypatch.setattr(p.packing, "SHARD_PIECES", 32)
    monkeypatch.setattr(p.packing, "POOL_SEQUENCES", 0)
    rows = [(i, "word " * (1 + i * 37 % 900), "en", "a" if i < 300 else "b", 1) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    mixed = p.source_mixing(spark, docs, str(tmp_path))
    ids = [r["doc_id"] for r in mixed.collect()]
    place = {i: k for k, i in enumerate(ids)}
    mixed.write.parquet(f"{tmp_path}/mixed")
    for frame in (spark.read.parquet(f"{tmp_path}/mixed"), mixed):
        packed = p.best_fit_packing(spark, frame, str(tmp_path)).toPandas()
        assert sorted(packed.doc_id) == sorted(ids)
        packed["place"] = packed.doc_id.map(place)
        spans = packed.groupby("sequence_id")["place"].agg(["min", "max"])
        assert (spans["max"] - spans["min"]).max() < 32
        assert packed.sort_values(["length", "place"], ascending=[False, True]).groupby("sequence_id")["place"].first().is_monotonic_increasing
    # The order of another table gives other sequences.
    other = p.best_fit_packing(spark, docs, str(tmp_path)).toPandas()
    assert set(other.groupby("sequence_id").doc_id.agg(frozenset)) != set(packed.groupby("sequence_id").doc_id.agg(frozenset))
