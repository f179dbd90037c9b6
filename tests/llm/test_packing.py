import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talus.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

TEXTS = st.text(alphabet=st.sampled_from(list("aB1 ,.'\n\t  é字 　$#s<|>")), max_size=60) | st.text(max_size=30)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=8))
def test_ids_equal_the_tokenizers_library(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)] + ["it's <|endoftext|> x", " a  b ", "end "]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing._units().encode(texts)]
    assert got == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bin_completion_is_optimal_on_small_cases(sizes):
    bins = packing.bin_completion(sizes, 20, nodes=50_000)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 20 for b in bins)
    fewest = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= fewest[0]:
            return
        if i == len(sizes):
            fewest[0] = len(rooms)
            return
        for k, r in enumerate(rooms):
            if r >= sizes[i] and r not in rooms[:k]:
                place(i + 1, [*rooms[:k], r - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, 20 - sizes[i]])

    place(0, [])
    assert len(bins) == fewest[0]
    assert packing.lower_bound(np.array(sizes), 20) <= fewest[0]


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    rng = np.random.default_rng(1)
    texts = [None, "", "x " * 5000, *[" ".join(rng.choice(["the", "quick", "zygote", "\n"], rng.integers(1, 400))) for _ in range(400)]]
    rows = [(i, t, i, "z") for i, t in enumerate(texts)] + [(5, texts[5], 0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, sequence_id string")
    got = packing.pack_documents(docs, 256).toPandas()
    for i, t in enumerate(texts):
        ids = [*WHOLE.encode(t or "", add_special_tokens=False).ids, 0]
        mine = got[got.id == i].drop_duplicates(["piece", "start"]).sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine))) and mine.length.sum() == len(ids)
        assert (mine.length.iloc[1:] == 256).all() and mine.length.max() <= 256
        for r in mine.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
    bound = packing.lower_bound(got.length.to_numpy(), 256)
    assert got.sequence_id.nunique() <= 1.03 * bound
    assert packing.pack_documents(spark.createDataFrame([], docs.schema)).count() == 0


def test_search_goes_on_after_a_success():
    """Sizes for which best fit is bins away from the bound, in more bins than one search takes."""
    sizes = [6, 6, 5, 5, 4, 4] * 30  # 15 + 15 a pair of sixes, fives and fours: two full bins of 15 each
    bins = packing.bin_completion(sizes, 15, nodes=20_000)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 15 for b in bins)
    fit = packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 15)
    assert len(bins) < len(fit) - 1 or len(fit) == packing.lower_bound(np.array(sizes), 15)


def test_sequences_follow_an_order(spark, monkeypatch):
    """Shards are stretches of the order, and sequence ids rise with it, whatever the ids."""
    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    monkeypatch.setattr(packing, "POOL_SEQUENCES", 0)
    rng = np.random.default_rng(2)
    rows = [((i * 7919) % 1000, " ".join(["the"] * int(rng.integers(1, 90))), i) for i in range(1000)] + [(None, None, 1000), (2000, "x " * 600, 1001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long").repartition(5)
    got = packing.pack_documents(docs, 256, order=F.col("at")).toPandas()
    alone = packing.pack_documents(docs, 256).toPandas()
    assert sorted(map(str, got[["id", "piece", "start", "length", "ids_crc32"]].values)) == sorted(map(str, alone[["id", "piece", "start", "length", "ids_crc32"]].values))
    number = {r[0]: r[2] for r in rows}
    got["at"] = [number[None if pd.isna(i) else int(i)] for i in got.id]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
        assert s["at"].is_monotonic_increasing and s["at"].max() - s["at"].min() < 64
    longest = got.sort_values(["length", "at", "piece"], ascending=[False, True, True]).groupby("sequence_id", sort=True)["at"].first()
    assert longest.is_monotonic_increasing and got.sequence_id.nunique() > 100
