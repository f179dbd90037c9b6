import re
from fractions import Fraction
from math import ceil, floor

import pytest

from talus.llm import mixing


def brute_pattern(parts, period):
    placed, out = dict.fromkeys(parts, 0), []
    for slot in range(period):
        due = [(ceil(Fraction((placed[s] + 1) * period, q)), s) for s, q in sorted(parts.items()) if placed[s] < q and floor(Fraction(placed[s] * period, q)) <= slot]
        _, best = min(due)
        out.append((best, placed[best]))
        placed[best] += 1
    return out


@pytest.mark.parametrize("parts", [{"a": 7, "b": 2, "c": 1}, {"a": 3, "b": 3, "c": 3, "d": 1}, {"x": 10}, {f"s{i}": 1 for i in range(10)}])
def test_pattern_is_earliest_deadline_first_and_stays_within_a_block(spark, parts):
    got = mixing.pattern(spark.createDataFrame(list(parts.items()), "source string, parts long"), 10).orderBy("slot").collect()
    assert [(r["source"], r["k"]) for r in got] == brute_pattern(parts, 10)
    done = dict.fromkeys(parts, 0)
    for t, r in enumerate(got):
        done[r["source"]] += 1
        assert all(abs(done[s] - Fraction(q * (t + 1), 10)) < 1 for s, q in parts.items())


def test_mix_is_whole_and_keeps_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 16)
    rows = [(i, "hot" if i % 3 else ["b", None, "c"][i // 3 % 3], 0, "x") for i in range(900)] + [(None, "b", 0, "y"), (4, "hot", 0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, rank int, block string")
    weights = spark.createDataFrame([("hot", 5.0), ("b", 2.0), (None, 2.0), ("c", 1.0), ("none", 0.0)], "source string, weight double")
    got = mixing.mix_sources(docs, weights, period=10, block_docs=4).collect()
    assert len(got) == len(rows)
    places = [r["position"] for r in got]
    assert len(set(places)) == len(places)
    inside = [r for r in got if r["in_mix"]]
    horizon = max(r["slot"] for r in inside) + 1
    full = {}
    for r in inside:
        full.setdefault(r["slot"], set()).add(r["position"] - 4 * r["slot"])
    # Only the last block of a source may be shorter.
    assert all(places == set(range(len(places))) for places in full.values()) and set(full) == set(range(horizon))
    assert sum(len(places) < 4 for places in full.values()) <= 4
    for t in range(1, horizon + 1):
        for s, q in (("hot", 5), ("b", 2), (None, 2), ("c", 1)):
            blocks = {r["slot"] for r in inside if r["source"] == s and r["slot"] < t}
            assert abs(len(blocks) - Fraction(q * t, 10)) < 1
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_small_sources_are_not_left_out(spark):
    docs = spark.createDataFrame([(i, f"s{i % 5}") for i in range(40)], "doc_id long, source string")
    assert mixing.mix_sources(docs).where("in_mix").count() == 40


def test_every_source_with_a_weight_has_its_slots(spark, monkeypatch):
    """Many small sources beside a large one: their blocks follow by exact deadlines, and none
    falls a block behind its share of the slots that they have together."""
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i % 30}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = spark.createDataFrame([("hot", 70.0), *[(f"t{i}", 1.0 if i % 2 else 0.5) for i in range(30)], ("gone", 0.0)], "source string, weight double")
    got = mixing.mix_sources(docs, weights, period=20, block_docs=1).collect()
    assert len(got) == 640 and None not in [r["slot"] for r in got] and len({r["slot"] for r in got}) == 640
    small = sorted((r["slot"], r["source"], r["block"]) for r in got if r["source"] != "hot")
    due = sorted(((r["block"] + 1) / (1.0 if int(r["source"][1:]) % 2 else 0.5), r["source"], r["block"]) for r in got if r["source"] != "hot")
    assert [x[1:] for x in small] == [x[1:] for x in due]
    parts = {r["source"]: r["parts"] for r in mixing.whole_parts(weights, 20).collect()}
    assert parts == {"hot": 15, None: 5}
    done = dict.fromkeys((f"t{i}" for i in range(30)), 0)
    for n, (_, name, _) in enumerate(small[:120], 1):
        done[name] += 1
        for s, k in done.items():
            share = (1.0 if int(s[1:]) % 2 else 0.5) / 22.5
            assert n * share - 1 - 1e-9 < k < n * share + 1 + 30 * share  # never a block behind


def test_weights_empty_tables_and_sources_without_weight(spark):
    got = mixing.whole_parts(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", -1.0)], "source string, weight double"), 10).collect()
    assert sorted((r["source"], r["parts"]) for r in got) == [("a", 4), ("b", 3), ("c", 3)]
    docs = spark.createDataFrame([(1, "a"), (2, "z")], "doc_id long, source string")
    some = mixing.mix_sources(docs, spark.createDataFrame([("a", 1.0)], "source string, weight double"), block_docs=1)
    assert sorted((r["id"], r["slot"], r["in_mix"]) for r in some.collect()) == [(1, 0, True), (2, None, False)]
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    assert not re.search("Python|Pandas|Arrow", mixing.mix_sources(docs)._jdf.queryExecution().toString())
