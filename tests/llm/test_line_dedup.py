import hashlib
import re

import numpy as np
import pytest

from talus.llm import line_dedup


def brute(rows, n):
    blank = "\x20\t\n\x0b\x0c\r"
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(blank))
    first, docs = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= n:
                docs.setdefault(key(line), set()).add(i)
                first[key(line)] = min(first.get(key(line), i), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(key(s)) >= n and len(docs[key(s)]) > 1 and first[key(s)] < i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("share", [1, 2000])
def test_matches_brute_force(spark, share, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)  # all lines cold, or most of them hot
    rng = np.random.default_rng(2)
    pool = ["The same Line of text", " the same line of text\t", "ÉCOLE de la ville", "école de la ville", "short", "", " ", "K" * 10, "k" * 10, "Kelvin K sign x", "kelvin k sign x", "a$b\\c regex.*"]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(0, 9)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "lone line here\n" * 3), (104, "x\ny\n" * 3000 + "The same line of text")]
    frame = spark.createDataFrame([(i, t, 0, "h") for i, t in rows], "doc_id long, text string, pos int, h1 string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in line_dedup.dedup_lines(frame).collect()}
    assert got == brute(rows, 10)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a common line\nx"), (1, "a common line\ny"), (2, "a common line"), (None, "a common line")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["kept_text"]) for r in line_dedup.dedup_lines(frame).collect())
    assert got == [(0, "a common line"), (1, "a common line\nx"), (1, "a common line\ny"), (2, "")]
    assert line_dedup.dedup_lines(spark.createDataFrame([], frame.schema)).count() == 0


def test_plan_is_native(spark):
    plan = line_dedup.dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_columns_may_be_named_like_the_operators_own(spark):
    line = "a line that both documents hold"
    rows = [(1, line, 7, "p", 1), (2, line + "\nown line of two", 8, "q", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id long, row string, pos int")
    got = sorted((r["doc_id"], r["id"], r["row"], r["pos"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(frame).collect())
    assert got == [(1, 7, "p", 1, 0, line), (2, 8, "q", 2, 1, "own line of two")]
