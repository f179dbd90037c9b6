import re
from collections import Counter

import numpy as np

from talus.llm import license_scan as s


def tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    return re.findall(rb"[0-9a-z\x80-\xff]+", low)


def brute(texts):
    """(best licence, its score) of each text by dense vectors."""
    vocabulary = sorted({t for _, x in s.TEMPLATES for t in tokens(x)})
    df = {t: sum(t in set(tokens(x or "")) for x in texts) for t in vocabulary}
    n = len(texts)
    idf = {t: np.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}
    unknown = np.log(1 + n) + 1
    vectors = [{t: k * idf[t] for t, k in Counter(tokens(x)).items()} for _, x in s.TEMPLATES]
    out = []
    for text in texts:
        text = text or ""
        best = (0.0, None)
        for part in [*text.split("\n"), *re.split(r"\n(?<=\n\n)", text), text]:
            tf = Counter(tokens(part))
            norm = np.sqrt(sum((k * idf[t]) ** 2 if t in idf else k * unknown**2 for t, k in tf.items()))
            for (name, _), v in zip(s.TEMPLATES, vectors):
                if norm:
                    c = sum(tf[t] * idf[t] * x for t, x in v.items()) / norm / np.sqrt(sum(x * x for x in v.values()))
                    if c > best[0] + 1e-12:
                        best = (c, name)
        out.append(best)
    return out


TEXTS = [
    "import os\n# Licensed under the Apache License, Version 2.0.\nx = 1", "Released under the MIT License.", None, "", "no notice here at all\n\nnone",
    "Prose before it.\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files\n\nmore",
    "GNU General Public License, version 3", "the of and work is under this", "word " * 9000 + "\nLicensed under CC BY-NC 4.0.\n", "Lizenz: MIT", "ISC License, licensed under it.",
]


def test_cosines_match_brute_force(spark):
    rows = [(f"a/{i}.txt", t, 1.0, "x") for i, t in enumerate(TEXTS)]
    got = {r["path"]: r for r in s.own_licenses(spark.createDataFrame(rows, "path string, text string, score double, license string")).collect()}
    for i, (score, name) in enumerate(brute(TEXTS)):
        r = got[f"a/{i}.txt"]
        if score >= 0.6:
            assert (r["license"], round(r["score"], 9)) == (name, round(score, 9))
        else:
            assert r["license"] is None


def test_nearest_directory_with_a_licence_file(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("LICENSE", mit), ("r/COPYING", gpl + "\nmany other words follow here in this long file of notices"), ("r/a/b/f.py", "x"), ("r/a/LICENSE.txt", mit), ("r/a/g.py", "x"),
        ("q/h.py", None), ("r/k.py", "# Licensed under CC BY 4.0.\ncode"), ("top.py", "y"), (None, "z"), ("q/h.py", None), ("rr/a/x.py", ""),
    ]
    got = s.scan_licenses(spark.createDataFrame([(p, t, "e") for p, t in rows], "path string, text string, dir string")).collect()
    assert len(got) == len(rows)
    named = {r["path"]: (r["license"], r["origin"], r["inherited_from"]) for r in got}
    assert named["r/a/b/f.py"] == ("MIT", "inherited", "r/a") and named["r/a/g.py"] == ("MIT", "inherited", "r/a")
    assert named["q/h.py"] == named["top.py"] == named["rr/a/x.py"] == ("MIT", "inherited", "")
    assert named["r/k.py"][:2] == ("CC-BY-4.0", "own") and named["r/COPYING"][:2] == ("GPL-3.0", "own")
    assert named[None] == (None, "none", None)
    assert s.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def test_common_words_outside_the_templates_weigh_little(spark):
    """At 3,000 documents a common word in a notice must not hide it, as a word never seen
    would; and whole texts of any length are compared."""
    rows = [(f"a/{i}.txt", f"river house number n{i}") for i in range(3000)]
    rows += [("b/common.txt", "river house number " * 4 + "released under the MIT License"), ("b/rare.txt", "".join(f"rare{i} " for i in range(12)) + "released under the MIT License")]
    rows += [("c/LICENSE.txt", "Released\nunder\nthe\nMIT\nLicense\n" * 1000)]
    got = {r["path"]: r for r in s.own_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    texts = [x for _, x in rows]
    n, df = len(texts), Counter(t for x in texts for t in set(tokens(x)))
    idf = lambda t: np.log((1 + n) / (1 + df[t])) + 1
    line, notice = (Counter(tokens(x)) for x in (rows[3000][1], s.TEMPLATES[0][1]))
    length = lambda c: np.sqrt(sum((k * idf(t)) ** 2 for t, k in c.items()))
    want = sum(line[t] * k * idf(t) ** 2 for t, k in notice.items()) / length(line) / length(notice)
    assert got["b/common.txt"]["license"] == "MIT" and round(got["b/common.txt"]["score"], 9) == round(want, 9)
    assert got["b/rare.txt"]["license"] is None and got["a/7.txt"]["license"] is None
    assert got["c/LICENSE.txt"]["license"] == "MIT" and got["c/LICENSE.txt"]["is_license_file"] and got["c/LICENSE.txt"]["score"] > 0.99


def test_one_line_notice_is_no_licence_file(spark, monkeypatch):
    mit = "Released under the MIT License."
    rows = [("d/a.txt", mit), ("d/b.txt", "nothing here"), ("e/c.txt", "\n".join([mit] * 12)), ("e/f.txt", "nothing here")]
    frame = spark.createDataFrame(rows, "path string, text string")
    want = {"d/a.txt": ("MIT", False, "own"), "d/b.txt": (None, False, "none"), "e/c.txt": ("MIT", True, "own"), "e/f.txt": ("MIT", False, "inherited")}
    for most in (s.SMALL_DIRS, 0):  # broadcast, and by salts
        monkeypatch.setattr(s, "SMALL_DIRS", most)
        assert {r["path"]: (r["license"], r["is_license_file"], r["origin"]) for r in s.scan_licenses(frame).collect()} == want


def test_query_keeps_null_negative_and_repeated_ids(spark, tmp_path):
    from talus.llm.queries import QUERIES

    template = s.TEMPLATES[0][1]
    rows = [(None, template, "en", "web"), (-5, template, "en", "web"), (5, template, "en", "web"), (5, "plain words", "en", "web"), (7, None, None, None), (8, "", "en", None), (2**62, template, None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((r[0] for r in rows), key=repr)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.license for r in got if r.doc_id in (None, -5, 2**62)} == {s.TEMPLATES[0][0]}


def test_ties_between_templates_take_the_first(spark):
    templates = [("B", "alpha beta gamma delta"), ("A", "alpha beta gamma delta")]
    got = s.own_licenses(spark.createDataFrame([("a", "alpha beta gamma delta")], "path string, text string"), templates=templates).first()
    assert got.license == "B"
