"""Trigram profiles: counts and sums of tasks against plain Python, odd rows against the SQL."""

import math
import random
from collections import Counter

import duckdb
import pytest

from talus.operators import language
from talus.plans import postings

ALPHABETS = {"en": "abcdefgh", "fr": "abcdéèêç", "ru": "абвгдежз", "zh": "水火木金土日月山", "x": "ab𐐨𐐩ßş"}


def fixture(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(ALPHABETS))
        words = ["".join(rng.choices(ALPHABETS[lang], k=rng.randint(1, 7))) for _ in range(rng.randint(1, 60))]
        rows.append((i, rng.choice([" ", " 12, ", "\n--"]).join(words).title() if i % 3 else "".join(words), lang if i % 11 else None))
    return [*rows, (n, None, "en"), (n + 1, "", "fr"), (n + 2, " \n 123 " * 20, "en")]


def grams(text):
    clean = " " + "".join(c if c.isalpha() else " " for c in text.lower())
    clean = " " + " ".join(clean.split()) + " "
    return Counter(clean[i : i + 3] for i in range(len(clean) - 2))


@pytest.mark.parametrize("step, held, tabled, sent", [(1 << 18, 500_000, 128, 50_000), (200, 100, 3, 50_000), (1, 1, 128, 50), (1 << 18, 500_000, 128, 0)])
def test_profiles_equal_plain_counts(spark, monkeypatch, step, held, tabled, sent):
    for name, value in (("STEP", step), ("HELD", held), ("TABLED", tabled), ("BROADCAST_ROWS", sent)):
        monkeypatch.setattr(language, name, value)
    rows = fixture(90)
    df = spark.createDataFrame(rows, "id long, t string, lang string")
    counts = {}
    for _, text, lang in rows:
        if lang and text:
            counts.setdefault(lang, Counter()).update(grams(text))
    want = {}
    for lang, c in counts.items():
        total = sum(c.values())
        for g, n in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: language.PROFILE]:
            want[lang, g] = math.log(n * language.PROFILE * 10 / total + 1)
    profiles = language.fit_profiles(df, "t", "lang")
    got = {(r.lang, r.gram): r.weight for r in profiles.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-12 for k, w in want.items())
    found = language.detect(df, profiles, "id", "t")
    if sent > len(want):
        assert "explode" not in found._jdf.queryExecution().toString()
    best = {}
    for i, text, _ in rows:
        sums = {lang: round(sum(n * want.get((lang, g), 0.0) for g, n in grams(text or "").items()), 9) for lang in counts}
        top = max((s, lang) for lang, s in sums.items())
        best[i] = top[1] if len((text or "").strip(" ")) >= language.LEAST and top[0] > 0 else "Unknown"
    assert {r.id: r.language for r in found.collect()} == best and len(set(best.values())) > 4


def test_odd_ids_equal_sql(spark, tmp_path):
    text = {"en": "the quick brown fox jumps over the lazy dog and then they went to the house", "de": "der schnelle braune fuchs springt und dann gingen sie alle nach haus zurueck"}
    rows = [(i, text["en" if i % 3 else "de"] + " " + str(i), "en" if i % 3 else "de") for i in range(12)]
    rows += [(4, text["de"] * 2, "de"), (None, text["de"], "de"), (-3, text["en"], "en"), (-2, text["en"], None), (20, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(postings.LANGUAGE).fetchall()
    got = postings.language_id(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) == 17
