import datetime as dt

import pytest
from pyspark.sql import functions as F

from talus.functions import gates, scoring, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("phrase", "ok", "label"),
    [
        ("Italian required for this role.", False, "language_required"), ("Italian (fluent) is a plus, but not required.", True, None), ("Fluent German and English.", False, "fluent_language"),
        ("Native English speaker", True, None), ("You are a native speaker of English", True, None), ("native speaker wanted", False, "native_speaker"), ("", True, None), ("abcd", True, None), (None, True, None),
        ("German required " + "x" * 60 + " is a plus here", True, None), ("German required " + "x" * 80 + " is a plus", False, "language_required"),
        ("German required" + " " * 81 + "is a plus", True, None), ("Dutch-speaking role", False, "language_speaking_role"),
        ("C1 French", False, "c1c2_language"), ("French is nice to have", True, None),
    ],
)
def test_language_gate(spark, phrase, ok, label):
    got = spark.createDataFrame([(phrase,)], "t string").select(gates.language_gate("t").alias("g")).first()["g"]
    assert (got["ok"], got["label"]) == (ok, label)


@pytest.mark.parametrize(
    ("phrase", "ok", "label"),
    [("EU citizenship required", False, "eu_citizenship_required"), ("No visa sponsorship.", False, "no_visa_sponsorship"), ("We offer visa sponsorship", True, None), ("We cannot sponsor visas", False, "cannot_sponsor"), ("Work permit is required", False, "work_permit_required")],
)
def test_visa_gate(spark, phrase, ok, label):
    got = spark.createDataFrame([(phrase,)], "t string").select(gates.visa_gate("t").alias("g")).first()["g"]
    assert (got["ok"], got["label"]) == (ok, label)


@pytest.mark.parametrize(
    ("title", "track", "ok", "reason"),
    [
        ("Senior Product Manager", None, True, "always_accept"), ("Director of Sales", None, False, "hard_reject_title"), ("VP Growth", None, False, "vp_reject"), ("HR Business Partner", None, False, "partner_reject"),
        ("Senior Engineer", None, False, "soft_reject_no_accept"), ("Senior Internship Lead", None, True, "accept_title"), ("Engineer", None, False, "no_accept_signal"),
        ("HR Analytics Manager Intern", "A", True, "intern_accept"), ("Analyst", "B", False, "seniority_reject"), ("Wizard", "A", False, "no_accept_signal"),
    ],
)
def test_seniority(spark, title, track, ok, reason):
    got = one(spark, gates.seniority_by_track(F.col("t"), F.lit(""), F.col("k")), t=title, k=track)
    assert (got["ok"], got["reason"]) == (ok, reason)


@pytest.mark.parametrize(
    ("place", "focus", "ok", "reason"),
    [("Milano, Italy", ["it", "nl"], True, "in_focus"), ("Remote", ["it"], True, "remote_in_focus"), ("Remote, US", ["it"], False, "outside_focus"), ("Bucharest, Romania", ["it"], False, "outside_focus"), ("", None, True, "no_location"), ("MÜNCHEN", None, True, "eu"), ("New York", None, False, "non_eu"), ("Anywhere, USA", None, True, "remote_worldwide"), ("Atlantis", None, False, "unknown_reject")],
)
def test_geography(spark, place, focus, ok, reason):
    got = one(spark, gates.geography(F.col("p"), focus), p=place)
    assert (got["ok"], got["reason"]) == (ok, reason)


def test_names_hashes_and_masks(spark):
    assert one(spark, text.norm_company(F.col("n")), n="ACME  Holding GmbH") == "acme"
    assert one(spark, text.norm_company(F.col("n")), n="GmbH") == ""
    assert one(spark, text.hash_bucket(F.lit("exp1"), F.col("u")), u="unit-A") == 1903743207
    assert one(spark, text.mask_email(F.col("t")), t="write to ann@example.com now") == "write to a***@example.com now"
    assert spark.createDataFrame([("call +39 333 123 4567",), (None,)], "t string").select(text.mask_phone("t")).collect()[0][0] == "call ***67"
    assert one(spark, text.slugify(F.col("t")), t=" AI & Product—Lead ") == "ai-product-lead"
    assert one(spark, text.strip_html(F.col("t")), t="<p>A&amp;B</p>\n<b>c&nbsp;d</b>") == "A&B c d"
    day = dt.date(2026, 3, 1)
    for raw, want in (("3 days ago", dt.date(2026, 2, 26)), ("2 weeks ago", dt.date(2026, 2, 15)), ("1 month ago", dt.date(2026, 1, 30)), ("5 hours ago", day), ("2026-01-05T10:00", dt.date(2026, 1, 5)), ("soon", None)):
        assert one(spark, text.posted_date(F.col("r"), F.lit(day)), r=raw) == want


def test_scores(spark):
    assert one(spark, scoring.track_alignment(F.col("c")), c="ai_strategy") == 30
    assert one(spark, scoring.track_alignment(F.col("c")), c="nothing") == 0
    assert one(spark, scoring.skill_score(F.lit(3), F.lit(None).cast("double"))) == 15
    assert one(spark, scoring.skill_score(F.lit(3), F.lit(20.0))) == 18
    assert one(spark, scoring.skill_score(F.lit(0), F.lit(20.0))) == 0
    assert one(spark, scoring.adjusted(F.lit(95), F.lit(40))) == 100
    assert one(spark, scoring.proficiency(F.lit(2), F.lit(3), F.lit(0.5))) == 58.0
    full = {"mba_relevance": 15, "track_alignment": 30, "company_quality": 15, "intl_friendliness": 10, "total_score": 100, "visa_accessibility": 40, "visa_friendliness": 10, "job_id": 1}
    row = scoring.composite(scoring.eight_metrics(spark.createDataFrame([tuple(full.values())], list(full)))).first()
    assert (row["composite"], row["tier"], row["effort"], row["roi"]) == (100.0, 1, 0, 100)
    only = spark.createDataFrame([(100, 0, 0, 0, 0, 0)], list(scoring.COMPOSITE))
    assert scoring.composite(only).first()["composite"] == 30.0
    tiers = spark.createDataFrame([(65.0,), (64.99,), (50.0,), (49.99,)], ["interview_prob"]).select((F.col("interview_prob") / 0.3).alias("interview_prob"), *[F.lit(0).alias(c) for c in list(scoring.COMPOSITE)[1:]])
    assert [r["tier"] for r in scoring.composite(tiers).collect()] == [1, 2, 2, 3]


def test_gates_read_text_behind_markup(spark):
    rows = [
        (1, "<p><strong>Italian</strong>&nbsp;(fluent)</p>"), (2, "<b>Italian</b>&nbsp;<i>required</i>"), (3, "Italian&nbsp;language required"), (4, "<b>Italian</b> is a <i>plus</i>"),
        (5, "<li>No&nbsp;visa</li> <li>sponsorship</li>"), (6, None), (7, ""),
    ]
    got = {r["i"]: (r["l"], r["v"]) for r in spark.createDataFrame(rows, "i int, t string").select("i", gates.language_gate("t")["ok"].alias("l"), gates.visa_gate("t")["ok"].alias("v")).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (False, True), 4: (True, True), 5: (True, False), 6: (True, True), 7: (True, True)}


def test_every_country_may_be_a_focus(spark):
    frame = spark.createDataFrame([(x,) for x in ("Athens, Greece", "Tallinn", "Padova", "Breda", "Remote", "Remote, Riga")], "place string")
    greek = {r[0]: r[1] for r in frame.select("place", gates.geography(F.col("place"), ["gr", "ee"])["ok"]).collect()}
    assert greek == {"Athens, Greece": True, "Tallinn": True, "Padova": False, "Breda": False, "Remote": True, "Remote, Riga": False}
    assert {r[0] for r in frame.where(~gates.outside_focus(F.col("place"), ["it", "nl"])).collect()} == {"Padova", "Breda", "Remote"}


def test_gates_search_only_for_what_can_match():
    """Texts without a stem of a pattern aren't searched, and those that repeat are judged once."""
    import re
    import time

    import pandas as pd

    from talus.functions import gates

    tables = {"language": gates.LANGUAGE_GATE, "visa": gates.VISA_GATE}
    said = ["Italian required here", "fluent in French", "C1 German", "mother-tongue", "Native speaker of English", "native speaker", "local language is required", "lengua materna", "EU citizens only: open to EU citizens",
            "must be an EU citizen", "must hold work permit", "right to work is required", "no visa sponsorship", "will not sponsor", "\u017fwiss permit is required", "work authorisation needed", "candidates must have permission to work"]
    for name, table in tables.items():
        compiled = gates._compiled(name, table)
        got = gates._judge(pd.Series([*said, None]), compiled)
        for text, found in zip(said, got["label"]):
            first = next((n for n, p in compiled if p.search(text)), None)
            assert found == first, text
    text = "plain words of an advert for a house by the river " * 4000
    start = time.process_time()
    gates._judge(pd.Series([text + str(i % 2) for i in range(40)]), gates._compiled("language", gates.LANGUAGE_GATE))
    assert time.process_time() - start < 3 and re
