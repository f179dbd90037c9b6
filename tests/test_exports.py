"""Report tables: fixed columns, order on disk, derived fields, checks."""

import csv
import datetime as dt
import glob

from pyspark.sql import functions as F

from talus.operators import exports


def test_country_code_and_label(spark):
    rows = [("Milano, Italy", "it", "Italy"), ("Duke Street", "gb", "United Kingdom"), (None, "eu", "Unknown"), ("  ", "eu", "Unknown"), ("Remote", "eu", "Remote/EU"), ("Anywhere", "eu", "Remote/EU"),
            ("\tKraków ", "eu", "Poland"), (" Atlantis ", "eu", "Atlantis"), ("Zürich", "eu", "Switzerland"), ("Vienna or Berlin", "de", "Germany")]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string").select("p", exports.country_code(F.col("p")).alias("c"), exports.country_label(F.col("p")).alias("l"))
    assert [(r.c, r.l) for r in df.collect()] == [r[1:] for r in rows]
    assert len(exports.COUNTRY_CODES) == 36


def jobs(spark):
    base = dict.fromkeys(exports.SCORED_COLUMNS) | {"job_id": 0, "description": "", "fetched_date": dt.date(2026, 1, 1)}
    rows = [
        base | {"job_id": 1, "title": "Strategy Intern", "location": "Milan", "total_score": 95, "priority_bucket": "Apply Immediately", "url": "u1"},
        base | {"job_id": 2, "title": "Strategy Intern", "location": "London", "total_score": 85, "priority_bucket": "High Priority", "url": "u2"},
        base | {"job_id": 3, "title": "Manager", "location": "Rome", "total_score": 82, "url": "u3"},
        base | {"job_id": 4, "title": "Intern", "location": None, "total_score": 81, "priority_bucket": "High Priority", "description": "Italian required for this role.", "url": "u4"},
        base | {"job_id": 5, "title": "Intern", "location": "Turin", "total_score": None, "language_risk": "HIGH", "url": "u5"},
    ]
    kinds = {"job_id": "long", "total_score": "int", "fetched_date": "date", "posted_date": "date"}
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in base))


def test_filters_and_tables(spark, tmp_path):
    j = jobs(spark)
    ids = lambda **how: sorted(r.job_id for r in exports.report_rows(j, **how).collect())
    assert ids() == [1, 2, 3, 5] and ids(interns_only=True) == [1, 2, 5] and ids(focus=["it"]) == [1, 3, 5] and ids(reject_non_english=True) == [1, 2, 3]
    applied = spark.createDataFrame([(1, "Applied", "a", "2026-01-01"), (1, "Interview", "b", "2026-01-02"), (9, "Applied", "c", "2026-01-01")], "job_id long, status string, notes string, last_updated string")
    recommended = spark.createDataFrame([(1, "Apply Immediately", 1), (2, "Apply This Week", 2)], "job_id long, recommendation string, place int")
    tables = exports.report_tables(j, applied, recommended)
    exports.write_reports(tables, str(tmp_path / "r"))
    exports.write_reports(tables, str(tmp_path / "r"))  # again: replaced, not added to

    def read(name):
        out = []
        for f in sorted(glob.glob(f"{tmp_path}/r/{name}/part-*")):
            with open(f, newline="") as fh:
                out += list(csv.DictReader(fh))
        return out

    assert list(tables) == ["scored_jobs", "jobs_master", "apply_now", "this_week", "applications", "analytics", "summary"]
    assert list(read("jobs_master")[0]) == exports.MASTER_COLUMNS and [r["url"] for r in read("jobs_master")] == ["u1", "u2", "u3", "u5"]
    assert read("jobs_master")[0]["application_status"] == "Interview" and read("jobs_master")[1]["country"] == "United Kingdom"
    assert [r["url"] for r in read("scored_jobs")] == ["u1", "u2", "u4", "u3", "u5"]  # no bucket counts as Ignore
    assert [r["url"] for r in read("apply_now")] == ["u1"] and [r["url"] for r in read("this_week")] == ["u2"]
    assert [(r["bucket"], r["n"]) for r in read("summary")] == [("Apply Immediately", "1"), ("High Priority", "2"), ("Medium Priority", "0"), ("Low Priority", "0"), ("Ignore", "2"), ("Rejected", "0"), ("Total", "5")]
    assert len(read("applications")) == 2


def test_score_offenders_and_watchlist(spark):
    df = spark.createDataFrame([(1, 100.0, 0.0), (2, 101.0, -1.0), (3, None, 5.5), (4, float("nan"), 1.0)], "k int, a double, b double")
    got = {r.k: r.offenders for r in exports.score_offenders(df, "k", ["a", "b"]).collect()}
    assert got == {2: "a=101.0, b=-1.0", 3: "a=null, b=5.5", 4: "a=NaN"}
    rows = spark.createDataFrame([("ACME Ltd",), ("GmbH",), (None,), ("Other",)], "c string")
    watched = spark.createDataFrame([("Acme GmbH",), ("Inc",), (None,)], "n string")
    assert {r.c: r.watched for r in exports.on_watchlist(rows, "c", watched, "n").collect()} == {"ACME Ltd": True, "GmbH": False, None: False, "Other": False}
