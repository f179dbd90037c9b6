"""URL filters: parts, rules and the model against plain Python; odd rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from talus.llm import url_filter as uf


@pytest.fixture(scope="module")
def weights(spark):
    return uf.fit_urls(uf.labelled_urls(spark))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def buckets(host, path):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in path)
    codes = [ord(c) for c in f"^{host} {low}$"]
    out = []
    for n in uf.GRAMS:
        for s in range(len(codes) - n + 1):
            h = codes[s]
            for k in range(1, n):
                h = (h * uf.HASH_BASE + codes[s + k]) % uf.HASH_MOD
            out.append((h + n) % uf.BUCKETS)
    return out


def rule_of(host, path, rules):
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, None)


URLS = [
    None, "", "no scheme", "http://", "://", "https://WWW.Example.NET/en/12?x=1#y", "https://example.net/de/", "http://example.net", "http://notexample.net/en/", "http://xexample.com/de/1",
    "http://a.example.com/de/x", "http://example.com/DE/x", "ftp://b.org/fr/", "http://org/fr/1", "http://net/", "a://b://c.net/x", "http://u:p@h.net:80/x", "http://h.org#f/fr/", "http://ÄÖ.org/fr/Straße",
    "http://x.org/\n/y?z", "http://😀.example.com/😀😀", "http://free-bets.example.com/en/1", "http://tionsh.example.org/en/1", "h://" + "a.b" * 50_000 + "/" + "c" * 100_000,
]


def test_parts_rules_and_model(spark, weights):
    rows = [(i, u, "kept", 1) for i, u in enumerate(URLS)] + [(1, "", "again", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, buckets int")
    got = uf.filter_urls(df, weights).orderBy("page_id").collect()
    assert len(got) == len(rows) and "buckets" in got[0]
    for r in got:
        host, path = parts(r.url)
        assert (r.host, r.path) == (host, path), r.url
        rule, verdict = rule_of(host, path, uf.RULES)
        b = buckets(host, path)
        p = 1 / (1 + math.exp(-(weights[0] + sum(weights[1 + x] for x in b) / math.sqrt(max(1, len(b))))))
        assert abs(r.block_ppm - p * 1e6) <= 2
        assert (r.rule, r.verdict) == (rule, verdict or ("block" if p >= uf.BLOCK_FROM else "allow")), r.url


def test_longest_rule_wins_and_ties_are_fixed(spark, weights):
    rules = [("b.c", "/x", "allow"), ("a.b.c", "/", "block"), ("b.c", "/", "block"), ("b.c", "/", "allow"), ("c", "/x/yz", "allow")]
    urls = ["h://a.b.c/x/yz", "h://a.b.c/", "h://b.c/q", "h://b.c/x", "h://q.c/x/yz1", "h://q.c/"]
    got = uf.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), weights, rules).collect()
    for r in got:
        want = rule_of(*parts(r.url), rules)
        assert r.rule == want[0] and (want[0] is None or r.verdict == want[1]), r.url
    with pytest.raises(ValueError):
        uf.fitting_rule(F.lit("a"), F.lit("/"), [("a", "/", "allow")] * (uf.MAX_RULES + 1))


def test_fit_equals_plain_gradient_descent(spark, weights):
    rows = sorted(uf.labelled_rows())
    vectors = []
    for url, _ in rows:
        b = buckets(*parts(url))
        x = {-1: 1.0}
        for k in b:
            x[k] = x.get(k, 0) + 1 / math.sqrt(len(b))
        vectors.append(x)
    w = dict.fromkeys(range(-1, uf.BUCKETS), 0.0)
    for _ in range(uf.STEPS):
        step = dict.fromkeys(w, 0.0)
        for x, (_, y) in zip(vectors, rows):
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                step[k] += (y - p) * v
        w = {k: v * (1 - uf.RATE * uf.RIDGE) + uf.RATE / len(rows) * step[k] for k, v in w.items()}
    assert max(abs(w[b] - weights[b + 1]) for b in w) < 1e-8


def test_labelled_urls_are_learnt_and_held_out_names_too(spark, weights):
    got = uf.filter_urls(uf.labelled_urls(spark), weights, rules=()).where((F.col("label") == 1) != (F.col("verdict") == "block"))
    assert got.count() == 0
    new = [
        ("https://casino-palace.example.com/en/7", "block"), ("http://www.adult-pics.example.org/", "block"), ("http://poker-bets.example.org/en/3", "block"),
        ("http://blog.pill-shop.example.com/en/3", "block"), ("http://river-walks.example.com/de/2", "allow"), ("http://old-library.example.net/", "allow"),
        ("http://hatter-math.example.com/en/3", "allow"),
    ]
    out = uf.filter_urls(spark.createDataFrame(new, "url string, want string"), weights, rules=()).where("verdict <> want").collect()
    assert len(out) <= 2 and all(r.want == "block" for r in out)  # names that share few n-grams with the table


def test_empty_tables_and_bounds(spark, weights):
    assert uf.filter_urls(spark.createDataFrame([], "page_id long, url string"), weights).count() == 0
    assert set(uf.fit_urls(spark.createDataFrame([], "url string, label int"))) == {0.0}
    assert set(uf.fit_urls(spark.createDataFrame([("h://a", None)], "url string, label int"))) == {0.0}
    with pytest.raises(ValueError):
        uf.fit_urls(spark.createDataFrame([("h://a", 1)] * (uf.MAX_LABELLED + 1), "url string, label int"))


def test_no_shuffle_and_no_python(spark, weights):
    plan = uf.filter_urls(spark.createDataFrame([("h://a",)], "url string"), weights)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
