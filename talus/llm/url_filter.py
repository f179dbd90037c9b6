"""URL filters with DataFrame functions only: host and path rules, and a logistic regression
on hashed character n-grams of host and path for the URLs that no rule fits.

The model is fitted on a small labelled URL table inside Spark. With fewer labelled rows
than buckets the fit runs in the span of the labelled vectors: one coefficient per labelled
row, full gradient steps over their Gram matrix, and the weights of the buckets come out as
the coefficients' sum. Judging a URL reads its own row only; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import cycle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import free_name
from talus.llm.line_dedup import LOWER, UPPER

#: Buckets of the hashed n-grams (a prime), and the n-grams' lengths in code points.
BUCKETS = 4093
GRAMS = (3, 4)
#: Multiplier and modulus of the polynomial hash of code points.
HASH_BASE, HASH_MOD = 65_599, 2_147_483_647
#: The fit: full gradient steps on the mean loss, step size, ridge penalty.
STEPS, RATE, RIDGE = 400, 4.0, 1e-4
#: Greatest number of labelled rows (the Gram matrix has its square) and of rules.
MAX_LABELLED, MAX_RULES = 400, 1000
#: URLs that the model holds to be unwanted with this probability or more are blocked.
BLOCK_FROM = 0.55

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its path.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

# Names of sites of the labelled table, invented: kinds of site that a crawl blocks or keeps.
BLOCKED_NAMES = (
    "casino-royal mega-casino casino-bonus lucky-win win-jackpot poker-win slots-bonus bet-now sports-bets free-betting online-bets pills-online cheap-meds "
    "cheap-tabs pharma-pills diet-pills adult-chat adult-videos xxx-cams hot-adult sex-chat spam-links link-farm seo-spam spam-mailer content-farm ads-server "
    "ad-tracker click-track track-pixel banner-ads pop-ads payday-loans quick-loan free-money free-prizes crypto-doubler get-rich-fast cheap-replica "
    "replica-watches keygen-crack warez-crack phish-login malware-kit fake-diploma casino betting pills adult spam ads freewin"
).split()
ALLOWED_NAMES = (
    "garden-club library news-room recipe-book weather school-board science history music-hall travel-notes football museum theatre physics open-data town-hall "
    "fire-brigade sea-view book-club city-bikes the-reader forest-walk mathematics chemistry river-trust choir-practice painting knitting bakery hill-farmers "
    "train-times bird-watch astronomy language-lab grammar poetry short-stories village-green harbour-log tennis chess-league student-union research-group "
    "archive parish-council old-maps bridge-building carpentry health-advice nursing children-books encyclopedia dictionary law-review economy parliament "
    "thistle tithing thenar thorough nation motion station theories other-things athens ether thrush"
).split()


def labelled_rows() -> list[tuple[str, int]]:
    """The small labelled table, label 1 for unwanted. Both labels go through the same
    prefixes, domains and paths, so that only the names tell them apart."""
    rows = []
    for names, label in ((BLOCKED_NAMES, 1), (ALLOWED_NAMES, 0)):
        prefix, domain, path = cycle(("", "www.", "m.", "blog.")), cycle(("com", "org", "net")), cycle(("/en/12", "/de/870.html", "/fr/3/", "/es/455", "/"))
        rows += [(f"https://{next(prefix)}{name}.example.{next(domain)}{next(path)}", label) for name in names]
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "url string, label int")


# ------------------------------------------------------------------ parts of a URL
def host_of(url: Column) -> Column:
    """From behind the first :// to the next /, ? or # or the end, A-Z in lower case; '' for a null url or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, to the next ? or # or the end; '' as for the host."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(rest, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. Of rules of one length
    that with the longer host counts, then a blocking one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string, verdict:string>")
    # From the weakest rule to the strongest: what comes later stands outside.
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


# ------------------------------------------------------------------ features
def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets (from 0) of all n-grams of `^host path$`, A-Z in lower case, repeats included."""
    text = F.concat(F.lit("^"), host, F.lit(" "), F.translate(path, UPPER, LOWER), F.lit("$"))
    codes = F.transform(F.split(text, "", -1), lambda c: F.ascii(c).cast("long"))

    def of(size: int, c: Column) -> Column:
        def hashed(start: Column) -> Column:
            out = F.get(c, start - 1)
            for k in range(1, size):
                out = (out * HASH_BASE + F.get(c, start - 1 + k)) % HASH_MOD
            return ((out + size) % BUCKETS).cast("int")

        # The text has one code point more than host and path together have, and the two marks.
        last = F.char_length(host) + F.char_length(path) + 3 - size + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), hashed)).otherwise(F.array().cast("array<int>"))

    # The codes are bound once, by a transform over the one-element array that holds them.
    return F.flatten(F.transform(F.array(codes), lambda c: F.concat(*[of(n, c) for n in GRAMS])))


def url_buckets(urls: DataFrame, url: str) -> DataFrame:
    parts = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    return parts.withColumn("buckets", gram_buckets(F.col("host"), F.col("path")))


# ------------------------------------------------------------------ model
def fit_urls(labelled: DataFrame, url: str = "url", label: str = "label") -> list[float]:
    """The intercept, then the weight of each bucket.

    A URL's vector has count / sqrt(all n-grams) in each bucket, and 1 for the intercept.
    Rows with a null label are left out; repeated rows weigh as often as they occur. More
    than MAX_LABELLED rows raise an error, an empty table gives weights of zero.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("double").alias("y")).limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs")
    if not rows:
        return [0.0] * (BUCKETS + 1)
    spark = labelled.sparkSession
    order = sorted(rows, key=lambda r: (r.url or "", r.y))
    numbered = spark.createDataFrame([(i, r.url, r.y) for i, r in enumerate(order)], "i int, url string, y double").coalesce(1)
    held = url_buckets(numbered, "url").select("i", "y", F.explode("buckets").alias("bucket"), F.size("buckets").alias("m"))
    vectors = held.groupBy("i", "bucket").agg((F.count(F.lit(1)) / F.sqrt(F.first("m"))).alias("x"))
    other = vectors.select(F.col("i").alias("j"), "bucket", F.col("x").alias("z"))
    gram = vectors.join(other, "bucket").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    n = len(order)
    # One row of the Gram matrix per labelled URL, the intercept's 1 included.
    by_row = gram.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("ks"))
    matrix = numbered.join(by_row, "i").select("i", "y", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("ks", j), F.lit(0.0)) + 1.0).alias("ks"))
    whole = matrix.agg(F.sort_array(F.collect_list(F.struct("i", "y", "ks"))).alias("rows"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, z: x * z), F.lit(0.0), lambda s, x: s + x)

    def step(alpha: Column, _: Column) -> Column:
        def moved(r: Column) -> Column:
            error = r["y"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-dot(r["ks"], alpha)))
            return F.get(alpha, r["i"]) * (1 - RATE * RIDGE) + error * (RATE / n)

        return F.transform(F.col("rows"), moved)

    alphas = whole.select(F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array_repeat(F.lit(0.0), n), step)).alias("i", "alpha"))
    # The intercept is bucket -1, with value 1 for every URL.
    spanned = vectors.unionByName(numbered.select("i", F.lit(-1).alias("bucket"), F.lit(1.0).alias("x")))
    parts = spanned.join(F.broadcast(alphas), "i").groupBy("bucket").agg(F.sum(F.col("alpha") * F.col("x")).alias("w"))
    # A row per bucket at most: BUCKETS + 1 numbers, whatever the size of the corpus.
    found = {r.bucket: r.w for r in parts.collect()}
    return [found.get(b, 0.0) for b in range(-1, BUCKETS)]


def block_probability(buckets: Column, weights: Sequence[float]) -> Column:
    """Probability of label 1. The weights are one literal of BUCKETS + 1 numbers."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b + 1))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(weights[0])) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1))))))


def filter_urls(
    pages: DataFrame, weights: Sequence[float], rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", block_from: float = BLOCK_FROM
) -> DataFrame:
    """`pages` with the columns host, path, rule, verdict (allow or block) and block_ppm (the
    model's probability in millionths, rounded down), which replace columns of those names.

    The longest rule that fits decides, else the model. A null url and one without :// have
    an empty host and path, fit no rule whose path isn't empty, and are judged by the model;
    repeated rows give a row each, an empty table none. All rows are judged in their own
    place: the plan has no shuffle.
    """
    made = ("host", "path", "rule", "verdict", "block_ppm")
    names = [c for c in pages.columns if c not in made]
    row = free_name([*names, *made, "buckets", "fitting", "p"], "row")
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col(f"`{url}`").alias("judged_url"))
    judged = url_buckets(own, "judged_url").withColumn("p", block_probability(F.col("buckets"), weights)).withColumn("fitting", fitting_rule(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("p") >= block_from, "block").otherwise("allow")
    return judged.select(
        *[F.col(f"{row}.`{c}`") for c in names],
        "host",
        "path",
        F.col("fitting.rule").alias("rule"),
        F.coalesce(F.col("fitting.verdict"), by_model).alias("verdict"),
        F.floor(F.col("p") * 1e6).alias("block_ppm"),
    )


# ------------------------------------------------------------------ SQL
def filter_sql(labelled: Sequence[tuple[str, int]], rules: Sequence[tuple[str, str, str]] = RULES, block_from: float = BLOCK_FROM) -> str:
    """The whole operator over `pages` as one statement, the fit included."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({text(u)}, {y})" for u, y in labelled)
    ruled = ", ".join(f"({text(h)}, {text(p)}, {text(v)})" for h, p, v in rules)
    gram = {}
    for n in GRAMS:
        out = "c[s]"
        for k in range(1, n):
            out = f"(({out} * {HASH_BASE} + c[s + {k}]) % {HASH_MOD})"
        gram[n] = f"list_transform(range(1, len(c) - {n} + 2), lambda s: ({out} + {n}) % {BUCKETS})"
    return f"""
WITH RECURSIVE labelled AS (
  SELECT row_number() OVER (ORDER BY url, y) - 1 AS i, url, y::DOUBLE AS y FROM (VALUES {values}) v(url, y)
), pages_ AS (
  SELECT row_number() OVER () AS i, page_id, url FROM pages
), urls AS (
  SELECT 'l' AS kind, i, url FROM labelled UNION ALL SELECT 'p', i, url FROM pages_
), parts AS (
  SELECT kind, i, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM urls
), codes AS (
  SELECT kind, i, list_transform(string_split('^' || host || ' ' || translate(path, '{UPPER}', '{LOWER}') || '$', ''), lambda x: ascii(x)::BIGINT) AS c FROM parts
), grams AS (
  SELECT kind, i, {" || ".join(gram[n] for n in GRAMS)} AS b FROM codes
), held AS (
  SELECT kind, i, len(b) AS m, unnest(b) AS b FROM grams
), vectors AS (
  SELECT i, b, count(*) / sqrt(any_value(m)) AS x FROM held WHERE kind = 'l' GROUP BY i, b
), k AS (
  SELECT v.i, u.i AS j, sum(v.x * u.x) AS k FROM vectors v JOIN vectors u ON v.b = u.b GROUP BY v.i, u.i
), matrix AS (
  SELECT a.i, a.y, list(coalesce(k.k, 0) + 1 ORDER BY z.i) AS ks FROM labelled a, labelled z LEFT JOIN k ON k.i = a.i AND k.j = z.i GROUP BY a.i, a.y
), whole AS (
  SELECT list({{'y': y, 'ks': ks}} ORDER BY i) AS r, count(*) AS n FROM matrix
), fit AS (
  SELECT 0 AS t, list_transform(r, lambda x: 0::DOUBLE) AS a FROM whole
  UNION ALL
  SELECT t + 1, list_transform(r, lambda x, q: a[q] * {1 - RATE * RIDGE!r} + (x.y - 1 / (1 + exp(-list_dot_product(x.ks, a)))) * ({RATE!r} / n))
  FROM fit, whole WHERE t < {STEPS}
), alphas AS (
  SELECT unnest(a) AS a, generate_subscripts(a, 1) - 1 AS i FROM fit WHERE t = {STEPS}
), weights AS (
  SELECT b, sum(a * x) AS w FROM vectors v JOIN alphas a ON v.i = a.i GROUP BY b
), scored AS (
  SELECT h.i, 1 / (1 + exp(-((SELECT sum(a) FROM alphas) + coalesce(sum(w), 0) / sqrt(any_value(m))))) AS p
  FROM held h LEFT JOIN weights w ON h.b = w.b WHERE kind = 'p' GROUP BY h.i
), rules AS (
  SELECT * FROM (VALUES {ruled}) r(h, p, v)
), fits AS (
  SELECT u.i, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM parts u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) WHERE kind = 'p' GROUP BY u.i
)
SELECT g.page_id, u.host, u.path, f.rule, coalesce(f.v, CASE WHEN s.p >= {block_from!r} THEN 'block' ELSE 'allow' END) AS verdict, floor(s.p * 1e6)::BIGINT AS block_ppm
FROM pages_ g JOIN parts u ON u.kind = 'p' AND u.i = g.i JOIN scored s ON s.i = g.i LEFT JOIN fits f ON f.i = g.i"""
