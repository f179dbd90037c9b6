"""Profiles, resumes, conversations and run health as table jobs (survey C19-C22, D16, D17,
E16, E25, E26, E30, E34, F12, H7, H10, I6, I7)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.functions import gates
from talus.functions.text import PROFICIENCY_BANDS, band, percent, slugify
from talus.operators import similarity

# ------------------------------------------------------------------ fixed values
# Vocabularies and phrases of resumes and eligibility; equal results need them as they are.
HARD_SKILLS = [
    "python", "sql", "excel", "tableau", "power bi", "machine learning", "data analysis", "product management", "agile", "scrum", "java", "aws",
    "financial modeling", "a/b testing", "roadmapping", "stakeholder management",
]
SOFT_SKILLS = ["leadership", "communication", "teamwork", "problem solving", "negotiation", "presentation", "collaboration", "adaptability"]
TRANSFERABLE_SKILLS = ["project management", "analytical thinking", "strategy", "research", "mentoring", "budgeting"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DATE_RANGE = r"([A-Za-z]{3,9})?\s*((?:19|20)\d{2})\s*[-–—to]+\s*(?:(present|current|now)|([A-Za-z]{3,9})?\s*((?:19|20)\d{2}))"
DEGREE = r"\b(ph\.?d|doctorate|m\.?b\.?a|m\.?sc|master(?:'s)?|b\.?sc|bachelor(?:'s)?|b\.?a|b\.?eng|diploma)\b"
CERTIFICATE = ["certified", "certificate", "certification", "license", "licensed", "pmp", "cfa", "scrum master", "aws certified"]
ENGLISH_OFFICIAL = (
    r"(?:working|official|business|primary|main|corporate)\s+language\s+(?:is\s+)?english|english\s+(?:is\s+(?:the\s+)?)?(?:working|official|business|primary|main)\s+(?:\w+\s+)?language"
    r"|all\s+(?:communication|meetings?|documents?|work)\s+(?:is\s+|are\s+)?(?:conducted\s+)?in\s+english|english[-\s](?:speaking|only)\s+(?:office|workplace|environment|company|team)"
)
ENGLISH_STRONG = (
    r"english\s+(?:is\s+)?(?:required|mandatory|essential)|proficient\s+in\s+english|fluent\s+(?:in\s+)?english|strong\s+english\s+(?:communication\s+)?(?:skills?|proficiency)"
    r"|excellent\s+english|advanced\s+english|english\s+proficiency\s+(?:is\s+)?(?:required|essential|expected)"
)
LANGUAGE_WISH = (
    gates.LANGUAGE + r"\s+(?:language\s+)?(?:is\s+)?(?:a\s+)?(?:plus|bonus|advantage|asset|preferred|preferable|desirable|nice[- ]to[- ]have|welcome)"
    r"|knowledge\s+of\s+(?:the\s+)?(?:local\s+language|" + gates.LANGUAGE + r")|local\s+language\s+(?:is\s+)?(?:a\s+)?(?:plus|bonus|advantage|preferred|desirable|nice[- ]to[- ]have)"
)
VISA_OFFERED = (
    r"visa\s+sponsorship\s+(?:is\s+)?(?:available|provided|offered|possible|supported)|(?:we\s+(?:do\s+)?)?(?:provide|offer|support|sponsor|cover)\s+(?:visa(?:s)?|work\s+(?:authoris?ation|permit))"
    r"|will\s+(?:fully\s+)?sponsor\s+(?:(?:your\s+)?visa|work\s+authoris?ation)|sponsorship\s+(?:is\s+)?(?:available|provided|offered)|visa\s+(?:assistance|support|help)\s+(?:is\s+)?(?:available|provided|offered)"
)
RELOCATION = r"relocation\s+(?:package|support|assistance|stipend|allowance|benefit|costs?)|we\s+(?:offer|provide|support|cover)\s+relocation|relocation\s+(?:costs?\s+)?(?:will\s+be\s+)?covered"
WELCOMED = (
    r"international\s+(?:candidates?|students?|applicants?)\s+(?:are\s+)?(?:welcome|encouraged|invited|considered)"
    r"|open\s+to\s+(?:candidates?\s+(?:from\s+)?)?(?:worldwide|globally|internationally|all\s+(?:countries|backgrounds|nationalities))|welcome\s+(?:applications?\s+from\s+)?(?:candidates?\s+(?:from\s+)?)?(?:worldwide|globally|internationally)"
)
EU_PREFERRED = (
    r"EU\s+(?:citizenship|citizen|passport|national(?:ity)?|work\s+(?:authoris?ation|permit))\s+(?:is\s+)?(?:preferred|a\s+plus|an?\s+advantage|desirable|advantageous)"
    r"|right\s+to\s+work\s+(?:in\s+\w+\s+)?(?:is\s+)?(?:preferred|a\s+plus|advantageous)"
)
TEAM = (
    r"international\s+(?:team|environment|company|colleagues?|workforce|office|culture)|diverse\s+(?:team|workforce|environment|colleagues?|group|culture)"
    r"|multicultural\s+(?:team|environment|company|workplace)|global\s+(?:team|workforce|environment)|cosmopolitan\s+(?:team|workplace|environment)|people\s+from\s+\d+\+?\s+(?:countries|nationalities|backgrounds)"
)
GLOBAL_COMPANY = (
    r"global\s+(?:company|organization|corporation|firm|enterprise|business|group)|multinational\s+(?:company|organization|corporation|firm|group)|presence\s+in\s+\d+\+?\s+countries"
    r"|operates?\s+(?:in|across)\s+(?:\d+\+?\s+)?countries|worldwide\s+(?:offices?|operations?|presence|footprint)|Fortune\s+(?:500|100|50|Global\s+\d+)"
)
EXPATS = r"expat(?:riate)?[-\s](?:friendly|community|network|support)|highly\s+international\s+(?:team|environment|company)|diverse\s+and\s+inclusive\s+(?:workplace|environment|team|company)"
HIGH_BARRIERS = ["c1c2_language", "native_speaker", "native_language", "language_native", "mother_tongue", "mother_tongue_specific"]


# ------------------------------------------------------------------ eligibility
def eligibility(df: DataFrame, text: str, profile: dict[str, str] | None = None) -> DataFrame:
    """language_accessibility, visa_accessibility, english_environment, international_signals,
    eligibility_score and eligibility_status. `profile` names the columns visa, english and
    international of what is known of the company, used where the text is silent."""
    gated = df.withColumns({"__l": gates.language_gate(text), "__v": gates.visa_gate(text)})
    t = F.coalesce(F.col(text), F.lit(""))
    has, soft = lambda p: gates.has(t, p), F.col("__l.softened")
    language = (
        F.when(~F.col("__l.ok"), 0).when(has(ENGLISH_OFFICIAL), 40).when(has(ENGLISH_STRONG), 35)
        .when(F.arrays_overlap(soft, F.array(*[F.lit(x) for x in HIGH_BARRIERS])), 18).when(F.array_contains(soft, "b2_language"), 22)
        .when((F.size(soft) > 0) | has(LANGUAGE_WISH), 26).otherwise(30)
    )
    visa = F.when(~F.col("__v.ok"), 0).when(has(VISA_OFFERED), 40).when(has(RELOCATION), 35).when(has(WELCOMED), 30).when(has(EU_PREFERRED), 18).otherwise(28)
    english = F.when(has(ENGLISH_OFFICIAL), 10).when(has(TEAM), 7).when(has(ENGLISH_STRONG), 5).otherwise(0)
    others = has(TEAM) | has(WELCOMED) | has(VISA_OFFERED)
    signals = F.when(has(GLOBAL_COMPANY), F.when(has(EXPATS) | others, 10).otherwise(8)).when(has(EXPATS), 7).when(others, 5).otherwise(0)
    if profile:
        known = lambda k: F.col(profile[k])
        visa = F.when((visa == 28) & known("visa").isNotNull(), known("visa") * 4).otherwise(visa)
        english = F.when((english == 0) & known("english").isNotNull(), known("english")).otherwise(english)
        signals = F.when((signals == 0) & known("international").isNotNull(), known("international")).otherwise(signals)
    ok = F.col("__l.ok") & F.col("__v.ok")
    parts = {"language_accessibility": language, "visa_accessibility": visa, "english_environment": english, "international_signals": signals}
    zero = {k: F.when(ok, v).otherwise(0).cast("int") for k, v in parts.items()}
    out = gated.withColumns(zero | {"eligibility_status": F.when(ok, "ELIGIBLE").otherwise("REJECTED"), "rejection": F.coalesce("__l.label", "__v.label")})
    return out.withColumn("eligibility_score", sum((F.col(k) for k in list(parts)[1:]), F.col("language_accessibility"))).drop("__l", "__v")


# Notes of an explanation by score component, each from a number of points on.
NOTES = {
    "track_alignment": [(24, "Strong primary track alignment (AI/Product/Strategy)"), (10, "Secondary track alignment"), (None, "Unclassified role")],
    "skill_match": [(15, "strong skill keyword overlap"), (8, "moderate skill overlap")],
    "mba_relevance": [(10, "MBA-caliber opportunity signals present")],
    "company_quality": [(13, "Tier 1 company"), (11, "Tier 2 company")],
    "pivot_bonus": [(4, "explicit AI × strategy intersection in JD")],
}


def explanation(df: DataFrame) -> Column:
    """A sentence of ordered threshold phrases from the score components: of each component
    the first note whose threshold it reaches."""
    notes = [_first_note(tuple((F.lit(True) if least is None else F.col(component) >= least, said) for least, said in table)) for component, table in NOTES.items()]
    return F.concat(F.concat_ws(". ", *notes), F.lit("."))


def _first_note(cases: tuple) -> Column:
    out = F.lit(None).cast("string")
    for condition, said in reversed(cases):
        out = F.when(condition, F.lit(said)).otherwise(out)
    return out


# ------------------------------------------------------------------ resumes and skills
RANGES = T.ArrayType(T.StructType([T.StructField("start_year", T.IntegerType()), T.StructField("end_year", T.IntegerType()), T.StructField("months", T.IntegerType()), T.StructField("open", T.BooleanType())]))


@F.pandas_udf(RANGES)
def date_ranges(texts: pd.Series) -> pd.Series:
    """Month and year ranges; a missing month is January at the start, December at the end."""
    pattern, month = re.compile(DATE_RANGE, re.I), {m: i for i, m in enumerate(MONTHS, 1)}

    def read(text: str | None) -> list[dict]:
        out = []
        for m1, y1, now, m2, y2 in pattern.findall(text or ""):
            if now:
                out.append({"start_year": int(y1), "end_year": None, "months": 0, "open": True})
            else:
                months = (int(y2) - int(y1)) * 12 + month.get(m2[:3].lower(), 12) - month.get(m1[:3].lower(), 1)
                out.append({"start_year": int(y1), "end_year": int(y2), "months": max(0, months), "open": False})
        return out

    return texts.map(read)


def tenure(ranges: Column, present_year: int) -> Column:
    """Months of all ranges; open ones count from their start year."""
    one = lambda r: F.when(r["open"], F.greatest(F.lit(0), (F.lit(present_year) - r["start_year"]) * 12)).otherwise(r["months"])
    return F.aggregate(ranges, F.lit(0), lambda t, r: t + one(r))


def skills_of(text: Column) -> Column:
    """array of (skill, name, category, confidence, mentions), most confident first."""
    from talus.functions.text import count_of

    low = F.lower(F.coalesce(text, F.lit("")))
    entries = []
    for category, terms in (("hard", HARD_SKILLS), ("soft", SOFT_SKILLS), ("transferable", TRANSFERABLE_SKILLS)):
        for term in terms:
            n = count_of(low, F.lit(term))
            confidence = F.least(F.lit(1.0), F.bround(0.6 + 0.2 * n, 4))
            entries.append(F.when(n > 0, F.struct((-confidence).alias("o"), F.lit(term).alias("name"), slugify(F.lit(term)).alias("skill"), F.lit(category).alias("category"), confidence.alias("confidence"), n.alias("mentions"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*entries))), lambda s: F.struct(s["skill"].alias("skill"), s["name"].alias("name"), s["category"].alias("category"), s["confidence"].alias("confidence"), s["mentions"].alias("mentions")))


def normalise_resumes(df: DataFrame, text: str, language: str, present_year: int) -> DataFrame:
    """skills, experience_months, education, certifications, confidence and missing."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(F.split(t, "\n"), F.trim)
    hinted = F.lit(False)
    out = df.withColumns({"__ranges": date_ranges(text), "skills": skills_of(F.col(text))})

    def certificate(line: Column) -> Column:
        hit = hinted
        for hint in CERTIFICATE:
            hit = hit | F.contains(F.lower(line), F.lit(hint))
        return hit

    out = out.withColumns({
        "experience_months": tenure(F.col("__ranges"), present_year),
        "education": F.transform(F.filter(lines, lambda x: x.rlike("(?iu)" + DEGREE)), lambda x: F.regexp_extract(x, "(?iu)" + DEGREE, 1)),
        "certifications": F.filter(lines, certificate),
    })
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    parse = F.bround(0.5 * F.least(F.lit(1.0), words / 120.0) + 0.5 * F.when(F.coalesce(F.col(language), F.lit("Unknown")).isin("Unknown", "Other"), 0.5).otherwise(1.0), 4)
    filled = sum(((F.size(c) > 0).cast("int") for c in ("__ranges", "education", "certifications")), (F.size("skills") > 0).cast("int"))
    missing = F.array_compact(F.array(F.when(F.size("skills") == 0, "skills"), F.when(F.col("experience_months") == 0, "experience"), F.when(F.size("education") == 0, "education")))
    return out.withColumns({"confidence": F.bround(0.5 * parse + 0.5 * filled / 4.0, 4), "missing": missing}).drop("__ranges")


def skill_profiles(df: DataFrame, key: str, skills: str, months: str) -> DataFrame:
    """(key, skill, category, proficiency, band) of every skill of a profile."""
    rows = df.select(key, F.col(months).alias("m"), F.explode(skills).alias("s"))
    mentions = F.greatest(F.lit(1), F.bround(F.col("s.confidence") * 3))
    score = F.least(F.lit(100.0), F.least(F.lit(40.0), 12.0 * mentions) + F.least(F.lit(40.0), 8.0 * F.col("m") / 12.0) + 20.0 * F.col("s.confidence"))
    out = rows.select(key, F.col("s.skill").alias("skill"), F.col("s.category").alias("category"), F.bround(score, 2).alias("proficiency"))
    return out.withColumn("band", band(F.col("proficiency"), PROFICIENCY_BANDS))


# ------------------------------------------------------------------ memory
def remember(queries: DataFrame, memories: DataFrame, tenant: str, as_of: Column, k: int, least: float) -> DataFrame:
    """(query_id, memory_id, similarity, rank): the k memories of the query's tenant that
    haven't expired and whose bags of words are most alike, at `least` > 0 or more. queries:
    (query_id, tenant, text); memories: (memory_id, tenant, text, expires_at)."""
    alive = memories.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    q, m = similarity.bags(queries, ["query_id", tenant], "text"), similarity.bags(alive, ["memory_id", tenant], "text")
    out = similarity.sparse_top_k(q, m, "query_id", "memory_id", tenant, k, least)
    return out.select(F.col("query").alias("query_id"), F.col("memory").alias("memory_id"), "similarity", "rank")


def clusters(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(name, cluster): each name with the first leader of a single greedy pass that it is
    similar to. pairs: (a, b) of similar names."""
    return similarity.greedy_leaders(pairs, names).select("name", F.col("leader").alias("cluster"))


# ------------------------------------------------------------------ health and cost
def run_rates(runs: DataFrame, detail: str, duration: str, run_id: str, last: int = 200) -> DataFrame:
    """Cache-hit and reuse rates, mean duration and failures of the last runs, from JSON."""
    schema = "research_researched long, research_cached long, documents_generated long, documents_reused long, errors array<string>"
    rows = runs.orderBy(F.desc(run_id)).limit(last).select(F.coalesce(duration, F.lit(0.0)).alias("d"), F.from_json(detail, schema).alias("j"))
    total = lambda name: F.sum(F.coalesce(F.col(f"j.{name}"), F.lit(0)))
    g = rows.agg(
        F.count(F.lit(1)).alias("runs"), F.avg("d").alias("d"), total("research_researched").alias("a"), total("research_cached").alias("b"), total("documents_generated").alias("g"),
        total("documents_reused").alias("r"), F.sum(F.coalesce(F.size("j.errors"), F.lit(0)).cast("long")).alias("failures"),
    )
    return g.select(
        "runs", percent(F.col("b"), F.col("a") + F.col("b")).alias("cache_hit_rate"), percent(F.col("r"), F.col("g") + F.col("r")).alias("reuse_rate"),
        F.bround(F.coalesce("d", F.lit(0.0)), 1).alias("avg_duration"), F.coalesce("failures", F.lit(0)).alias("failures"),
    )


def spend_advice(costs: DataFrame, model: str, cost: str, cached: str, saved: str) -> DataFrame:
    """(advice): few cache hits, one model that dominates, savings; else that all is well."""
    models = costs.groupBy(model).agg(F.sum(cost).alias("c"))
    top = models.agg(F.max(F.struct("c", model)).alias("t"), F.sum("c").alias("all"))
    t = costs.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col(cached).cast("long")).alias("hits"), F.sum(saved).alias("saved")).crossJoin(F.broadcast(top))  # a row each
    rate, share = F.col("hits") / F.col("calls"), F.try_divide(F.col("t.c"), F.col("all"))
    as_percent = lambda x: F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))
    said = F.array_compact(F.array(
        F.when((F.col("calls") > 0) & (rate < 0.2), F.concat(F.lit("Low cache hit rate ("), as_percent(rate), F.lit(")"))),
        F.when(share > 0.6, F.concat(F.col(f"t.{model}"), F.lit(" drives "), as_percent(share), F.lit(" of spend"))),
        F.when(F.col("saved") > 0, F.lit("Caching already saves cost")),
    ))
    return t.select(F.explode(F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("No cost optimizations detected")))).alias("advice"))


def model_benchmarks(df: DataFrame, model: str, latency: str, cost: str, quality: str) -> DataFrame:
    """Means per model, with flags for the fastest, cheapest and best one."""
    g = df.groupBy(model).agg(F.bround(F.avg(latency), 4).alias("latency"), F.bround(F.avg(cost), 4).alias("cost"), F.bround(F.avg(quality), 4).alias("quality"))
    best = g.agg(F.min_by(model, F.struct("latency", model)).alias("f"), F.min_by(model, F.struct("cost", model)).alias("c"), F.max_by(model, F.struct("quality", model)).alias("q"))  # one row
    out = g.crossJoin(F.broadcast(best))
    return out.select(model, "latency", "cost", "quality", (F.col(model) == F.col("f")).alias("fastest"), (F.col(model) == F.col("c")).alias("cheapest"), (F.col(model) == F.col("q")).alias("best"))


def metric_rollup(df: DataFrame, name: str, kind: str, labels: list[str], value: str, time: str) -> DataFrame:
    """(name, labels, value, n, mean): counters add up, gauges take the last, histograms
    give their sum, number and mean."""
    g = df.groupBy(name, kind, *labels).agg(F.sum(value).alias("s"), F.max_by(value, time).alias("l"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"))
    shown = F.when(F.col(kind) == "gauge", F.col("l")).otherwise(F.col("s"))
    return g.select(name, kind, *labels, F.bround(shown, 4).alias("value"), "n", F.when(F.col(kind) == "histogram", F.bround("m", 4)).alias("mean"))


def invariants(prioritised: DataFrame, recommended: DataFrame, top: DataFrame, key: str, tier: str) -> DataFrame:
    """(check, bad): recommendations and top rows must be known, tiers must be 1 to 3."""
    loose = lambda a, b, name: a.select(key).join(b.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("check"), "bad")
    tiers = prioritised.agg((F.count(F.lit(1)) - F.sum(F.coalesce(F.col(tier).isin(1, 2, 3), F.lit(False)).cast("long"))).alias("bad")).select(F.lit("tiers").alias("check"), "bad")
    return loose(recommended, prioritised, "recommended").unionByName(loose(top, recommended, "top")).unionByName(tiers)
