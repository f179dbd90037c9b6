"""Scoring formulas over posting columns (survey group H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.gates import TRACK_B, has

# ------------------------------------------------------------------ fixed values
# Points, weights, phrases and thresholds of the score; equal results need them as they are.
TRACK_POINTS = {
    "ai_strategy": 30, "product_management": 28, "digital_transformation": 26, "business_strategy": 24, "workforce_strategy": 18,
    "hr_transformation": 16, "people_analytics": 14, "hr_analytics": 12, "workforce_planning": 10, "talent_acquisition": 6,
}
MBA_PHRASES = [
    (4, r"mba"), (3, r"graduate programme?|graduate program|rotational programme?|rotational program|graduate rotation|rotational scheme"),
    (3, r"leadership (programme?|program|development|track|academy)"),
    (2, r"c-suite|c suite|board level|board reporting|executive visibility|senior leadership team|senior stakeholder"),
    (2, r"transformation (project|initiative|programme?|program)|strategic (project|initiative|assignment)"),
    (1, r"structured (thinking|analysis|approach|problem.solving)|strategic frameworks?|hypothesis.driven"),
    (1, r"high.?impact|high.?visibility|cross.?functional|global (exposure|experience)"),
]
VISA_PHRASES = [
    (10, r"visa sponsorship|will sponsor|sponsoring visa|visa support|work authorization provided|provides? visa"),
    (7, r"work permit|sponsoring work permit|permit sponsorship|relocation support|relocation assistance|relocation package"),
    (6, r"eu blue card|blue card|skilled worker visa|tier ?2 visa"),
    (4, r"global (team|company|offices|organization|workforce)|international (team|company|environment|offices)|multicultural|multi-national|diverse (team|workforce)"),
    (3, r"fully remote|remote.?first|work from anywhere|location.?flexible|remote eligible|distributed team"),
]
PIVOT_TITLE = r"ai product|product ai|ai strategy|digital transformation strategy|ai.{1,15}strategy|strategy.{1,15}ai|product (strategy|management).{1,15}(ai|digital)|(ai|digital).{1,15}product (strategy|management)"
PIVOT_TEXT = r"ai.{1,30}product|product.{1,30}ai|ai.{1,30}strategy|strategy.{1,30}ai"
TECH_TITLE = r"technology strategy|tech strategy|platform strategy|data strategy|digital strategy|innovation strategy|ai roadmap|transformation strategy"
TECH_TEXT = r"technology strategy|tech strategy|digital strategy|innovation strategy|data strategy|platform strategy"
BRIDGE_TEXT = r"ai.{1,20}(mba|graduate|intern|internship)|(mba|graduate|intern|internship).{1,20}(ai|product|strategy|digital)"
TARGET_CITIES = [
    "milan", "milano", "london", "amsterdam", "berlin", "paris", "barcelona", "dublin", "zurich", "zürich", "munich", "münchen", "vienna", "wien",
    "stockholm", "brussels", "lisbon", "madrid", "oslo", "copenhagen", "helsinki", "warsaw", "prague", "budapest",
]
TIER_POINTS = {1: 15, 2: 11, 3: 7, 4: 4}
COMPOSITE = {"interview_prob": 0.30, "mba_fit": 0.20, "ai_dt_fit": 0.20, "sponsorship_prob": 0.15, "brand": 0.10, "pivot_value": 0.05}
METRICS = ["mba_fit", "ai_dt_fit", "brand", "interview_prob", "sponsorship_prob", "pivot_value", "effort", "roi"]
ACTIONS = ["Apply Immediately", "Apply This Week", "Find Referral First", "Research Company", "Save For Later", "Skip"]
IN_PIPELINE = ["Applied", "Online Assessment", "Interview", "Final Round", "Offer", "Rejected"]
PRIMARY = ["ai_strategy", "product_management", "digital_transformation", "business_strategy"]
AI_TRACKS = PRIMARY[:3]
# Sentences of a recommendation: its signals, and the reasons of each action.
SIGNALS = {
    "role": "Strong role fit", "sponsor": "High sponsorship likelihood", "ai": "AI initiatives align with MBA specialization", "place": "Target geography match",
    "mode": "Flexible work mode",
}
REASONS = {
    "pipeline": "Already in pipeline (%s)", "below": "Score below strategic threshold", "moderate": "Moderate fit — revisit if capacity allows",
    "referral": "Sponsorship unlikely — secure a referral to strengthen the case", "research": "High-fit role — research the company before applying", "top": "Top-tier match",
    "strong": "Strong match",
}
# Sentences of a recommendation by metrics: strengths, risks and preparation.
STRENGTHS = {
    "mba": "Strong MBA-level fit", "ai": "Strong AI / Digital-Transformation alignment", "brand": "High employer-brand value", "interview": "Competitive interview probability",
    "sponsor": "Favorable sponsorship likelihood",
}
RISKS = {"interview": "Low interview probability (stretch)", "sponsor": "Sponsorship uncertain", "effort": "High application effort", "roi": "Low expected ROI"}
PREPARATION = {
    "always": "Tailor CV and cover letter to the role", "product": "Practice product-sense and product-case interviews", "ai": "Prepare 2-3 AI / digital-transformation strategy examples",
    "strategy": "Prepare a structured business/strategy case", "people": "Revise people-analytics / workforce metrics and tooling",
    "network": "Network with alumni/employees at %s to secure a referral", "visa": "Confirm visa-sponsorship availability before investing time",
    "time": "Block extra preparation time; expect strong competition",
}
BY_METRICS = "Tier %d (composite %s): interview %d%%, ROI %d, AI/DT fit %d, sponsorship %d%%."


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def track_alignment(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TRACK_POINTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit(0))


def keyword_score(n_categories: Column) -> Column:
    return F.least(F.lit(25), 5 * n_categories)


def skill_score(n_categories: Column, semantic: Column) -> Column:
    """0 without a category; keywords alone without a vector score; else 40 % and 60 %."""
    words = keyword_score(n_categories)
    return F.when(n_categories == 0, 0).when(semantic.isNull(), words).otherwise(clamp(F.bround(0.4 * words + 0.6 * semantic), 0, 25)).cast("int")


def mba_relevance(text: Column, is_target_company: Column) -> Column:
    points = is_target_company.cast("int") * 3
    for n, phrases in MBA_PHRASES:
        points = points + has(text, phrases).cast("int") * n
    return F.least(points, F.lit(15))


def company_quality(tier: Column, on_watchlist: Column, mba_friendliness: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TIER_POINTS.items() for x in pair])
    bonus = F.when(mba_friendliness >= 8, 2).when(mba_friendliness >= 6, 1).otherwise(0)
    return F.least(F.coalesce(F.try_element_at(table, tier), F.lit(4)) + F.when(on_watchlist, 2).otherwise(0) + bonus, F.lit(15))


def international_friendliness(text: Column, location: Column, visa: Column, students: Column) -> Column:
    """The best visa phrase and a place bonus, at least 2, raised by what is known of the company."""
    best = F.greatest(*[F.when(has(text, phrases), n).otherwise(0) for n, phrases in VISA_PHRASES])
    low = F.lower(F.coalesce(location, F.lit("")))
    city = F.lit(False)
    for name in TARGET_CITIES:
        city = city | F.contains(low, F.lit(name))
    place = F.when(city, 2).when(has(location, "remote|hybrid"), 1).otherwise(0)
    score = F.least(best + place, F.lit(10))
    return F.greatest(F.when(score == 0, 2).otherwise(score), F.coalesce(F.least(F.bround((visa + students) / 2), F.lit(10)), F.lit(0))).cast("int")


def pivot_bonus(title: Column, description: Column, category: Column) -> Column:
    part = F.substring(description, 1, 1500)
    first = F.when(has(title, PIVOT_TITLE), 5).when(has(part, PIVOT_TEXT), 3).otherwise(0)
    second = F.when(has(title, TECH_TITLE), 4).when(has(part, TECH_TEXT), 2).otherwise(0)
    return F.greatest(first, second, F.when(has(part, BRIDGE_TEXT), 3).otherwise(0), F.when(category.isin(AI_TRACKS), 2).otherwise(0))


def total_score(*components: Column) -> Column:
    total = components[0]
    for c in components[1:]:
        total = total + c
    return clamp(total, 0, 100)


def adjusted(total: Column, adjustment: Column) -> Column:
    """The total moved by an external adjustment of at most 10 either way."""
    return clamp(total + clamp(F.coalesce(adjustment, F.lit(0)), -10, 10), 0, 100)


def proficiency(months: Column, years: Column, confidence: Column) -> Column:
    return F.least(F.least(12.0 * months, F.lit(40.0)) + F.least(8.0 * years, F.lit(40.0)) + 20.0 * confidence, F.lit(100.0))


def cost(model_in: Column, model_out: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Price of a call at prices per million tokens."""
    return F.bround(tokens_in / 1e6 * model_in + tokens_out / 1e6 * model_out, 6)


def quality_tier(points: Column) -> Column:
    p = clamp(points, 0, 10)
    return F.when(p <= 3, "Poor").when(p <= 6, "Moderate").otherwise("Strong")


def eight_metrics(df: DataFrame) -> DataFrame:
    """The eight opportunity metrics from score components; interview_override and
    effort_override columns, where given, replace the fallbacks."""
    share = lambda c, top: clamp(F.bround(F.col(c) / float(top) * 100), 0, 100).cast("int")
    given = lambda c, other: (F.coalesce(F.col(c), other) if c in df.columns else other)
    out = df.withColumns({"mba_fit": share("mba_relevance", 15), "ai_dt_fit": share("track_alignment", 30), "brand": share("company_quality", 15), "pivot_value": share("track_alignment", 30)})
    visa = F.coalesce(F.col("visa_friendliness"), F.lit(5))
    sponsor = 0.5 * (F.coalesce("visa_accessibility", F.lit(0)) / 40.0 * 100) + 0.3 * (visa / 10.0 * 100) + 0.2 * (F.col("intl_friendliness") / 10.0 * 100)
    out = out.withColumn("sponsorship_prob", clamp(F.bround(sponsor), 0, 100).cast("int"))
    out = out.withColumn("interview_prob", clamp(given("interview_override", F.col("total_score")), 0, 100).cast("int"))
    out = out.withColumn("effort", clamp(given("effort_override", 100 - F.col("interview_prob")), 0, 100).cast("int"))
    base = 0.5 * F.col("interview_prob") + 0.3 * F.col("pivot_value") + 0.2 * F.col("sponsorship_prob")
    return out.withColumn("roi", clamp(F.bround(base * (1 - 0.3 * F.col("effort") / 100)), 0, 100).cast("int"))


def composite(df: DataFrame) -> DataFrame:
    total = None
    for c, w in COMPOSITE.items():
        total = w * F.col(c) if total is None else total + w * F.col(c)
    out = df.withColumn("composite", F.bround(total, 2))
    return out.withColumn("tier", F.when(F.col("composite") >= 65, 1).when(F.col("composite") >= 50, 2).otherwise(3))


def recommend(df: DataFrame, geo_match: Column | None = None) -> DataFrame:
    """recommendation, recommendation_reason and recommendation_rank from total_score,
    application_status, sponsorship, has_research, role_category and work_mode."""
    score, status = F.coalesce("total_score", F.lit(0)), F.coalesce("application_status", F.lit("Not Started"))
    sponsor, role = F.coalesce("sponsorship", F.lit("Unknown")), F.coalesce("role_category", F.lit(""))
    researched = F.coalesce("has_research", F.lit(False))
    note = lambda condition, said: F.when(condition, F.lit(said))
    signals = F.array_compact(
        F.array(
            note((score >= 80) | role.isin(PRIMARY), SIGNALS["role"]),
            note(sponsor.isin("Likely", "High"), SIGNALS["sponsor"]),
            note(role.isin(AI_TRACKS), SIGNALS["ai"]),
            note(F.lit(False) if geo_match is None else geo_match, SIGNALS["place"]),
            note(F.coalesce("work_mode", F.lit("")).isin("Remote", "Hybrid"), SIGNALS["mode"]),
        )
    )
    said = lambda x: F.array(F.lit(x))
    or_else = lambda x: F.when(F.size(signals) > 0, signals).otherwise(said(x))
    cases = [
        (status.isin(IN_PIPELINE), "Skip", F.array(F.format_string(REASONS["pipeline"], status))),
        (score < 50, "Skip", said(REASONS["below"])),
        (score < 70, "Save For Later", said(REASONS["moderate"])),
        (sponsor == "No", "Find Referral First", F.concat(said(REASONS["referral"]), signals)),
        (~researched & (score >= 80), "Research Company", F.concat(said(REASONS["research"]), signals)),
        (score >= 90, "Apply Immediately", or_else(REASONS["top"])),
    ]
    action, reason = F.lit("Apply This Week"), or_else(REASONS["strong"])
    for condition, name, why in reversed(cases):
        action, reason = F.when(condition, F.lit(name)).otherwise(action), F.when(condition, why).otherwise(reason)
    out = df.withColumns({"recommendation": action, "recommendation_reason": F.array_distinct(reason)})
    return out.withColumn("recommendation_rank", F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("recommendation")) - 1)


def recommend_by_metrics(df: DataFrame) -> DataFrame:
    """recommendation_type, strengths, risks, preparation and recommendation_reason from the
    eight metrics, composite, tier, role_category and company."""
    note = lambda condition, said: F.when(condition, said if isinstance(said, Column) else F.lit(said))
    c, role = F.col, F.coalesce("role_category", F.lit("unknown"))
    kind = (
        F.when(c("tier") == 1, "APPLY_IMMEDIATELY").when(c("tier") == 3, "MONITOR")
        .when((c("interview_prob") <= 40) & (c("ai_dt_fit") >= 70), "STRETCH_ROLE").when(c("roi") >= 60, "APPLY_THIS_WEEK").otherwise("MONITOR")
    )
    strengths = [
        (c("mba_fit") >= 70, STRENGTHS["mba"]), (c("ai_dt_fit") >= 70, STRENGTHS["ai"]), (c("brand") >= 70, STRENGTHS["brand"]),
        (c("interview_prob") >= 60, STRENGTHS["interview"]), (c("sponsorship_prob") >= 60, STRENGTHS["sponsor"]),
    ]
    risks = [
        (c("interview_prob") <= 40, RISKS["interview"]), (c("sponsorship_prob") <= 40, RISKS["sponsor"]),
        (c("effort") >= 60, RISKS["effort"]), (c("roi") <= 40, RISKS["roi"]),
    ]
    company = F.coalesce("company", F.lit("the company"))
    preparation = [
        (F.lit(True), PREPARATION["always"]),
        (role == "product_management", PREPARATION["product"]),
        (role.isin(AI_TRACKS), PREPARATION["ai"]),
        (role == "business_strategy", PREPARATION["strategy"]),
        (role.isin(TRACK_B[2:]), PREPARATION["people"]),
        (c("interview_prob") <= 40, F.format_string(PREPARATION["network"], company)),
        (c("sponsorship_prob") <= 40, PREPARATION["visa"]),
        (c("effort") >= 60, PREPARATION["time"]),
    ]
    lists = {name: F.array_compact(F.array(*[note(*pair) for pair in table])) for name, table in (("strengths", strengths), ("risks", risks), ("preparation", preparation))}
    reason = F.format_string(BY_METRICS, "tier", c("composite").cast("string"), "interview_prob", "roi", "ai_dt_fit", "sponsorship_prob")
    return df.withColumns(lists | {"recommendation_type": kind, "recommendation_reason": reason})


def opportunity(df: DataFrame, coverage: str, demand: str, salary_fit: Column | None = None) -> DataFrame:
    """100 * (0.55 coverage + 0.30 demand share + 0.15 salary fit), and a confidence."""
    top = df.agg(F.greatest(F.lit(1), F.max(demand)).alias("__top"))  # one row
    fit = F.lit(0.5) if salary_fit is None else salary_fit
    share = F.least(F.lit(1.0), F.col(demand) / F.col("__top"))
    rows = df.crossJoin(F.broadcast(top))
    score = F.bround(100 * (0.55 * F.col(coverage) + 0.30 * share + 0.15 * fit), 2)
    return rows.withColumns({"opportunity": score, "confidence": F.least(F.lit(1.0), F.bround(0.4 + 0.6 * F.col(coverage), 4))}).drop("__top")
