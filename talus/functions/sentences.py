"""Sentences over rows: reasons of a match and the summary of a plan (survey C29, E33). The
texts are fixed values; numbers are rounded half to even, as the sentences' formats do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import percent_text

# Tiers and kinds of a recommendation, in their order.
TIERS = ["tier_1", "tier_2", "tier_3"]
KINDS = ["APPLY_IMMEDIATELY", "APPLY_THIS_WEEK", "STRETCH_ROLE", "MONITOR", "IGNORE"]
# The sentences.
MATCH, DEMAND, READY = "%s skill-match with the role.", "Strong market demand (%d recent postings).", "No remaining skill gaps — apply-ready."
GAPS, PLAIN = "%d skill gap(s) to close: %s.", "Recommended %s (score %s/100)."
STATUS = "%d recommendations: %d Tier-1, %d Tier-2, %d Tier-3. %d role(s) planned this week, %d next week."
FOCUS = "Focus: %d apply-immediately, %d apply-this-week, %d stretch, %d monitor."
ACTION, NO_ACTION = "Apply to %s — %s", "No Tier 1/2 roles this week; expand sourcing or revisit Tier 3."


def match_reasons(coverage: Column, demand: Column, gaps: Column) -> Column:
    """The reasons of a match, in order: its share of skills, the demand if there is some, and
    the first three gaps, or that there is none. Nulls count as 0 and no gaps."""
    n = F.greatest(F.coalesce(F.size(gaps), F.lit(0)), F.lit(0))
    asked = F.coalesce(demand, F.lit(0)).cast("long")
    said = F.array(
        F.format_string(MATCH, percent_text(F.coalesce(coverage, F.lit(0.0)))), F.when(asked > 0, F.format_string(DEMAND, asked)),
        F.when(n > 0, F.format_string(GAPS, n, F.array_join(F.slice(gaps, 1, 3), ", "))).otherwise(READY),
    )
    return F.array_compact(said)


def explain(reasons: Column, target: Column, score: Column) -> Column:
    """The reasons joined, or a plain sentence without any."""
    plain = F.format_string(PLAIN, target, F.bround(score).cast("long").cast("string"))
    return F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, F.array_join(reasons, " ")).otherwise(plain)


def kind_counts(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """One row with a column for each kind, 0 if it doesn't occur; other values aren't counted."""
    return df.agg(*[F.count(F.when(F.col(column) == k, 1)).alias(k) for k in kinds])


def plan_summary(recommended: DataFrame, prioritised: DataFrame, planned: DataFrame) -> DataFrame:
    """(application_status, recommended_focus) of a plan. recommended: kind; prioritised: tier
    (1, 2, or else 3); planned: slot (this_week or next_week)."""
    tiers = prioritised.agg(*[F.count(F.when(F.col("tier") == i + 1, 1)).alias(t) for i, t in enumerate(TIERS[:2])], F.count(F.lit(1)).alias("__all"))
    kinds = kind_counts(recommended, "kind", KINDS).crossJoin(recommended.agg(F.count(F.lit(1)).alias("__n")))  # a row each
    slots = kind_counts(planned, "slot", ["this_week", "next_week"])
    one = kinds.crossJoin(tiers).crossJoin(slots)  # a row each
    third = F.col("__all") - F.col("tier_1") - F.col("tier_2")
    return one.select(
        F.format_string(STATUS, "__n", "tier_1", "tier_2", third, "this_week", "next_week").alias("application_status"),
        F.format_string(FOCUS, *[F.col(k) for k in KINDS[:4]]).alias("recommended_focus"),
    )


def actions(planned: DataFrame, company: str, title: str) -> DataFrame:
    """(action) of each row of this week's plan, or that there is none."""
    said = planned.select(F.format_string(ACTION, company, title).alias("action"))
    none = planned.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(NO_ACTION).alias("action"))
    return said.unionByName(none)
