"""Text, date and hash column functions. Each takes and returns Columns and stays in the JVM
but for the few marked as Arrow functions."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal suffixes of company names and the labels of score bands.
TOKEN_SUFFIXES = r"gmbh|spa|s\.p\.a\.|ltd|limited|inc|incorporated|se|ag|nv|bv|srl|sarl|sa|plc|llc|llp|kg|co|group|holding|holdings"
COMPANY_SUFFIXES = TOKEN_SUFFIXES.replace("|co|", r"|co\.?|")
SCORE_BANDS = [(90, "90-100"), (80, "80-89"), (70, "70-79"), (None, "<70")]
PRIORITY_BANDS = [(90, "Apply Now"), (80, "This Week"), (70, "Good Match"), (None, "Low Priority")]
STRATEGIC_BUCKETS = [(85, "Apply Immediately"), (70, "High Priority"), (50, "Medium Priority"), (35, "Low Priority"), (None, "Ignore")]
BUCKET_ORDER = ["Apply Immediately", "High Priority", "Medium Priority", "Low Priority", "Ignore", "Rejected"]
PROFICIENCY_BANDS = [(85, "expert"), (65, "advanced"), (40, "intermediate"), (None, "beginner")]


def squeeze(text: Column) -> Column:
    """Lower case, white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def norm_company(name: Column) -> Column:
    """Company name without legal suffixes; '' if nothing else is left."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"(?iu)\b(?:{COMPANY_SUFFIXES})\b", ""))


def norm_token(text: Column) -> Column:
    """norm_company without punctuation, for fingerprints."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?iu)\b(?:{TOKEN_SUFFIXES})\b", "")
    return squeeze(F.regexp_replace(bare, r"(?U)[^\w\s]", ""))


def natural_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[squeeze(F.coalesce(p, F.lit(""))) for p in parts])


def fingerprint(*parts: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)


def slugify(text: Column, limit: int | None = None) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return slug if limit is None else F.substring(slug, 1, limit)


def first_label(text: Column, table: list[tuple[str, str]], default: Column | str) -> Column:
    """Label of the first entry whose needle the lower-cased text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(F.contains(low, F.lit(needle)), F.lit(label)) for needle, label in table]
    return F.coalesce(*hits, default if isinstance(default, Column) else F.lit(default))


def work_mode(location: Column, description: Column) -> Column:
    where = F.lower(F.concat_ws(" ", F.coalesce(location, F.lit("")), F.substring(F.coalesce(description, F.lit("")), 1, 600)))
    return F.when(F.contains(where, F.lit("hybrid")), "Hybrid").when(where.rlike(r"\bremote\b"), "Remote").otherwise("On-site")


def band(score: Column, table: list[tuple[int | None, str]]) -> Column:
    """Label of the first threshold that the score reaches; a null score counts as 0."""
    value, out = F.coalesce(score, F.lit(0)), None
    for least, label in table:
        hit = F.lit(True) if least is None else value >= least
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def head_tail(text: Column, budget: int, marker: str = " ... ") -> Column:
    """Texts over the budget keep their first third and last two thirds of it."""
    head = budget // 3
    return F.when(F.char_length(text) <= budget, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.substring(text, -(budget - head), budget - head)))


def mask_email(text: Column) -> Column:
    return F.regexp_replace(text, r"([A-Za-z0-9])[A-Za-z0-9._%+\-]*(@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})", "$1***$2")


PHONE = re.compile(r"\+?\d[\d\s().\-]{6,}\d")


@F.pandas_udf(T.StringType())
def mask_phone(texts: pd.Series) -> pd.Series:
    """Phone numbers become *** and their last two digits (needs the digits of the match)."""
    hide = lambda m: "***" + re.sub(r"\D", "", m[0])[-2:]
    return texts.map(lambda t: None if t is None else PHONE.sub(hide, t))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def strip_html(text: Column) -> Column:
    """Tags to spaces, character references decoded, white space collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(text, r"<[^>]+>", " ")), r"(?U)\s+", " "))


def posted_date(raw: Column, fetched: Column) -> Column:
    """The fetch date less 'N hours|minutes|days|weeks|months' (a month is 30 days), else an
    ISO date at the start, else null."""
    pattern = r"(?i)(\d+)\s*(hour|minute|day|week|month)"
    n, unit = F.regexp_extract(raw, pattern, 1).try_cast("int"), F.lower(F.regexp_extract(raw, pattern, 2))
    days = F.when(unit.isin("hour", "minute"), 0).when(unit == "day", n).when(unit == "week", n * 7).when(unit == "month", n * 30)
    return F.coalesce(F.date_sub(fetched, days), F.try_to_date(F.substring(F.trim(raw), 1, 10), "yyyy-MM-dd"))


def count_of(text: Column, needle: Column) -> Column:
    """Occurrences of needle that don't overlap; 0 for an empty needle."""
    left = F.char_length(text) - F.char_length(F.replace(text, needle, F.lit("")))
    return F.when(F.char_length(needle) > 0, (left / F.char_length(needle)).cast("long")).otherwise(F.lit(0).cast("long"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def percent_text(ratio: Column) -> Column:
    return F.concat(F.bround(ratio * 100).cast("int").cast("string"), F.lit("%"))


def hash_bucket(*parts: Column, sep: str = ":") -> Column:
    """The first 32 bits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, 8), 16, 10).cast("long")
