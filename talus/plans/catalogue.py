"""All driver queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.plans import compose, exports, insight, platform, postings, ranked, reports, similar, views

_ALL = ranked.QUERIES | reports.QUERIES | postings.QUERIES | insight.QUERIES | views.QUERIES | compose.QUERIES | similar.QUERIES | platform.QUERIES | exports.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.posting_pipeline(spark, sf_dir)
