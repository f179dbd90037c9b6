"""Table functions that SQL and DataFrames call laterally: the leaves of a JSON text, and of
the JSON-LD objects of a page (survey M3, A7, A17, A18)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Blocks of linked data in a page.
LD_BLOCK = re.compile(r"<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>", re.I | re.S)
#: The kind of object that a posting is, and where lists of objects stand.
POSTING, LISTS = "JobPosting", ("@graph", "itemListElement")


def _leaves(value: object) -> Iterator[tuple[str, str, str]]:
    """(path, kind, text) of all leaves, however deep, in the order of the text."""
    todo: list[tuple[str, object]] = [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, str):
            yield path, "string", v
        elif v is not None:
            yield path, "boolean" if isinstance(v, bool) else "number", json.dumps(v)


def _parse(text: str | None) -> object:
    """The value of a JSON text; null for null, broken or too deeply nested text."""
    try:
        return json.loads(text or "null")
    except (ValueError, RecursionError):
        return None


@udtf(returnType="path string, kind string, value string")
class JsonLeaves:
    """A row for each leaf that isn't null: its path (a.b[0].c), kind and text. Null and broken
    texts have no rows."""

    def eval(self, text: str) -> Iterator[tuple[str, str, str]]:
        yield from _leaves(_parse(text))


@udtf(returnType="at int, title string, company string, location string, posted string, url string")
class JsonLdPostings:
    """A row for each posting in the linked data of a page, in its order: inside graphs, lists and
    item lists too. Broken blocks are passed over; objects without a title count."""

    def eval(self, html: str) -> Iterator[tuple]:
        at = 0
        for block in LD_BLOCK.findall(html or ""):
            todo = [_parse(block)]
            while todo:
                v = todo.pop()
                if isinstance(v, list):
                    todo += reversed(v)
                elif isinstance(v, dict):
                    kind = v.get("@type")
                    if kind == POSTING or isinstance(kind, list) and POSTING in kind:
                        yield at, _text(v.get("title")), _name(v.get("hiringOrganization")), _place(v.get("jobLocation")), _text(v.get("datePosted")), _text(v.get("url"))
                        at += 1
                    else:
                        todo += reversed([v[k] for k in (*LISTS, "item") if k in v])


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def _name(value: object) -> str | None:
    return _text(value.get("name")) if isinstance(value, dict) else _text(value)


def _place(value: object) -> str | None:
    """The first place as locality, region and country, as far as they are given."""
    first = value[0] if isinstance(value, list) and value else value
    address = first.get("address", first) if isinstance(first, dict) else first
    if isinstance(address, dict):
        return ", ".join(x for x in (_name(address.get(k)) for k in ("addressLocality", "addressRegion", "addressCountry")) if x) or None
    return _text(address)


def register(spark: SparkSession) -> None:
    """json_leaves(text) and json_ld_postings(html) for SQL."""
    spark.udtf.register("json_leaves", JsonLeaves)
    spark.udtf.register("json_ld_postings", JsonLdPostings)


def json_leaves(df: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """(keys, path, kind, value) of every leaf of the JSON texts in `doc`."""
    # The keys stay in one struct, so that none of their names can clash.
    rows = df.select(F.struct(*keys).alias("__keys"), F.col(doc).alias("__doc"))
    return rows.lateralJoin(JsonLeaves(F.col("__doc").outer())).select(*[F.col(f"__keys.{k}").alias(k) for k in keys], "path", "kind", "value")


def token_sets(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, tokens): the distinct lower-cased, trimmed texts of all string leaves of a nested value,
    sorted, at least one letter long; a document without any has an empty set."""
    leaves = json_leaves(df, [key], doc).where("kind = 'string'").select(key, F.lower(F.trim("value")).alias("t")).where("t <> ''")
    sets = leaves.groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("tokens"))  # the leaves of one document
    return df.select(key).distinct().join(sets, key, "left").select(key, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def in_token_set(tokens: Column, text: Column) -> Column:
    """True if some token occurs in the lower-cased text."""
    return F.exists(tokens, lambda t: F.contains(F.lower(text), t))
