"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from directories.

Lines, paragraphs and the whole text of a file are compared with the templates as sparse
TF-IDF vectors; the best one names the licence if its cosine reaches the threshold. A file
without one of its own takes the licence of the nearest directory above it that holds a
licence file, found by joins of directories with their ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import LOWER, SharedTable, Words, count_rows, text_chunks, word_hashes

THRESHOLD = 0.6
#: Tokens that a text must have to be a licence file by its text alone: a one-line notice is none.
FILE_TOKENS = 50
#: Directories that may be broadcast (two short strings each); more are joined by salts.
SMALL_DIRS, SALTS = 200_000, 32
# SPDX identifiers with notices that name the licence, and the openings of
# licence files.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([-._][^/]*)?$"

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _tokens(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters, digits and bytes beyond ASCII; none crosses a document."""
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    on = _TOKEN[data]
    begin, stop = on.copy(), on.copy()
    begin[1:] &= ~on[:-1]
    stop[:-1] &= ~on[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] |= on[cut]
    stop[cut - 1] |= on[cut - 1]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets))


class Vocabulary:
    """The templates' tokens with their weights; bounded by the templates."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        raw = [t.encode() for _, t in templates]
        data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        w = _tokens(data, offsets)
        self.hashes, token = np.unique(word_hashes(data, w), return_inverse=True)
        self.counts = np.zeros((len(templates), len(self.hashes)))
        np.add.at(self.counts, (np.repeat(np.arange(len(templates)), w.counts()), token), 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each token in the vocabulary, -1 if it isn't there."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def weigh(self, n_docs: int, doc_counts: np.ndarray) -> None:
        self.idf = np.log((1 + n_docs) / (1 + doc_counts)) + 1
        scaled = self.counts * self.idf
        self.vectors = scaled / np.linalg.norm(scaled, axis=1)[:, None]


def _segments(data: np.ndarray, offsets: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token ranges [a, b) of all lines, paragraphs and whole texts."""
    breaks = np.flatnonzero(data == 0x0A)
    blank = breaks[1:][np.diff(breaks) == 1] if len(breaks) > 1 else breaks[:0]
    ranges = []
    for cuts in (breaks, blank):
        edges = np.unique(np.concatenate((offsets, cuts + 1)))
        at = np.searchsorted(w.starts, edges)
        ranges.append(np.stack((at[:-1], at[1:])))
    whole = np.stack((w.first[:-1], w.first[1:]))
    ranges.append(whole)
    both = np.concatenate(ranges, axis=1)
    return tuple(both[:, both[1] > both[0]])


def _document_counts(docs: DataFrame, text: str) -> DataFrame:
    """(token, n): the documents with each token of the whole table, by the token's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in text_chunks(batches, text):
            w = _tokens(c.data, c.offsets)
            h, doc = word_hashes(LOWER[c.data], w), np.repeat(np.arange(c.n), w.counts())
            h, _, n = _runs(h, doc)
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return docs.select(text).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _runs(h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h, group) and how often each comes, in the order of the groups."""
    order = np.lexsort((h, group))
    h, group = h[order], group[order]
    lead = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (group[1:] != group[:-1]))))
    return h[lead], group[lead], np.diff(np.append(lead, len(h)))


def _members(on: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, segment) for the tokens marked in `on` of the ranges [a, b)."""
    before = np.concatenate(([0], np.cumsum(on)))
    size = before[b] - before[a]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(before[a], size)
    return np.flatnonzero(on)[at], np.repeat(np.arange(len(a)), size)


def candidates(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, threshold: float) -> pa.ListArray:
    """By document, the segments that could reach the threshold if all tokens outside the
    vocabulary were in every document (and so had the least weight, 1): best template, dot
    product, squared length of the known tokens, is it a whole text of FILE_TOKENS or more,
    and other tokens."""
    n = len(offsets) - 1
    w = _tokens(data, offsets)
    h = word_hashes(LOWER[data], w) if len(w.starts) else np.zeros(0, np.uint64)
    found = vocabulary.find(h)
    a, b = _segments(data, offsets, w)
    known = np.concatenate(([0], np.cumsum(found >= 0)))
    some = known[b] > known[a]
    a, b = a[some], b[some]
    if len(a):
        place, segment = _members(found >= 0, a, b)
        pairs, tf = np.unique(segment * len(vocabulary.hashes) + found[place], return_counts=True)
        segment, token = pairs // len(vocabulary.hashes), pairs % len(vocabulary.hashes)
        value = tf * vocabulary.idf[token]
        starts = np.searchsorted(segment, np.arange(len(a)))
        square = np.add.reduceat(value**2, starts)
        dots = np.add.reduceat(value[:, None] * vocabulary.vectors.T[token], starts, axis=0)
        top, dot = dots.argmax(1), dots.max(1)
        others = b - a - (known[b] - known[a])
        good = dot >= threshold * np.sqrt(square + others) - 1e-9
        a, b, top, dot, square = a[good], b[good], top[good], dot[good], square[good]
    else:
        top, dot, square = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    doc = np.searchsorted(w.first, a, side="right") - 1
    order = np.argsort(doc, kind="stable")
    a, b, doc, top, dot, square = a[order], b[order], doc[order], top[order], dot[order], square[order]
    entire = (a == w.first[doc]) & (b == w.first[doc + 1]) & (b - a >= FILE_TOKENS)
    place, segment = _members(found < 0, a, b)
    other, segment, tf = _runs(h[place], segment)
    tokens = pa.StructArray.from_arrays([pa.array(other.view(np.int64)), pa.array(tf.astype(np.int64))], ["token", "tf"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(segment, np.arange(len(a) + 1)).astype(np.int32)), tokens)
    parts = pa.StructArray.from_arrays([pa.array(top.astype(np.int32)), pa.array(dot), pa.array(square), pa.array(entire), lists], ["template", "dot", "square", "entire", "others"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), parts)


def own_licenses(
    files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str | None = None
) -> DataFrame:
    """(path, license, score, is_license_file), a row per row of `files`, and `id` beside the
    path if `id_col` names a column. All tokens weigh by
    the documents they are in. score is the best cosine of the segments that could reach the
    threshold, 0 if there is none."""
    vocabulary = Vocabulary(TEMPLATES if templates is None else templates)
    counts = SharedTable(_document_counts(files, text), "tokens").df
    n_docs = count_rows(files)
    have = {r["token"]: r["n"] for r in counts.where(F.col("token").isin(vocabulary.hashes.view(np.int64).tolist())).collect()}
    vocabulary.weigh(n_docs, np.array([have.get(t, 0) for t in vocabulary.hashes.view(np.int64).tolist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in text_chunks(batches, text):
            paths = c.batch.column(c.batch.schema.get_field_index(path))
            ids = c.batch.column(c.batch.schema.get_field_index(id_col or path))
            yield pa.RecordBatch.from_arrays([paths, ids, candidates(c.data, c.offsets, vocabulary, threshold)], ["path", "id", "segments"])

    schema = f"path string, id {dict(files.dtypes)[id_col or path]}, segments array<struct<template int, dot double, square double, entire boolean, others array<struct<token bigint, tf bigint>>>>"
    rows = SharedTable(files.select(*dict.fromkeys([path, id_col or path, text])).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "segments").df
    segments = rows.select("row", F.posexplode("segments").alias("s", "x")).select("row", "s", "x.*")
    others = segments.select("row", "s", F.explode("others").alias("o")).select("row", "s", "o.token", "o.tf")
    needed = counts.join(others.select("token").distinct(), "token", "left_semi")
    idf = F.log(F.lit(1.0 + n_docs) / (1 + F.col("n"))) + 1
    rest = others.join(needed, "token").groupBy("row", "s").agg(F.sum(F.pow(F.col("tf") * idf, F.lit(2.0))).alias("rest"))
    cosine = F.col("dot") / F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0)))
    scored = segments.drop("others").join(rest, ["row", "s"], "left").withColumn("cosine", cosine)
    best = scored.groupBy("row").agg(F.min(F.struct(-F.col("cosine"), "template")).alias("b"), F.max(F.when(F.col("entire"), F.col("cosine"))).alias("whole"))
    best = best.select("row", (-F.col("b.col1")).alias("score"), F.col("b.template").alias("template"), "whole")
    kept = ["path"] if id_col is None else ["path", "id"]
    out = rows.select(*kept, "row").join(best, "row", "left").withColumn("good", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    name = F.element_at(F.array(*[F.lit(x) for x in vocabulary.names]), F.col("template") + 1)
    holds = F.coalesce(F.col("whole") >= threshold, F.lit(False)) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    # Roundings may lift a cosine a little above 1.
    score = F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0))
    return out.select(*kept, F.when(F.col("good"), name).alias("license"), score.alias("score"), (F.col("good") & holds).alias("is_license_file"))


def _directory(path: str):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan_licenses(
    files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str | None = None
) -> DataFrame:
    """(path, license, score, is_license_file, origin, inherited_from), a row per row, and `id`
    beside the path if `id_col` names a column: any id, null or not, stays with its row.

    A licence file is named as one (LICENSE, COPYING ...) or is as a whole like a template and
    has FILE_TOKENS tokens or more. origin is own, inherited or none; inherited_from is the directory ('' is the root). Null
    and empty texts have no licence of their own; a null path inherits nothing. The licence
    of a directory is that of its licence file with the highest score, then smallest path.
    Repeated rows give a row each, an empty table none.
    """
    own = SharedTable(own_licenses(files, path, text, templates, threshold, id_col).withColumn("dir", _directory("path")), "own-licences").df
    by_dir = own.where("is_license_file and path is not null").groupBy("dir").agg(F.min(F.struct(-F.col("score"), "path", "license")).alias("b"))
    by_dir = by_dir.select(F.col("dir").alias("holder"), F.col("b.license").alias("dir_license"))
    # Directories rather than files are joined with their ancestors; a directory with many
    # files is one row.
    dirs = own.where("license is null and path is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.size(steps), F.lit(0)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    ancestors = dirs.select("dir", F.posexplode(F.array_distinct(above)).alias("up", "holder"))
    nearest = ancestors.join(by_dir, "holder").groupBy("dir").agg(F.min(F.struct("up", "holder", "dir_license")).alias("b"))
    nearest = nearest.select(F.col("dir").alias("d"), F.col("b.holder").alias("inherited_from"), F.col("b.dir_license").alias("dir_license"))
    nearest = SharedTable(nearest, "directories").df
    same = F.col("license").isNull() & (F.col("dir") == F.col("d"))
    if count_rows(nearest) <= SMALL_DIRS:
        joined = own.join(F.broadcast(nearest), same, "left")
    else:  # a directory may hold a third of all files
        salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("own_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("own_salt") == F.col("salt")), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return joined.select("path", *([] if id_col is None else ["id"]), F.coalesce("license", "dir_license").alias("license"), "score", "is_license_file", origin.alias("origin"), "inherited_from")
