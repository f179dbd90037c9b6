"""Language identification by character trigram profiles, fitted and scored in Spark.

Trigrams of a text are never rows: tasks count or weigh them batch by batch, and what is
shuffled is a sum for a trigram of each task, or for a language of each text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.graph import cut
from talus.operators.lookup import BROADCAST_ROWS, small

#: Trigrams kept per language: bounds the model, so that it can be broadcast.
PROFILE = 400
#: Characters that one step handles at most (a longer text is one step of its own), and counts that a task holds.
STEP, HELD = 1 << 18, 500_000
#: Letters of the profiles up to which trigrams are looked up in a table of all of them.
TABLED = 128
#: The least characters that are judged.
LEAST = 50


def _clean(text: Column) -> Column:
    """Letters with one space between words and at both ends: two texts side by side make trigrams
    with two spaces in a row, which no text has."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _trigrams(text: Column) -> Column:
    """All trigrams of the whole text, in one pass: a match of no length at each place."""
    return F.regexp_extract_all(_clean(text), F.lit("(?=(.{3}))"), F.lit(1))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(first column, code points, starts) of rows whose second column is a clean text, about STEP characters at a time."""
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + STEP, side="right")))
            points = np.frombuffer("".join(batch.column(1).slice(at, to - at).to_pylist()).encode("utf-32-le"), np.uint32)
            yield batch.column(0).slice(at, to - at), points, np.r_[0, ends[at : to - 1] - before]
            at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of rows (lang, clean text), summed over as many rows as fit in HELD counts."""
    held: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            grams = [chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in counts]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])
        held.clear()

    for langs, points, starts in _steps(batches):
        coded = langs.dictionary_encode()
        seen = np.zeros(int(points.max()) + 1, bool)
        seen[points] = True
        letters = np.flatnonzero(seen)
        code = np.zeros(len(seen), np.int64)
        code[letters] = np.arange(len(letters))
        c, a = code[points], len(letters)
        lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(np.r_[starts, len(points)]))
        key = ((lang[: len(c) - 2] * a + c[:-2]) * a + c[1:-1]) * a + c[2:]
        if len(coded.dictionary) * a**3 <= 8 * STEP:
            n = np.bincount(key)
            key = np.flatnonzero(n)
            n = n[key]
        else:
            key, n = np.unique(key, return_counts=True)
        x, y, z = (letters[key // d % a] for d in (a * a, a, 1))
        real = ((x != 32) | (y != 32)) & ((y != 32) | (z != 32))
        of, gram, n = (key // a**3)[real], ((x << 42) | (y << 21) | z)[real], n[real]
        for k, name in enumerate(coded.dictionary.to_pylist()):
            lo, hi = np.searchsorted(of, [k, k + 1])
            held.setdefault(name, Counter()).update(dict(zip(gram[lo:hi].tolist(), n[lo:hi].tolist())))
        if sum(map(len, held.values())) > HELD:
            yield from out()
    yield from out()


def _scorer(profiles: list[tuple[str, str, float]]):
    """Rows (id, clean text) to (id, lang, s): the sums of the weights of a text's trigrams, for each language that has one of them."""
    langs = sorted({lang for lang, _, _ in profiles})
    grams = sorted({gram for _, gram, _ in profiles})
    letters = np.unique([ord(x) for g in grams for x in g]).astype(np.int64)
    a = len(letters) + 1  # 0: any other letter
    code = np.zeros(int(letters.max(initial=0)) + 2, np.int64)
    code[letters] = np.arange(1, a)
    keys = np.array([(code[ord(g[0])] * a + code[ord(g[1])]) * a + code[ord(g[2])] for g in grams], np.int64)
    by = np.argsort(keys)
    weights = np.zeros((len(langs), len(grams) + 1))  # the last one: any other trigram
    place, number = {g: i for i, g in enumerate(grams)}, {x: i for i, x in enumerate(langs)}
    for lang, gram, w in profiles:
        weights[number[lang], place[gram]] = w

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(a**3 if a <= TABLED else 0, len(grams), np.int32)
        if len(table):
            table[keys] = np.arange(len(grams))
        for ids, points, starts in _steps(batches):
            c = code[np.minimum(points, len(code) - 1)]
            key = (c[:-2] * a + c[1:-1]) * a + c[2:]
            if len(table):
                found = table[key]
            else:
                near = by[np.minimum(np.searchsorted(keys, key, sorter=by), len(keys) - 1)]
                found = np.where(keys[near] == key, near, len(grams))
            found = np.r_[found, len(grams), len(grams)]  # a place for each character; no trigram starts at the last two
            any_, sums = weights > 0, []
            for k, lang in enumerate(langs):
                has = np.add.reduceat(any_[k][found], starts, dtype=np.int64) > 0
                at = np.flatnonzero(has)
                sums.append((at, lang, np.add.reduceat(weights[k][found], starts)[at]))
            for at, lang, s in sums:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([lang] * len(at), pa.string()), pa.array(s)], ["id", "lang", "s"])

    return score


def fit_profiles(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, weight): log odds of the most frequent trigrams of each language."""
    clean = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), _clean(F.col(text)).alias("text"))
    grams = cut(clean.mapInArrow(_count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))  # texts are read once
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = grams.withColumn("r", place).where(F.col("r") <= PROFILE)
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    return top.join(small(totals), "lang").select("lang", "gram", F.log(F.col("n") * PROFILE * 10 / F.col("total") + 1).alias("weight"))


def detect(df: DataFrame, profiles: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, language): the best profile, by its sum to nine digits, the last name of equal ones;
    Unknown for texts too short to judge. Profiles of at most BROADCAST_ROWS rows go to the
    tasks; trigrams join with larger ones (of more than 125 languages)."""
    long = df.where(F.char_length(F.trim(text)) >= LEAST)
    held = profiles.select("lang", "gram", "weight").limit(BROADCAST_ROWS + 1).collect()
    if len(held) <= BROADCAST_ROWS:
        clean = long.select(F.col(id_col).alias("id"), _clean(F.col(text)).alias("text"))
        sums = clean.mapInArrow(_scorer([tuple(r) for r in held]), f"id {dict(df.dtypes)[id_col]}, lang string, s double").withColumnRenamed("id", id_col)
    else:
        sums = long.select(id_col, F.explode(_trigrams(F.col(text))).alias("gram")).join(profiles, "gram").select(id_col, "lang", F.col("weight").alias("s"))
    scores = sums.groupBy(id_col, "lang").agg(F.round(F.sum("s"), 9).alias("s"))
    best = scores.groupBy(id_col).agg(F.max(F.struct("s", "lang"))["lang"].alias("language"))
    return df.select(id_col).join(best, id_col, "left").select(id_col, F.coalesce("language", F.lit("Unknown")).alias("language"))


def risk(language: Column) -> Column:
    return F.when(language.isin("en", "Unknown"), "LOW").otherwise("HIGH")
