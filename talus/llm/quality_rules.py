"""Quality rules: base word and line statistics, and zstandard compression bands.

Repetitive text compresses far better, and random or encoded text far worse, than prose of
its length. Both the whole document and its fixed chunks are compressed; the accepted band
depends on the length, because short texts have no history to refer to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from talus.llm.common import _SPACE, Words, spread, text_chunks, window_hashes, within_documents, word_hashes, words_of

LEVEL = 3
CHUNK = 4096
#: (bytes below which the band holds, least and greatest accepted compressed share).
BANDS = (
    (64, 0.0, 9.0),
    (200, 0.30, 1.30),
    (500, 0.33, 0.95),
    (1000, 0.33, 0.85),
    (2000, 0.30, 0.75),
    (5000, 0.28, 0.70),
    (20000, 0.25, 0.68),
    (None, 0.22, 0.68),
)
#: Share of a document's chunks that may lie outside the chunk band.
STRAY_CHUNKS = 0.2
SYMBOLS = "#*$%&|<>"


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in BANDS if below is None or n_bytes < below)


def _repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found twice in its document; is it equal to an earlier one."""
    tagged = keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((tagged,))  # stable: the first in the text comes first
    same = tagged[order[1:]] == tagged[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def _per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def base_statistics(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    w = words_of(data, offsets)
    n_words = w.counts().astype(np.int64)
    word_bytes = ~_SPACE[data] & ((data & 0xC0) != 0x80)
    symbols = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    h = word_hashes(data, w)
    at = np.flatnonzero(within_documents(w, window)[: max(0, len(h) - window + 1)])
    twice, _ = _repeated(window_hashes(h, window)[at], spread(w.first)[at])
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    # Lines: from a document's start or after \n, to before \n or the document's end.
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    has_word = _per_document_any(~_SPACE[data], starts, ends)
    starts, ends = starts[has_word], ends[has_word]
    lines = word_hashes(data, Words(starts, ends, offsets))
    _, later = _repeated(lines, np.searchsorted(offsets, starts, side="right") - 1)
    dup = np.bincount(np.searchsorted(offsets, starts[later], side="right") - 1, minlength=len(n_words))
    return {
        "n_words": n_words,
        "word_chars": _per_document(word_bytes, offsets),
        "n_symbols": _per_document(symbols, offsets),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": _per_document(covered, w.first),
    }


def _per_document_any(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[ends] > sums[starts]


def compression(coder: zstandard.ZstdCompressor, text: bytes) -> tuple[float, int, int, str]:
    """(compressed share, chunks, chunks outside their band, verdict): ok, repetitive or
    incompressible. Empty text is ok: it has nothing to compress. The last chunk may be
    shorter; its band is that of its length."""
    n = len(text)
    if not n:
        return 0.0, 0, 0, "ok"
    share = len(coder.compress(text)) / n
    low, high = band(n)
    chunks = [text[i : i + CHUNK] for i in range(0, n, CHUNK)] if n > CHUNK else []
    shares = [(len(coder.compress(c)) / len(c), *band(len(c))) for c in chunks]
    under, over = sum(s < least for s, least, _ in shares), sum(s > most for s, _, most in shares)
    verdict = "ok"
    if share < low or under > STRAY_CHUNKS * len(chunks):
        verdict = "repetitive"
    elif share > high or over > STRAY_CHUNKS * len(chunks):
        verdict = "incompressible"
    return share, len(chunks), under + over, verdict


def quality_rules(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: the base statistics, compressed_share, n_chunks,
    n_stray_chunks, verdict, base_failed and kept.

    Whole texts are read; a null text is an empty one (no words, so base_failed). Repeated
    rows and null ids give a row each, an empty table none; extra columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=LEVEL)
        for c in text_chunks(batches, text):
            ids = c.batch.column(c.batch.schema.get_field_index(id_col))
            base = base_statistics(c.data, c.offsets)
            raw, offs = c.data.tobytes(), c.offsets.tolist()
            packed = [compression(coder, raw[a:b]) for a, b in zip(offs, offs[1:])]
            failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
            verdicts = [p[3] for p in packed]
            kept = ~failed & np.array([v == "ok" for v in verdicts], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    *[pa.array(base[k]) for k in counts],
                    pa.array([p[0] for p in packed], pa.float64()),
                    pa.array([p[1] for p in packed], pa.int64()),
                    pa.array([p[2] for p in packed], pa.int64()),
                    pa.array(verdicts, pa.string()),
                    pa.array(failed),
                    pa.array(kept),
                ],
                ["id", *counts, "compressed_share", "n_chunks", "n_stray_chunks", "verdict", "base_failed", "kept"],
            )

    columns = ", ".join(f"{k} bigint" for k in counts)
    return docs.select(id_col, text).mapInArrow(
        run, f"id {kind}, {columns}, compressed_share double, n_chunks bigint, n_stray_chunks bigint, verdict string, base_failed boolean, kept boolean"
    )
