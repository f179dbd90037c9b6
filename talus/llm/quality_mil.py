"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, a gated attention network (tanh
branch times sigmoid branch) gives it a weight within its document, and the weighted mean
of the encodings is scored. Only documents have labels; the weights are learned from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import SharedTable, spread, text_chunks, word_hashes, words_of

#: Words in a passage, and buckets of hashed words among the features.
PASSAGE_WORDS, BUCKETS = 64, 48
#: Labelled documents used for fitting, and their passages together, at most: the bound of
#: what the driver holds (about 80 MB of features). A document is fitted on whole or not at all.
FIT_ROWS, FIT_TOTAL = 4800, 300_000
HIDDEN, GATES, EPOCHS, BATCH, RATE, DECAY = 24, 12, 24, 200, 0.01, 1e-4
THRESHOLD = 0.7

#: Byte classes counted in a passage.
_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!?", "#$%&*", "|<>", "()[]{}\"'-_/\\+=~^`@", " \t", "\n"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)  # the last class: bytes beyond ASCII and control bytes
for _i, _c in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_c.encode(), np.uint8)] = _i
SHAPES = len(_CLASSES) + 1
FEATURES = SHAPES + 8 + BUCKETS


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, document) of every passage of every document in a chunk. A document
    without words has one passage without features."""
    w = words_of(data, offsets)
    counts = w.counts()
    per_doc = np.maximum(1, -(-counts // PASSAGE_WORDS))
    at = np.concatenate(([0], np.cumsum(per_doc)))
    doc = spread(at)
    lead = w.first[doc] + (np.arange(at[-1]) - at[doc]) * PASSAGE_WORDS
    stop = np.minimum(lead + PASSAGE_WORDS, w.first[doc + 1])
    size = stop - lead
    n_words = len(w.starts)
    passage = np.repeat(np.arange(len(doc)), size)
    x = np.zeros((len(doc), FEATURES), np.float32)
    if not n_words:
        return x, doc
    # Bytes of a passage: from its first word to the next passage's, or the document's end.
    full = size > 0
    begin = np.where(full, w.starts[np.minimum(lead, n_words - 1)], offsets[doc])
    last = np.concatenate((begin[1:], offsets[-1:]))
    same = np.concatenate((doc[1:] == doc[:-1], [False]))
    last = np.where(same, last, offsets[doc + 1])
    n_bytes = np.maximum(last - begin, 1)
    kinds = _CLASS[data]
    for k in range(SHAPES):
        sums = np.concatenate(([0], np.cumsum(kinds == k, dtype=np.int64)))
        x[:, k] = (sums[last] - sums[begin]) / n_bytes
    h = word_hashes(data, w)
    length = (w.ends - w.starts).astype(np.float64)
    words = np.maximum(size, 1)
    mean = np.bincount(passage, length, len(doc)) / words
    square = np.bincount(passage, length**2, len(doc)) / words
    x[:, SHAPES] = mean
    x[:, SHAPES + 1] = np.sqrt(np.maximum(square - mean**2, 0))
    for j, back in enumerate((1, 2)):
        equal = np.zeros(n_words, bool)
        equal[back:] = (h[back:] == h[:-back]) & (passage[back:] == passage[:-back])
        x[:, SHAPES + 2 + j] = np.bincount(passage, equal, len(doc)) / words
    tagged = np.sort(h ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(h ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    again = np.zeros(n_words, bool)
    again[order[1:]] = tagged[1:] == tagged[:-1]
    x[:, SHAPES + 4] = np.bincount(passage, again, len(doc)) / words
    by_doc = h ^ (doc[passage].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(by_doc, kind="stable")
    again = np.zeros(n_words, bool)
    again[order[1:]] = by_doc[order[1:]] == by_doc[order[:-1]]
    x[:, SHAPES + 5] = np.bincount(passage, again, len(doc)) / words
    x[:, SHAPES + 6] = np.log1p(size)
    x[:, SHAPES + 7] = np.log1p(n_bytes / words)
    bucket = np.bincount(passage * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=len(doc) * BUCKETS)
    x[:, SHAPES + 8 :] = bucket.reshape(len(doc), BUCKETS) / words[:, None]
    x[~full] = 0
    return x, doc


# ------------------------------------------------------------------ network
def _sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _forward(p: dict[str, np.ndarray], x: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
    """doc: sorted document numbers from 0 without gaps."""
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    h = np.tanh(x @ p["w1"] + p["b1"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["g"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
    a = e / _sum(e, starts)[doc]
    z = _sum(a[:, None] * h, starts)
    score = 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))
    return {"starts": starts, "h": h, "t": t, "s": s, "a": a, "z": z, "score": score}


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(p, x, doc)
    h, t, s, a = f["h"], f["t"], f["s"], f["a"]
    ds = (f["score"] - y) / len(y)
    dz = ds[:, None] * p["c"]
    da = (dz[doc] * h).sum(1)
    de = a * (da - _sum(a * da, f["starts"])[doc])
    gate = de[:, None] * p["g"]
    dt, dsg = gate * s * (1 - t * t), gate * t * s * (1 - s)
    dh = (a[:, None] * dz[doc] + dt @ p["v"].T + dsg @ p["u"].T) * (1 - h * h)
    return {"w1": x.T @ dh, "b1": dh.sum(0), "v": h.T @ dt, "u": h.T @ dsg, "g": (t * s).T @ de, "c": f["z"].T @ ds, "d": np.array([ds.sum()])}


def fit(x: np.ndarray, doc: np.ndarray, y: np.ndarray, seed: int = 0) -> Model:
    """A model of labelled documents: features by passage, sorted document numbers, labels
    by document. Adam on batches of documents."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6).astype(np.float64)
    d = x.shape[1]
    p = {
        "w1": rng.standard_normal((d, HIDDEN)) / np.sqrt(d), "b1": np.zeros(HIDDEN),
        "v": rng.standard_normal((HIDDEN, GATES)) / np.sqrt(HIDDEN), "u": rng.standard_normal((HIDDEN, GATES)) / np.sqrt(HIDDEN),
        "g": rng.standard_normal(GATES) / np.sqrt(GATES), "c": rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), "d": np.zeros(1),
    }
    first = np.searchsorted(doc, np.arange(len(y) + 1))
    m, v, step = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            take = order[at : at + BATCH]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in take])
            local = np.repeat(np.arange(len(take)), first[take + 1] - first[take])
            g = _gradients(p, x[rows], local, y[take])
            step += 1
            for k in p:
                gk = g[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, {k: q.astype(np.float32) for k, q in p.items()})


def score_passages(model: Model, x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score by document, attention weight by passage)."""
    f = _forward(model.weights, np.clip((x - model.mean) / model.scale, -6, 6).astype(np.float32), doc)
    return f["score"], f["a"]


# ------------------------------------------------------------------ Spark
def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fit_on_labels(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS, fit_total: int = FIT_TOTAL) -> Model:
    """Fit on at most `fit_rows` labelled documents outside the held-out fold, a third of them
    of label 0 where there are as many, chosen by a hash of the id, in whose order documents
    are taken as long as all their passages together are `fit_total` at most (one that is longer by
    itself is passed over). Scores cover all passages. Labels other than 0 and 1 are ignored; an id labelled more than once takes its greatest label,
    and of several texts with one id the one with the smallest features is fitted on. Without
    any labelled document the model scores 0.5 throughout."""
    named = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).alias("__y"))
    share = {0: fit_rows // 3, 1: fit_rows - fit_rows // 3}
    pick = lambda y: named.where(F.col("__y") == y).orderBy(F.xxhash64(id_col), id_col).limit(share[y])
    chosen = pick(0).unionByName(pick(1))  # at most fit_rows rows: safe to broadcast
    rows = docs.select(id_col, text).join(F.broadcast(chosen), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in text_chunks(batches, text):
            x, doc = passages(c.data, c.offsets)
            ids, y = (c.batch.column(c.batch.schema.get_field_index(k)).take(pa.array(range(c.n))) for k in (id_col, "__y"))
            edge = np.searchsorted(doc, np.arange(c.n + 1))
            bags = [x[a:b].tobytes() for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), y.cast(pa.int32()), pa.array(bags, pa.binary())], ["id", "y", "x"])

    by_id = rows.mapInArrow(run, "id string, y int, x binary").groupBy("id").agg(F.min(F.struct("y", "x")).alias("bag"))
    held = SharedTable(by_id.select("id", "bag.*", (F.octet_length("bag.x") / (4 * FEATURES)).cast("long").alias("n")), "labelled-bags")  # an id of `chosen` each
    upto = F.sum("n").over(Window.partitionBy().orderBy(F.xxhash64("id"), "id"))  # `fit_rows` rows at most
    taken = held.df.where(F.col("n") <= fit_total).select("id", "n").withColumn("upto", upto).where(F.col("upto") <= fit_total)
    got = sorted(held.df.join(F.broadcast(taken.select("id")), "id").collect(), key=lambda r: r["id"])
    held.drop()
    if not got:
        zero = np.zeros((FEATURES, HIDDEN), np.float32)
        parts = {"w1": zero, "b1": zero[0], "v": zero[:HIDDEN, :GATES], "u": zero[:HIDDEN, :GATES], "g": zero[0, :GATES], "c": zero[0], "d": zero[0, :1]}
        return Model(np.zeros(FEATURES), np.ones(FEATURES), parts)
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return fit(np.concatenate(bags), doc, np.array([r["y"] for r in got], float))


def score_documents(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score, n_passages, top_passage, top_weight), a row per row of `docs`: the whole
    text is encoded, passage by passage. Null and empty texts have one empty passage."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in text_chunks(batches, text):
            x, doc = passages(c.data, c.offsets)
            score, weight = score_passages(model, x, doc)
            first = np.searchsorted(doc, np.arange(c.n + 1))
            top = np.lexsort((np.arange(len(doc)), -weight, doc))[first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    c.batch.column(c.batch.schema.get_field_index(id_col)),
                    pa.array(score.astype(np.float64)), pa.array(np.diff(first)), pa.array(top - first[:-1]), pa.array(weight[top].astype(np.float64)),
                ],
                ["id", "score", "n_passages", "top_passage", "top_weight"],
            )

    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, score double, n_passages bigint, top_passage bigint, top_weight double")


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns as they are, that score `threshold` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in text_chunks(batches, text):
            score, _ = score_passages(model, *passages(c.data, c.offsets))
            yield c.batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """score_documents of a model fitted on the labels, with held_out and predicted.
    Repeated rows and null ids give a row each, an empty table none."""
    scored = score_documents(docs, fit_on_labels(docs, labels, text=text, id_col=id_col), text, id_col)
    return scored.withColumn("held_out", F.coalesce(held_out("id"), F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
