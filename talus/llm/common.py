"""Shared helpers of the training-data operators: shared-folder tables, Arrow text
chunks, word boundaries and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles at most (a longer document is one step of its own).
CHUNK_BYTES = 256 << 10


# ------------------------------------------------------------------ shared tables
def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode
    (one machine, as in tests) and an error on a cluster, whose executors share no local disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class SharedTable:
    """A DataFrame written once to the shared folder and read back: its lineage is cut, and
    it survives the loss of any executor."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jpath, fs = _fs(self.df.sparkSession, self.path)
        fs.delete(jpath, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return SharedTable(df, name).df


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores behind it until none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


# ------------------------------------------------------------------ Arrow text chunks
@dataclass
class TextChunk:
    """Rows of one record batch with their texts as UTF-8 bytes, document after document."""

    batch: pa.RecordBatch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than documents

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def ids(self, name: str = "doc_id") -> np.ndarray:
        return self.batch.column(self.batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[TextChunk]:
    """Cut Arrow batches into chunks of about CHUNK_BYTES; a null text counts as empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if col.null_count:
            col = pc.fill_null(col, "")
        wide = pa.types.is_large_string(col.type)
        n = len(col)
        if not n:
            continue
        offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        raw = col.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield TextChunk(batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
            at = to


# ------------------------------------------------------------------ words
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True  # words are [^\x20\x09-\x0D]+
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    starts: np.ndarray  # byte positions in the chunk
    ends: np.ndarray
    first: np.ndarray  # per document: index of its first word; one more than documents

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Word boundaries; a word never crosses a document. `space` marks the bytes between words."""
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    word = ~space[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < n)]
    begin[cut] |= word[cut]
    stop[cut - 1] |= word[cut - 1]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets))


_MIX = np.random.default_rng(20240601).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, kept for chunks of the usual size."""
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 2 * CHUNK_BYTES:
            _POWERS[str(base)] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """64-bit hashes of the words, equal for equal bytes in any chunk."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_MIX[data] * _powers(_BASE, n)[:n], out=sums[1:])
    return mix64((sums[w.ends] - sums[w.starts]) * _powers(_BASE_INV, n + 1)[w.starts])


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of h[i : i + size] for each i; windows that would pass the end are missing."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += h[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    return mix64(out)


def within_documents(w: Words, size: int) -> np.ndarray:
    """True for each word at which a window of `size` words of one document starts."""
    total = len(w.starts)
    ends = np.repeat(w.first[1:], w.counts())
    return np.arange(total) + size <= ends


def spread(first: np.ndarray) -> np.ndarray:
    """Document number (in the chunk) of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def joined_words(data: np.ndarray, w: Words, words: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The named words joined by one space inside each group, and the groups' byte offsets;
    group g has words[first[g] : first[g + 1]]."""
    size = w.ends[words] - w.starts[words]
    has = np.diff(first) > 0
    joined = size + 1  # a space behind each word but a group's last one
    joined[first[1:][has] - 1] -= 1
    begin = np.concatenate(([0], np.cumsum(joined)))
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin[:-1], size) + within] = data[np.repeat(w.starts[words], size) + within]
    return out.tobytes(), begin[first]


def string_array(text: bytes, offsets: np.ndarray) -> pa.Array:
    """Arrow strings from one buffer of UTF-8 bytes."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(text)).cast(pa.string())
