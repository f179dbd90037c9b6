"""Landed tables as a Python data source with key ranges as partitions: bulk reads without
one long scan, keyset pages, and streams whose offset is the last key (survey A21)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Rows of a partition, about, where the option `rows` says nothing.
ROWS = 1_000_000
#: Partitions of a read at most, as each reads whole row groups: beyond it, ranges are longer than `rows`.
PARTS = 256


@dataclass
class KeyRange(InputPartition):
    """Keys above `after` (null: from the first) up to `until`."""

    after: int | None
    until: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Table:
    """Files of one folder (or one file) of Parquet, with the key bounds of their row groups."""

    def __init__(self, options: dict[str, str]):
        self.path, self.key = options.get("path", ""), options.get("key", "")
        if not self.path or not self.key:
            raise ValueError("keyset needs the options path and key")
        self.rows = int(options.get("rows", ROWS))

    def data(self) -> ds.Dataset:
        fs, path = _open(self.path)
        return ds.dataset(path, format="parquet", filesystem=fs)

    def groups(self) -> list[tuple[int, int, int]]:
        """(least key, greatest key, rows) of each row group that has keys, from the footers."""
        data, out = self.data(), []
        for file in data.files:
            meta = pq.ParquetFile(file, filesystem=data.filesystem).metadata
            at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == self.key)
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                stats = group.column(at).statistics
                if group.num_rows and stats is not None and stats.has_min_max:
                    out.append((stats.min, stats.max, group.num_rows))
        return out

    def ranges(self, after: int | None, until: int | None) -> list[KeyRange]:
        """Ranges of about `rows` rows each, or PARTS longer ones: the bounds of the row groups, as if keys lay evenly
        between them, cut where the counted rows pass a multiple of it."""
        groups = [(max(a, a if after is None else after + 1), min(b, b if until is None else until), n) for a, b, n in self.groups()]
        groups = sorted(g for g in groups if g[0] <= g[1])
        if not groups:
            return []
        last = max(b for _, b, _ in groups)
        total = sum(n for _, _, n in groups)
        parts = min(PARTS, max(1, -(-total // self.rows)))
        edges = sorted({a - 1 for a, _, _ in groups} | {b for _, b, _ in groups})
        held = lambda x: sum(n * min(1.0, max(0, x - a + 1) / (b - a + 1)) for a, b, n in groups)
        cuts = [after]
        for k in range(1, parts):
            want, lo, hi = total * k / parts, edges[0], last
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if held(mid) >= want else (mid + 1, hi)
            if lo < last and (cuts[-1] is None or lo > cuts[-1]):
                cuts.append(lo)
        return [KeyRange(a, b) for a, b in zip(cuts, [*cuts[1:], last])]

    def read(self, part: KeyRange) -> Iterator[pa.RecordBatch]:
        """Whole columns of the rows of a range; row groups outside it are not read."""
        inside = ds.field(self.key) <= part.until
        if part.after is not None:
            inside &= ds.field(self.key) > part.after
        for batch in self.data().to_batches(filter=inside):
            if batch.num_rows:
                yield batch


class _Reader(DataSourceReader):
    def __init__(self, table: _Table):
        self.table, self.after, self.until = table, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the key narrow the ranges. Spark applies all filters again: a bound that
        isn't whole, or that other filters narrow too, stays right."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.table.key,) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    low = f.value - (not isinstance(f, GreaterThan))
                    self.after = low if self.after is None else max(self.after, low)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    high = f.value - isinstance(f, LessThan)
                    self.until = high if self.until is None else min(self.until, high)
            yield f

    def partitions(self) -> list[KeyRange]:
        return self.table.ranges(self.after, self.until) or [KeyRange(0, -1)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        if partition.after is None or partition.until > partition.after:
            yield from self.table.read(partition)


class _Stream(DataSourceStreamReader):
    """The offset is the last key: rows that land with greater keys are new."""

    def __init__(self, table: _Table):
        self.table = table

    def initialOffset(self) -> dict:
        return {"key": None}

    def latestOffset(self) -> dict:
        return {"key": max((b for _, b, _ in self.table.groups()), default=None)}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        if end["key"] is None:
            return []
        return self.table.ranges(start["key"], end["key"])

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        yield from self.table.read(partition)

    def commit(self, end: dict) -> None:
        pass


class KeysetSource(DataSource):
    """format("keyset"): options path (Parquet), key (a whole-number column) and rows (of a
    partition). Rows without a key are never read, as no key range holds them."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_Table(self.options).data().schema, prefer_timestamp_ntz=True)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Table(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Table(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("keyset") known; key bounds reach it only if Spark may push them down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeysetSource)


def read_keys(spark: SparkSession, path: str, key: str, rows: int = ROWS) -> DataFrame:
    """The table at `path` in partitions of about `rows` rows by ranges of its key."""
    register(spark)
    return spark.read.format("keyset").option("path", path).option("key", key).option("rows", rows).load()


def stream_keys(spark: SparkSession, path: str, key: str, rows: int = ROWS) -> DataFrame:
    """Rows that land at `path` with keys above the last one read, as a stream."""
    register(spark)
    return spark.readStream.format("keyset").option("path", path).option("key", key).option("rows", rows).load()
