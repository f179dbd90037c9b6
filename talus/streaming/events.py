"""Event streams on Structured Streaming: idempotent publish, dead letters, event-time
windows, alerts, and micro-batch sinks that can be replayed (survey group J)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.lookup import small
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENVELOPE = "event_id string, type string, version int, tenant_id string, idempotency_key string, payload string, created_at timestamp"


def read_events(spark: SparkSession, path: str, schema: str = ENVELOPE, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A file stream; files_per_batch bounds a micro-batch (backpressure)."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).load(path)


def publish_once(events: DataFrame, time: str = "created_at", delay: str = "1 day", keys: tuple[str, str] = ("type", "idempotency_key")) -> DataFrame:
    """Repeats of (type, key) inside the delay are dropped; events without a key all stay."""
    keyed = events.where(F.col(keys[1]).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return keyed.unionByName(events.where(F.col(keys[1]).isNull()).withWatermark(time, delay))


def split_poison(events: DataFrame, payload: str, schema: str, poison: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good with `parsed`, bad with `error`): payloads that don't parse, or that a rule
    calls poison, go to the dead letters; nothing is lost."""
    parsed = events.withColumn("parsed", F.from_json(payload, schema))
    rule = F.lit(False) if poison is None else F.coalesce(poison, F.lit(False))
    broken = F.col(payload).isNull() | F.col("parsed").isNull() | rule
    error = F.when(rule, "poison").otherwise("payload does not parse")
    return parsed.where(~broken), parsed.where(broken).drop("parsed").withColumn("error", error)


def event_counts(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts; rows later than the watermark are dropped in a stream."""
    g = events.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def budget_alerts(events: DataFrame, key: str, amount: str, budget: float, warn: float = 0.8) -> DataFrame:
    """(key, spent, state) each time a key's running total enters warn or exceeded."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, level = state.get if state.exists else (0.0, 0)
        out = []
        for frame in frames:
            spent += float(frame[amount].sum())
            now = 2 if spent >= budget else 1 if spent >= warn * budget else 0
            if now > level:
                out.append((k[0], spent, ("ok", "warn", "exceeded")[now]))
                level = now
        state.update((spent, level))
        yield pd.DataFrame(out, columns=["key", "spent", "state"])

    typed = events.select(F.col(key).cast("string").alias(key), F.col(amount).cast("double").alias(amount))
    return typed.groupBy(key).applyInPandasWithState(step, "key string, spent double, state string", "spent double, level int", "append", GroupStateTimeout.NoTimeout)


def write_idempotent(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Micro-batches as folders named by batch id: a batch that runs again replaces its own
    folder, so that a restart or a replay adds nothing twice. Runs what is there, then ends."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(events: DataFrame, kinds: list[str] | None = None, since: int | None = None, id_col: str = "event_id", type_col: str = "event_type") -> DataFrame:
    """Past events in order, by type and from an id on."""
    rows = events if kinds is None else events.where(F.col(type_col).isin(kinds))
    return (rows if since is None else rows.where(F.col(id_col) > since)).orderBy(id_col)


def poll(events: DataFrame, commits: DataFrame, per_partition: int, total: int) -> DataFrame:
    """The next events of each partition after its committed offset: at most per_partition
    of each and `total` in all, by offset then partition."""
    left = events.join(small(commits), "partition", "left").where(F.col("offset") >= F.coalesce("committed", F.lit(0)))
    ahead = left.where(F.col("offset") < F.coalesce("committed", F.lit(0)) + per_partition)
    return ahead.drop("committed").orderBy("offset", "partition").limit(total)
