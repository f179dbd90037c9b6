"""Stateful alerts on posting updates: high scores, status changes, offers and quiet keys
(survey J12). The same rules as a batch job over a table and as a stream with value state
and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ALERTS = "key string, seq long, ts timestamp, event string, message string, level string"
# Names, texts and levels of the alerts: fixed values.
HIGH, CHANGE, OFFER, QUIET = "new_high_scoring_job", "interview_status_change", "offer_received", "no_update"
OFFER_STATUS = "Offer"
LEVEL = "INFO"


def _message(event: str, key: str, status: str | None, score: float | None) -> str:
    if event == HIGH:
        return f"{key} scored {int(score)}"
    return {CHANGE: f"{key} → {status}", OFFER: f"Offer received: {key}", QUIET: f"{key} has no update"}[event]


def _said(event: str) -> Column:
    key = F.col("key")
    return {
        HIGH: F.concat(key, F.lit(" scored "), F.floor("score").cast("string")), CHANGE: F.concat(key, F.lit(" → "), F.col("status")), OFFER: F.concat(F.lit("Offer received: "), key),
    }[event]


def updates(df: DataFrame, key: str, seq: str, time: str, status: str, score: str) -> DataFrame:
    """(key, seq, ts, status, score) with the types that the alerts read."""
    return df.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(time).alias("ts"), F.col(status).alias("status"), F.col(score).cast("double").alias("score"))


def alerts(rows: DataFrame, least: float) -> DataFrame:
    """Alerts of a table of updates (see `updates`), each key by (ts, seq): its score reaches
    `least` and the last known one didn't; its status differs from the last known one, with an
    offer as an alert of its own. Null scores and statuses leave what is known as it is; the
    first status of a key is no change, but an offer is. Rows without a key or time give none."""
    before = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.where("key is not null and ts is not null").withColumns({"old_score": F.last("score", True).over(before), "old_status": F.last("status", True).over(before)})
    high = (F.col("score") >= least) & ~F.coalesce(F.col("old_score") >= least, F.lit(False))
    moved = F.col("status").isNotNull() & ~F.col("status").eqNullSafe(F.col("old_status"))
    offer = moved & (F.col("status") == OFFER_STATUS)
    change = moved & (F.col("status") != OFFER_STATUS) & F.col("old_status").isNotNull()
    one = lambda when, event: F.when(when, F.struct(F.lit(event).alias("event"), _said(event).alias("message")))
    said = F.array_compact(F.array(one(high, HIGH), one(change, CHANGE), one(offer, OFFER)))
    return seen.select("key", "seq", "ts", F.explode(said).alias("a")).select("key", "seq", "ts", "a.event", "a.message", F.lit(LEVEL).alias("level"))


class _Alerts(StatefulProcessor):
    """Last status, score and time of a key as value state; a timer after `quiet_ms` without an
    update raises an alert, one after `keep_ms` forgets the key."""

    def __init__(self, least: float, quiet_ms: int, keep_ms: int):
        self.least, self.quiet_ms, self.keep_ms = least, quiet_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, score double, at_ms long, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, score, at_ms, last_seq = self.last.get() if self.last.exists() else (None, None, None, None)
        frame = pd.concat(list(rows))
        frame = frame[frame["ts"].notna()].sort_values(["ts", "seq"], kind="stable")
        out = []
        for seq, ts, new_status, new_score in zip(frame["seq"], frame["ts"], frame["status"], frame["score"]):
            now = int(ts.timestamp() * 1000)
            if at_ms is not None and (now, int(seq)) <= (at_ms, last_seq):
                continue  # a row that was overtaken changes nothing that is known
            at_ms, last_seq = now, int(seq)
            said = []
            if pd.notna(new_score):
                if new_score >= self.least and not (score is not None and score >= self.least):
                    said.append((HIGH, new_status, new_score))
                score = float(new_score)
            if pd.notna(new_status):
                if new_status != status and new_status == OFFER_STATUS:
                    said.append((OFFER, new_status, score))
                elif new_status != status and status is not None:
                    said.append((CHANGE, new_status, score))
                status = new_status
            out += [(key[0], int(seq), ts, event, _message(event, key[0], s, x), LEVEL) for event, s, x in said]
        if at_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at_ms + self.quiet_ms)
            self.handle.registerTimer(at_ms + self.keep_ms)
            self.last.update((status, score, at_ms, last_seq))
        yield pd.DataFrame(out, columns=["key", "seq", "ts", "event", "message", "level"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.last.exists():
            status, score, at_ms, seq = self.last.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= at_ms + self.keep_ms:
                self.last.clear()
            else:
                out.append((key[0], seq, pd.Timestamp(at_ms + self.quiet_ms, unit="ms"), QUIET, _message(QUIET, key[0], status, score), LEVEL))
        yield pd.DataFrame(out, columns=["key", "seq", "ts", "event", "message", "level"])

    def close(self) -> None:
        pass


def alert_stream(rows: DataFrame, least: float, quiet_minutes: int, keep_minutes: int, late: str = "10 minutes") -> DataFrame:
    """The alerts of a stream of updates, and one for each key that had no update for
    `quiet_minutes` of event time; a key is forgotten after `keep_minutes`, which are more.
    Rows later than the watermark are dropped. The session needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    if keep_minutes <= quiet_minutes:
        raise ValueError("a key is kept longer than it may be quiet")
    keyed = rows.where("key is not null").withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(_Alerts(least, quiet_minutes * 60_000, keep_minutes * 60_000), ALERTS, "Append", "EventTime")
