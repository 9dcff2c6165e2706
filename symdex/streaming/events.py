"""Watcher events: what they ask for, debouncing, cooldown; as batches and as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEBOUNCE_S, COOLDOWN_S = 0.5, 5.0


def clean_path(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\./)+", "")


def once(events: DataFrame) -> DataFrame:
    """Events without redelivered ones (the first by arrival stays) and without those that lack a time or path."""
    kept = events.where("ts is not null and path is not null").withColumn("path", clean_path(F.col("path"))).withColumn("dest_path", clean_path(F.col("dest_path")))
    cols = [c for c in kept.columns if c != "event_id"]
    first = kept.groupBy("event_id").agg(F.min_by(F.struct(*cols), F.struct("received_at", "ts", "path")).alias("x"))
    return first.select("event_id", "x.*")


def actions(events: DataFrame) -> DataFrame:
    """(event_id, ts, path, action): a move deletes its source and upserts its target, if it has one."""
    delete, upsert = F.struct(F.lit("delete").alias("action"), F.col("path").alias("p")), lambda c: F.struct(F.lit("upsert").alias("action"), c.alias("p"))
    asked = F.when(F.col("op") == "deleted", F.array(delete)).when(F.col("op") == "moved", F.array(delete, upsert(F.col("dest_path")))).otherwise(F.array(upsert(F.col("path"))))
    return events.select("event_id", "ts", F.explode(asked).alias("a")).select("event_id", "ts", F.col("a.p").alias("path"), "a.action").where("path is not null and path <> ''")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def debounce(df: DataFrame, key: str, time: str, gap_s: float = DEBOUNCE_S, tie: str | None = None) -> DataFrame:
    """Rows of df that no other of the same key follows within the gap; one after exactly the gap comes too late to replace it."""
    w = Window.partitionBy(key).orderBy(time, *([tie] if tie else []))
    following = F.lead(_micros(time)).over(w) - _micros(time)
    return df.withColumn("__f", following).where(F.col("__f").isNull() | (F.col("__f") >= int(gap_s * 1e6))).drop("__f")


def latest(df: DataFrame, key: str, time: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(time).alias(time))


def cooldown(df: DataFrame, key: str, time: str, gap_s: float = COOLDOWN_S) -> DataFrame:
    """(key, time) that fire when after each firing the gap has to pass: a fold along each key, fed by one sorted stream per task."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {time} {df.schema[time].dataType.simpleString()}"
    gap = pd.Timedelta(seconds=gap_s)

    def run(batches):
        current, fired = object(), None
        for b in batches:
            keep = []
            for k, t in zip(b[key], b[time]):
                if k != current or t - fired >= gap:
                    current, fired = k, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield b[keep]

    shown = df.select(key, time).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    return shown.repartition(key).sortWithinPartitions(key, time).mapInPandas(run, schema)


def debounce_stream(stream: DataFrame, key: str = "path", gap_s: float = DEBOUNCE_S, value: str = "action", at_once: str = "delete") -> DataFrame:
    """(path, ts, action) of the newest row of a key once it has been quiet for the gap of processing time; each row starts the wait anew.

    stream is (path, ts, action). A newest row whose value is `at_once` doesn't wait, and drops what waited before it.
    """

    def step(k, frames, state: GroupState):
        newest = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "ts": [pd.Timestamp(newest[0], unit="us")], value: [newest[1]]})
            return
        for f in frames:
            f = f.sort_values("ts", kind="stable")
            row = (int(f["ts"].iloc[-1].value // 1000), f[value].iloc[-1])
            newest = row if newest is None or row[0] >= newest[0] else newest
        if newest[1] == at_once:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [k[0]], "ts": [pd.Timestamp(newest[0], unit="us")], value: [newest[1]]})
            return
        state.update(newest)
        state.setTimeoutDuration(max(1, int(gap_s * 1000)))

    shown = stream.select(key, "ts", value).where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    return shown.groupBy(key).applyInPandasWithState(step, f"{key} string, ts timestamp, {value} string", f"newest long, {value} string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_stream(stream: DataFrame, key: str = "path", gap: str = "500 milliseconds", late: str = "10 minutes", once_by: str | None = None) -> DataFrame:
    """(path, ts, n) of each burst of a key, by event time: sessions that the watermark has closed.

    With once_by, rows delivered again within the watermark count once; state is bounded by the watermark either way.
    """
    timed = stream.withWatermark("ts", late)
    if once_by:
        timed = timed.dropDuplicatesWithinWatermark([once_by])
    return timed.groupBy(F.session_window("ts", gap), key).agg(F.max("ts").alias("ts"), F.count("*").alias("n")).select(key, "ts", "n")


def closing(log: DataFrame, late: str, once_by: str = "event_id") -> DataFrame:
    """One row of a finished log's columns (once_by a number, ts, path) that moves the watermark beyond all sessions of the log.

    Its own session stays open, so it is never written.
    """
    end = log.agg(F.max("ts").alias("ts"), F.max(once_by).alias(once_by))
    row = {"ts": F.coalesce("ts", F.lit(0).cast("timestamp")) + F.expr(f"interval {late}") + F.expr("interval 1 day"), once_by: F.coalesce(once_by, F.lit(0)) + 1, "path": F.lit("")}
    return end.select(*(row[c].cast(log.schema[c].dataType).alias(c) for c in log.columns))
