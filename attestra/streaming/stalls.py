"""Runs that stop telling they are alive: arbitrary state with timers over a stream of heartbeats."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "run string, last long, stalled long, beats long"


class Stalls(StatefulProcessor):
    """Per run: the last heartbeat (microseconds), how many there were, and whether its silence was told. A timer stands `limit` behind the last heartbeat."""

    def __init__(self, limit: timedelta):
        self.limit = limit // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, beats long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = pd.concat([r[["us", "event"]] for r in rows]).sort_values("us", kind="stable")
        at, count, told = self.last.get() if self.last.exists() else (None, 0, False)
        out = []
        for now, event in zip(beats["us"].tolist(), beats["event"], strict=True):
            if at is not None and now < at:
                continue  # older than what is known
            if at is not None and not told and now - at > self.limit:
                out.append((key[0], at, at + self.limit, count))
            at, count, told = now, count + 1, event == "finished"  # who has finished may be silent
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if at is not None:
            self.last.update((at, count, told))
            if not told:
                self.handle.registerTimer(-(-(at + self.limit) // 1000))
        yield pd.DataFrame(out, columns=["run", "last", "stalled", "beats"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, count, told = self.last.get()
        if not told:
            self.last.update((at, count, True))
            yield pd.DataFrame([(key[0], at, at + self.limit, count)], columns=["run", "last", "stalled", "beats"])

    def close(self) -> None:
        pass


def stalls(beats: DataFrame, limit: timedelta, late: str = "0 seconds") -> DataFrame:
    """run, last, stalled and beats (heartbeats so far) of each time that a run is silent for longer than `limit`, once, when event time has passed or
    the next heartbeat shows it. beats: a stream of run, at and event (`finished`: no stall follows until the run begins anew). Heartbeats that are older than the
    run's last one, or than the watermark (`late` behind the latest), are ignored; null runs and times too. The session's state store has to be STORE."""
    rows = beats.where("run IS NOT NULL AND at IS NOT NULL").select(F.col("run").cast("string").alias("run"), F.col("at").cast("timestamp").alias("at"), "event").withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    told = rows.groupBy("run").transformWithStateInPandas(statefulProcessor=Stalls(limit), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    return told.select("run", F.timestamp_micros("last").alias("last"), F.timestamp_micros("stalled").alias("stalled"), "beats")


def record(beats: DataFrame, limit: timedelta, out: str, checkpoint: str, late: str = "0 seconds") -> None:
    """Appends the stalls of what is new in the stream to out; begins where the checkpoint ends."""
    spark = beats.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stalls(beats, limit, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
