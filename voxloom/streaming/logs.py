"""Structured Streaming over event files: windows with late data, deduplication and stage state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxloom.operators.text import route_lines

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events as a stream; ts becomes a timestamp that watermarks accept."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "v")


def session_counts(events: DataFrame, gap: str = "8 hours", late: str = "1 day") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def stage_states(events: DataFrame, late: str = "400 days", idle: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """Running (user_id, seen, state): 'error' stays until a later 'signup' retries; any other event activates.

    A batch's events of a user are taken in order of time, whatever frames they come in. The
    state of a user from whom nothing came for ``idle`` milliseconds of event time, behind the watermark, is given up.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen, name = state.get if state.exists else (0, "pending")
        own = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in own["event_type"]:
            seen += 1
            name = "error" if kind == "error" else "complete" if kind == "purchase" and name != "error" else "active" if name != "error" or kind == "signup" else name
        state.update((seen, name))
        last = int(own["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "state": [name]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, seen long, state string", "seen long, state string", "update", GroupStateTimeout.EventTimeTimeout)


def route(lines: DataFrame, progress_sink, log_sink):
    """foreachBatch writer that sends progress structs and log lines to two sinks."""

    def both(batch: DataFrame, epoch: int) -> None:
        routed = route_lines(batch, "line").persist()
        progress_sink(routed.where("sink = 'progress'").select("progress.*"), epoch)
        log_sink(routed.where("sink = 'log'").select("line"), epoch)
        routed.unpersist()

    return lines.writeStream.foreachBatch(both)
