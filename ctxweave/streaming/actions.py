"""Event streams to action tables, by micro-batches and by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ctxweave.operators import write
from ctxweave.streaming.events import ENVELOPE, to_actions


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events from JSON files of a folder."""
    return spark.readStream.schema(ENVELOPE).json(path)


def distinct_actions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Actions of a stream, each once though its event come again within the delay."""
    actions = to_actions(events).withColumn("event_time", F.to_timestamp("timestamp"))
    return actions.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["action_id"])


def action_log(spark: SparkSession, target: str) -> write.MergeLog:
    return write.MergeLog(spark, target, ["action_id"], ["timestamp"])


def write_actions(events: DataFrame, target: str, checkpoint: str, compact_every: int = 100) -> StreamingQuery:
    """Keeps an action table: each micro-batch adds its actions as a delta numbered by the batch, and of actions of one id the first is in force.

    A batch costs what it holds, however large the table. Every `compact_every` batches
    the deltas are folded into the base.
    """

    def merge(batch: DataFrame, number: int) -> None:
        log = action_log(batch.sparkSession, target)
        log.append(to_actions(batch), number)
        if len(log.deltas()) >= compact_every:
            log.compact()

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EDGE = "session_id string, prev string, curr string"


def followed_by_stream(actions: DataFrame, timeout: str = "1 day") -> DataFrame:
    """FOLLOWED_BY edges of a stream in order of time within each batch; the last action of a session is its state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["timestamp", "action_id"])
        out = []
        for action in rows["action_id"]:
            if action == last:
                continue
            if last is not None:
                out.append((key[0], last, action))
            last = action
        state.update((last,))
        state.setTimeoutDuration(int(pd.Timedelta(timeout).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["session_id", "prev", "curr"])

    return actions.select("session_id", "action_id", "timestamp").groupBy("session_id").applyInPandasWithState(run, EDGE, "last string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_usage(actions: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(window, tool_name, calls, failures) of a stream of actions with event_time; late events within the delay still count."""
    rows = actions if "event_time" in actions.columns else actions.withColumn("event_time", F.to_timestamp("timestamp")).withWatermark("event_time", delay)
    return rows.where("tool_name is not null").groupBy(F.window("event_time", width), "tool_name").agg(F.count("*").alias("calls"), F.sum(F.col("is_error").cast("long")).alias("failures"))
