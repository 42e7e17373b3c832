"""Work queues and event streams: the same operators in batch and in Structured Streaming (Q1-Q9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What an event does to its task.
STATES = {"signup": "pending", "view": "pending", "click": "in_progress", "purchase": "done", "error": "failed"}


def task_id(path: Column) -> Column:
    return F.sha1(path)


def enqueue(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Tasks that are in no state yet (Q1)."""
    return new.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")


def latest_state(events: DataFrame, key: str, ts: str, state: Column, tie: str) -> DataFrame:
    """``(key, state, ts)`` of each task's last event (Q3): a partial aggregate."""
    return events.select(key, F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), state.alias("state")).alias("x")).groupBy(key).agg(F.max("x").alias("x")).select(key, F.col("x.state").alias("state"), F.col("x.ts").alias("ts"))


def recover(tasks: DataFrame, now: Column, after: str = "15 minutes") -> DataFrame:
    """Tasks stuck in progress go back to pending (Q4, Q6)."""
    stuck = (F.col("state") == "in_progress") & (F.col("ts") < now - F.expr(f"INTERVAL {after}"))
    return tasks.withColumn("stalled", stuck).withColumn("state", F.when(stuck, "pending").otherwise(F.col("state")))


def resume(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without output (Q7)."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def queue_status(tasks: DataFrame) -> DataFrame:
    """``(state, n)``."""
    return tasks.groupBy("state").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, ts: str, keys: list[str], size: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts and sums; with ``late`` a watermark, so that the same plan runs on a stream."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions that end after a gap."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """A state table ``(key, state, ts)`` with a batch of later or earlier events of the same form: the last of each key holds, whatever the order of arrival (Q3)."""
    x = F.struct("ts", "state")
    return state.unionByName(batch).groupBy(key).agg(F.max(x).alias("x")).select(key, F.col("x.state").alias("state"), F.col("x.ts").alias("ts"))


def stalled(tasks: DataFrame, now: Column, after: str = "15 minutes") -> DataFrame:
    """Tasks in progress for too long (Q6)."""
    return tasks.where((F.col("state") == "in_progress") & (F.col("ts") < now - F.expr(f"INTERVAL {after}")))


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is there, in batches, resumable at the checkpoint (Q5, Q8)."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
