"""Event streams of jobs: latest states, windows over event time, and appended records without repeats."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemill.sources.stored import folder


def records(spark: SparkSession, folder: str, schema: StructType | str, most_files: int = 100) -> DataFrame:
    """JSON lines of a folder as a stream, a bounded number of files at a time; lines that don't parse are null rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).json(folder)


def latest_states(events: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """The state of each key's last event, and how many it had; for the update or complete mode."""
    return events.groupBy(key).agg(F.max_by(state, order).alias(state), F.max(order).alias(order), F.count("*").alias("n"))


def per_window(events: DataFrame, ts: str, window: str, late: str, *by: str) -> DataFrame:
    """Events in tumbling windows of event time; those later than `late` behind the newest are dropped."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), *by, "n")


def outbound(events: DataFrame, key: str = "job", state: str = "state", order: str = "at") -> DataFrame:
    """Jobs whose last state waits to be sent: done or failed and not delivered since, or waiting for approval that was not sent
    since. Later events `delivered` and `approval_sent` settle it; each event of a state opens it again."""
    waits = F.col(state).isin("completed", "failed", "approval_pending")
    last = events.groupBy(key).agg(
        F.max_by(F.when(waits | F.col(state).isin("pending", "processing"), F.struct(state, order)), F.when(waits | F.col(state).isin("pending", "processing"), F.col(order))).alias("last"),
        F.max(F.when(F.col(state) == "delivered", F.col(order))).alias("delivered"), F.max(F.when(F.col(state) == "approval_sent", F.col(order))).alias("sent"),
    )
    settled = F.when(F.col(f"last.{state}") == "approval_pending", F.col("sent")).otherwise(F.col("delivered"))
    open_ = F.col(f"last.{state}").isin("completed", "failed", "approval_pending") & (settled.isNull() | (settled < F.col(f"last.{order}")))
    return last.where(open_).select(key, F.col(f"last.{state}").alias(state), F.col(f"last.{order}").alias(order))


def stage_seconds(marks: DataFrame, key: str, at: str) -> DataFrame:
    """marks with the seconds since the key's mark before; null at the first."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, "mark"))
    return marks.withColumn("seconds", F.round((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6, 2))


def stale_jobs(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """A stream of (job, since, stale_at) from a stream of (job, at, state): jobs that stay in `processing` for more than `seconds`
    of event time, at the time when they fall back. Any later event ends the wait, each event `processing` starts it anew.

    The state of a job is the time when it began to wait; a timer of event time ends it where no further event comes. Events of a
    batch are taken in order of time; those later than the watermark are dropped, repeated ones change nothing.
    """
    wait = pd.Timedelta(seconds=seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        since = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        if state.hasTimedOut:
            out.append((key[0], since, since + wait))
            since = None
        else:
            rows = pd.concat(list(batches)).drop_duplicates().sort_values(["at", "state"])
            for at, now in zip(rows["at"], rows["state"], strict=True):
                if since is not None and at > since + wait:
                    out.append((key[0], since, since + wait))
                if since is None or at >= since:
                    since = at if now == "processing" else None
        if since is None:
            if state.exists:
                state.remove()
        else:
            state.update((since.value // 1000,))
            ends = (since + wait).value // 1_000_000 + 1
            if ends <= state.getCurrentWatermarkMs():  # the time is over already
                out.append((key[0], since, since + wait))
                state.remove()
            else:
                state.setTimeoutTimestamp(ends)
        if out:
            yield pd.DataFrame(out, columns=["job", "since", "stale_at"])

    kind = events.schema["job"].dataType.simpleString()
    rows = events.select("job", F.col("at").cast("timestamp").alias("at"), "state").withWatermark("at", late)
    return rows.groupBy("job").applyInPandasWithState(step, f"job {kind}, since timestamp, stale_at timestamp", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for what its source has now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/tidemill-{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def first_seen(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key's first event, with state kept only as long as the watermark says."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
