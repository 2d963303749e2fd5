"""The state of jobs as a stream: what each job did last, across micro-batches, and which have gone quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "job string, at timestamp, stage string, done double, message string"
STATES = "job string, stage string, done double, message string, events long, started timestamp, at timestamp"
ENDED = ("done", "failed")


def job_events(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of job events from the JSON lines of a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def job_states(events: DataFrame, quiet_minutes: int = 30) -> DataFrame:
    """A row for each job of a micro-batch: its last stage, how far it is, its last message, how many events it had, and when
    it began and was last heard of.

    The last event is the one with the latest time, in one instant the one furthest on. What is done never falls.
    Events after a job has ended count, but change nothing else. A job that is not heard of for ``quiet_minutes`` of
    event time is told once more with the stage ``lost`` and forgotten; so is an ended one, without a word. Events
    without a job or a time are left out.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (job,) = key
        stage, done, message, count, started, at = state.get if state.exists else ("", 0.0, "", 0, None, None)
        if state.hasTimedOut:
            state.remove()
            if stage not in ENDED:
                yield row(job, "lost", done, message, count, started, at)
            return
        for batch in batches:
            count += len(batch)
            for e in batch.sort_values(["at", "done"], kind="stable").itertuples():
                when = int(e.at.value // 1000)
                started = when if started is None else min(started, when)
                if stage in ENDED or (at is not None and when < at):
                    continue
                stage, at = e.stage or stage, when
                done, message = max(done, 0.0 if pd.isna(e.done) else e.done), e.message or message
        state.update((stage, done, message, count, started, at))
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs() + 1) + quiet_minutes * 60_000)
        yield row(job, stage, done, message, count, started, at)

    def row(job, stage, done, message, count, started, at) -> pd.DataFrame:
        times = [pd.Timestamp(t * 1000) for t in (started, at)]
        return pd.DataFrame([(job, stage, done, message, count, *times)], columns=[c.split(" ")[0] for c in STATES.split(", ")])

    kept = "stage string, done double, message string, events long, started long, at long"
    heard = events.where("job is not null and at is not null").withWatermark("at", "1 minute")
    return heard.groupBy("job").applyInPandasWithState(update, STATES, kept, "update", GroupStateTimeout.EventTimeTimeout)


def follow_jobs(spark: SparkSession, folder: str, sink: str, checkpoint: str, quiet_minutes: int = 30, once: bool = False) -> StreamingQuery:
    """Write the states of jobs as they change, as Parquet, one folder for each micro-batch; a restart goes on where it was."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = job_states(job_events(spark, folder), quiet_minutes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
