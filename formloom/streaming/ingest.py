"""File-drop ingestion: each micro-batch of sidecar files goes through the batch engine, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import trace_events
from ..sources.evidence import SIDECAR
from ..sources.sinks import append_trace


def stream_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """A stream of sidecar files, one row each, with the job named after the file."""
    rows = spark.readStream.schema(SIDECAR).option("multiLine", True).json(path)
    return rows.withColumn("job_id", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", ""))


def run_stream(files: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Process batches of files to Parquet at ``out``; a batch that is repeated after a failure replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_trace(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of steps to a trace; an event that is there already isn't added again."""

    def write(batch: DataFrame, _: int) -> None:
        append_trace(trace_events(batch), path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
