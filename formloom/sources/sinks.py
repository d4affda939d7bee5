"""Sinks: results, ledgers, review queues and traces, idempotent by job and by event."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.utils import AnalysisException

from ..operators.audit import envelope_json, trace_append


def write_results(envelopes: DataFrame, path: str) -> None:
    """One JSON line per job, nulls kept."""
    envelope_json(envelopes).select("value").write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, by_job: bool = False) -> None:
    """A ledger or queue as Parquet; written by job only where jobs are few and large."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("job_id") if by_job else writer).parquet(path)


def write_records(rows: DataFrame, path: str) -> None:
    """Layouts, descriptions and other records as JSON lines, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_trace(events: DataFrame, path: str) -> None:
    """Append the events that the trace at ``path`` doesn't have yet. Writing the same events again adds nothing."""
    spark: SparkSession = events.sparkSession
    try:
        known = spark.read.parquet(path).select("event_id", "status")
    except AnalysisException:
        known = spark.createDataFrame([], "event_id string, status string")
    trace_append(events, known).write.mode("append").parquet(path)


def read_trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """Event ids of a trace in JSON lines; lines that can't be read are skipped."""
    return spark.read.schema("event_id string, status string").option("mode", "DROPMALFORMED").json(path).where("event_id is not null")


_NAMES = {T.StringType: "string", T.BooleanType: "boolean", T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "number", T.FloatType: "number"}


def json_schema(kind: T.DataType, nullable: bool = False) -> dict[str, Any]:
    """A closed JSON Schema of a Spark type."""
    if isinstance(kind, T.StructType):
        out: dict[str, Any] = {"type": "object", "additionalProperties": False, "properties": {f.name: json_schema(f.dataType, f.nullable) for f in kind.fields}}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    else:
        out = {"type": _NAMES.get(type(kind), "string")}
    if nullable:
        out["type"] = [out["type"], "null"]
    return out
