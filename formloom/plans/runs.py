"""Durable runs: stages written by job batch and resumed, steps timed and traced."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import sha256_json
from ..operators.audit import trace_events
from ..sources.sinks import append_trace

STEPS = "run_id string, node string, attempt int, input_hash string, status string, ms double, error string, at double"


class Run:
    """A run with a folder. A stage that was written is read again; a step that fails is traced and raised.

    The folder may be on any file system that Spark reads. A stage's name and attempt are its key, so resuming a run
    continues behind the last stage that was written completely.
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: str | None = None) -> None:
        self.spark, self.folder, self.run_id = spark, folder.rstrip("/"), run_id or uuid.uuid4().hex
        self.steps: list[tuple] = []

    @contextmanager
    def step(self, node: str, attempt: int = 0, inputs: dict | None = None):
        began, at, status, error = time.perf_counter(), time.time(), "ok", None
        try:
            yield
        except Exception as e:
            status, error = "failed", f"{type(e).__name__}: {e}"[:240]
            raise
        finally:
            self.steps.append((self.run_id, node, attempt, sha256_json(inputs) if inputs else None, status, (time.perf_counter() - began) * 1000, error, at))

    def _complete(self, path: str) -> bool:
        """Whether a write to the folder was committed; one that was broken off leaves no such mark."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def stage(self, node: str, build: Callable[[], DataFrame], attempt: int = 0) -> DataFrame:
        path = f"{self.folder}/{node}/attempt={attempt}"
        if self._complete(path):
            return self.spark.read.parquet(path)
        with self.step(node, attempt):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def write_trace(self) -> None:
        """Append the steps to the run's trace. Values are never part of it."""
        if self.steps:
            append_trace(trace_events(self.spark.createDataFrame(self.steps, STEPS)), f"{self.folder}/trace")
