"""Stage boundaries: tables that several later steps read are written once to the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a table that may be broadcast, when each is a few hundred bytes at most.
SMALL_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="formloom-")


#: Jobs of a task where tables are dealt by job: a job becomes a few dozen rows, which a task sorts in memory.
TASK_JOBS = 40_000


def by_job(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose joins and windows on a job and more columns run where the job's rows are: rows dealt by job stay."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # All readers of a table dealt by job share one exchange: none pushes its own columns or null checks below it.
    for rule in ("constraintPropagation", "optimizer.nestedSchemaPruning", "optimizer.expression.nestedPruning"):
        own.conf.set(f"spark.sql.{rule}.enabled", "false")
    return own


def once(value: Column, name: str) -> Column:
    """For a select: ``value``, computed once for each row, where a plain column would be copied to all that read it."""
    return F.explode(F.array(value)).alias(name)


def staged(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, where every executor can read it; its plan is cut here."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which are counted; else as it is, and joins shuffle."""
    return F.broadcast(df) if len(df.select(F.lit(1)).limit(rows + 1).groupBy().count().where(F.col("count") <= rows).take(1)) else df
