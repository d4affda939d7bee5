"""Session helpers: the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..stages import staged

#: Rows of at most 32 bytes that may be broadcast: 32 MB at most.
BROADCAST_ROWS = 1_000_000


#: Bytes of an Arrow batch on its way to Python: rows with very long texts travel in small batches.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES, for good: plans are built now and run later, so it can't be set back here."""
    spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage."""
    bounded_batches(df.sparkSession)
    return staged(df)


def narrow(small: DataFrame, rows: int) -> DataFrame:
    """Mark a side of ``rows`` short rows for broadcast if it is within the bound; else leave the join to a shuffle."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


#: Keys that may count as hot, so that their table is small; rows of a hot key that one task joins, at least.
HOT_KEYS, HOT_ROWS = 10_000, 1_024


def salted_join(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner", counted: DataFrame | None = None, by: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``left`` join ``right`` on ``key`` where one key may hold any share of the ``rows`` rows of ``left``.

    Rows of a hot key (more than HOT_ROWS, and more than one in HOT_KEYS of all) are dealt over parts of about that many, and
    the key's rows of ``right`` go to each part. Keys are counted in ``counted`` (``left`` itself unless given), which
    should be stored, unless ``sizes`` (the key, __n) tells their counts; rows are dealt by column ``by``, or by all.
    """
    part = max(HOT_ROWS, -(-rows // HOT_KEYS))
    sizes = sizes if sizes is not None else (counted if counted is not None else left).groupBy(key).agg(F.count("*").alias("__n"))
    hot = sizes.where(F.col("__n") > part).select(key, F.ceil(F.col("__n") / part).cast("int").alias("__parts"))
    hot = F.broadcast(hot)  # at most HOT_KEYS rows
    one = F.coalesce("__parts", F.lit(1))
    salt = F.pmod(F.xxhash64(*([by] if by else left.columns)), one).cast("int")
    dealt = left.join(hot, key, "left").withColumn("__salt", salt).drop("__parts")
    copies = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("__parts")
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
