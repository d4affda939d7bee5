"""Exact token counts from a histogram of encoded lengths.

Documents are counted by encoded length once. Suffix sums over the histogram then
answer, for every context limit, how many documents and tokens there are, how
many are truncated, and what is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .pieces import SLICE, default_model, tokenizer
from .session import bounded_batches, checkpointed, table
from .words import text_slices

#: Lengths of a block of the histogram: sums run within blocks and over the blocks' sums, so no task gets all lengths.
BLOCK = 1024


def length_histogram(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """length, docs: how many texts encode to so many tokens. Null and empty texts have length 0."""
    path = model_file or default_model()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = tokenizer(path)
        for batch in batches:
            for part in text_slices(batch, most=SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(built.lengths([t or "" for t in part.column("text").to_pylist()]))], ["length"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "length long").groupBy("length").agg(F.count("*").alias("docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """A row for every length that occurs, as a context limit.

    limit, docs (of that length), docs_over (longer), docs_within, tokens_within (of documents within the limit),
    tokens_total, tokens_kept (when longer texts are truncated to the limit), quantile (share of documents within).
    Between two rows tokens_kept grows by docs_over of the lower row for each token of the limit, so the rows answer
    every limit. An empty histogram gives an empty result.
    """
    rows = histogram.where("length is not null").groupBy("length").agg(F.sum("docs").alias("docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum(F.col("docs") * F.col("length")).alias("bt"))
    over = Window.orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    everything = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"), F.sum("bd").over(everything).alias("all_docs"), F.sum("bt").over(everything).alias("tokens_total"))
    own = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"d": F.sum("docs").over(own), "t": F.sum(F.col("docs") * F.col("length")).over(own)}).join(blocks, "block")
    within, tokens = F.col("d") + F.col("d0"), F.col("t") + F.col("t0")
    return rows.select(
        F.col("length").alias("limit"), "docs", (F.col("all_docs") - within).alias("docs_over"), within.alias("docs_within"), tokens.alias("tokens_within"), "tokens_total",
        (tokens + (F.col("all_docs") - within) * F.col("length")).alias("tokens_kept"), (within / F.col("all_docs")).alias("quantile"),
    )


def quantile_length(limit_rows: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents doesn't exceed (no row's: null)."""
    return limit_rows.where(F.col("quantile") >= q).agg(F.min("limit").alias("length"))


def kept_at(limit_rows: DataFrame, limit: int) -> DataFrame:
    """Tokens kept when texts are truncated to any ``limit``, whether or not a text has that length (no row's: null)."""
    low = limit_rows.where(F.col("limit") <= limit).agg(F.max(F.struct("limit", "docs_over", "tokens_kept")).alias("low"))
    total = limit_rows.agg(F.max(F.col("docs_over") + F.col("docs_within")).alias("n"))
    return low.crossJoin(total).select(F.coalesce(F.col("low.tokens_kept") + F.col("low.docs_over") * (limit - F.col("low.limit")), F.col("n") * limit).alias("tokens_kept"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return limits(checkpointed(length_histogram(table(spark, sf_dir, "documents"))))
