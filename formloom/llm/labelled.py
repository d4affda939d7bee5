"""Bounded training samples: the classifiers fit on the driver, on at most so many labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def usable_labels(labels: DataFrame, target: str, usable: Column | None = None) -> DataFrame:
    """One row per doc_id with a 0 or 1 in ``target`` that passes ``usable``: a doc_id that has several counts once, with its largest labels."""
    names = [c for c in labels.columns if c != "doc_id"]
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
    if usable is not None:
        rows = rows.where(usable)
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(c).alias(c) for c in names])


def training_ids(labels: DataFrame, target: str, per_class: int, usable: Column | None = None) -> DataFrame:
    """At most ``per_class`` usable_labels() of each class of ``target``, those of the smallest hashes, with all label columns.

    The bound is what the classifiers' ``per_class`` documents; rows with a null doc_id or label are not used.
    """
    rows = usable_labels(labels, target, usable)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    return rows.where(F.col(target) == 0).orderBy(*order).limit(per_class).union(rows.where(F.col(target) == 1).orderBy(*order).limit(per_class))
