"""Evidence ledger, result envelope, steps and timings, idempotent traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geometry import CORNERS
from ..functions.hashing import event_id, text_sha256

LEDGER = ("job_id", "id", "kind", "page", *CORNERS, "confidence", "source", "text_sha256", "artifact_path", "artifact_sha256", "transform_chain")


def _ledger(rows: DataFrame, kind: str, text: str | None, confidence: str = "confidence") -> DataFrame:
    none = F.lit(None).cast("string")
    digest = text_sha256(F.col(text)) if text else none
    return rows.select("job_id", "id", F.lit(kind).alias("kind"), "page", *CORNERS, F.col(confidence).alias("confidence"), "source", digest.alias("text_sha256"), none.alias("artifact_path"), none.alias("artifact_sha256"), F.array().cast("array<string>").alias("transform_chain"))


def evidence_ledger(spans: DataFrame, blocks: DataFrame, controls: DataFrame) -> DataFrame:
    """Spans, blocks and controls as evidence records. Texts are kept as digests only."""
    return _ledger(spans, "ocr_span", "text").unionByName(_ledger(blocks, "layout_block", "content")).unionByName(_ledger(controls, "control", None, "state_confidence"))


def image_evidence(images: DataFrame, kind: str = "image") -> DataFrame:
    """Evidence records of image files (job_id, path, content, width, height)."""
    return images.select(
        "job_id", F.concat_ws(":", F.lit(kind), "job_id").alias("id"), F.lit(kind).alias("kind"), F.lit(1).alias("page"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"),
        F.lit(1.0).alias("confidence"), F.lit("source").alias("source"), F.lit(None).cast("string").alias("text_sha256"), F.col("path").alias("artifact_path"), F.sha2("content", 256).alias("artifact_sha256"), F.array().cast("array<string>").alias("transform_chain"),
    )


def crop_evidence(crops: DataFrame) -> DataFrame:
    """Evidence records of crops (job_id, block_id, page, cx1, cy1, cx2, cy2, data, actions); digests are of the pixels that were read."""
    none = F.lit(None).cast("string")
    return crops.where("data is not null").select(
        "job_id", F.concat_ws(":", F.lit("crop"), "job_id", "block_id").alias("id"), F.lit("crop").alias("kind"), "page", *[F.col(f"c{c}").alias(c) for c in CORNERS],
        F.lit(1.0).alias("confidence"), F.lit("layout_crop").alias("source"), none.alias("text_sha256"), none.alias("artifact_path"), F.sha2("data", 256).alias("artifact_sha256"), F.col("actions").alias("transform_chain"),
    )


def layout_records(blocks: DataFrame, spans: DataFrame, controls: DataFrame, members: DataFrame, held: DataFrame) -> DataFrame:
    """What each block holds: job_id, block_id, label, page, its box, and the ids of its spans and controls in order.

    ``members`` and ``held`` are (job_id, page, item_id, block_id) of the spans and of the controls. A job's blocks are a
    page's, so the lists are short.
    """
    def ids(items: DataFrame, of: DataFrame, name: str) -> DataFrame:
        rows = of.join(items.select("job_id", "page", F.col("id").alias("item_id"), "seq"), ["job_id", "page", "item_id"])
        listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "item_id"))), lambda x: x["item_id"])
        return rows.groupBy("job_id", "page", "block_id").agg(listed.alias(name))

    none = F.array().cast("array<string>")
    rows = blocks.withColumnRenamed("id", "block_id")
    for part, name in ((ids(spans, members, "span_ids"), "span_ids"), (ids(controls, held, "control_ids"), "control_ids")):
        rows = rows.join(part, ["job_id", "page", "block_id"], "left").withColumn(name, F.coalesce(name, none))
    return rows.select("job_id", "block_id", "seq", "label", "page", *CORNERS, "span_ids", "control_ids")


def layout_extractions(records: DataFrame, decisions: DataFrame, envelopes_: DataFrame) -> DataFrame:
    """One row per job: ``layouts``, its layout_records() in order, and ``combined``, what they came to together.

    Jobs that have no envelope yet have no row.
    """
    kept = [c for c in records.columns if c not in ("job_id", "seq")]
    layouts = records.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block_id", F.struct(*kept).alias("v")))), lambda x: x["v"]).alias("layouts"))
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.struct("score", "disposition", "reasons", "value", "evidence_ids").alias("d"))))).alias("fieldDecisions")
    rows = path_lists(decisions).join(decisions.groupBy("job_id").agg(fields), "job_id").join(envelopes_.select("job_id", F.to_json("data", {"ignoreNullFields": "false"}).alias("data")), "job_id")
    combined = F.struct("data", F.col("accepted").alias("acceptedPaths"), F.col("unresolved").alias("unresolvedPaths"), "fieldDecisions")
    out = rows.select("job_id", combined.alias("combined")).join(layouts, "job_id", "left")
    return out.select("job_id", "layouts", "combined")


def trace_events(rows: DataFrame) -> DataFrame:
    """Steps (run_id, node, attempt, input_hash, status, ...) with their event ids. Values are never part of them."""
    return rows.withColumn("event_id", event_id(F.col("run_id"), F.col("node"), F.col("attempt"), F.col("input_hash"))).drop("values")


def trace_append(events: DataFrame, known: DataFrame) -> DataFrame:
    """The events that are not in ``known`` (event_id, status); of repeated ones, the first by ``at``."""
    new = events.join(known.select("event_id", "status").distinct(), ["event_id", "status"], "left_anti")
    return new.withColumn("r_", F.row_number().over(Window.partitionBy("event_id", "status").orderBy("at"))).where("r_ = 1").drop("r_")


def total_timing(steps: DataFrame) -> DataFrame:
    """Milliseconds of each job: the sum of each node's last duration."""
    last = steps.groupBy("job_id", "node").agg(F.max_by("ms", F.struct("attempt", "seq")).alias("ms"))
    return last.groupBy("job_id").agg(F.sum("ms").alias("total_ms"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "ms")))).alias("timings"))


def stage_mean(rows: DataFrame, value: str, by: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """The mean of a stage's values for each job; 0 where there is none."""
    return rows.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def label_counts(blocks: DataFrame) -> DataFrame:
    counts = blocks.groupBy("job_id", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"), F.sum("n").alias("blocks"))


def path_lists(decisions: DataFrame) -> DataFrame:
    """Accepted and unresolved paths of each job, sorted."""
    of = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("path"))))
    return decisions.groupBy("job_id").agg(of(F.col("disposition") == "accepted").alias("accepted"), of(F.col("disposition") != "accepted").alias("unresolved"))


def envelopes(decisions: DataFrame, paths: list[str], corrections: DataFrame | None = None, pre_paths: tuple[str, ...] = ()) -> DataFrame:
    """One row per job: ``data``, a nested struct of accepted values with camel-case names, and ``meta``.

    Corrections (job_id, path, value) overwrite values of known paths; others are left out. Blank names become null.
    ``pre`` holds the raw readings of ``pre_paths`` whether accepted or not.
    """
    rows = decisions
    if corrections is not None:
        fixed = corrections.where(F.col("path").isin(*paths)).groupBy("job_id", "path").agg(F.max("value").alias("fix_"))
        rows = rows.join(fixed, ["job_id", "path"], "left").withColumn("final", F.coalesce("fix_", F.when(F.col("disposition") == "accepted", F.col("value"))))
    else:
        rows = rows.withColumn("final", F.when(F.col("disposition") == "accepted", F.col("value")))
    wide = rows.groupBy("job_id").agg(
        *[F.max(F.when(F.col("path") == p, F.col("final"))).alias(f"v{i}") for i, p in enumerate(paths)], *[F.max(F.when(F.col("path") == p, F.col("raw"))).alias(f"r{i}") for i, p in enumerate(pre_paths)],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.struct("score", "disposition", "reasons", "evidence_ids").alias("m"))))).alias("fields"),
    )
    tree: dict = {}
    for i, p in enumerate(paths):
        at = tree
        *heads, leaf = p.split(".")[1:]
        for h in heads:
            at = at.setdefault(h, {})
        value = F.col(f"v{i}")
        at[leaf] = F.when(F.trim(value) != "", value) if leaf in ("firstName", "lastName", "nationality") else value

    def build(node: dict):
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    pre = F.struct(*[F.col(f"r{i}").alias(p.rsplit(".", 1)[-1]) for i, p in enumerate(pre_paths)]) if pre_paths else F.lit(None)
    return wide.select("job_id", build(tree).alias("data"), F.struct(F.col("fields"), pre.alias("pre")).alias("meta"))


def envelope_json(rows: DataFrame) -> DataFrame:
    """(job_id, value): exactly two top-level keys, nulls kept."""
    return rows.select("job_id", F.to_json(F.struct("data", "meta"), {"ignoreNullFields": "false"}).alias("value"))
