"""Verification of proposed values against the evidence that they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import json_literal
from ..functions.normalize import normalize_value
from ..functions.text import text_supports_value

ASSOCIATION = 0.92
VISUAL = ("crop", "image")


def verify_proposals(proposals: DataFrame, paths: DataFrame, evidence: DataFrame, spans: DataFrame, blocks: DataFrame, controls: DataFrame, visual: bool = False, date_order: str = "REJECT_AMBIGUOUS", weight_unit: str = "kg", attempt: int = 0) -> DataFrame:
    """``proposals`` (job_id, pid, path, raw, evidence_ids) with reject_code, null if grounded, and the candidate's columns.

    A proposal must name a known path and known evidence. Text must be supported by the cited texts; a boolean must agree
    with the cited controls, or, in visual verification with a cited image, with those that are not ambiguous.
    """
    spec = F.broadcast(paths.select("path", "type", F.col("ord").alias("path_ord")))
    cites = proposals.select("job_id", "pid", F.posexplode("evidence_ids").alias("pos", "id"))
    texts = spans.select("job_id", "id", F.col("text").alias("t")).withColumn("first", F.lit(0)).union(blocks.select("job_id", "id", F.col("content").alias("t")).withColumn("first", F.lit(1)))
    texts = texts.groupBy("job_id", "id").agg(F.min_by("t", "first").alias("t"))
    states = controls.select("job_id", "id", "state")
    known = evidence.select("job_id", "id", "kind", F.col("confidence").alias("e_confidence"), F.col("source").alias("e_source"), F.lit(True).alias("known"))
    rows = cites.join(known, ["job_id", "id"], "left").join(texts, ["job_id", "id"], "left").join(states, ["job_id", "id"], "left")
    per = rows.groupBy("job_id", "pid").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("known", F.lit(False)).alias("known"), "kind", "e_confidence", "e_source", F.coalesce("t", F.lit("")).alias("t"), "state"))).alias("c")
    )
    joined = proposals.join(per, ["job_id", "pid"], "left").join(spec, "path", "left")
    unknown = F.transform(F.filter("c", lambda x: ~x["known"]), lambda x: x["id"])
    cited_text = F.array_join(F.transform("c", lambda x: x["t"]), " ")
    image = F.lit(visual) & F.coalesce(F.exists("c", lambda x: x["kind"].isin(*VISUAL)), F.lit(False))
    held = F.transform(F.filter("c", lambda x: x["state"].isNotNull()), lambda x: x["state"])
    ambiguous = F.array_contains(held, "ambiguous")
    sure = F.filter(held, lambda s: s != "ambiguous")
    # A boolean is given as 'true' or 'false'; any other text that isn't empty counts as true.
    truth = ~F.col("raw").isin("", "false")
    checked = F.array_contains(held, "checked")
    boolean = F.when(F.col("raw").isNull(), "boolean_requires_value").when(
        ~image, F.when(F.coalesce(F.size(held), F.lit(0)) <= 0, "boolean_requires_control_evidence").when(ambiguous, "ambiguous_control_evidence").when(truth != checked, "boolean_conflicts_with_control")
    ).otherwise(F.when((F.size(sure) > 0) & (truth != F.array_contains(sure, "checked")), "boolean_conflicts_with_cited_control"))
    supported = F.coalesce(text_supports_value(F.coalesce(cited_text, F.lit("")), F.col("raw")), F.lit(False))
    code = (
        F.when(F.col("type").isNull(), "unknown_output_path").when(F.size(unknown) > 0, F.concat(F.lit("unknown_evidence_ids:"), F.array_join(unknown, ",")))
        .when(F.col("type") == "boolean", boolean).when(~supported, "value_not_supported_by_cited_text")
    )
    sources = F.array_distinct(F.transform(F.filter("c", lambda x: ~x["kind"].isin(*VISUAL)), lambda x: x["e_source"]))
    sources = F.when(image, F.array_distinct(F.array_append(sources, F.lit("local_vlm_visual")))).otherwise(sources)
    out = joined.withColumn("n", normalize_value(F.col("raw"), F.col("type"), date_order, weight_unit))
    return out.select(
        "job_id", "pid", "path", "path_ord", "raw", code.alias("reject_code"), F.col("n.value").alias("value"), json_literal(F.col("n.value"), F.col("type")).alias("norm_json"), "evidence_ids",
        F.lit("vlm_visual" if visual else "vlm_grounded").alias("source"), F.coalesce(sources, F.array().cast("array<string>")).alias("support_sources"),
        F.coalesce(F.array_min(F.transform("c", lambda x: x["e_confidence"])), F.lit(0.0)).alias("recognition"), F.lit(ASSOCIATION).alias("association"), F.lit(attempt).alias("attempt"), F.col("n.codes").alias("codes"),
    )


def accepted_candidates(verdicts: DataFrame) -> DataFrame:
    """Grounded proposals as candidates, in the order of their ids."""
    from pyspark.sql import Window

    rows = verdicts.where("reject_code is null").withColumn("page", F.lit(1))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy("pid")) - 1).drop("pid", "reject_code")


def rejection_warnings(verdicts: DataFrame) -> DataFrame:
    rows = verdicts.where("reject_code is not null")
    return rows.select("job_id", F.concat_ws(":", F.lit("rejected_proposal"), "path", "reject_code").alias("warning"))
