"""A model's description of a page: decoded, checked, and turned into quality and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .readiness import HANDWRITING, SEVERITY

_BOX = "bbox:struct<x1:int,y1:int,x2:int,y2:int>"
SCHEMA = (
    "detectedDocumentType string, schemaMatch string, languages array<string>, handwritingPresent boolean, handwritingLegibility string, "
    f"regions array<struct<name:string,kind:string,{_BOX}>>, controlGroups array<struct<name:string,kind:string,exclusive:boolean,optionLabels:array<string>,{_BOX}>>, "
    f"qualityIssues array<struct<kind:string,severity:string,affects:array<string>,{_BOX}>>, recommendedProfiles array<string>"
)
#: Names that a description may use, and how long its lists may be.
MATCHES = ("match", "possible", "mismatch", "unknown")
PROFILES = {"deskew": "deskew", "local_contrast": "clahe", "illumination_normalization": "illumination_normalization", "mild_denoise_sharpen": "denoise_sharpen", "upscale": "upscale", "none": None}
LIMITS = {"languages": 5, "regions": 12, "controlGroups": 12, "qualityIssues": 12, "recommendedProfiles": 3}


def decode_understanding(replies: DataFrame) -> DataFrame:
    """``replies`` (job_id, reply) with ``u``, the description, and ``error``, which says why there is none.

    The first JSON object of a reply counts. A page without handwriting has legibility not_present, whatever is said; one
    with handwriting can't have it.
    """
    text = F.expr("substring(reply, greatest(locate('{', reply), 1))")
    raw = F.from_json(text, SCHEMA)
    rows = replies.withColumn("raw", raw)
    r = lambda n: F.col(f"raw.{n}")
    present = F.coalesce(r("handwritingPresent"), F.lit(False))
    hand = F.when(present, F.coalesce(r("handwritingLegibility"), F.lit("not_present"))).otherwise(F.lit("not_present"))
    unknown = lambda c, names: c.isNotNull() & ~c.isin(*names)
    long = F.lit(False)
    for name, most in LIMITS.items():
        long = long | (F.coalesce(F.size(r(name)), F.lit(0)) > most)
    empty = F.col("raw").isNull() | F.coalesce(*[r(n).cast("string") for n in ("detectedDocumentType", "schemaMatch", "handwritingPresent", "handwritingLegibility")], F.to_json(r("languages")), F.to_json(r("qualityIssues"))).isNull()
    error = (
        F.when(~F.contains("reply", F.lit("{")) | empty, "unreadable").when(long, "list_too_long").when(present & (hand == "not_present"), "handwriting_inconsistent")
        .when(unknown(r("schemaMatch"), MATCHES) | unknown(hand, tuple(HANDWRITING)) | F.exists(F.coalesce(r("qualityIssues"), F.from_json(F.lit("[]"), "array<struct<kind:string,severity:string,affects:array<string>,bbox:struct<x1:int,y1:int,x2:int,y2:int>>>")), lambda q: ~q["severity"].isin(*SEVERITY)), "unknown_name")
    )
    fixed = F.col("raw").withField("handwritingLegibility", hand).withField("schemaMatch", F.coalesce(r("schemaMatch"), F.lit("unknown")))
    return rows.withColumn("error", error).withColumn("u", F.when(F.col("error").isNull(), fixed)).drop("raw")


def understood(rows: DataFrame) -> DataFrame:
    """Of each job: handwriting, severities (for semantic quality), mismatch, and the enhancement actions it suggests."""
    actions: Column = F.filter(F.transform(F.coalesce("u.recommendedProfiles", F.array().cast("array<string>")), lambda p: F.coalesce(*[F.when(p == k, F.lit(v)) for k, v in PROFILES.items() if v])), lambda a: a.isNotNull())
    return rows.select(
        "job_id", F.col("u.handwritingLegibility").alias("handwriting"), F.transform(F.coalesce("u.qualityIssues", F.from_json(F.lit("[]"), "array<struct<kind:string,severity:string,affects:array<string>,bbox:struct<x1:int,y1:int,x2:int,y2:int>>>")), lambda q: q["severity"]).alias("severities"),
        F.coalesce(F.col("u.schemaMatch") == "mismatch", F.lit(False)).alias("mismatch"), actions.alias("actions"), "error",
    )


def understanding_records(rows: DataFrame, images: DataFrame, model_id: str) -> DataFrame:
    """A record of each page that was described: job_id, imageSha256 (of the pixels shown), modelId, analysis. ``rows`` are decoded replies."""
    shown = images.select("job_id", F.sha2("data", 256).alias("imageSha256"))
    return rows.where("error is null").join(shown, "job_id").select("job_id", "imageSha256", F.lit(model_id).alias("modelId"), F.col("u").alias("analysis"))
