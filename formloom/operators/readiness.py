"""OCR readiness, its fusion with image quality, and the gates that an enhanced page must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import word_tokens

#: Weights of readiness and fusion, and the scores of handwriting and visible issues.
CONFIDENT = 0.80
READY = {"mean": 0.65, "high": 0.20, "coverage": 0.15}
FUSION = {"overall": 0.55, "ocr": 0.30, "semantic": 0.15}
HANDWRITING = {"not_present": 1.0, "good": 0.95, "fair": 0.72, "poor": 0.42, "unreadable": 0.10}
SEVERITY = {"mild": 0.88, "moderate": 0.65, "severe": 0.35}
COVERAGE_CHARS = 120.0
MAX_TECHNICAL_DROP = 0.10


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ocr_readiness(spans: DataFrame, by: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """One row per job: score, span_count, character_count, mean_confidence, high_fraction; one map-side combined aggregate."""
    n = F.length(F.regexp_replace("text", r"(?U)\s", ""))
    rows = spans.select(*by, "confidence", F.coalesce(n, F.lit(0)).alias("n"))
    agg = rows.groupBy(*by).agg(F.sum("n").alias("chars"), F.count_if(F.col("n") > 0).alias("span_count"), F.sum(F.col("confidence") * F.col("n")).alias("w"), F.sum(F.when(F.col("confidence") >= CONFIDENT, F.col("n")).otherwise(0)).alias("h"))
    some = F.col("chars") > 0
    mean, high = F.col("w") / F.nullif(F.col("chars"), F.lit(0)), F.col("h") / F.nullif(F.col("chars"), F.lit(0))
    coverage = 1.0 - F.exp(-F.col("chars") / COVERAGE_CHARS)
    score = READY["mean"] * mean + READY["high"] * high + READY["coverage"] * coverage
    zero = lambda c: F.when(some, clip(c)).otherwise(0.0)
    return agg.select(*by, zero(score).alias("score"), "span_count", F.col("chars").alias("character_count"), zero(mean).alias("mean_confidence"), zero(high).alias("high_fraction"))


def lookup(key: Column, table: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])


def semantic_quality(handwriting: Column, severities: Column) -> Column:
    """The worse of the handwriting's and the issues' scores; null without an understanding (null handwriting)."""
    issue = F.coalesce(F.array_min(F.transform(severities, lambda s: lookup(s, SEVERITY))), F.lit(1.0))
    return F.when(handwriting.isNotNull(), F.least(issue, lookup(handwriting, HANDWRITING)))


def fused_readiness(overall: Column, ocr: Column, semantic: Column) -> Column:
    """Weighted geometric mean of what there is, weights renormalised."""
    parts = {"overall": overall, "ocr": ocr, "semantic": semantic}
    total = sum(F.when(c.isNotNull(), F.lit(FUSION[k])).otherwise(0.0) for k, c in parts.items())
    logs = sum(F.when(c.isNotNull(), F.lit(FUSION[k]) * F.ln(F.greatest(c, F.lit(1e-6)))).otherwise(0.0) for k, c in parts.items())
    return clip(F.exp(logs / total))


def effective_quality(readiness: Column, overall: Column) -> Column:
    return F.coalesce(readiness, overall)


def text_retention(baseline: DataFrame, candidate: DataFrame, key: str = "job_id") -> DataFrame:
    """The share of a baseline's confident words that are still there; 1 without any. One row per baseline job."""
    words = lambda rows: rows.select(key, F.explode(word_tokens(F.col("text"))).alias("token")).distinct()
    kept = words(baseline.where(F.col("confidence") >= CONFIDENT)).join(words(candidate).withColumn("hit", F.lit(1)), [key, "token"], "left")
    share = kept.groupBy(key).agg((F.count("hit") / F.count("*")).alias("share"))
    return baseline.select(key).distinct().join(share, key, "left").select(key, F.coalesce("share", F.lit(1.0)).alias("text_retention"))


def control_retention(before: Column, after: Column) -> Column:
    return F.when(before <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), after / F.nullif(before, F.lit(0))))


def enhancement_gates(rows: DataFrame, min_gain: float = 0.02, min_text: float = 0.80, min_controls: float = 0.75, ocr_enabled: bool = True) -> DataFrame:
    """``rows`` with eligible and reason, from ocr_before, ocr_after, text_retention, control_retention, technical_before and technical_after."""
    codes = F.array_compact(F.array(
        F.when(F.lit(not ocr_enabled), F.lit("ocr_engine_disabled")),
        F.when(F.col("ocr_after") - F.col("ocr_before") < min_gain, F.lit("insufficient_ocr_gain")),
        F.when(F.col("text_retention") < min_text, F.lit("baseline_text_not_preserved")),
        F.when(F.col("control_retention") < min_controls, F.lit("controls_not_preserved")),
        F.when(F.col("technical_after") < F.col("technical_before") - MAX_TECHNICAL_DROP, F.lit("technical_quality_regressed")),
    ))
    return rows.withColumn("eligible", F.size(codes) == 0).withColumn("reason", F.when(F.size(codes) == 0, F.lit("eligible")).otherwise(F.array_join(codes, "+")))


def best_enhancement(rows: DataFrame) -> DataFrame:
    """The eligible variant of each job with the best OCR score, readiness and technical quality; ties: the first."""
    order = F.struct("ocr_after", "readiness", "technical_after", (-F.col("variant")).alias("place"))
    return rows.where("eligible").groupBy("job_id").agg(F.max_by("variant", order).alias("variant"))


def document_route(rows: DataFrame, threshold: float = 0.90, attempt: int = 0, most: int = 1) -> DataFrame:
    """``rows`` (extraction_readiness, overall) with the next step: enhance what is below the threshold while attempts are left."""
    low = effective_quality(F.col("extraction_readiness"), F.col("overall")) < threshold
    return rows.withColumn("route", F.when(low & F.lit(attempt < most), "enhance_document").otherwise("map_rules"))


#: What is recommended for an issue, the action of each, and the order in which actions run on a page.
ACTIONS = ("upscale", "denoise_sharpen", "clahe", "illumination_normalization", "deskew")
PAGE_ORDER = ("deskew", "illumination_normalization", "clahe", "denoise_sharpen", "upscale")


def planned_actions(recommendations: Column) -> Column:
    """The first three recommended actions."""
    return F.slice(F.filter(recommendations, lambda a: a.isin(*ACTIONS)), 1, 3)


def variant_rows(rows: DataFrame, most: int = 3) -> DataFrame:
    """plan_variants() of every row of ``rows`` (job_id, suggested, recommendations): job_id, variant (from 0), actions."""
    wanted = F.array_union("suggested", planned_actions(F.col("recommendations")))
    ordered = F.filter(F.array(*[F.lit(a) for a in PAGE_ORDER]), lambda a: F.array_contains(wanted, a))
    alone = F.transform(ordered, lambda a: F.when(a == "illumination_normalization", F.array(a, F.lit("clahe"))).otherwise(F.array(a)))
    variants = F.when(F.size(ordered) > 1, F.array_prepend(alone, F.slice(ordered, 1, 3))).otherwise(alone)
    return rows.select("job_id", F.posexplode(F.slice(F.array_distinct(variants), 1, most)).alias("variant", "actions"))


def plan_variants(suggested: list[str], recommendations: list[str], most: int = 3) -> list[list[str]]:
    """Pages to try: all safe actions together, then one by one; illumination is followed by contrast."""
    wanted = [a for a in dict.fromkeys([*suggested, *[a for a in recommendations if a in ACTIONS][:3]]) if a in PAGE_ORDER]
    wanted.sort(key=PAGE_ORDER.index)
    variants = [[a, "clahe"] if a == "illumination_normalization" else [a] for a in wanted]
    if len(wanted) > 1:
        variants.insert(0, wanted[:3])
    found: list[list[str]] = []
    for v in variants:
        if v not in found:
            found.append(v)
    return found[: max(0, most)]
