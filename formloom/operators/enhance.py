"""Enhancement of pages: variants planned, drawn, scanned again, gated, and the best one's evidence taken."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.image import assess_images, transform_pixels
from ..stages import staged
from .readiness import best_enhancement, control_retention, enhancement_gates, ocr_readiness, text_retention, variant_rows

#: Between a job's name and the number of a variant; no job's name has it.
MARK = "~"
IMAGE = "job_id string, width int, height int, channels int, data binary"


def draw_variants(images: DataFrame, variants: DataFrame) -> DataFrame:
    """Decoded images (job_id, width, height, channels, data) of each variant (job_id, variant, actions, degrees), named job~variant."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                pixels = np.repeat(pixels, 3, axis=2) if row.channels == 1 else pixels[:, :, :3]
                for action in row.actions:
                    pixels = transform_pixels(pixels, action, row.degrees)
                out.append((row.job_id, pixels.shape[1], pixels.shape[0], 3, np.ascontiguousarray(pixels).tobytes()))
            yield pd.DataFrame(out, columns=["job_id", "width", "height", "channels", "data"])

    rows = images.select("job_id", "width", "height", "channels", "data").join(variants, "job_id")
    named = rows.withColumn("job_id", F.concat_ws(MARK, "job_id", F.col("variant").cast("string")))
    return named.select("job_id", "width", "height", "channels", "data", "actions", "degrees").mapInPandas(run, IMAGE)


def _parted(rows: DataFrame) -> DataFrame:
    at = F.split("job_id", MARK)
    return rows.withColumns({"own": at[0], "variant": at[1].cast("int")})


def enhanced(evidence: tuple[DataFrame, DataFrame, DataFrame], images: DataFrame, jobs: DataFrame, scan: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], min_gain: float = 0.02, min_text: float = 0.80, min_controls: float = 0.75, most: int = 3) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame, DataFrame]:
    """Spans, blocks and controls with those of jobs replaced by an enhanced page's, where one passes all gates; the verdicts; and the images with those pages in place of the old ones.

    ``jobs`` has job_id, suggested, recommendations, degrees, ocr_before and technical_before of the jobs to enhance; ``scan``
    reads images. Verdicts have a row for each variant: job_id, variant, actions, eligible, reason, chosen.
    """
    spans, blocks, controls = evidence
    variants = staged(variant_rows(jobs, most).join(jobs.select("job_id", "degrees"), "job_id"))
    drawn = staged(draw_variants(images, variants))
    new = [staged(t) for t in scan(drawn)]
    ready = _parted(ocr_readiness(new[0]).withColumnRenamed("score", "ocr_after")).select("own", "variant", "ocr_after")
    technical = _parted(assess_images(drawn)).select("own", "variant", F.col("overall").alias("technical_after"))
    tried = _parted(drawn.select("job_id")).select("job_id", "own")
    before = spans.select(F.col("job_id").alias("own"), "text", "confidence").join(tried, "own").select("job_id", "text", "confidence")
    text = _parted(text_retention(before, new[0])).select("own", "variant", "text_retention")
    had = controls.groupBy(F.col("job_id").alias("own")).agg(F.count("*").alias("before"))
    have = _parted(new[2].groupBy("job_id").agg(F.count("*").alias("after"))).select("own", "variant", "after")
    rows = variants.withColumnRenamed("job_id", "own").join(jobs.select(F.col("job_id").alias("own"), "ocr_before", "technical_before"), "own")
    for part in (ready, technical, text, have):
        rows = rows.join(part, ["own", "variant"], "left")
    rows = rows.join(had, "own", "left").withColumns({
        "ocr_after": F.coalesce("ocr_after", F.lit(0.0)), "text_retention": F.coalesce("text_retention", F.lit(1.0)), "readiness": F.coalesce("ocr_after", F.lit(0.0)),
        "control_retention": control_retention(F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))),
    })
    gated = staged(enhancement_gates(rows, min_gain, min_text, min_controls).withColumnRenamed("own", "job_id"))
    best = best_enhancement(gated).select("job_id", F.col("variant"), F.lit(True).alias("chosen"))
    verdicts = gated.join(best, ["job_id", "variant"], "left").select("job_id", "variant", "actions", "eligible", "reason", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    chosen = staged(best.select("job_id", "variant"))

    def taken(old: DataFrame, new_: DataFrame) -> DataFrame:
        found = _parted(new_).join(chosen.withColumnRenamed("job_id", "own"), ["own", "variant"], "left_semi").withColumn("job_id", F.col("own"))
        return old.join(chosen, "job_id", "left_anti").unionByName(found.select(old.columns))

    pages = images.select("job_id", "width", "height", "channels", "data")
    return tuple(taken(o, n) for o, n in zip(evidence, new, strict=True)), verdicts, taken(pages, drawn)
