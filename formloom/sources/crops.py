"""Crops of pages: cut, enhanced, read by a recogniser, and what it finds mapped back to the page.

A page's blocks travel to its pixels, so each image is shuffled once however many crops it gives. A crop that can't be
cut or read is a row with an error; it fails neither its page nor its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.controls import detect_controls
from ..functions.geometry import Box, crop_to_page, upscaled_to_page
from ..functions.image import pixels_of, transform_pixels
from ..functions.text import safe_error
from ..schemas import CONTROLS, SPANS
from .providers import attempted

#: Between a job's name and a block's where a crop stands for a page; no job's name has it.
MARK = "~"
CROPS = "job_id string, block_id string, page int, cx1 int, cy1 int, cx2 int, cy2 int, scale int, short int, width int, height int, channels int, data binary, actions array<string>, error string"
READ = "job_id string, block_id string, page int, cx1 int, cy1 int, cx2 int, cy2 int, scale int, status string, attempts int, error string, spans array<struct<text:string,confidence:double,x1:int,y1:int,x2:int,y2:int>>"
#: ``seq`` of what is read in a crop starts behind that of a page's own evidence.
BEHIND = 1_000_000_000


#: Bytes of pixels of a table of crops on its way from Python; a single crop may be larger.
TABLE_BYTES = 4 << 20
#: Where ``data`` is in a row of CROPS.
DATA = [c.strip().split(" ")[0] for c in CROPS.split(",")].index("data")
#: Rows of such a table.
TABLE_ROWS = 1_000


def tables(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows of CROPS in lists of TABLE_ROWS or about TABLE_BYTES: enhanced crops are several times a page's size, others are small and many."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[DATA] or b"")
        if held >= TABLE_BYTES or len(out) >= TABLE_ROWS:
            yield out
            out, held = [], 0
    if out:
        yield out


def cut_crops(images: DataFrame, boxes: DataFrame, padding: int = 12) -> DataFrame:
    """A row of CROPS for each box (job_id, block_id, page, x1, y1, x2, y2, actions): padded, cut, and its actions applied.

    A box with null corners is the whole page. ``cx1`` to ``cy2`` are the crop's place on the page, ``scale`` is how much
    larger its pixels are, and ``short`` the page's short side. Boxes of jobs without an image give no row.
    """

    def one(page: np.ndarray, b: Any) -> tuple:
        h, w = page.shape[:2]
        if pd.isna(b["x1"]):
            x1, y1, x2, y2 = 0, 0, w, h
        else:  # floats where another box of the page has nulls
            x1, y1, x2, y2 = (int(b[c]) for c in ("x1", "y1", "x2", "y2"))
            x1, y1, x2, y2 = max(0, x1 - padding), max(0, y1 - padding), min(w, x2 + padding), min(h, y2 + padding)
        actions = list(b["actions"])
        try:
            if x2 <= x1 or y2 <= y1:
                raise ValueError("the crop is empty")
            crop = page[y1:y2, x1:x2]
            for action in actions:
                crop = transform_pixels(crop, action)
        except Exception as e:  # a crop's failure is its own
            return x1, y1, x2, y2, 1, min(h, w), 0, 0, 3, None, actions, safe_error(f"{type(e).__name__}: {e}")
        return x1, y1, x2, y2, crop.shape[1] // (x2 - x1), min(h, w), crop.shape[1], crop.shape[0], 3, np.ascontiguousarray(crop).tobytes(), actions, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in CROPS.split(",")]
        def rows() -> Iterator[tuple]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    page = pixels_of(row)
                    for b in row.boxes:
                        yield row.job_id, b["block_id"], b["page"], *one(page, b)

        for out in tables(rows()):
            yield pd.DataFrame(out, columns=names).astype({"error": object, "data": object})

    own = boxes.groupBy("job_id").agg(F.collect_list(F.struct("block_id", "page", "x1", "y1", "x2", "y2", "actions")).alias("boxes"))
    return images.select("job_id", "width", "height", "channels", "data").join(own, "job_id").mapInPandas(run, CROPS)


def read_crops(crops: DataFrame, recognise: Callable[[np.ndarray], list[dict[str, Any]]], retries: int = 1) -> DataFrame:
    """READ rows: what ``recognise`` finds in each crop's BGR pixels, in crop pixels; a crop is tried 1 + ``retries`` times by itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in READ.split(", ")]
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                found, error, tries = (None, row.error, 0) if row.data is None else attempted(lambda row=row: list(recognise(pixels_of(row))), retries)
                out.append((row.job_id, row.block_id, row.page, row.cx1, row.cy1, row.cx2, row.cy2, row.scale, "failed" if error else "ok", tries, error, found or []))
            yield pd.DataFrame(out, columns=names)

    return crops.mapInPandas(run, READ)


def _renamed(rows: DataFrame, part: str, attempt: int, order: list) -> DataFrame:
    """``rows`` with ids and order of their own: block, part, attempt and place in the block; ``seq`` behind the page's."""
    place = F.row_number().over(Window.partitionBy("job_id", "block_id").orderBy(*order)) - 1
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("block_id", *order)) + F.lit(BEHIND * (attempt + 1))
    return rows.withColumns({"id": F.concat_ws(":", "block_id", F.lit(part), F.lit(str(attempt)), F.format_string("%04d", place)), "seq": seq.cast("long")})


def crop_spans(read: DataFrame, attempt: int, source: str) -> DataFrame:
    """Spans in page pixels, with their block_id, of what was read; blank texts drop out."""
    rows = read.select("job_id", "block_id", "page", "cx1", "cy1", "cx2", "cy2", "scale", F.posexplode("spans").alias("pos", "s")).where("trim(s.text) <> ''")
    item = Box(columns=tuple(F.col(f"s.{c}") for c in ("x1", "y1", "x2", "y2")))
    rows = rows.select("job_id", "block_id", "page", "pos", F.trim("s.text").alias("text"), F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"), *upscaled_to_page(item, Box("c"), F.col("scale")).flat())
    rows = _renamed(rows, "crop", attempt, ["pos"]).withColumns({"script": F.lit(None).cast("string"), "source": F.lit(source), "attempt": F.lit(attempt)})
    return rows.select(*_names(SPANS), "block_id")


def crop_controls(crops: DataFrame, attempt: int) -> DataFrame:
    """Controls in page pixels, with their block_id, that the detector finds in crops."""
    good = crops.where("data is not null")
    found = detect_controls(good.select(F.concat_ws(MARK, "job_id", "block_id").alias("job_id"), "scale", "short", "width", "height", "channels", "data"), attempt)
    at = F.split("job_id", MARK, 2)
    found = found.withColumns({"block_id": at[1], "job_id": at[0], "pos": F.col("seq")}).drop("page").join(good.select("job_id", "block_id", "page", "cx1", "cy1", "cx2", "cy2"), ["job_id", "block_id"])
    box = dict(zip(("x1", "y1", "x2", "y2"), crop_to_page(Box(), Box("c")).flat(), strict=True))
    rows = _renamed(found.withColumns(box), "control", attempt, ["pos"])
    return rows.select(*_names(CONTROLS), "block_id")


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]


@dataclass(frozen=True)
class Reading:
    """What was read in crops: spans and controls with block_id, the crops, and warnings (job_id, warning) of those that failed."""

    spans: DataFrame
    controls: DataFrame
    crops: DataFrame
    warnings: DataFrame


class CropReader:
    """Reads the crops of tasks (job_id, block_id[, actions]) again: a recovery provider, and a reader of blocks.

    A task's block is one of the evidence's; the block "page" is the whole page. ``keep`` stores a table that is read
    several times.
    """

    def __init__(self, images: DataFrame, recognise: Callable[[np.ndarray], list[dict[str, Any]]], padding: int = 12, retries: int = 1, source: str = "ocr", detect: bool = True) -> None:
        self.images, self.recognise, self.padding, self.retries, self.source, self.detect = images, recognise, padding, retries, source, detect

    def __call__(self, tasks: DataFrame, e: Any, attempt: int, keep: Callable[..., DataFrame] | None = None) -> Reading:
        keep = keep or (lambda name, build, attempt=0: build())
        again = "actions" in tasks.columns
        actions = F.col("actions") if again else F.array().cast("array<string>")
        places = e.blocks.select("job_id", F.col("id").alias("block_id"), F.col("page").alias("page"), "x1", "y1", "x2", "y2")
        rows = tasks.select("job_id", "block_id", actions.alias("actions")).join(places, ["job_id", "block_id"], "left").where("x1 is not null or block_id = 'page'")
        name = "recovery" if again else "blocks"
        crops = keep(f"{name}_crops", lambda: cut_crops(self.images, rows.withColumn("page", F.coalesce("page", F.lit(1))), self.padding), attempt)
        read = keep(f"{name}_read", lambda: read_crops(crops, self.recognise, self.retries), attempt)
        spans = crop_spans(read, attempt, f"{self.source}:layout_recovery:{attempt}" if again else f"{self.source}:layout_crop")
        controls = crop_controls(crops, attempt) if self.detect and again else e.controls.limit(0).withColumn("block_id", F.lit("")).select(*_names(CONTROLS), "block_id")
        warnings = read.where("status = 'failed'").select("job_id", F.concat_ws(":", F.lit("layout_crop_failed"), "block_id", "error").alias("warning"))
        return Reading(spans, keep(f"{name}_controls", lambda: controls, attempt), crops, warnings)
