"""Detection of check boxes and radio buttons in page images, in numpy.

Ink is what is darker than its surroundings. Connected shapes of the right size
and squareness are boxes or circles; shapes of long strokes alone are looked at
too, so that a tick that touches its box doesn't hide it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.regions import suppress_overlaps
from .hashing import ordinal_id
from .image import _box_blur, control_state

SMALLEST, LARGEST = 0.006, 0.055


def ink_mask(bgr: np.ndarray) -> np.ndarray:
    gray = bgr.astype(np.float64) @ np.array([0.114, 0.587, 0.299])
    return gray < _box_blur(gray[:, :, None], 15)[:, :, 0] - 9


def runs(row: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of true values of a row; the end is exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def strokes(mask: np.ndarray, length: int) -> np.ndarray:
    """The mask's horizontal and vertical stretches of at least ``length``."""
    out = np.zeros_like(mask)
    for view, target in ((mask, out), (mask.T, out.T)):
        for y, row in enumerate(np.ascontiguousarray(view)):
            for a, b in runs(row):
                if b - a >= length:
                    target[y, a:b] = True
    return out


def shapes(mask: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """x1, y1, x2, y2 and filled area (its rows from end to end) of each connected shape."""
    parent: list[int] = []
    rows: list[tuple[int, int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        here = []
        at = 0
        for a, b in runs(row):
            own = len(parent)
            parent.append(own)
            rows.append((y, a, b))
            while at < len(above) and above[at][1] < a:
                at += 1
            k = at
            while k < len(above) and above[k][0] <= b:
                parent[find(own)] = find(above[k][2])
                k += 1
            here.append((a, b, own))
        above = here
    found: dict[int, dict[int, list[int]]] = {}
    for i, (y, a, b) in enumerate(rows):
        span = found.setdefault(find(i), {}).setdefault(y, [a, b])
        span[0], span[1] = min(span[0], a), max(span[1], b)
    for spans in found.values():
        ys = list(spans)
        yield min(s[0] for s in spans.values()), min(ys), max(s[1] for s in spans.values()), max(ys) + 1, sum(b - a for a, b in spans.values())


def outlines(mask: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """The mask's shapes, and its holes with the rim around them."""
    yield from shapes(mask)
    h, w = mask.shape
    for x1, y1, x2, y2, area in shapes(~mask):
        if x1 > 0 and y1 > 0 and x2 < w and y2 < h:
            yield x1 - 1, y1 - 1, x2 + 1, y2 + 1, area + 2 * (x2 - x1 + y2 - y1) + 4


def find_controls(bgr: np.ndarray, short: int | None = None) -> list[tuple[int, int, int, int, str, float, float]]:
    """x1, y1, x2, y2, kind, shape confidence and inner ink ratio of what may be a control; overlaps are left in.

    Sizes are measured against ``short``, the page's short side: the image's own unless it is a crop.
    """
    mask = ink_mask(bgr)
    short = short or min(mask.shape)
    least = max(8, int(short * SMALLEST))
    most = max(least + 1, int(short * LARGEST))
    out = []
    for source, border in ((mask, False), (strokes(mask, max(5, round(least * 0.70))), True)):
        for x1, y1, x2, y2, area in outlines(source):
            w, h = x2 - x1, y2 - y1
            if not (least <= w <= most and least <= h <= most and 0.72 <= w / h <= 1.28):
                continue
            fill, square = area / (w * h), 1 - abs(1 - w / h)
            if border and fill >= 0.40:
                kind, sure = "checkbox", min(1.0, 0.90 + 0.10 * square)
            elif fill >= 0.90:
                kind, sure = "checkbox", min(1.0, square)
            elif fill >= 0.62 * np.pi / 4:
                kind, sure = "radio", min(1.0, fill * 4 / np.pi)
            else:
                continue
            dx, dy = max(2, round(w * 0.24)), max(2, round(h * 0.24))
            inner = mask[y1 + dy : y2 - dy, x1 + dx : x2 - dx]
            if inner.size:
                out.append((x1, y1, x2, y2, kind, float(sure), float(inner.mean())))
    return out


def detect_controls(images: DataFrame, attempt: int = 0) -> DataFrame:
    """Controls of decoded images (job_id, width, height, channels, data), named by their place in reading order.

    Crops also have ``scale``, how many of their pixels are one of the page, and ``short``, the page's short side. Boxes are
    in pixels of the page's size.
    """
    columns = ["job_id", "width", "height", "channels", "data", *[c for c in ("scale", "short") if c in images.columns]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                pixels = np.repeat(pixels, 3, axis=2) if row.channels == 1 else pixels[:, :, :3]
                step = getattr(row, "scale", 1)
                out += [(row.job_id, str(i), *c) for i, c in enumerate(find_controls(pixels[::step, ::step], getattr(row, "short", None)))]
            yield pd.DataFrame(out, columns=["job_id", "id", "x1", "y1", "x2", "y2", "kind", "confidence", "ink_ratio"])

    rows = images.select(*columns).mapInPandas(run, "job_id string, id string, x1 int, y1 int, x2 int, y2 int, kind string, confidence double, ink_ratio double")
    rows = rows.withColumn("page", F.lit(1))
    kept = rows.join(suppress_overlaps(rows).select("job_id", "page", "id"), ["job_id", "page", "id"], "left_semi")
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("y1", "x1")) - 1
    out = kept.withColumns({"seq": seq.cast("long"), "s": control_state(F.col("ink_ratio"), F.col("confidence"))})
    return out.select("job_id", "page", "seq", ordinal_id(F.lit("control"), F.col("page"), F.col("seq")).alias("id"), "kind", F.col("s.state").alias("state"), F.col("s.state_confidence").alias("state_confidence"),
                      "x1", "y1", "x2", "y2", "ink_ratio", F.lit(None).cast("string").alias("associated_label_id"), F.lit("opencv").alias("source"), F.lit(attempt).alias("attempt"))
