"""Diagnostic overlays: block boxes drawn on a copy of the page, as PNG, with digests and label counts."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Ten distinct colours (BGR), chosen by the label's digest.
PALETTE = tuple((int(60 + 19 * k), int((97 * k + 40) % 200), int(230 - 21 * k)) for k in range(10))


def png(bgr: np.ndarray) -> bytes:
    """A PNG file of an image."""
    h, w = bgr.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(bgr[:, :, ::-1]).reshape(h, w * 3)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def draw(bgr: np.ndarray, boxes: list[tuple[int, int, int, int, str]], thick: int = 3) -> np.ndarray:
    """A copy with a frame around each box (x1, y1, x2, y2, label); without boxes, a frame around the page says so."""
    out = bgr.copy()
    h, w = out.shape[:2]
    for x1, y1, x2, y2, label in boxes or [(0, 0, w, h, "")]:
        colour = PALETTE[int(hashlib.sha256(label.encode()).hexdigest()[:2], 16) % 10]
        x1, y1, x2, y2 = max(0, x1), max(0, y1), min(w, x2), min(h, y2)
        out[y1 : y1 + thick, x1:x2] = out[max(y1, y2 - thick) : y2, x1:x2] = colour
        out[y1:y2, x1 : x1 + thick] = out[y1:y2, max(x1, x2 - thick) : x2] = colour
    return out


def render_overlays(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """job_id, png, sha256, blocks and label_counts of each decoded image; a page without blocks has an overlay too."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                pixels = np.repeat(pixels, 3, axis=2) if row.channels == 1 else pixels[:, :, :3]
                boxes = [(b["x1"], b["y1"], b["x2"], b["y2"], b["label"]) for b in (row.boxes if row.boxes is not None else [])]
                data = png(draw(pixels, boxes))
                out.append((row.job_id, data, hashlib.sha256(data).hexdigest(), len(boxes), pd.Series([b[4] for b in boxes], dtype=object).value_counts().to_dict()))
            yield pd.DataFrame(out, columns=["job_id", "png", "sha256", "blocks", "label_counts"])

    own = blocks.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2", "label"))).alias("boxes"))
    return images.select("job_id", "width", "height", "channels", "data").join(own, "job_id", "left").mapInPandas(run, "job_id string, png binary, sha256 string, blocks int, label_counts map<string,int>")
