"""Image features and control states, in numpy over decoded pixels.

The features need no vision library; pixel parity with one is not promised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Weights of the technical score, and where a feature becomes an issue.
WEIGHTS = {"resolution": 0.16, "sharpness": 0.24, "contrast": 0.22, "illumination": 0.14, "glare": 0.12, "skew": 0.12}
CUTOFFS = {"resolution": 0.90, "sharpness": 0.80, "contrast": 0.80, "illumination": 0.80, "glare": 0.75, "skew": 0.85}
ADVICE = {"resolution": "upscale", "sharpness": "denoise_sharpen", "contrast": "clahe", "illumination": "illumination_normalization", "skew": "deskew"}
ISSUES = {"resolution": "low_resolution", "sharpness": "blur", "contrast": "low_contrast", "illumination": "uneven_illumination", "glare": "glare", "skew": "skew"}


def _blocks_mean(gray: np.ndarray, n: int = 16) -> np.ndarray:
    rows, cols = (np.linspace(0, s, n + 1).astype(int) for s in gray.shape)
    return np.array([[gray[a:max(b, a + 1), c:max(d, c + 1)].mean() for c, d in zip(cols[:-1], cols[1:])] for a, b in zip(rows[:-1], rows[1:])])


def estimate_skew(gray: np.ndarray) -> float:
    """The angle within 15 degrees at which rows of ink are sharpest, 0 without ink. By projection profiles on a small copy."""
    step = max(1, max(gray.shape) // 400)
    y, x = np.nonzero(gray[::step, ::step] < 128)
    if len(y) < 50:
        return 0.0
    best, score = 0.0, -1.0
    for angle in np.arange(-15, 15.01, 0.5):
        t = np.deg2rad(angle)
        row = np.round(y * np.cos(t) - x * np.sin(t)).astype(int)
        counts = np.bincount(row - row.min())
        value = float((counts.astype(float) ** 2).sum())
        if value > score * (1 + 1e-9) or (abs(value - score) <= 1e-9 * score and abs(angle) < abs(best)):
            best, score = float(angle), value
    return best


def features(bgr: np.ndarray) -> dict[str, float]:
    """Six features in [0, 1] of an image of shape (height, width, 3)."""
    b, g, r = (bgr[:, :, i].astype(np.float64) for i in range(3))
    gray = np.round(0.114 * b + 0.587 * g + 0.299 * r)
    lap = gray[1:-1, :-2] + gray[1:-1, 2:] + gray[:-2, 1:-1] + gray[2:, 1:-1] - 4 * gray[1:-1, 1:-1] if min(gray.shape) > 2 else np.zeros((1, 1))
    p5, p95 = np.percentile(gray, [5, 95])
    ink = gray < p95 - 12
    spread = p95 - np.percentile(gray[ink], 20) if ink.mean() >= 0.0005 else p95 - p5
    high = bgr.max(axis=2).astype(float)
    low = bgr.min(axis=2).astype(float)
    saturation = np.where(high > 0, (high - low) / np.maximum(high, 1) * 255, 0)
    washed = ((high >= 248) & (saturation <= 28)).mean()
    white_page = washed >= 0.40 and (gray < 235).mean() < 0.25
    degrees = estimate_skew(gray)
    clip = lambda v: float(min(1.0, max(0.0, v)))
    return {
        "resolution": clip(min(gray.shape) / 1200), "sharpness": clip(1 - np.exp(-lap.var() / 220)), "contrast": clip(spread / 170), "illumination": clip(1 - max(0.0, _blocks_mean(gray).std() - 42) / 85),
        "glare": 1.0 if white_page else clip(1 - min(1.0, washed / 0.06)), "skew": clip(1 - min(1.0, abs(degrees) / 8)), "degrees": degrees,
    }


def pixels_of(row) -> np.ndarray:
    """The BGR pixels of a row of decoded images."""
    # Numbers are floats in a batch where some rows have no image.
    pixels = np.frombuffer(row.data, np.uint8).reshape(int(row.height), int(row.width), int(row.channels))
    return np.repeat(pixels, 3, axis=2) if row.channels == 1 else pixels[:, :, :3]


def assess_images(images: DataFrame) -> DataFrame:
    """Features of decoded images (job_id, width, height, channels, data)."""
    names = [*WEIGHTS, "degrees"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                pixels = np.repeat(pixels, 3, axis=2) if row.channels == 1 else pixels[:, :, :3]
                found = features(pixels)
                out.append((row.job_id, row.width, row.height, *(found[n] for n in names)))
            yield pd.DataFrame(out, columns=["job_id", "width", "height", *names])

    rows = images.select("job_id", "width", "height", "channels", "data").mapInPandas(run, "job_id string, width int, height int, " + ", ".join(f"{n} double" for n in names))
    return with_quality(rows)


def with_quality(rows: DataFrame) -> DataFrame:
    """``rows`` of features with overall, issues and recommendations."""
    overall = F.exp(sum(F.lit(w) * F.ln(F.greatest(F.col(n), F.lit(1e-6))) for n, w in WEIGHTS.items()))
    bad = lambda n: F.col(n) < CUTOFFS[n]
    issues = F.array_compact(F.array(*[F.when(bad(n), F.lit(ISSUES[n])) for n in WEIGHTS]))
    advice = F.array_compact(F.array(*[F.when(bad(n), F.lit(ADVICE[n])) for n in WEIGHTS if n in ADVICE]))
    return rows.withColumns({"overall": F.greatest(F.lit(0.0), F.least(F.lit(1.0), overall)), "issues": issues, "recommendations": advice})


def control_gates(width: Column, height: Column, circularity: Column, short_side: Column) -> Column:
    """Whether a contour may be a box: size against the page, squareness, roundness for circles."""
    size, aspect = F.greatest(width, height), width / F.greatest(height, F.lit(1))
    return (size >= F.greatest(F.lit(8.0), 0.006 * short_side)) & (size <= 0.055 * short_side) & aspect.between(0.72, 1.28) & (circularity.isNull() | (circularity >= 0.62))


def control_state(ink: Column, shape_confidence: Column) -> Column:
    """struct<state, state_confidence> of the inner ink ratio: empty below .035, ticked from .070."""
    empty = F.least(F.lit(1.0), (0.035 - ink) / 0.035)
    ticked = F.least(F.lit(1.0), (ink - 0.070) / 0.13)
    sure = F.least(F.lit(1.0), F.abs(ink - 0.0525) / 0.035)
    state = F.when(ink <= 0.035, F.lit("unchecked")).when(ink >= 0.070, F.lit("checked")).otherwise(F.lit("ambiguous"))
    value = F.when(ink <= 0.035, 0.55 + 0.45 * empty).when(ink >= 0.070, 0.60 + 0.40 * ticked).otherwise(0.50 + 0.20 * sure)
    return F.struct(state.alias("state"), (value * shape_confidence).alias("state_confidence"))


def transform_pixels(bgr: np.ndarray, action: str, degrees: float = 0.0) -> np.ndarray:
    """One of the seven crop and page transforms, in plain numpy."""
    img = bgr.astype(np.float64)
    gray = img @ np.array([0.114, 0.587, 0.299])
    clip = lambda x: np.clip(np.round(x), 0, 255).astype(np.uint8)
    if action == "upscale":
        k = 3 if min(bgr.shape[:2]) < 500 else 2
        return bgr.repeat(k, axis=0).repeat(k, axis=1)
    if action == "clahe":
        low, high = np.percentile(gray, [1, 99])
        return clip((img - low) * 255 / max(high - low, 1.0))
    if action == "denoise_sharpen":
        soft = _box_blur(img, 1)
        return clip(img * 1.5 - soft * 0.5)
    if action == "illumination_normalization":
        light = _box_blur(img, max(7, min(bgr.shape[:2]) // 16))
        return clip(img * 220 / np.maximum(light, 1))
    if action == "adaptive_binarize":
        local = _box_blur(gray[:, :, None], 15)[:, :, 0]
        return np.where(gray > local - 11, 255, 0).astype(np.uint8)[:, :, None].repeat(3, axis=2)
    if action == "checkbox_focus":
        return np.where(gray > _otsu(gray), 255, 0).astype(np.uint8)[:, :, None].repeat(3, axis=2)
    if action == "deskew":
        return _rotate(bgr, degrees)
    raise ValueError(f"unknown action {action}")


def _box_blur(img: np.ndarray, radius: int) -> np.ndarray:
    for axis in (0, 1):
        size = img.shape[axis]
        sums = np.cumsum(np.insert(img, 0, 0, axis=axis), axis=axis)
        high = np.minimum(np.arange(size) + radius + 1, size)
        low = np.maximum(np.arange(size) - radius, 0)
        n = (high - low).reshape([-1 if a == axis else 1 for a in range(img.ndim)])
        img = (np.take(sums, high, axis=axis) - np.take(sums, low, axis=axis)) / n
    return img


def _otsu(gray: np.ndarray) -> float:
    counts = np.bincount(np.clip(gray, 0, 255).astype(int).ravel(), minlength=256).astype(float)
    weight, mean = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * weight / weight[-1] - mean) ** 2 / (weight * (weight[-1] - weight))
    return float(np.nanargmax(np.nan_to_num(between)))


def _rotate(bgr: np.ndarray, degrees: float) -> np.ndarray:
    h, w = bgr.shape[:2]
    t = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.round((x - cx) * np.cos(t) - (y - cy) * np.sin(t) + cx).astype(int)
    sy = np.round((x - cx) * np.sin(t) + (y - cy) * np.cos(t) + cy).astype(int)
    out = np.full_like(bgr, 255)
    good = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out[good] = bgr[sy[good], sx[good]]
    return out
