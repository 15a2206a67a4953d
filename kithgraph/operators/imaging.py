"""Measurements of pictures given as pixel arrays, and of landmarks given as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.scoring import clamp

# Limits that results depend on.
LEAST_EYE_DISTANCE, MOST_SLANT, LEAST_NOSE, MOST_NOSE, MOST_OFFSET = 20.0, 30.0, 0.3, 2.0, 0.5
IDEAL_NOSE, NO_NOSE_SCORE, CROP_QUALITY, MOST_ROTATION, SCALES = 0.8, 0.7, 0.3, 35.0, (0.3, 3.0)
#: Distance of the reference eyes (0.34191, 0.46157) and (0.65653, 0.45983).
EYES_APART = ((0.65653 - 0.34191) ** 2 + (0.45983 - 0.46157) ** 2) ** 0.5


def landmark_check(width: int, height: int, target: int = 112) -> dict[str, Column]:
    """verdict, geometry and alignment of the eyes (lx, ly, rx, ry) and the nose (nx, ny, may be null) on a picture.

    geometry scores the proportions from 0 to 1; alignment blends how little the face has to be turned and scaled to the
    target size with it, and is that of a plain crop where the landmarks can't be used.
    """
    lx, ly, rx, ry, nx, ny = (F.col(c) for c in ("lx", "ly", "rx", "ry", "nx", "ny"))
    outside = (F.least(lx, ly, rx, ry) < 0) | (F.greatest(lx, rx) > width) | (F.greatest(ly, ry) > height)
    apart = F.sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly))
    slant = F.degrees(F.atan2(ry - ly, rx - lx))
    ratio, offset = (ny - (ly + ry) / 2) / apart, F.abs(nx - (lx + rx) / 2) / apart
    nose = nx.isNotNull() & ny.isNotNull()
    verdict = (
        F.when(outside, "OUT_OF_BOUNDS").when(apart < LEAST_EYE_DISTANCE, "EYES_TOO_CLOSE").when(F.abs(slant) > MOST_SLANT, "EXTREME_POSE")
        .when(nose & ((ratio < LEAST_NOSE) | (ratio > MOST_NOSE)), "INVALID_GEOMETRY").when(nose & (offset > MOST_OFFSET), "EXTREME_POSE").otherwise("VALID")
    )
    ideal = 1 - clamp(F.abs(ratio - IDEAL_NOSE) / IDEAL_NOSE, 0, 1)
    valid = verdict == "VALID"
    geometry = F.when(valid, F.when(nose, clamp(ideal * (1 - offset * 2), 0, 1)).otherwise(NO_NOSE_SCORE)).otherwise(0.0)
    scale = clamp(F.lit(EYES_APART * target) / apart, *SCALES)
    turned, scaled = clamp(F.abs(slant) / MOST_ROTATION, 0, 1), clamp(F.abs(F.log2(scale)), 0, 1)
    alignment = F.when(valid & (F.abs(slant) <= MOST_ROTATION), clamp((1 - turned) * 0.4 + (1 - scaled) * 0.3 + geometry * 0.3, 0, 1)).otherwise(CROP_QUALITY)
    return {"verdict": verdict, "geometry": geometry, "alignment": alignment}


def levels(values: str) -> Column:
    """Pixel levels of values from -1 to 1 in float arithmetic; a plain 1 or 127 would make it double, which cuts some values a level lower."""
    one, scale = F.lit(1).cast("float"), F.lit(127).cast("float")
    return F.transform(values, lambda e: ((e.cast("float") + one) * scale).cast("int"))


def measure_images(images: DataFrame) -> DataFrame:
    """image_id, variance of the 4-neighbour Laplacian, mean, least and most of gray pictures (w, h, pixels)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for image_id, w, h, pixels in zip(b.image_id, b.w, b.h, b.pixels, strict=True):
                a = np.asarray(pixels, dtype=np.float64).reshape(h, w)
                laplace = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
                out.append((image_id, float(laplace.var()) if laplace.size else 0.0, float(a.mean()), float(a.min()), float(a.max())))
            yield pd.DataFrame(out, columns=["image_id", "variance", "brightness", "darkest", "lightest"])

    return images.mapInPandas(measure, "image_id long, variance double, brightness double, darkest double, lightest double")


#: Side of the picture that a descriptor reads, of its grid, and the descriptor's length (fixed values).
SIDE, GRID, LENGTH = 32, 4, 512


def hash_descriptor(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """A unit vector of a picture (packed RGB): mean colours of a grid, then blue differences along the diagonal."""
    at = np.arange(SIDE)
    small = pixels.reshape(height, width)[at * height // SIDE][:, at * width // SIDE]
    colours = np.stack([small >> 16 & 255, small >> 8 & 255, small & 255], axis=2)
    cell = SIDE // GRID
    means = colours.reshape(GRID, cell, GRID, cell, 3).mean(axis=(1, 3)) / 255
    blue = colours[:, :, 2].astype(np.float64)
    out = np.concatenate([means.ravel(), ((blue[:-1, :-1] - blue[1:, 1:]) / 255).ravel()])[:LENGTH]
    size = np.linalg.norm(out)
    return (out / size if size else out).astype(np.float32)


def hash_descriptors(pictures: DataFrame) -> DataFrame:
    """image_id, descriptor of pictures (image_id, w, h, pixels)."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [hash_descriptor(np.asarray(p), w, h) for p, w, h in zip(b.pixels, b.w, b.h, strict=True)]
            yield pd.DataFrame({"image_id": b.image_id, "descriptor": found})

    return pictures.select("image_id", "w", "h", "pixels").mapInPandas(describe, "image_id long, descriptor array<float>")
