"""Seeded floor-plan masks: rooms by recursive cuts, walls on their borders, a door between neighbours, windows outside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seeds of the validation split start here.
VALIDATION = 10_000_000


def cuts(r: np.random.Generator, box: tuple[int, int, int, int], least: int, depth: int = 0) -> list[tuple[int, int, int, int]]:
    """Rectangles (x, y, w, h) of a recursive random partition with sides of at least `least`."""
    x, y, w, h = box
    wide, high = w >= 2 * least, h >= 2 * least
    if not (wide or high) or depth >= 2 and r.random() < 0.25 + 0.1 * depth:
        return [box]
    if wide and (not high or w > h):
        c = int(r.integers(least, w - least + 1))
        return cuts(r, (x, y, c, h), least, depth + 1) + cuts(r, (x + c, y, w - c, h), least, depth + 1)
    c = int(r.integers(least, h - least + 1))
    return cuts(r, (x, y, w, c), least, depth + 1) + cuts(r, (x, y + c, w, h - c), least, depth + 1)


def _carve(mask: np.ndarray, axis: int, at: int, lo: int, hi: int, half: int, value: int) -> None:
    """Sets wall pixels of a stretch to a value."""
    part = mask[lo:hi, at - half : at + half + 1] if axis == 0 else mask[at - half : at + half + 1, lo:hi]
    part[part == 1] = value


def plan_mask(seed: int, size: int = 256) -> np.ndarray:
    """A label mask (0 background, 1 wall, 2 room, 3 door, 4 window); the same for the same seed and size."""
    r = np.random.default_rng(seed)
    edge, half = size // 10, max(2, size // 128)
    rooms = cuts(r, (edge, edge, size - 2 * edge, size - 2 * edge), size // 5)
    mask = np.zeros((size, size), np.uint8)
    mask[edge : size - edge, edge : size - edge] = 2
    for x, y, w, h in rooms:
        for c in (x, x + w):
            mask[y - half : y + h + half + 1, c - half : c + half + 1] = 1
        for c in (y, y + h):
            mask[c - half : c + half + 1, x - half : x + w + half + 1] = 1
    wide = size // 16
    for i, (x, y, w, h) in enumerate(rooms):
        for x2, y2, w2, h2 in rooms[i + 1 :]:
            for axis, at, lo, hi in ((0, x2, max(y, y2), min(y + h, y2 + h2)) if x + w == x2 else (0, x, max(y, y2), min(y + h, y2 + h2)) if x2 + w2 == x else (1, y2, max(x, x2), min(x + w, x2 + w2)) if y + h == y2 else (1, y, max(x, x2), min(x + w, x2 + w2)) if y2 + h2 == y else (0, 0, 0, 0),):
                if hi - lo >= wide + 6 * half and r.random() < 0.8:
                    s = int(r.integers(lo + 3 * half, hi - wide - 3 * half + 1))
                    _carve(mask, axis, at, s, s + wide, half, 3)
        for axis, at, lo, hi in ((0, x, y, y + h), (0, x + w, y, y + h), (1, y, x, x + w), (1, y + h, x, x + w)):
            if at in (edge, size - edge) and hi - lo >= wide + 6 * half and r.random() < 0.6:
                s = int(r.integers(lo + 3 * half, hi - wide - 3 * half + 1))
                _carve(mask, axis, at, s, s + wide, half, 4)
    return mask


def masks_of(plans: DataFrame, seed: int = 0, size: int = 256) -> DataFrame:
    """(plan_id, height, width, data) of plans (id); plan k has seed + k, whatever task makes it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"plan_id": pdf.id, "height": size, "width": size, "data": [plan_mask(seed + int(k), size).tobytes() for k in pdf.id]})

    return plans.select("id").mapInPandas(run, "plan_id long, height int, width int, data binary")


def masks(spark: SparkSession, n: int, seed: int = 0, size: int = 256) -> DataFrame:
    return masks_of(spark.range(n), seed, size)


def write_dataset(spark: SparkSession, path: str, n_train: int, n_val: int, size: int = 256, seed: int = 0) -> None:
    """Training and validation masks as a table partitioned by split; validation seeds start at VALIDATION."""
    train, val = masks(spark, n_train, seed, size), masks(spark, n_val, seed + VALIDATION, size)
    both = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    both.write.mode("overwrite").partitionBy("split").parquet(path)
