"""Training data by kind: one name for each source, all as (plan_id, height, width, data) masks or image and mask pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.sources import generate, readers


def folder(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(name, image, mask) of <root>/<split>/images and masks."""
    return readers.folder_pairs(spark, root, split)


def synthetic(spark: SparkSession, plans: int, seed: int = 0, size: int = 512) -> DataFrame:
    """Generated masks of so many plans."""
    return generate.masks_of(spark.range(plans), seed=seed, size=size)


def drawings(spark: SparkSession, path: str, height: int, width: int, taxonomy: str = "coarse") -> DataFrame:
    """Masks painted from annotated drawings, one file each; the plan's number is a hash of its path."""
    raw = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("plan_id"), F.decode("content", "UTF-8").alias("svg"))
    return readers.paint(readers.svg_polygons(raw), height, width, taxonomy)


KINDS: dict[str, Callable[..., DataFrame]] = {"folder": folder, "synthetic": synthetic, "drawings": drawings}


def dataset(spark: SparkSession, kind: str, **options) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of dataset {kind!r}; there are {sorted(KINDS)}")
    return KINDS[kind](spark, **options)
