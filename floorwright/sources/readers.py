"""Readers: images and masks, split files, annotated SVG drawings, geometry documents and training logs.

All go through Spark's own readers, so a path may lie in any store that these reach.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.functions import scalars as S
from floorwright.functions import taxonomy
from floorwright.operators import scanlines
from floorwright.operators.raster import painted, painters_order
from floorwright.sources.shared import cut, dropped

#: Fixed value: largest upload in bytes.
MOST = 25 * 1024 * 1024


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, height, width, channels, data) of image files; files that are none are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    return raw.select(F.col("image.origin").alias("path"), F.substring_index("image.origin", "/", -1).alias("name"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def class_masks(spark: SparkSession, path: str) -> DataFrame:
    """Single-channel images as label masks."""
    return images(spark, path).where("channels = 1")


def raw_masks(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """(path, height, width, data, error) of files of height * width bytes; others get an error."""
    raw = spark.read.format("binaryFile").load(path)
    ok = F.col("length") == height * width
    return raw.select("path", F.lit(height).alias("height"), F.lit(width).alias("width"), F.when(ok, F.col("content")).alias("data"), F.when(~ok, F.format_string("%d bytes, not %d", "length", F.lit(height * width))).alias("error"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, status): 413 for files over the limit, 400 for those that are no image (neither has content), else 200."""
    raw = spark.read.format("binaryFile").load(path)
    place = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("place")  # the two readers write a local path differently
    shown = images(spark, path).select(place, F.lit(True).alias("shown"))
    status = F.when(F.col("length") > MOST, 413).when(F.col("shown").isNull(), 400).otherwise(200)
    return raw.withColumn("place", place).join(shown, "place", "left").select("path", "length", F.when(status == 200, F.col("content")).alias("content"), status.alias("status"))


def split_folders(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(split, folder) of a split file: folders between white space, slashes at the ends stripped."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("w"))
    return words.select(F.lit(split).alias("split"), F.regexp_replace("w", "^/+|/+$", "").alias("folder")).where("folder <> ''")


def all_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    out = None
    for split, path in paths.items():
        one = split_folders(spark, path, split)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no split")
    return out


def folder_pairs(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(name, image, mask): images and masks of a folder dataset by file name; an empty one raises."""
    side = lambda kind: images(spark, f"{root}/{split}/{kind}").select("name", F.struct("height", "width", "channels", "data").alias(kind[:-1]))
    out = side("images").join(side("masks"), "name")
    if out.isEmpty():
        raise ValueError(f"no pairs under {root}/{split}")
    return out


def write_masks(masks: DataFrame, path: str) -> None:
    """The mask cache: a table partitioned by taxonomy, read again instead of drawn again."""
    masks.write.mode("overwrite").partitionBy("taxonomy").parquet(path)


def _kind(attrs: dict[str, str]) -> tuple[str, str] | None:
    words = attrs.get("class", "").split() or [attrs.get("id", "")]
    head = words[0] if words else ""
    if head == "Space":
        return "room", words[1] if len(words) > 1 else "Undefined"
    named = {"Wall": "wall", "Door": "door", "Window": "window", "Railing": "railing"}
    found = named.get(head) or named.get(attrs.get("id", ""))
    return (found, words[1] if len(words) > 1 else "") if found else None


def svg_shapes(text: str) -> Iterator[tuple[int, str, str, str, str]]:
    """(ordinal, kind, subtype, transforms, points): polygons of groups that stand for an element, with all transforms above.

    A group's polygons are those right below it; polygons of other groups inside it (decoration) don't count for it.
    """
    ordinal = 0
    todo: list[tuple[Any, str, tuple[str, str] | None]] = [(ET.fromstring(text), "", None)]
    while todo:
        node, above, owner = todo.pop()
        maps = f"{above} {node.get('transform', '')}".strip()
        tag = node.tag.rpartition("}")[2]
        if tag == "polygon" and owner:
            yield ordinal, *owner, maps, node.get("points", "")
            ordinal += 1
        mine = _kind(node.attrib) if tag == "g" else None
        todo += [(child, maps, mine) for child in reversed(list(node))]


_SHAPE = "array<struct<ordinal:int,kind:string,subtype:string,transforms:string,points:string>>"


def _parsed(drawings: DataFrame) -> DataFrame:
    """(plan_id, shapes, error) of drawings (plan_id, svg): a drawing that is no XML has an error and no shapes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            shapes, errors = [], []
            for text in pdf.svg:
                try:
                    shapes.append([dict(zip(("ordinal", "kind", "subtype", "transforms", "points"), s, strict=True)) for s in svg_shapes(text)] if text else [])
                    errors.append(None)
                except ET.ParseError as e:
                    shapes.append([])
                    errors.append(str(e))
            yield pd.DataFrame({"plan_id": pdf.plan_id, "shapes": shapes, "error": pd.Series(errors, dtype=object)})

    return drawings.select("plan_id", "svg").mapInPandas(run, f"plan_id {drawings.schema['plan_id'].dataType.simpleString()}, shapes {_SHAPE}, error string")


def svg_polygons(drawings: DataFrame) -> DataFrame:
    """(plan_id, ordinal, kind, subtype, points) of drawings (plan_id, svg), points in the drawing's own space.

    Null drawings and those that are no XML have none; svg_errors() gives the latter.
    """
    raw = _parsed(drawings).select("plan_id", F.explode("shapes").alias("s")).select("plan_id", "s.*")
    out = raw.select("plan_id", "ordinal", "kind", "subtype", S.applied(S.affine(F.col("transforms")), S.points(F.col("points"))).alias("points"))
    return out.where(F.size("points") > 0)


def svg_errors(drawings: DataFrame) -> DataFrame:
    """(plan_id, error) of the drawings that are no XML."""
    return _parsed(drawings).where("error is not null").select("plan_id", "error")


def painted_runs(polygons: DataFrame, height: int, width: int, tax: str = "coarse") -> DataFrame:
    """(plan_id, ordinal, z, value, y, lo, hi): runs of polygons (plan_id, ordinal, kind, subtype, points) inside the raster; z is the painter's order."""
    t = taxonomy.taxonomy(tax)
    fixed = {"wall": t.wall, "door": t.door, "window": t.window}
    kind = F.col("kind")
    value = F.when(kind == "room", taxonomy.room_class(F.col("subtype"), tax)).when(kind == "railing", taxonomy.room_class(F.lit("Railing"), tax))
    for k, v in fixed.items():
        value = value.when(kind == k, v)
    own = polygons.select("plan_id", "ordinal", painters_order(kind).alias("z"), value.cast("int").alias("value"), "points").where("value is not null")
    return scanlines.filled_runs(own, ["plan_id", "ordinal", "z", "value"], "points", (height, width))


def painted_pixels(polygons: DataFrame, height: int, width: int, tax: str = "coarse") -> DataFrame:
    """(plan_id, y, x, value): polygons (plan_id, ordinal, kind, subtype, points) painted in the painter's order, inside the raster."""
    runs = painted_runs(polygons, height, width, tax)
    return painted(runs.select("plan_id", "ordinal", "z", "value", "y", F.explode(F.sequence("lo", "hi")).alias("x")), "value", ["z", "ordinal"])


def paint(polygons: DataFrame, height: int, width: int, tax: str = "coarse") -> DataFrame:
    """(plan_id, height, width, data, taxonomy): polygons painted as rasters; a plan whose polygons all lie outside has none.

    A raster is one value, so polygons are dealt out by plan once, before sides and runs are made of them.
    """
    dealt = polygons.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")), "plan_id")
    own = scanlines.painted_rasters(painted_runs(dealt, height, width, tax), height, width, "value", ["z", "ordinal"])
    return own.select(F.col("plan_id").cast("long").alias("plan_id"), F.lit(height).alias("height"), F.lit(width).alias("width"), "data", F.lit(tax).alias("taxonomy"))


MASK = "plan_id long, content string, height int, width int, data binary, taxonomy string"


def cached_masks(drawings: DataFrame, path: str, height: int, width: int, tax: str = "coarse") -> DataFrame:
    """(plan_id, content, height, width, data, taxonomy) of drawings (plan_id, svg), read through the table of masks at path.

    A mask is known by its plan, the sha256 of its drawing (content), its size and its taxonomy, which partitions the table.
    Only drawings without a mask there are drawn, and appended; a changed drawing is another one. Runs at the same time may
    both append a mask: readers take one row of each. A drawing that holds no shape, or isn't XML, has an empty mask; nulls
    are passed over, repeated rows count once. Hints, as masks pack so well that Spark would send them to all executors.
    """
    spark = drawings.sparkSession
    key = ["plan_id", "content"]
    own = drawings.where("plan_id is not null and svg is not null").select(F.col("plan_id").cast("long").alias("plan_id"), "svg", F.sha2("svg", 256).alias("content")).dropDuplicates(key)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    held = lambda: spark.read.schema(MASK).parquet(path).where((F.col("taxonomy") == tax) & (F.col("height") == height) & (F.col("width") == width))
    new = own.join(held().select(*key).hint("merge"), key, "left_anti") if there else own
    new = cut(new.withColumn("id", F.monotonically_increasing_id()))  # the id is written with the drawing
    if new.limit(1).count():
        # drawings are small and slow to parse, so they are dealt out by number, not size; painting reads the shapes three times
        dealt = new.select(F.col("id").alias("plan_id"), "svg").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "plan_id")
        shapes = cut(svg_polygons(dealt))
        drawn = paint(shapes, height, width, tax).select(F.col("plan_id").alias("id"), "data")
        blank = F.unhex(F.repeat(F.lit("00"), height * width))
        rows = new.select(*key, "id").join(drawn.hint("merge"), "id", "left").select(*key, F.lit(height).alias("height"), F.lit(width).alias("width"), F.coalesce("data", blank).alias("data"), F.lit(tax).alias("taxonomy"))
        rows.write.mode("append").partitionBy("taxonomy").parquet(path)
        dropped(shapes)
    dropped(new)
    return held().join(own.select(*key).hint("merge"), key, "left_semi").dropDuplicates(key)


LOG = "iter int, epoch int, lr double, ce double, dice double, total double, aux double, elapsed_s double, eval struct<mIoU:double,fwIoU:double,pixel_acc:double,mean_acc:double,per_class_iou:map<string,double>>"


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """Step and evaluation records of a log of JSON lines; evaluations have eval."""
    return spark.read.schema(LOG).json(path)
