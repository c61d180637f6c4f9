"""Label rasters as rows: pixels (plan_id, y, x, label) and runs (plan_id, y, x0, x1, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ("plan_id", "y", "x")


def rectangle_pixels(rects: DataFrame) -> DataFrame:
    """One row for each pixel of rectangles (plan_id, x0, y0, w, h, ..); other columns come along.

    Rows of pixels are dealt out by (plan_id, y) before they are spread over x: what paints them, finds their runs or joins
    them row by row needs no further shuffle.
    """
    rest = [c for c in rects.columns if c not in ("x0", "y0", "w", "h")]
    rows = rects.where("w > 0 and h > 0").select(*rest, "x0", "w", F.explode(F.sequence("y0", F.col("y0") + F.col("h") - 1)).alias("y"))
    rows = rows.repartition(int(rects.sparkSession.conf.get("spark.sql.shuffle.partitions")), "plan_id", "y")
    return rows.select(*rest, "y", F.explode(F.sequence("x0", F.col("x0") + F.col("w") - 1)).alias("x"))


def painted(pixels: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(plan_id, y, x, value): what was painted last on each pixel, by the order columns."""
    return pixels.groupBy(*PIXEL).agg(F.max_by(value, F.struct(*order)).alias(value))


def painters_order(kind):
    """Rooms lie under railings, walls, windows and doors, in this order."""
    return F.when(kind == "room", 0).when(kind == "railing", 1).when(kind == "wall", 2).when(kind == "window", 3).when(kind == "door", 4)


def boundaries(pixels: DataFrame, label: str = "label") -> DataFrame:
    """(plan_id, y, x, axis, before, after): pixels whose left (x) or upper (y) neighbour has another label."""
    out = []
    for axis, fixed in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("plan_id", fixed).orderBy(axis)
        near = pixels.select(*PIXEL, F.lit(axis).alias("axis"), F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(label).over(w)).alias("before"), F.col(label).alias("after"))
        out.append(near.where("before is not null and before <> after"))
    return out[0].unionByName(out[1])


def runs(points: DataFrame, by: list[str], at: str) -> DataFrame:
    """(by.., lo, hi, n): maximal runs of consecutive whole numbers; repeated ones count once."""
    own = points.select(*by, at).distinct()
    island = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return own.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).drop("_i")


def shared_segments(pixels: DataFrame, label: str = "label") -> DataFrame:
    """(plan_id, a, b, axis, fixed, lo, hi, n): straight stretches along which regions a < b touch."""
    edges = boundaries(pixels, label).select("plan_id", F.least("before", "after").alias("a"), F.greatest("before", "after").alias("b"), "axis", F.when(F.col("axis") == "x", F.col("x")).otherwise(F.col("y")).alias("fixed"), F.when(F.col("axis") == "x", F.col("y")).otherwise(F.col("x")).alias("at"))
    return runs(edges, ["plan_id", "a", "b", "axis", "fixed"], "at")


def longest(segments: DataFrame, by: list[str]) -> DataFrame:
    """The longest segment of each group; of equals the least (axis, fixed, lo)."""
    first = F.max_by(F.struct("axis", "fixed", "lo", "hi", "n"), F.struct(F.col("n"), F.when(F.col("axis") == "x", 1).otherwise(0), -F.col("fixed"), -F.col("lo")))
    return segments.groupBy(*by).agg(first.alias("s")).select(*by, "s.*")


def _around(radius: int, across: dict, down: dict, pixels: DataFrame) -> DataFrame:
    """pixels with columns computed over the square of so many pixels around each: first along rows, then along columns.

    Each pixel is read twice, not (2 r + 1)^2 times; absent pixels count for nothing.
    """
    row = Window.partitionBy("plan_id", "y").orderBy("x").rangeBetween(-radius, radius)
    column = Window.partitionBy("plan_id", "x").orderBy("y").rangeBetween(-radius, radius)
    out = pixels.select("*", *[e.over(row).alias(c) for c, e in across.items()])
    return out.select("*", *[e.over(column).alias(c) for c, e in down.items()]).drop(*across)


def box(pixels: DataFrame, radius: int, value: str, kind: str, name: str) -> DataFrame:
    """pixels with the largest or least value in the square of so many pixels around each."""
    f = F.max if kind == "max" else F.min
    return _around(radius, {"_a": f(value)}, {name: f("_a")}, pixels)


def edge_map(pixels: DataFrame, radius: int, label: str = "label") -> DataFrame:
    """pixels with edge 0 or 1: whether the square around holds more than one label; ignored labels count as -1."""
    own = pixels.withColumn("_v", F.when(F.col(label) == 255, -1).otherwise(F.col(label)))
    own = _around(radius, {"_a": F.max("_v"), "_b": F.min("_v")}, {"_hi": F.max("_a"), "_lo": F.min("_b")}, own)
    return own.withColumn("edge", (F.col("_hi") != F.col("_lo")).cast("int")).drop("_v", "_hi", "_lo")


def edge_sides(edges: DataFrame, near: DataFrame) -> DataFrame:
    """(plan_id, y, x, exterior, interior): edge pixels (plan_id, y, x, edge) that are near the outside (in near), and the others."""
    beside = near.select(*PIXEL, F.lit(True).alias("_n")).distinct().hint("merge")  # pixels look as small as their rectangles
    own = edges.select(*PIXEL, (F.col("edge") == 1).alias("_e")).join(beside, list(PIXEL), "left")
    return own.select(*PIXEL, (F.col("_e") & F.col("_n").isNotNull()).alias("exterior"), (F.col("_e") & F.col("_n").isNull()).alias("interior"))


def dilate(pixels: DataFrame, radius: int, bit: str = "bit") -> DataFrame:
    return box(pixels, radius, bit, "max", "_d").withColumn(bit, F.col("_d")).drop("_d")


def erode(pixels: DataFrame, radius: int, bit: str = "bit") -> DataFrame:
    return box(pixels, radius, bit, "min", "_d").withColumn(bit, F.col("_d")).drop("_d")


def close(pixels: DataFrame, radius: int, bit: str = "bit") -> DataFrame:
    return erode(dilate(pixels, radius, bit), radius, bit)


def component_stats(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by.., area, x0, y0, x1, y1, sum_x, sum_y): size, box and sums of coordinates; cx = sum_x / area."""
    return pixels.groupBy(*by).agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def overlaps(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """(plan_id, left, right, inter, area_left, area_right, iou) of regions that share a pixel; runs are joined, not pixels.

    Spark takes exploded rows for no larger than what they come from, and would send them to all executors: hence the hints.
    """
    one = runs(a, ["plan_id", "y", left], "x").select("plan_id", "y", left, "lo", "hi", "n")
    two = runs(b, ["plan_id", "y", right], "x").select("plan_id", "y", right, F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("n").alias("n2"))
    both = one.join(two.hint("merge"), ["plan_id", "y"]).where("lo <= hi2 and lo2 <= hi")
    both = both.groupBy("plan_id", left, right).agg(F.sum(F.least("hi", "hi2") - F.greatest("lo", "lo2") + 1).cast("long").alias("inter"))
    areas = one.groupBy("plan_id", left).agg(F.sum("n").alias("area_left")), two.groupBy("plan_id", right).agg(F.sum("n2").alias("area_right"))
    both = both.join(areas[0].hint("merge"), ["plan_id", left]).join(areas[1].hint("merge"), ["plan_id", right])
    return both.withColumn("iou", F.col("inter") / (F.col("area_left") + F.col("area_right") - F.col("inter")))


def overlap_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(plan_id, both_, only_a, only_b, either): pixels of two masks in one pass over both."""
    marked = a.select(*PIXEL, F.lit(1).alias("m")).unionByName(b.select(*PIXEL, F.lit(2).alias("m"))).groupBy(*PIXEL).agg(F.bit_or("m").alias("m"))
    count = lambda v, name: F.count_if(F.col("m") == v).alias(name)
    return marked.groupBy("plan_id").agg(count(3, "both_"), count(1, "only_a"), count(2, "only_b"), F.count("*").alias("either"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).unionByName(b.select(*PIXEL)).distinct()


def inside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of a that b has too."""
    return a.join(b.select(*PIXEL), list(PIXEL), "left_semi")


def outside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of a that b hasn't."""
    return a.join(b.select(*PIXEL), list(PIXEL), "left_anti")


def resized(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Nearest neighbour to another size: target pixel (x, y) takes source pixel floor((x, y) * source / target)."""

    def targets(at: str, n: int, m: int):
        first, last = f"cast(({at} * {m} + {n} - 1) div {n} as int)", f"cast((({at} + 1) * {m} + {n} - 1) div {n} - 1 as int)"
        return F.expr(f"case when {first} <= {last} then sequence({first}, {last}) else array() end")

    rest = [c for c in pixels.columns if c not in ("x", "y")]
    rows = pixels.select(*rest, "x", F.explode(targets("y", height, to_height)).alias("y"))
    return rows.select(*rest, "y", F.explode(targets("x", width, to_width)).alias("x"))
