"""Polygon fill: edges met with scanlines, crossings sorted and paired into runs, boundary pixels included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorwright.operators import raster


def edges(polygons: DataFrame, keys: list[str], corners: str = "polygon") -> DataFrame:
    """(keys.., x1, y1, x2, y2): the sides of polygons (keys.., array of points), corners rounded to pixels, halves up, none beyond 10^9.

    Null and empty polygons, and points with a null, have no sides; a single point is a side of no length.
    """
    whole = lambda v: F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), v.cast("double"))) + 0.5).cast("int")
    known = F.filter(corners, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    own = polygons.select(*keys, F.transform(known, lambda p: F.struct(whole(p["x"]).alias("x"), whole(p["y"]).alias("y"))).alias("p"))
    own = own.select(*keys, "p", F.posexplode("p").alias("i", "a"))
    b = F.get("p", (F.col("i") + 1) % F.size("p"))
    return own.select(*keys, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def filled_runs(polygons: DataFrame, keys: list[str], corners: str = "polygon", size: tuple[int, int] | None = None) -> DataFrame:
    """(keys.., y, lo, hi): pixels of polygons as disjoint runs: what is inside by the even-odd rule, and the outline.

    A side crosses a scanline y if one of its ends is at or above y and the other below; the outline is sampled at each
    step of a side's longer extent, halves rounded up. keys have to tell polygons apart. size: height and width of a
    raster; what lies outside is left out before it is spread, however far it reaches.
    """
    own = edges(polygons, keys, corners)
    first, last = F.least("y1", "y2"), F.greatest("y1", "y2") - 1
    if size:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(size[0] - 1))
    crossing = own.where("y1 <> y2").withColumns({"first": first, "last": last}).where("first <= last")
    crossing = crossing.select(*keys, "x1", "y1", "x2", "y2", F.explode(F.sequence("first", "last")).alias("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")).cast("double") * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossing = crossing.select(*keys, "y", at.alias("at"))
    pair = F.floor((F.row_number().over(Window.partitionBy(*keys, "y").orderBy("at")) - 1) / 2)
    inner = crossing.withColumn("pair", pair).groupBy(*keys, "y", "pair").agg(F.ceil(F.min("at")).cast("int").alias("lo"), F.floor(F.max("at")).cast("int").alias("hi"))
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    steps = own.withColumns({"n": F.greatest(dx, dy), "first": F.lit(0), "last": F.greatest(dx, dy)})
    if size:  # a step is a pixel of the longer extent: those before and behind the raster
        flat = dx >= dy
        begin, end, most = F.when(flat, F.col("x1")).otherwise(F.col("y1")), F.when(flat, F.col("x2")).otherwise(F.col("y2")), F.when(flat, size[1] - 1).otherwise(size[0] - 1)
        up = begin <= end
        steps = steps.withColumns({"first": F.greatest(F.lit(0), F.when(up, -begin).otherwise(begin - most)), "last": F.least(F.col("n"), F.when(up, most - begin).otherwise(begin))})
    steps = steps.where("first <= last")
    level = steps.where("y1 = y2").select(*keys, F.col("y1").alias("y"), F.least("x1", "x2").alias("lo"), F.greatest("x1", "x2").alias("hi"))  # its steps are a run
    steps = steps.where("y1 <> y2").select(*keys, "x1", "y1", "x2", "y2", "n", F.explode(F.sequence("first", "last")).alias("i"))
    t = F.col("i") / F.greatest(F.col("n"), F.lit(1))
    on = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * t + 0.5).cast("int")
    line = steps.select(*keys, on("y1", "y2").alias("y"), on("x1", "x2").alias("lo")).distinct().withColumn("hi", F.col("lo"))
    every = inner.drop("pair").unionByName(line).unionByName(level)
    if size:
        every = every.withColumns({"lo": F.greatest("lo", F.lit(0)), "hi": F.least("hi", F.lit(size[1] - 1))}).where((F.col("y") >= 0) & (F.col("y") < size[0]))
    w = Window.partitionBy(*keys, "y").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = every.where("lo <= hi").withColumn("new", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    return joined.groupBy(*keys, "y", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def rasters(pixels: DataFrame, height: int, width: int, value: str) -> DataFrame:
    """(plan_id, data): each plan's pixels (plan_id, y, x, value) as height x width bytes, row by row; absent ones are 0.

    Pixels become runs of one value, runs become rows, rows the raster; only that, which is one value by definition, is put
    together in one place.
    """
    runs = raster.runs(pixels.withColumn(value, F.col(value).cast("int")), ["plan_id", "y", value], "x")

    byte = F.lpad(F.hex(value), 2, "0")
    rows = _joined(runs, ["plan_id", "y"], "lo", "hi", _times(byte, F.col("n")), width, F.lit("00"))
    return _stacked(rows, height, width)


def painted_rasters(runs: DataFrame, height: int, width: int, value: str, order: list[str]) -> DataFrame:
    """(plan_id, data): runs (plan_id, y, lo, hi, value, order..) painted in that order as rasters; they lie inside the raster.

    Each row is a fold over its runs, each of which overlays what was painted before; no pixel gets a row of its own.
    """
    byte = F.lpad(F.hex(F.col(value).cast("int")), 2, "0")
    listed = runs.groupBy("plan_id", "y").agg(F.sort_array(F.collect_list(F.struct(*order, "lo", "hi", byte.alias("byte")))).alias("r"))
    over = lambda s, r: F.overlay(s, _times(r["byte"], r["hi"] - r["lo"] + 1), 2 * r["lo"] + 1, 2 * (r["hi"] - r["lo"] + 1))
    return _stacked(listed.select("plan_id", "y", F.aggregate("r", F.lit("00" * width), over).alias("s")), height, width)


def _stacked(rows: DataFrame, height: int, width: int) -> DataFrame:
    """(plan_id, data) of rows (plan_id, y, s) in hex; absent ones are 0."""
    whole = _joined(rows.withColumn("y2", F.col("y")), ["plan_id"], "y", "y2", F.col("s"), height, F.lit("00" * width))
    return whole.select("plan_id", F.unhex("s").alias("data"))


def _joined(df: DataFrame, by: list[str], at: str, end: str, piece: Column, most: int, blank: Column) -> DataFrame:
    """The pieces of a group in order, with blanks before, between and behind them."""
    gap = F.col(at) - F.coalesce(F.lag(end).over(Window.partitionBy(*by).orderBy(at)), F.lit(-1)) - 1
    parts = df.select(*by, at, end, F.concat(_times(blank, gap), piece).alias("piece"))
    whole = parts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "piece"))), lambda p: p["piece"]), "").alias("s"), F.max(end).alias("end"))
    return whole.select(*by, F.concat("s", _times(blank, most - 1 - F.col("end"))).alias("s"))


def _times(s: Column, n: Column) -> Column:
    return F.call_function("repeat", s, n.cast("int"))


def filled(polygons: DataFrame, keys: list[str], corners: str = "polygon") -> DataFrame:
    """(keys.., y, x): pixels of polygons."""
    return filled_runs(polygons, keys, corners).select(*keys, "y", F.explode(F.sequence("lo", "hi")).alias("x"))
