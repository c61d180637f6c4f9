"""Floor-plan tables derived from the driver's tables by whole-number arithmetic, the same in every SQL engine.

Plans are numbered p_partkey % 8 for rasters and o_orderkey % plans for walls; nothing of the tables is left out: where a
raster of all parts would pile up, parts spread over as many plans as they fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts on one plan of 64 x 64 pixels.
ROOMS_PER_PLAN = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, logits, target): five values of each embedding as class logits, the label as target."""
    return read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 8).alias("plan_id"), F.slice("embedding", 1, 5).alias("logits"), (F.col("label") % 5).cast("int").alias("target"))


def rectangles(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """(plan_id, rid, x0, y0, w, h): a room for each part."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.floor(k / ROOMS_PER_PLAN).alias("plan_id"), k.alias("rid"), ((k * 37) % 48 + shift).cast("int").alias("x0"), ((k * 53) % 48).cast("int").alias("y0"),
        (4 + F.col("p_size") % 12).cast("int").alias("w"), (4 + (F.col("p_size") * 7) % 12).cast("int").alias("h"),
    )


RECTANGLES = "select p_partkey // 8 plan_id, p_partkey rid, (p_partkey * 37) % 48 + {shift} x0, (p_partkey * 53) % 48 y0, 4 + p_size % 12 w, 4 + (p_size * 7) % 12 h from part"
PIXELS = "select plan_id, y, x, max(rid) rid from (select plan_id, rid, unnest(range(x0, x0 + w)) x, y from (select *, unnest(range(y0, y0 + h)) y from ({rects}))) group by plan_id, y, x"


def rooms(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """(plan_id, y, x, rid): the parts' rectangles painted in order of key."""
    from floorwright.operators.raster import painted, rectangle_pixels

    return painted(rectangle_pixels(rectangles(spark, sf_dir, shift)), "rid", ["rid"])


def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, wall_id, x1, y1, x2, y2, thickness): a wall for each order, even keys lie, odd ones stand; 50 on a plan."""
    k = F.col("o_orderkey")
    lies = k % 2 == 0
    a, b, f = (k * 7) % 400, (k * 7) % 400 + 20 + k % 60, (k * 13) % 400
    d = lambda c: c.cast("double")
    return read(spark, sf_dir, "orders").select(
        F.floor(k / 50).alias("plan_id"), k.alias("wall_id"), d(F.when(lies, a).otherwise(f)).alias("x1"), d(F.when(lies, f).otherwise(a)).alias("y1"),
        d(F.when(lies, b).otherwise(f)).alias("x2"), d(F.when(lies, f).otherwise(b)).alias("y2"), (4.0 + k % 5).alias("thickness"),
    )


WALLS = """select o_orderkey // 50 plan_id, o_orderkey wall_id,
  (case when o_orderkey % 2 = 0 then (o_orderkey * 7) % 400 else (o_orderkey * 13) % 400 end)::double x1,
  (case when o_orderkey % 2 = 0 then (o_orderkey * 13) % 400 else (o_orderkey * 7) % 400 end)::double y1,
  (case when o_orderkey % 2 = 0 then (o_orderkey * 7) % 400 + 20 + o_orderkey % 60 else (o_orderkey * 13) % 400 end)::double x2,
  (case when o_orderkey % 2 = 0 then (o_orderkey * 13) % 400 else (o_orderkey * 7) % 400 + 20 + o_orderkey % 60 end)::double y2,
  4.0e0 + o_orderkey % 5 thickness from orders"""


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, opening_id, kind, px, py, width): an opening for each order and line number, on the plan of its order."""
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("p")
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"))
    return items.select(
        F.floor(k / 50).alias("plan_id"), (k * 16 + n).alias("opening_id"), F.when(F.col("f") == "R", "door").otherwise("window").alias("kind"),
        ((p * 11 + n * 17) % 460).cast("double").alias("px"), ((p * 19 + n * 29) % 460).cast("double").alias("py"), (8.0 + n * 2).alias("width"),
    )


OPENINGS = """select l_orderkey // 50 plan_id, l_orderkey * 16 + l_linenumber opening_id, case when f = 'R' then 'door' else 'window' end kind,
  ((p * 11 + l_linenumber * 17) % 460)::double px, ((p * 19 + l_linenumber * 29) % 460)::double py, 8.0e0 + l_linenumber * 2 width
  from (select l_orderkey, l_linenumber, min(l_partkey) p, min(l_returnflag) f from lineitem group by all)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, lo, hi, t): collinear spans, a track for each order's hundred and supplier's tenth."""
    a = F.col("l_partkey") % 500
    return read(spark, sf_dir, "lineitem").select((F.floor(F.col("l_orderkey") / 100) * 10 + F.col("l_suppkey") % 10).alias("k"), a.alias("lo"), (a + 3 + F.col("l_linenumber")).alias("hi"), F.col("l_quantity").alias("t"))


SPANS = "select l_orderkey // 100 * 10 + l_suppkey % 10 k, l_partkey % 500 lo, l_partkey % 500 + 3 + l_linenumber hi, l_quantity t from lineitem"


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(room_id, plan_id, polygon): a five-cornered room for each part."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = (k * 37) % 400, (k * 53) % 400
    poly = F.array(pt(x, y), pt(x + s + 5, y), pt(x + s + 5, y + s * 2 + 5), pt(x + 2, y + s * 2 + 8), pt(x, y + s))
    return read(spark, sf_dir, "part").select(k.alias("room_id"), F.floor(k / ROOMS_PER_PLAN).alias("plan_id"), poly.alias("polygon"))


POLYGONS = """select p_partkey room_id, p_partkey // 8 plan_id, [(p_partkey * 37) % 400, (p_partkey * 37) % 400 + p_size + 5, (p_partkey * 37) % 400 + p_size + 5, (p_partkey * 37) % 400 + 2, (p_partkey * 37) % 400]::double[] xs,
  [(p_partkey * 53) % 400, (p_partkey * 53) % 400, (p_partkey * 53) % 400 + p_size * 2 + 5, (p_partkey * 53) % 400 + p_size * 2 + 8, (p_partkey * 53) % 400 + p_size]::double[] ys from part"""
