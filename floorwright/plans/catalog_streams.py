"""Queries of streams, of the mask cache and of exports: what they leave behind, with the SQL of the same over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from floorwright.plans import catalog, scene
from floorwright.plans.catalog import query
from floorwright.sources import exports, readers
from floorwright.sources.shared import shared_path
from floorwright.streaming import metrics as streaming


def _events(spark, d):
    """The events as a stream; a table that is one file is found in its folder by name."""
    own = spark.readStream.schema(scene.read(spark, d, "events").schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return own.parquet(f"{d}/events.parquet")
    return own.option("pathGlobFilter", "events.parquet").parquet(d)


@query("log_written", "select event_id iter, user_id epoch, case when event_type = 'purchase' then null else value end lr, case when event_type = 'purchase' then value end miou from events")
def _(spark, d):
    bought = F.col("event_type") == "purchase"
    records = _events(spark, d).select(F.col("event_id").alias("iter"), F.col("user_id").alias("epoch"), F.when(~bought, F.col("value")).alias("lr"), F.when(bought, F.struct(F.col("value").alias("mIoU"))).alias("eval"))
    path = shared_path(spark, "log")
    streaming.append_log(records, path, shared_path(spark, "at"), once=True).awaitTermination()
    log = spark.read.schema("iter long, epoch long, lr double, eval struct<mIoU:double>").json(path)
    return log.select("iter", "epoch", "lr", F.col("eval.mIoU").alias("miou"))


@query("best_by_run", "select run, min(event_id) iter, miou from (select user_id run, event_id, value miou, max(value) over (partition by user_id) m from events where value is not null and user_id is not null) where miou = m group by run, miou")
def _(spark, d):
    path = shared_path(spark, "best")
    stream = streaming.best_by_run(_events(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("iter"), F.col("value").alias("miou")))
    add = lambda batch, _: batch.write.mode("append").parquet(path)
    stream.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "at")).foreachBatch(add).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("run long, iter long, miou double").parquet(path).groupBy("run").agg(F.max_by(F.struct("iter", "miou"), "miou").alias("b")).select("run", "b.*")


@query("mask_cache", "select p_partkey plan_id, (p_size + 11) * 36 room, (p_size + 11) * 5 wall from part")
def _(spark, d):
    w = (F.col("p_size") + 10).cast("int")
    svg = F.format_string(catalog._SVG, (F.col("p_partkey") % 30).cast("int"), w, w, w, w)
    drawings = scene.read(spark, d, "part").select(F.col("p_partkey").alias("plan_id"), svg.alias("svg"))
    path = shared_path(spark, "masks")
    readers.cached_masks(drawings.where("plan_id % 2 = 0"), path, 48, 100)
    masks = readers.cached_masks(drawings, path, 48, 100)  # half of them are there already
    count = lambda v: (F.length("data") - F.length(F.translate(F.col("data").cast("string"), chr(v), ""))).cast("long")
    return masks.select("plan_id", count(2).alias("room"), count(1).alias("wall"))


def _documents(spark, d):
    rooms = scene.polygons(spark, d).withColumn("label", F.concat(F.lit("room <"), F.col("room_id"), F.lit(">")))
    return exports.documents(rooms, scene.walls(spark, d), 512, 512)


_WALL_SUMS = f"select plan_id, count(*) walls, sum(x1)::double x1, sum({{y1}})::double y1, sum(x2)::double x2, sum({{y2}})::double y2 from ({scene.WALLS}) group by plan_id"
_ROOM_SUMS = f"select plan_id, count(*) rooms, sum(list_sum(xs))::double xs, sum(list_sum({{ys}}))::double ys from ({scene.POLYGONS}) group by plan_id"


def _content_sql(y1: str, y2: str, ys: str) -> str:
    return f"select plan_id, coalesce(walls, 0) walls, coalesce(x1, 0) x1, coalesce(y1, 0) y1, coalesce(x2, 0) x2, coalesce(y2, 0) y2, coalesce(rooms, 0) rooms, coalesce(xs, 0) xs, coalesce(ys, 0) ys from ({_WALL_SUMS.format(y1=y1, y2=y2)}) full join ({_ROOM_SUMS.format(ys=ys)}) using (plan_id)"


def _total(texts):
    """Sum of an array of numbers as texts."""
    return F.aggregate(texts, F.lit(0.0), lambda a, v: a + v.cast("double"))


@query("svg_content", _content_sql("y1", "y2", "ys"))
def _(spark, d):
    out = exports.exported(_documents(spark, d), "svg")
    walls = F.regexp_extract_all("svg", F.lit('<line class="wall"[^>]*>'), F.lit(0))
    paths = F.regexp_extract_all("svg", F.lit('<path class="room"[^>]* d="([^"]*)"'), F.lit(1))
    at = lambda c: _total(F.transform(walls, lambda w: F.regexp_extract(w, f' {c}="([^"]*)"', 1)))
    corner = lambda k: _total(F.regexp_extract_all(F.array_join(paths, " "), F.lit(r"([0-9.]+),([0-9.]+)"), F.lit(k)))
    return out.select("plan_id", F.size(walls).cast("long").alias("walls"), *[at(c).alias(c) for c in ("x1", "y1", "x2", "y2")], F.size(paths).cast("long").alias("rooms"), corner(1).alias("xs"), corner(2).alias("ys"))


@query("dxf_content", _content_sql("512 - y1", "512 - y2", "list_transform(ys, lambda v: 512 - v)"))
def _(spark, d):
    """Codes and values take a line each; 10 and 20 are a first point, 11 and 21 a second one."""
    out = exports.exported(_documents(spark, d), "dxf")
    line = F.lit("LINE\n8\nWALLS\n10\n([-0-9.]+)\n20\n([-0-9.]+)\n11\n([-0-9.]+)\n21\n([-0-9.]+)\n")
    wall = lambda k: F.regexp_extract_all("dxf", F.concat(F.lit("(?m)^"), line), F.lit(k))
    corner = lambda k: F.regexp_extract_all("dxf", F.lit("VERTEX\n8\nROOMS\n10\n([-0-9.]+)\n20\n([-0-9.]+)\n"), F.lit(k))
    rooms = F.regexp_count("dxf", F.lit("POLYLINE\n8\nROOMS\n"))
    return out.select("plan_id", F.size(wall(1)).cast("long").alias("walls"), *[_total(wall(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"), 1)], rooms.cast("long").alias("rooms"), _total(corner(1)).alias("xs"), _total(corner(2)).alias("ys"))
