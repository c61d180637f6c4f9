"""Edits of plan geometry: each takes the element tables and gives new ones; a history keeps versions for undo and redo.

Tables: rooms (plan_id, room_id, label, polygon, holes, area_px, area_m2, centroid), walls (plan_id, wall_id, x1, y1, x2,
y2, thickness, exterior), openings (plan_id, opening_id, kind, polygon, cx, cy, width, depth, angle, wall_id).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorwright.functions import scalars as S

UNDO = 100


def _point(x: float, y: float) -> Column:
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))


def _is(plan: int, key: str, value: int) -> Column:
    return (F.col("plan_id") == plan) & (F.col(key) == value)


def _with_polygon(rooms: DataFrame, here: Column, poly: Column) -> DataFrame:
    """rooms with another polygon where `here` holds; area and centre follow it (holes are left out of account)."""
    out = rooms.withColumn("polygon", F.when(here, poly).otherwise(F.col("polygon")))
    return out.withColumn("area_px", F.when(here, S.half_up(S.polygon_area(F.col("polygon")), 1)).otherwise(F.col("area_px"))).withColumn("centroid", F.when(here, S.polygon_centroid(F.col("polygon"))).otherwise(F.col("centroid")))


def move_room_vertex(rooms: DataFrame, plan: int, room: int, index: int, x: float, y: float) -> DataFrame:
    return _with_polygon(rooms, _is(plan, "room_id", room), F.transform("polygon", lambda p, i: F.when(i == index, _point(x, y)).otherwise(p)))


def insert_room_vertex(rooms: DataFrame, plan: int, room: int, x: float, y: float) -> DataFrame:
    """A vertex put into the edge it is nearest to (the first of equals)."""
    nxt = lambda i: F.get(F.col("polygon"), (i + 1) % F.size("polygon"))
    dist = F.transform("polygon", lambda p, i: S.point_segment_distance(F.lit(float(x)), F.lit(float(y)), p["x"], p["y"], nxt(i)["x"], nxt(i)["y"]))
    at = F.array_position(dist, F.array_min(dist)).cast("int")
    poly = F.concat(F.slice("polygon", 1, at), F.array(_point(x, y)), F.slice("polygon", at + 1, F.size("polygon")))
    return _with_polygon(rooms, _is(plan, "room_id", room), poly)


def remove_room_vertex(rooms: DataFrame, plan: int, room: int, index: int) -> DataFrame:
    """Without that vertex; a triangle stays as it is."""
    return _with_polygon(rooms, _is(plan, "room_id", room) & (F.size("polygon") > 3), F.filter("polygon", lambda p, i: i != index))


def move_wall_end(walls: DataFrame, plan: int, wall: int, end: int, x: float, y: float) -> DataFrame:
    here, (a, b) = _is(plan, "wall_id", wall), (("x1", "y1"), ("x2", "y2"))[end]
    return walls.withColumns({a: F.when(here, float(x)).otherwise(F.col(a)), b: F.when(here, float(y)).otherwise(F.col(b))})


def translate_walls(walls: DataFrame, here: Column, dx: float, dy: float) -> DataFrame:
    return walls.withColumns({c: F.when(here, F.col(c) + float(dx if c[0] == "x" else dy)).otherwise(F.col(c)) for c in ("x1", "y1", "x2", "y2")})


def translate_rooms(rooms: DataFrame, here: Column, dx: float, dy: float) -> DataFrame:
    c = F.struct((F.col("centroid.x") + float(dx)).alias("x"), (F.col("centroid.y") + float(dy)).alias("y"))
    holes = F.transform("holes", lambda h: S.moved(h, dx=dx, dy=dy, places=None))
    return rooms.withColumns({"polygon": F.when(here, S.moved(F.col("polygon"), dx=dx, dy=dy, places=None)).otherwise(F.col("polygon")), "holes": F.when(here, holes).otherwise(F.col("holes")), "centroid": F.when(here, c).otherwise(F.col("centroid"))})


def translate_openings(openings: DataFrame, here: Column, dx: float, dy: float) -> DataFrame:
    return openings.withColumns({"polygon": F.when(here, S.moved(F.col("polygon"), dx=dx, dy=dy, places=None)).otherwise(F.col("polygon")), "cx": F.when(here, F.col("cx") + float(dx)).otherwise(F.col("cx")), "cy": F.when(here, F.col("cy") + float(dy)).otherwise(F.col("cy"))})


def with_next_id(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """new (without the key) with ids after the largest of its plan in old, from 0 in an empty plan; in order of `ord`."""
    most = old.groupBy("plan_id").agg(F.max(key).alias("_m"))
    n = F.row_number().over(Window.partitionBy("plan_id").orderBy("ord"))
    return new.withColumn("_n", n).join(most, "plan_id", "left").withColumn(key, (F.coalesce("_m", F.lit(-1)) + F.col("_n")).cast(old.schema[key].dataType)).drop("_m", "_n", "ord")


def add_walls(walls: DataFrame, new: DataFrame) -> DataFrame:
    """new: plan_id, ord, x1, y1, x2, y2, thickness."""
    return walls.unionByName(with_next_id(new, walls, "wall_id").withColumn("exterior", F.lit(False)))


def add_room_rectangles(rooms: DataFrame, new: DataFrame) -> DataFrame:
    """new: plan_id, ord, ax, ay, bx, by: two opposite corners."""
    x0, x1, y0, y1 = F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    poly = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1))
    out = with_next_id(new.withColumn("polygon", poly).drop("ax", "ay", "bx", "by"), rooms, "room_id")
    out = out.select("plan_id", "room_id", F.lit("room").alias("label"), "polygon", F.array().cast(rooms.schema["holes"].dataType).alias("holes"), S.half_up(S.polygon_area(F.col("polygon")), 1).alias("area_px"), F.lit(None).cast("double").alias("area_m2"), S.polygon_centroid(F.col("polygon")).alias("centroid"))
    return rooms.select(*out.columns).unionByName(out)


def add_openings(openings: DataFrame, new: DataFrame) -> DataFrame:
    """new: plan_id, ord, kind, cx, cy, width, depth, angle, wall_id."""
    out = with_next_id(new, openings, "opening_id").withColumn("polygon", S.box_corners("cx", "cy", "width", "depth", "angle"))
    return openings.unionByName(out.select(*openings.columns))


def placed_openings(feet: DataFrame, kind: str) -> DataFrame:
    """Openings for clicks that met a wall (placed_on_wall): door 3.4, window 4.5 thicknesses wide, one more pixel deep.

    ord: of a plan's clicks in order of their foot, the same however the rows are partitioned.
    """
    wide = {"door": 3.4, "window": 4.5}[kind]
    return feet.select("plan_id", F.struct("fx", "fy", "wall_id").alias("ord"), F.lit(kind).alias("kind"), F.col("fx").alias("cx"), F.col("fy").alias("cy"), (F.col("thickness") * wide).alias("width"), (F.col("thickness") + 1.0).alias("depth"), "angle", "wall_id")


def remove_walls(walls: DataFrame, openings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walls without those in gone (plan_id, wall_id); openings that hung on one have no wall any more."""
    mark = gone.select("plan_id", "wall_id").distinct().withColumn("_gone", F.lit(True))
    kept = walls.join(mark, ["plan_id", "wall_id"], "left_anti")
    free = openings.join(mark, ["plan_id", "wall_id"], "left").withColumn("wall_id", F.when(F.col("_gone").isNull(), F.col("wall_id"))).drop("_gone")
    return kept, free.select(*openings.columns)


def remove(elements: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return elements.join(gone.select("plan_id", key), ["plan_id", key], "left_anti")


def patched(elements: DataFrame, key: str, plan: int, value: int, patch: dict[str, object]) -> DataFrame:
    here = _is(plan, key, value)
    return elements.withColumns({c: F.when(here, F.lit(v).cast(elements.schema[c].dataType)).otherwise(F.col(c)) for c, v in patch.items()})


def with_scale(rooms: DataFrame, px_per_meter: Column | float | None) -> DataFrame:
    """Rooms with area_m2 for another scale; null without one."""
    return rooms.withColumn("area_m2", F.lit(None).cast("double") if px_per_meter is None else S.square_metres("area_px", px_per_meter))


def axis_snap(ax, ay, bx, by) -> Column:
    """The end of a drawn line laid on the axis it is closer to."""
    ax, ay, bx, by = map(S._c, (ax, ay, bx, by))
    flat = F.abs(bx - ax) >= F.abs(by - ay)
    return F.struct(F.when(flat, bx).otherwise(ax).alias("x"), F.when(flat, ay).otherwise(by).alias("y"))


def orphans(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """Openings whose wall isn't there."""
    return openings.where("wall_id is not null").join(walls, ["plan_id", "wall_id"], "left_anti")


@dataclass(frozen=True)
class History:
    """Versions of a plan's geometry with a pointer; the tables of a version are kept by the caller under its number."""

    versions: tuple[int, ...] = (0,)
    at: int = 0
    fresh: int = 1
    #: A version that is shown while it is drawn, and not kept.
    shown: int | None = None

    def preview(self) -> History:
        """Shows the version that a commit would make; undo, redo and commit end that, and only commit keeps it."""
        return replace(self, shown=self.fresh)

    def commit(self) -> History:
        """A new version after the present one; what was undone is dropped, and so are versions over the limit of undo steps."""
        kept = (*self.versions[: self.at + 1], self.fresh)[-(UNDO + 1) :]
        return History(kept, len(kept) - 1, self.fresh + 1)

    def undo(self) -> History:
        return replace(self, at=max(0, self.at - 1), shown=None)

    def redo(self) -> History:
        return replace(self, at=min(len(self.versions) - 1, self.at + 1), shown=None)

    @property
    def version(self) -> int:
        return self.versions[self.at] if self.shown is None else self.shown


def history_table(spark: SparkSession, log: DataFrame) -> DataFrame:
    """(plan_id, version, op): the last versions of each plan in an append-only log, as many as undo keeps and the present."""
    n = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.col("version").desc()))
    return log.withColumn("_n", n).where(F.col("_n") <= UNDO + 1).drop("_n")
