"""Walls, openings and segments as rows: nearest joins, junctions, collinear merging, rescaling and summaries.

Every join carries plan_id as an equality, so it is a hash or sort-merge join within plans; the nearest row is taken by
an aggregation (min_by), which is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorwright.functions import scalars as S
from floorwright.sources.shared import cut

SEGMENT = ["x1", "y1", "x2", "y2"]


#: Side of a grid cell in which points look for walls.
CELL = 32.0


def wall_cells(walls: DataFrame, reach: Column, cell: float = CELL) -> DataFrame:
    """walls with cx, cy: each wall in every cell of a grid that it comes within reach of (none that it does is left out).

    Cells of the wall's box grown by reach, without those whose middle is farther off than reach and half a diagonal.
    """
    spread = lambda a, b, name: F.explode(F.sequence(F.floor((F.least(a, b) - F.col("_r")) / cell), F.floor((F.greatest(a, b) + F.col("_r")) / cell))).alias(name)
    out = walls.withColumn("_r", reach).where("_r >= 0").select("*", spread("x1", "x2", "cx")).select("*", spread("y1", "y2", "cy"))
    off = S.point_segment_distance((F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell, *SEGMENT)
    return out.where(off <= F.col("_r") + 0.71 * cell)


def _met(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (plan_id, px, py, ..) with the walls of their cell and the distance _d to each."""
    own = points.withColumns({"cx": F.floor(F.col("px") / CELL), "cy": F.floor(F.col("py") / CELL)})
    return own.join(cells, ["plan_id", "cx", "cy"]).withColumn("_d", S.point_segment_distance("px", "py", *SEGMENT))


def nearest_wall(points: DataFrame, walls: DataFrame, key: list[str], reach: Column) -> DataFrame:
    """points (plan_id, key.., px, py, ..) with wall_id and wall_dist of the nearest wall closer than reach; null if none.

    reach: a number, or made of the walls' columns. Of walls at the same distance the one with the least wall_id. A point
    meets the walls of its own cell of a grid only, however many its plan has; points and walls with a null meet nothing.
    """
    keys = ["plan_id", *key]
    cells = wall_cells(walls, reach).select("plan_id", "wall_id", *SEGMENT, "_r", "cx", "cy")
    near = _met(points.select(*keys, "px", "py"), cells).where("_d < _r")
    best = near.groupBy(*keys).agg(F.min(F.struct("_d", "wall_id")).alias("b")).select(*keys, F.col("b.wall_id").alias("wall_id"), F.col("b._d").alias("wall_dist"))
    return points.join(best, keys, "left")


def placed_on_wall(clicks: DataFrame, walls: DataFrame, key: list[str]) -> DataFrame:
    """clicks with their nearest wall, if closer than 3 thicknesses + 6, and the click's foot on it.

    A nearest wall farther off than the plan's thickest wall allows is refused whichever it is, so that distance bounds the search.
    """
    keys = ["plan_id", *key]
    most = walls.groupBy("plan_id").agg((3 * F.max("thickness") + 6).alias("_most"))
    cells = wall_cells(walls.join(most, "plan_id"), F.col("_most")).select("plan_id", "wall_id", "thickness", *SEGMENT, "cx", "cy")
    near = _met(clicks, cells)
    best = near.groupBy(*keys).agg(F.min_by(F.struct("wall_id", "thickness", *SEGMENT, "px", "py", "_d"), F.struct("_d", "wall_id")).alias("b"))
    b = best.select(*keys, "b.*").where(F.col("_d") <= 3 * F.col("thickness") + 6)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sq = F.when(dx * dx + dy * dy == 0, 1.0).otherwise(dx * dx + dy * dy)
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / sq))
    return b.select(*keys, "wall_id", "thickness", (F.col("x1") + u * dx).alias("fx"), (F.col("y1") + u * dy).alias("fy"), S.normal_angle(F.degrees(F.atan2(dy, dx))).alias("angle"))


def snapped_to_references(points: DataFrame, refs: DataFrame, key: list[str], tol: float) -> DataFrame:
    """points with sx, sy: each coordinate moved to the nearest one of the references of its plan, if closer than tol.

    Both axes go through one join, by buckets of tol, so no point meets all references of its plan.
    """
    keys = ["plan_id", *key]
    axes = lambda a, b: F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col(a).alias("v")), F.struct(F.lit(1).alias("axis"), F.col(b).alias("v"))))
    near = F.explode(F.array(*[F.floor(F.col("s.v") / tol) + i for i in (-1, 0, 1)])).alias("bucket")
    mine = points.select(*keys, axes("px", "py").alias("s")).select(*keys, F.col("s.axis").alias("axis"), F.col("s.v").alias("p"), near)
    own = refs.select("plan_id", axes("rx", "ry").alias("s")).select("plan_id", F.col("s.axis").alias("axis"), F.col("s.v").alias("v"), F.floor(F.col("s.v") / tol).alias("bucket")).distinct()
    hit = mine.join(own, ["plan_id", "axis", "bucket"]).where(F.abs(F.col("p") - F.col("v")) < tol)
    best = lambda axis: F.min(F.when(F.col("axis") == axis, F.struct(F.abs(F.col("p") - F.col("v")).alias("d"), F.col("v").alias("v"))))["v"]
    hit = hit.groupBy(*keys).agg(best(0).alias("sx"), best(1).alias("sy"))
    return points.join(hit, keys, "left").withColumns({"sx": F.coalesce("sx", "px"), "sy": F.coalesce("sy", "py")})


def _around(v: Column, size: Column) -> Column:
    """A row for each of the three buckets of that size in which something closer than size can stand."""
    return F.explode(F.array(*[F.floor(v / size) + i for i in (-1, 0, 1)]))


def junction_pass(segs: DataFrame, tol: Column, kind: str) -> DataFrame:
    """One pass of closing junctions: ends of H (or V) segments move to the nearest V (or H) segment closer than tol.

    segs: plan_id, seg_id, kind (H, V, D), x1, y1, x2, y2. tol: a number, or a column that is the same for a whole plan. A
    segment can be met within its own extent plus tol. Of equal ones the first seg_id counts. Ends meet segments by buckets of tol.
    """
    h = kind == "H"
    a1, a2, f = ("x1", "x2", "y1") if h else ("y1", "y2", "x1")
    own, other = segs.where(F.col("kind") == kind), segs.where(F.col("kind") == ("V" if h else "H"))
    o = other.select("plan_id", F.col("seg_id").alias("oid"), F.col("x1" if h else "y1").alias("at"), F.col("y1" if h else "x1").alias("lo"), F.col("y2" if h else "x2").alias("hi"), F.floor(F.col("x1" if h else "y1") / tol).alias("bucket"))
    ends = own.select("plan_id", "seg_id", F.col(f).alias("f"), F.explode(F.array(F.struct(F.lit(1).alias("e"), F.col(a1).alias("v")), F.struct(F.lit(2).alias("e"), F.col(a2).alias("v")))).alias("s"), tol.alias("tol"))
    ends = ends.withColumn("bucket", _around(F.col("s.v"), F.col("tol")))
    near = ends.join(o, ["plan_id", "bucket"]).where((F.col("lo") - F.col("tol") <= F.col("f")) & (F.col("f") <= F.col("hi") + F.col("tol")) & (F.abs(F.col("at") - F.col("s.v")) < F.col("tol")))
    best = near.groupBy("plan_id", "seg_id", F.col("s.e").alias("e")).agg(F.min(F.struct(F.abs(F.col("at") - F.col("s.v")).alias("d"), "oid", "at")).alias("b"))
    to = best.groupBy("plan_id", "seg_id").agg(F.max(F.when(F.col("e") == 1, F.col("b.at"))).alias("_1"), F.max(F.when(F.col("e") == 2, F.col("b.at"))).alias("_2"))
    moved = own.join(to, ["plan_id", "seg_id"], "left").withColumn(a1, F.coalesce("_1", a1)).withColumn(a2, F.coalesce("_2", a2)).drop("_1", "_2")
    return moved.unionByName(segs.where(F.col("kind") != kind))


def close_junctions(segs: DataFrame, tol: Column, rounds: int = 2) -> DataFrame:
    """H and V ends closed in turns, then ends of oblique segments on the nearest end of the others; points go."""
    for _ in range(rounds):
        segs = cut(junction_pass(segs, tol, "H"))  # each pass reads its input three times
        segs = cut(junction_pass(segs, tol, "V"))
    straight, other = segs.where("kind <> 'D'"), segs.where("kind = 'D'")
    order = F.when(F.col("kind") == "H", 0).otherwise(1)
    ends = straight.select("plan_id", F.explode(F.array(F.struct(order.alias("k"), "seg_id", F.lit(1).alias("e"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(order.alias("k"), "seg_id", F.lit(2).alias("e"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    ends = ends.join(segs.select("plan_id", tol.alias("_tol")).distinct(), "plan_id")
    ends = ends.select("plan_id", "p", F.floor(F.col("p.x") / F.col("_tol")).alias("_bx"), F.floor(F.col("p.y") / F.col("_tol")).alias("_by"))
    for x, y in (("x1", "y1"), ("x2", "y2")):
        d = S.length(x, y, F.col("p.x"), F.col("p.y"))
        mine = other.withColumn("_bx", _around(F.col(x), tol)).withColumn("_by", _around(F.col(y), tol))
        best = mine.join(ends, ["plan_id", "_bx", "_by"]).withColumn("_d", d).where(F.col("_d") < tol).groupBy("plan_id", "seg_id").agg(F.min_by("p", F.struct(F.col("_d"), F.col("p.k"), F.col("p.seg_id"), F.col("p.e"))).alias("_p"))
        other = other.join(best, ["plan_id", "seg_id"], "left").withColumn(x, F.coalesce("_p.x", x)).withColumn(y, F.coalesce("_p.y", y)).drop("_p")
    return straight.unionByName(other).where(S.length(*SEGMENT) > 0)


def span_runs(spans: DataFrame, by: list[str], gap: float) -> DataFrame:
    """spans (by.., lo, hi, ..) with run: spans of a group that overlap or lie at most gap apart have the same number."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = spans.withColumn("_new", F.when(reach.isNull() | (F.col("lo") > reach + gap), 1).otherwise(0))
    return own.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged_spans(spans: DataFrame, by: list[str], gap: float) -> DataFrame:
    """(by.., run, lo, hi, n): the runs of spans."""
    return span_runs(spans, by, gap).groupBy(*by, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """sum(value * weight) / sum(weight); a weight of 0 in all counts as 1."""
    v, w = S._c(value), S._c(weight)
    return F.sum(v * w) / F.when(F.sum(w) == 0, 1.0).otherwise(F.sum(w))


def cluster_and_merge(segs: DataFrame, offset: Column, gap: Column) -> DataFrame:
    """Collinear H and V segments merged, oblique ones as they are: (plan_id, kind, x1, y1, x2, y2, t).

    Segments of a plan and kind, in order of their fixed coordinate, join a cluster while they lie within offset of its
    length-weighted mean so far: a fold over the sorted array, as each step needs the last one's result. Spans of a
    cluster then merge over gaps, and position and thickness are length-weighted means.
    """
    own = segs.withColumn("kind", S.segment_kind(*SEGMENT)).withColumn("_len", S.length(*SEGMENT))
    own = own.withColumn("f", F.when(F.col("kind") == "H", F.col("y1")).otherwise(F.col("x1"))).withColumn("lo", F.when(F.col("kind") == "H", F.col("x1")).otherwise(F.col("y1"))).withColumn("hi", F.when(F.col("kind") == "H", F.col("x2")).otherwise(F.col("y2")))
    straight = own.where("kind <> 'D'").withColumn("_o", offset).withColumn("_g", gap)
    lists = straight.groupBy("plan_id", "kind").agg(F.sort_array(F.collect_list(F.struct("f", "seg_id", "lo", "hi", "t", F.col("_len").alias("len")))).alias("s"), F.max("_o").alias("_o"), F.max("_g").alias("_g"))
    start = F.struct(F.lit(0).alias("c"), F.lit(0.0).alias("w"), F.lit(0.0).alias("m"), F.array().cast("array<int>").alias("ids"))

    def step(a: Column, x: Column) -> Column:
        joins = (a["c"] > 0) & (F.abs(x["f"] - a["m"] / F.greatest(a["w"], F.lit(1e-6))) <= F.col("_o"))
        c = F.when(joins, a["c"]).otherwise(a["c"] + 1)
        keep = F.when(joins, 1.0).otherwise(0.0)
        return F.struct(c.alias("c"), (a["w"] * keep + x["len"]).alias("w"), (a["m"] * keep + x["f"] * x["len"]).alias("m"), F.concat(a["ids"], F.array(c)).alias("ids"))

    ids = F.aggregate("s", start, step)["ids"]
    rows = lists.select("plan_id", "kind", "_g", F.explode(F.arrays_zip(F.col("s"), ids.alias("c"))).alias("z")).select("plan_id", "kind", "_g", F.col("z.c").alias("cluster"), "z.s.*")
    w = Window.partitionBy("plan_id", "kind", "cluster").orderBy("lo", "seg_id")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_n", F.when(reach.isNull() | (F.col("lo") > reach + F.col("_g")), 1).otherwise(0)).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("plan_id", "kind", "cluster", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), weighted_mean("f", "len").alias("f"), weighted_mean("t", "len").alias("t"))
    h = F.col("kind") == "H"
    out = out.select("plan_id", "kind", F.when(h, F.col("lo")).otherwise(F.col("f")).alias("x1"), F.when(h, F.col("f")).otherwise(F.col("lo")).alias("y1"), F.when(h, F.col("hi")).otherwise(F.col("f")).alias("x2"), F.when(h, F.col("f")).otherwise(F.col("hi")).alias("y2"), "t")
    return out.unionByName(own.where("kind = 'D'").select("plan_id", "kind", *SEGMENT, "t"))


def long_enough(segs: DataFrame, least: Column) -> DataFrame:
    return segs.where(S.length(*SEGMENT) >= least)


def exterior(walls: DataFrame, pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """walls with exterior: whether at least two, or a quarter, of ten samples beside the wall are background or off the plan.

    pixels: (plan_id, y, x, label); sizes: (plan_id, width, height). Hints, as Spark takes pixels for no larger than what they
    were painted from and would send them to all executors.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ln = F.when(S.length(*SEGMENT) == 0, 1.0).otherwise(S.length(*SEGMENT))
    off = F.col("thickness") * 1.5 + 2.0
    sample = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(s).alias("s")) for f in (0.2, 0.35, 0.5, 0.65, 0.8) for s in (1.0, -1.0)])).alias("q")
    at = walls.join(sizes.select("plan_id", "width", "height").hint("merge"), "plan_id").select("plan_id", "wall_id", *SEGMENT, "thickness", "width", "height", sample)
    at = at.select("plan_id", "wall_id", "width", "height", F.floor(F.col("x1") + dx * F.col("q.f") - F.col("q.s") * dy / ln * off + 0.5).cast("int").alias("x"), F.floor(F.col("y1") + dy * F.col("q.f") + F.col("q.s") * dx / ln * off + 0.5).cast("int").alias("y"))
    at = at.join(pixels.select("plan_id", "y", "x", "label").hint("merge"), ["plan_id", "y", "x"], "left")
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= F.col("width")) | (F.col("y") >= F.col("height"))
    hits = at.groupBy("plan_id", "wall_id").agg(F.count_if(out | (F.coalesce("label", F.lit(0)) == 0)).alias("bg"), F.count("*").alias("n"))
    return walls.join(hits.select("plan_id", "wall_id", (F.col("bg") >= F.greatest(F.lit(2), F.floor(F.col("n") / 4))).alias("exterior")).hint("merge"), ["plan_id", "wall_id"], "left")


def plan_summary(rooms: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """(plan_id, rooms, walls, doors, windows, wall_length, room_area) of every plan that has any element; lengths to one place."""
    a = rooms.groupBy("plan_id").agg(F.count("*").alias("rooms"), F.sum("area_px").alias("room_area"))
    b = walls.groupBy("plan_id").agg(F.count("*").alias("walls"), F.sum(S.length(*SEGMENT)).alias("wall_length"))
    c = openings.groupBy("plan_id").agg(F.count_if(F.col("kind") == "door").alias("doors"), F.count_if(F.col("kind") == "window").alias("windows"))
    out = a.join(b, "plan_id", "full").join(c, "plan_id", "full").na.fill(0)
    return out.select("plan_id", "rooms", "walls", "doors", "windows", S.half_up("wall_length", 1).alias("wall_length"), S.half_up("room_area", 1).alias("room_area"))


def rescaled_walls(walls: DataFrame, sx: Column, sy: Column) -> DataFrame:
    to = {"x1": sx, "x2": sx, "y1": sy, "y2": sy, "thickness": (sx + sy) / 2}
    return walls.withColumns({c: S.half_up(F.col(c) * s) for c, s in to.items()})


def rescaled_rooms(rooms: DataFrame, sx: Column, sy: Column) -> DataFrame:
    holes = F.transform("holes", lambda h: S.moved(h, sx, sy))
    return rooms.withColumns({"polygon": S.moved(F.col("polygon"), sx, sy), "holes": holes, "area_px": S.half_up(F.col("area_px") * sx * sy, 1)})


def thickness(dist: Column, height: Column, width: Column) -> Column:
    """Wall thickness of a plan from the distances on its skeleton: twice their median, kept in bounds; 4 without any."""
    return F.coalesce(F.least(F.greatest(2 * F.median(dist), F.lit(2.0)), F.greatest(F.lit(4.0), F.least(F.max(height), F.max(width)) / 8)), F.lit(4.0))
