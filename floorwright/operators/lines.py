"""Lines and point sets as tables: simplification in rounds over intervals, convex hulls as a fold, least rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorwright.sources.shared import cut, dropped


def simplified(points: DataFrame, by: list[str], eps: float) -> DataFrame:
    """(by.., ord, x, y): the points of lines (by.., ord, x, y) that Douglas-Peucker keeps, with each line's ends.

    In each round every open stretch between two kept points is split at the point farthest from its chord (of equals the
    first), if that is farther than eps, or closed; only points of open stretches are met again. A line whose splits fall
    near the middle takes about log2(n) rounds, and no line is gathered in one task. Points with a null are passed over.
    """
    own = cut(points.where("ord is not null and x is not null and y is not null").select(*by, F.col("ord").cast("long").alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    ends = own.groupBy(*by).agg(F.min("ord").alias("s"), F.max("ord").alias("e"))
    kept = [own.join(ends, by).where("ord = s or ord = e").select(*by, "ord", "x", "y")]
    at = lambda c, names: own.select(*by, F.col("ord").alias(c), F.col("x").alias(names[0]), F.col("y").alias(names[1]))
    spans = cut(ends.join(at("s", ("x1", "y1")), [*by, "s"]).join(at("e", ("x2", "y2")), [*by, "e"]))
    inner = cut(own.join(spans, by).where("s < ord and ord < e"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    long = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
    off = F.abs(dy * F.col("x") - dx * F.col("y") + F.col("x2") * F.col("y1") - F.col("y2") * F.col("x1")) / long
    while inner.limit(1).count():
        far = inner.withColumn("off", off).groupBy(*by, "s", "e").agg(F.max_by(F.struct("ord", "x", "y", "off"), F.struct("off", -F.col("ord"))).alias("f"))
        far = cut(far.where(F.col("f.off") > eps).select(*by, "s", "e", F.col("f.ord").alias("m"), F.col("f.x").alias("xm"), F.col("f.y").alias("ym")))
        kept.append(far.select(*by, F.col("m").alias("ord"), F.col("xm").alias("x"), F.col("ym").alias("y")))
        left = F.col("ord") < F.col("m")
        pick = lambda a, b: F.when(left, F.col(a)).otherwise(F.col(b))
        new = inner.join(far, [*by, "s", "e"]).where("ord <> m")
        new = cut(new.select(*by, "ord", "x", "y", pick("s", "m").alias("s"), pick("m", "e").alias("e"), pick("x1", "xm").alias("x1"), pick("y1", "ym").alias("y1"), pick("xm", "x2").alias("x2"), pick("ym", "y2").alias("y2")))
        dropped(inner)
        inner = new
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def _cross(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _chain(points: Column) -> Column:
    """The hull's side below sorted points (x, y): a fold; those that a new point leaves inside are the last ones of the stack."""

    def step(held: Column, p: Column) -> Column:
        turns = lambda e, i: (i == 0) | (_cross(F.get(held, i - 1), e, p) > 0)
        return F.concat(F.filter(held, turns), F.array(p))

    return F.aggregate(points, F.array().cast("array<struct<x:double,y:double>>"), step)


def hulls(points: DataFrame, by: list[str]) -> DataFrame:
    """(by.., hull): corners of the convex hull of points (by.., x, y), from the leftmost (of these the lowest y) on, x turning to y.

    Of each x only the least and the largest y can be corners: these are found before points are gathered, so a group's
    array has at most two points for each distinct x. Points on a side are no corners; nulls are passed over.
    """
    num = lambda c: F.col(c).cast("double")
    own = points.where("x is not null and y is not null").select(*by, num("x").alias("x"), num("y").alias("y"))
    ends = own.groupBy(*by, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    ends = ends.select(*by, F.explode(F.array_distinct(F.array(F.struct("x", F.col("lo").alias("y")), F.struct("x", F.col("hi").alias("y"))))).alias("p"))
    lists = ends.groupBy(*by).agg(F.array_sort(F.collect_list("p")).alias("p"))
    lists = lists.select(*by, "p", _chain(F.col("p")).alias("below"), _chain(F.reverse("p")).alias("above"))
    most = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(1)))
    return lists.select(*by, F.when(F.size("p") < 3, F.col("p")).otherwise(F.concat(most("below"), most("above"))).alias("hull"))


def least_rectangles(points: DataFrame, by: list[str]) -> DataFrame:
    """(by.., corners, cx, cy, w, h, angle, area): the rectangle of least area round points (by.., x, y).

    One of its sides lies on a side of the hull; each is tried, w and angle (in degrees) are along it. Areas that are equal
    to nine places are ties, the first side counts. A single point has no extent.
    """
    own = hulls(points, by).select(*by, "hull", F.size("hull").alias("corners"), F.posexplode("hull").alias("i", "a"))
    b = F.get("hull", (F.col("i") + 1) % F.col("corners"))
    dx, dy = b["x"] - F.col("a.x"), b["y"] - F.col("a.y")
    size = F.sqrt(dx * dx + dy * dy)
    own = own.withColumns({"ux": F.when(size > 0, dx / size).otherwise(1.0), "uy": F.when(size > 0, dy / size).otherwise(0.0)})
    along = lambda q: q["x"] * F.col("ux") + q["y"] * F.col("uy")
    across = lambda q: q["y"] * F.col("ux") - q["x"] * F.col("uy")
    own = own.withColumns({"p": F.transform("hull", along), "q": F.transform("hull", across)})
    own = own.withColumns({"p0": F.array_min("p"), "p1": F.array_max("p"), "q0": F.array_min("q"), "q1": F.array_max("q")})
    p, q = (F.col("p0") + F.col("p1")) / 2, (F.col("q0") + F.col("q1")) / 2
    w, h = F.col("p1") - F.col("p0"), F.col("q1") - F.col("q0")
    rect = F.struct("corners", (p * F.col("ux") - q * F.col("uy")).alias("cx"), (p * F.col("uy") + q * F.col("ux")).alias("cy"), w.alias("w"), h.alias("h"), F.degrees(F.atan2("uy", "ux")).alias("angle"), (w * h).alias("area"))
    return own.groupBy(*by).agg(F.min_by(rect, F.struct(F.round(w * h, 9), "i")).alias("r")).select(*by, "r.*")
