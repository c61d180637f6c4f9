"""All queries of the engine by name, with the SQL that gives the same rows (in the dialect of the driver's check)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.functions import scalars as S
from floorwright.functions import taxonomy
from floorwright.operators import edits, geometry, matching, metrics, raster, tiles
from floorwright.plans import scene, vectorize
from floorwright.sources import exports, generate, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(v: str, places: int = 6) -> str:
    return f"floor(({v}) * 1e{places} + 0.5e0) / 1e{places}"


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: S.half_up(F.col(c), places) for c in cols})


# ---- metrics

_SOFT = "select vec_id % 8 plan_id, embedding[1:5] v, label % 5 t from embeddings"
_CONF = f"select t target, list_position(v, list_max(v)) - 1 pred, count(*) n from ({_SOFT}) group by all"
_IOU = f"""with c as ({_CONF}), g as (select target class_id, sum(n) gt, sum(case when target = pred then n else 0 end) tp from c group by 1),
p as (select pred class_id, sum(n) pr from c group by 1)
select s.range class_id, coalesce(tp, 0)::bigint tp, coalesce(gt, 0)::bigint gt, coalesce(pr, 0)::bigint pr, coalesce(tp, 0) / greatest(coalesce(gt, 0) + coalesce(pr, 0) - coalesce(tp, 0), 1)::double iou
from range(5) s left join g on g.class_id = s.range left join p on p.class_id = s.range"""


def _confusion(spark, d):
    return metrics.confusion(scene.logits(spark, d).withColumn("pred", metrics.argmax(F.col("logits"))))


@query("argmax_label", f"select pred, sum(n)::bigint n from ({_CONF}) group by pred")
def _(spark, d):
    return scene.logits(spark, d).groupBy(metrics.argmax(F.col("logits")).alias("pred")).agg(F.count("*").alias("n"))


@query("metrics_confusion", _CONF)
def _(spark, d):
    return _confusion(spark, d)


@query("metrics_iou", f"select class_id::int class_id, tp, gt, pr, {r('iou')} iou from ({_IOU})")
def _(spark, d):
    return rounded(metrics.per_class(_confusion(spark, d), 5), "iou")


@query("metrics_summary", f"select {r('coalesce(avg(iou) filter (where gt > 0), 0)')} miou, {r('sum(gt * iou) / greatest(sum(gt), 1)')} fwiou, {r('sum(tp) / greatest(sum(gt), 1)')} pixel_acc, {r('coalesce(avg(tp / gt::double) filter (where gt > 0), 0)')} mean_acc from ({_IOU})")
def _(spark, d):
    return rounded(metrics.summary(metrics.per_class(_confusion(spark, d), 5)), "miou", "fwiou", "pixel_acc", "mean_acc")


_HIST = "select label % 5 class_id, count(*) n from embeddings group by 1"


@query("class_histogram", _HIST)
def _(spark, d):
    return metrics.histogram(scene.logits(spark, d), "target")


@query("class_weights", f"with f as (select class_id, n, n / (sum(n) over ())::double freq from ({_HIST})), w as (select *, 1 / sqrt(freq + 1e-6) q from f) select class_id, n, {r('freq')} freq, {r('q / avg(q) over ()')} weight from w")
def _(spark, d):
    return rounded(metrics.class_weights(metrics.histogram(scene.logits(spark, d), "target")), "freq", "weight")


@query("class_share", f"select class_id, n, {r('n / (sum(n) over ())::double')} share from ({_HIST})")
def _(spark, d):
    return rounded(metrics.class_share(metrics.histogram(scene.logits(spark, d), "target")), "share")


_PROBS = f"select plan_id, t, list_transform(v, lambda x: exp(x::double - list_max(v)::double)) e from ({_SOFT})"
_PROBS = f"select plan_id, t, list_transform(e, lambda x: x / list_sum(e)) p from ({_PROBS})"


def _probs(spark, d):
    return scene.logits(spark, d).withColumn("probs", metrics.softmax(F.col("logits")))


@query("softmax_conf", f"select {r('avg(list_max(p))')} confidence from ({_PROBS})")
def _(spark, d):
    return rounded(metrics.mean_confidence(_probs(spark, d)), "confidence")


@query("mask_scores", f"select plan_id, {r('avg(list_max(p))')} confidence, count(*) n from ({_PROBS}) group by plan_id")
def _(spark, d):
    return rounded(_probs(spark, d).groupBy("plan_id").agg(F.avg(F.array_max("probs")).alias("confidence"), F.count("*").alias("n")), "confidence")


_DICE = f"select c.range class_id, sum(p[c.range + 1] * (t = c.range)::int) inter, sum(p[c.range + 1]) p_sum, sum((t = c.range)::int)::double t_sum from ({_PROBS}), range(5) c group by 1"


@query("soft_dice", f"select class_id::int class_id, {r('inter', 4)} inter, {r('p_sum', 4)} p_sum, t_sum, {r('(2 * inter + 1) / (p_sum + t_sum + 1)')} dice from ({_DICE})")
def _(spark, d):
    return rounded(rounded(metrics.soft_dice(_probs(spark, d)), "dice"), "inter", "p_sum", places=4)


@query("loss_dice", f"select {r('1 - coalesce(avg((2 * inter + 1) / (p_sum + t_sum + 1)), 1)')} dice_loss from ({_DICE}) where t_sum > 0")
def _(spark, d):
    return rounded(metrics.dice_loss(_probs(spark, d)), "dice_loss")


@query("loss_ce", f"select {r('avg(-ln(p[t + 1]))')} ce from ({_PROBS})")
def _(spark, d):
    return rounded(metrics.weighted_cross_entropy(scene.logits(spark, d)), "ce")


@query("lr_schedule", f"select i::int it, {r('0.002e0 * case when i < 150 then (i + 1) / 150.0e0 else pow(greatest(0, 1 - (i - 150) / 2250.0e0), 0.9e0) end', 9)} lr, n from (select event_id % 2400 i, count(*) n from events group by 1)")
def _(spark, d):
    steps = scene.read(spark, d, "events").groupBy((F.col("event_id") % 2400).cast("int").alias("it")).agg(F.count("*").alias("n"))
    return rounded(metrics.lr_schedule(steps, 0.002, 2400, 150), "lr", places=9)


_GATE = "select case when event_id % 2 = 0 then 'fp32' else 'int8' end artifact, avg(value) miou from events group by 1"


@query("quality_gate", f"with s as ({_GATE}), t as (select max(miou) filter (where artifact = 'fp32') fp32, max(miou) filter (where artifact = 'int8') int8 from s) select {r('fp32')} fp32, {r('int8')} int8, case when fp32 - int8 <= 0.01 then 'int8' else 'fp32' end chosen from t")
def _(spark, d):
    s = scene.read(spark, d, "events").groupBy(F.when(F.col("event_id") % 2 == 0, "fp32").otherwise("int8").alias("artifact")).agg(F.avg("value").alias("miou"))
    return rounded(metrics.quality_gate(s), "fp32", "int8")


@query("best_checkpoint", "select user_id, min(event_id) event_id, any_value(value) value from (select *, max(value) over (partition by user_id) m from events) where value = m group by user_id")
def _(spark, d):
    return metrics.best_so_far(scene.read(spark, d, "events"), "event_id", "value", ("user_id",))


@query("log_filter", "select event_id, json_extract_string(props, '$.k')::bigint k from events where json_extract_string(props, '$.k') is not null and event_type = 'purchase'")
def _(spark, d):
    e = scene.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.where("k is not null and event_type = 'purchase'").select("event_id", F.col("k").cast("long").alias("k"))


@query("label_map", "select p_partkey, case when p_size % 4 = 0 then 8 when p_size % 4 = 1 then 3 when p_size % 4 = 2 then 5 else 11 end fourteen, case when p_size % 4 = 0 then 0 else 2 end coarse from part")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("Railing", "Kitchen", "Bedroom", "NoSuchRoom"))), F.col("p_size") % 4 + 1)
    return scene.read(spark, d, "part").select("p_partkey", taxonomy.room_class(kind, "cubicasa12").alias("fourteen"), taxonomy.room_class(kind).alias("coarse"))


@query("taxonomy_names", "select case label % 5 when 0 then 'background' when 1 then 'wall' when 2 then 'room' when 3 then 'door' else 'window' end as name, count(*) n from embeddings group by 1")
def _(spark, d):
    names = taxonomy.table(spark).where("taxonomy = 'coarse'").select("class_id", "name")
    return scene.logits(spark, d).join(F.broadcast(names), F.col("target") == F.col("class_id")).groupBy("name").agg(F.count("*").alias("n"))


# ---- rasters

_RECTS = scene.RECTANGLES.format(shift=0)
_PIX = scene.PIXELS.format(rects=_RECTS)
_PIX2 = scene.PIXELS.format(rects=scene.RECTANGLES.format(shift=2))


@query("raster_paint", f"select plan_id, y, x, rid from ({_PIX})")
def _(spark, d):
    return scene.rooms(spark, d)


_EDGE = f"""select plan_id, y, x, 'x' axis, b before, rid after from (select *, lag(rid) over w b, lag(x) over w q from ({_PIX}) window w as (partition by plan_id, y order by x)) where q = x - 1 and b <> rid
union all select plan_id, y, x, 'y', b, rid from (select *, lag(rid) over w b, lag(y) over w q from ({_PIX}) window w as (partition by plan_id, x order by y)) where q = y - 1 and b <> rid"""


@query("edge_change", _EDGE)
def _(spark, d):
    return raster.boundaries(scene.rooms(spark, d), "rid")


@query("runs", f"select plan_id, rid, y, min(x) lo, max(x) hi, count(*) n from (select *, x - row_number() over (partition by plan_id, rid, y order by x) i from ({_PIX})) group by plan_id, rid, y, i")
def _(spark, d):
    return raster.runs(scene.rooms(spark, d), ["plan_id", "rid", "y"], "x")


_SHARED = f"""with e as (select plan_id, least(before, after) a, greatest(before, after) b, axis, case axis when 'x' then x else y end fixed, case axis when 'x' then y else x end pos from ({_EDGE}))
select plan_id, a, b, axis, fixed, min(pos) lo, max(pos) hi, count(*) n from (select *, pos - row_number() over (partition by plan_id, a, b, axis, fixed order by pos) i from (select distinct * from e)) group by plan_id, a, b, axis, fixed, i"""


@query("shared_segments", _SHARED)
def _(spark, d):
    return raster.shared_segments(scene.rooms(spark, d), "rid")


@query("longest_segment", f"select plan_id, a, b, axis, fixed, lo, hi, n from (select *, row_number() over (partition by plan_id, a, b order by n desc, axis, fixed, lo) k from ({_SHARED})) where k = 1")
def _(spark, d):
    return raster.longest(raster.shared_segments(scene.rooms(spark, d), "rid"), ["plan_id", "a", "b"])


def _box(f: str, v: str, src: str, rad: int) -> str:
    one = f"select *, {f}({v}) over (partition by plan_id, y order by x range between {rad} preceding and {rad} following) q from ({src})"
    return f"select * exclude (q), {f}(q) over (partition by plan_id, x order by y range between {rad} preceding and {rad} following) o from ({one})"


@query("box_edge", f"select plan_id, y, x, (hi <> lo)::int edge from (select * exclude (o), o lo from ({_box('min', 'rid', 'select * exclude (o), o hi from (' + _box('max', 'rid', _PIX, 2) + ')', 2)}))")
def _(spark, d):
    return raster.edge_map(scene.rooms(spark, d), 2, "rid").select("plan_id", "y", "x", "edge")


_BIT = f"select plan_id, y, x, (rid % 2)::int as bit from ({_PIX})"


@query("morph_close", f"select plan_id, y, x, o as bit from ({_box('min', 'b2', 'select plan_id, y, x, o b2 from (' + _box('max', 'bit', _BIT, 1) + ')', 1)})")
def _(spark, d):
    return raster.close(scene.rooms(spark, d).select("plan_id", "y", "x", (F.col("rid") % 2).cast("int").alias("bit")), 1)


@query("component_stats", f"select plan_id, rid, count(*) area, min(x) x0, min(y) y0, max(x) x1, max(y) y1, sum(x)::bigint sum_x, sum(y)::bigint sum_y from ({_PIX}) group by plan_id, rid")
def _(spark, d):
    return raster.component_stats(scene.rooms(spark, d), ["plan_id", "rid"])


@query("min_size_filter", f"select plan_id, rid, count(*) area from ({_PIX}) group by plan_id, rid having count(*) >= 40")
def _(spark, d):
    return raster.component_stats(scene.rooms(spark, d), ["plan_id", "rid"]).where("area >= 40").select("plan_id", "rid", "area")


_OVER = f"""with a as ({_PIX}), b as ({_PIX2}), i as (select plan_id, a.rid pred, b.rid as true_, count(*) inter from a join b using (plan_id, y, x) group by all),
p as (select plan_id, rid pred, count(*) ap from a group by all), t as (select plan_id, rid true_, count(*) bt from b group by all)
select plan_id, pred, true_ as "true", inter, ap area_left, bt area_right, inter / (ap + bt - inter)::double iou from i join p using (plan_id, pred) join t using (plan_id, true_)"""


def _overlaps(spark, d):
    return raster.overlaps(scene.rooms(spark, d).withColumnRenamed("rid", "pred"), scene.rooms(spark, d, 2).withColumnRenamed("rid", "true"), "pred", "true")


@query("pair_iou", f"select plan_id, pred, \"true\", inter, area_left, area_right, {r('iou')} iou from ({_OVER})")
def _(spark, d):
    return rounded(_overlaps(spark, d), "iou")


def _plan_scores(spark, d):
    rect = lambda shift: scene.rectangles(spark, d, shift).select("plan_id", "rid")
    return matching.plan_scores(matching.match_rooms(_overlaps(spark, d)), rect(0), rect(2))


_PR = "select quality q, toxic t, count(*) n from labels group by all"


@query("prf1", f"""with c as (select sum((quality = 1 and toxic = 0)::int)::double tp, sum((quality = 1)::int)::double np, sum((toxic = 0)::int)::double ng from labels), p as (select tp, np, ng, case when np = 0 then 1e0 else tp / np end p, case when ng = 0 then 1e0 else tp / ng end r from c)
select {r('p', 4)} "precision", {r('r', 4)} recall, {r('case when p + r = 0 then 0 else 2 * p * r / (p + r) end', 4)} f1 from p""")
def _(spark, d):
    c = scene.read(spark, d, "labels").agg(F.count_if(F.expr("quality = 1 and toxic = 0")).cast("double").alias("tp"), F.count_if(F.expr("quality = 1")).cast("double").alias("np"), F.count_if(F.expr("toxic = 0")).cast("double").alias("ng"))
    p, rec, f = metrics.precision_recall(F.col("tp"), F.col("np"), F.col("ng"))
    return c.select(p.alias("precision"), rec.alias("recall"), f.alias("f1"))


@query("mask_algebra", f"with a as ({_PIX}), b as ({_PIX2}) select plan_id, count(*) filter (where a.rid is not null and b.rid is not null) both_, count(*) filter (where b.rid is null) only_a, count(*) filter (where a.rid is null) only_b, count(*) either from a full join b using (plan_id, y, x) group by plan_id")
def _(spark, d):
    return raster.overlap_counts(scene.rooms(spark, d), scene.rooms(spark, d, 2))


# ---- geometry

_MERGED = f"select k, run, min(lo) lo, max(hi) hi, count(*) n from (select *, sum(f) over (partition by k order by lo, hi rows unbounded preceding) run from (select *, case when lo <= max(hi) over (partition by k order by lo, hi rows between unbounded preceding and 1 preceding) + 2 then 0 else 1 end f from ({scene.SPANS}))) group by k, run"


@query("span_merge", f"select k, run::bigint run, lo, hi, n from ({_MERGED})")
def _(spark, d):
    return geometry.merged_spans(scene.spans(spark, d), ["k"], 2)


@query("weighted_mean_run", f"select k, {r('sum(t * (hi - lo)) / sum(hi - lo)', 4)} t from ({scene.SPANS}) group by k")
def _(spark, d):
    return rounded(scene.spans(spark, d).groupBy("k").agg(geometry.weighted_mean("t", F.col("hi") - F.col("lo")).alias("t")), "t", places=4)


@query("seg_length", f"select wall_id, {r('sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))')} len, case when abs(y2 - y1) < 1e-6 then 'H' else 'V' end kind from ({scene.WALLS})")
def _(spark, d):
    return rounded(scene.walls(spark, d).select("wall_id", S.length(*geometry.SEGMENT).alias("len"), S.segment_kind(*geometry.SEGMENT).alias("kind")), "len")


@query("snap_axis", f"""with s as (select wall_id, x1, y1, x2 + wall_id % 9 x2, y2 + wall_id % 11 y2 from ({scene.WALLS})), a as (select *, abs(degrees(atan2(y2 - y1, x2 - x1))) % 180 ang from s),
k as (select *, case when least(ang, 180 - ang) <= 12 then 'H' when abs(ang - 90) <= 12 then 'V' else 'D' end kind from a)
select wall_id, kind, {r("case kind when 'H' then least(x1, x2) when 'V' then (x1 + x2) / 2 else x1 end")} x1, {r("case kind when 'H' then (y1 + y2) / 2 when 'V' then least(y1, y2) else y1 end")} y1,
{r("case kind when 'H' then greatest(x1, x2) when 'V' then (x1 + x2) / 2 else x2 end")} x2, {r("case kind when 'H' then (y1 + y2) / 2 when 'V' then greatest(y1, y2) else y2 end")} y2 from k""")
def _(spark, d):
    w = scene.walls(spark, d).withColumn("x2", F.col("x2") + F.col("wall_id") % 9).withColumn("y2", F.col("y2") + F.col("wall_id") % 11)
    out = w.select("wall_id", S.axis_of(*geometry.SEGMENT, 12.0).alias("kind"), S.snapped(*geometry.SEGMENT, 12.0).alias("s")).select("wall_id", "kind", "s.*")
    return rounded(out, *geometry.SEGMENT)


def _area(xs: str = "xs", ys: str = "ys") -> str:
    return f"list_sum(list_transform(range(1, len({xs}) + 1), lambda i: {xs}[i] * {ys}[i % len({xs}) + 1] - {xs}[i % len({xs}) + 1] * {ys}[i]))"


@query("shoelace", f"select room_id, {r('abs(' + _area() + ') / 2', 2)} area from ({scene.POLYGONS})")
def _(spark, d):
    return rounded(scene.polygons(spark, d).select("room_id", S.polygon_area(F.col("polygon")).alias("area")), "area", places=2)


_CENTRE = "list_sum(list_transform(range(1, 6), lambda i: ({0}[i] + {0}[i % 5 + 1]) * (xs[i] * ys[i % 5 + 1] - xs[i % 5 + 1] * ys[i])))"


@query("polygon_centroid", f"select room_id, {r(_CENTRE.format('xs') + ' / (3 * ' + _area() + ')', 2)} cx, {r(_CENTRE.format('ys') + ' / (3 * ' + _area() + ')', 2)} cy from ({scene.POLYGONS})")
def _(spark, d):
    return scene.polygons(spark, d).select("room_id", S.polygon_centroid(F.col("polygon")).alias("c")).select("room_id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@query("rescale", f"select wall_id, {r('x1 * 1.5e0', 2)} x1, {r('y1 * 0.75e0', 2)} y1, {r('x2 * 1.5e0', 2)} x2, {r('y2 * 0.75e0', 2)} y2, {r('thickness * 1.125e0', 2)} thickness from ({scene.WALLS})")
def _(spark, d):
    return geometry.rescaled_walls(scene.walls(spark, d), F.lit(1.5), F.lit(0.75)).drop("plan_id")


@query("area_m2", f"select room_id, {r('abs(' + _area() + ') / 2 / (20e0 * 20e0)', 2)} area_m2 from ({scene.POLYGONS})")
def _(spark, d):
    return scene.polygons(spark, d).select("room_id", S.square_metres(S.polygon_area(F.col("polygon")), 20.0).alias("area_m2"))


_DIST = "sqrt((px - (x1 + u * (x2 - x1))) * (px - (x1 + u * (x2 - x1))) + (py - (y1 + u * (y2 - y1))) * (py - (y1 + u * (y2 - y1))))"
_U = "case when (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) = 0 then 0 else greatest(0, least(1, ((px-x1)*(x2-x1)+(py-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) end"
_HOST = f"""with o as ({scene.OPENINGS}), w as ({scene.WALLS}), u as (select o.plan_id, opening_id, kind, px, py, wall_id, thickness, x1, y1, x2, y2, {_U} u from o join w using (plan_id)),
n as (select *, {_DIST} dist from u), b as (select *, row_number() over (partition by opening_id order by dist, wall_id) k from n where dist < 14)
select o.plan_id, o.opening_id, b.wall_id, {r('b.dist')} wall_dist from o left join b on b.opening_id = o.opening_id and b.k = 1"""


def _hosted(spark, d):
    return geometry.nearest_wall(scene.openings(spark, d), scene.walls(spark, d), ["opening_id"], F.lit(14.0))


@query("host_wall", _HOST)
def _(spark, d):
    return rounded(_hosted(spark, d).select("plan_id", "opening_id", "wall_id", "wall_dist"), "wall_dist")


@query("nearest_wall_click", f"""with o as ({scene.OPENINGS}), w as ({scene.WALLS}), u as (select o.plan_id, opening_id, px, py, wall_id, thickness, x1, y1, x2, y2, {_U} u from o join w using (plan_id)),
b as (select *, {_DIST} dist, row_number() over (partition by opening_id order by {_DIST}, wall_id) k from u)
select plan_id, opening_id, wall_id, {r('x1 + u * (x2 - x1)', 4)} fx, {r('y1 + u * (y2 - y1)', 4)} fy from b where k = 1 and dist <= 3 * thickness + 6""")
def _(spark, d):
    return rounded(geometry.placed_on_wall(scene.openings(spark, d).select("plan_id", "opening_id", "px", "py"), scene.walls(spark, d), ["opening_id"]).select("plan_id", "opening_id", "wall_id", "fx", "fy"), "fx", "fy", places=4)


@query("snap_refs", f"""with o as ({scene.OPENINGS}), w as ({scene.WALLS}), rx as (select distinct plan_id, x1 v from w), ry as (select distinct plan_id, y1 v from w),
a as (select opening_id, v, row_number() over (partition by opening_id order by abs(px - v), v) k from o join rx using (plan_id) where abs(px - v) < 5), b as (select opening_id, v, row_number() over (partition by opening_id order by abs(py - v), v) k from o join ry using (plan_id) where abs(py - v) < 5)
select o.plan_id, o.opening_id, coalesce(a.v, px) sx, coalesce(b.v, py) sy from o left join a on a.opening_id = o.opening_id and a.k = 1 left join b on b.opening_id = o.opening_id and b.k = 1""")
def _(spark, d):
    refs = scene.walls(spark, d).select("plan_id", F.col("x1").alias("rx"), F.col("y1").alias("ry"))
    return geometry.snapped_to_references(scene.openings(spark, d), refs, ["opening_id"], 5.0).select("plan_id", "opening_id", "sx", "sy")


_PASS = f"""with w as ({scene.WALLS}), h as (select * from w where wall_id % 2 = 0), v as (select * from w where wall_id % 2 = 1),
e as (select plan_id, wall_id, y1 f, 1 e, x1 q from h union all select plan_id, wall_id, y1, 2, x2 from h),
b as (select e.wall_id, e.e, v.x1 pos, row_number() over (partition by e.wall_id, e.e order by abs(v.x1 - e.q), v.wall_id) k from e join v using (plan_id) where v.y1 - 9 <= e.f and e.f <= v.y2 + 9 and abs(v.x1 - e.q) < 9)
select w.wall_id seg_id, coalesce(b1.pos, w.x1) x1, w.y1, coalesce(b2.pos, w.x2) x2, w.y2 from w left join b b1 on b1.wall_id = w.wall_id and b1.e = 1 and b1.k = 1 left join b b2 on b2.wall_id = w.wall_id and b2.e = 2 and b2.k = 1"""


def _segments(spark, d):
    return scene.walls(spark, d).select("plan_id", F.col("wall_id").alias("seg_id"), S.segment_kind(*geometry.SEGMENT).alias("kind"), *geometry.SEGMENT)


@query("junction_pass", _PASS)
def _(spark, d):
    return geometry.junction_pass(_segments(spark, d), F.lit(9.0), "H").select("seg_id", *geometry.SEGMENT)


@query("close_junctions")
def _(spark, d):
    return geometry.close_junctions(_segments(spark, d), F.lit(9.0)).select("plan_id", "seg_id", *geometry.SEGMENT)


@query("merge_collinear")
def _(spark, d):
    segs = _segments(spark, d).withColumn("t", F.lit(4.0))
    return rounded(geometry.cluster_and_merge(segs, F.lit(3.6), F.lit(4.8)), "x1", "y1", "x2", "y2", "t")


@query("plan_summary", f"""with a as (select plan_id, count(*) rooms, sum(abs({_area()}) / 2) room_area from ({scene.POLYGONS}) group by 1), b as (select plan_id, count(*) walls, sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) wall_length from ({scene.WALLS}) group by 1),
c as (select plan_id, count(*) filter (where kind = 'door') doors, count(*) filter (where kind = 'window') windows from ({scene.OPENINGS}) group by 1)
select plan_id, coalesce(rooms, 0) rooms, coalesce(walls, 0) walls, coalesce(doors, 0) doors, coalesce(windows, 0) windows, {r('coalesce(wall_length, 0)', 1)} wall_length, {r('coalesce(room_area, 0)', 1)} room_area from a full join b using (plan_id) full join c using (plan_id)""")
def _(spark, d):
    rooms = scene.polygons(spark, d).select("plan_id", S.polygon_area(F.col("polygon")).alias("area_px"))
    return geometry.plan_summary(rooms, scene.walls(spark, d), scene.openings(spark, d))


@query("thickness_estimate", f"select plan_id, least(greatest(2 * median(width), 2), greatest(4, 512 / 8)) t from ({scene.OPENINGS}) group by plan_id")
def _(spark, d):
    return scene.openings(spark, d).groupBy("plan_id").agg(geometry.thickness(F.col("width"), F.lit(512), F.lit(512)).alias("t"))


@query("first_n", "select wall_id, x1 from (" + scene.WALLS + ") order by wall_id limit 20")
def _(spark, d):
    return scene.walls(spark, d).select("wall_id", "x1").orderBy("wall_id").limit(20)


@query("tiles", "with s as (select p_partkey plan_id, 100 + p_partkey % 700 h, 100 + p_size * 20 w from part), y as (select *, unnest(case when h <= 256 then [0] else list_append(list_filter(range(0, h - 256, 192), lambda v: v < h - 256), h - 256) end) ty from s) select plan_id, ty, unnest(case when w <= 256 then [0] else list_append(list_filter(range(0, w - 256, 192), lambda v: v < w - 256), w - 256) end) tx from y")
def _(spark, d):
    plans = scene.read(spark, d, "part").select(F.col("p_partkey").alias("plan_id"), (100 + F.col("p_partkey") % 700).cast("int").alias("height"), (100 + F.col("p_size") * 20).cast("int").alias("width"))
    return tiles.tiles(plans, 256)


_G = "exp(-0.5e0 * pow((({0}) - 3.5e0) / 2e0, 2))"


@query("blend", f"""with l as (select l_orderkey plan_id, (l_linenumber % 2) * 4 t, l_partkey % 8 dy, l_suppkey % 8 dx, l_discount p, greatest({_G.format('l_partkey % 8')} * {_G.format('l_suppkey % 8')} / exp(-0.0625e0), 1e-3) w from lineitem)
select plan_id, t + dy y, t + dx x, 0 class_id, {r('sum(p * w) / greatest(sum(w), 1e-6)')} p from l group by all""")
def _(spark, d):
    t = ((F.col("l_linenumber") % 2) * 4).cast("long")
    s = scene.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), t.alias("ty"), t.alias("tx"), (F.col("l_partkey") % 8).alias("dy"), (F.col("l_suppkey") % 8).alias("dx"), F.lit(0).alias("class_id"), F.col("l_discount").alias("p"))
    return rounded(tiles.blend(s, 8), "p")


@query("points_parse", f"select room_id, {r('abs(' + _area() + ') / 2', 2)} area, 5 n from ({scene.POLYGONS})")
def _(spark, d):
    text = F.array_join(F.transform("polygon", lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), " ")
    out = scene.polygons(spark, d).select("room_id", S.points(text).alias("p"))
    return out.select("room_id", S.half_up(S.polygon_area(F.col("p")), 2).alias("area"), F.size("p").alias("n"))


# ---- edits


@query("edit_delete_wall", f"select opening_id, case when wall_id % 7 = 0 then null else wall_id end wall_id from ({_HOST})")
def _(spark, d):
    w = scene.walls(spark, d)
    o = edits.remove_walls(w, _hosted(spark, d), w.where("wall_id % 7 = 0"))[1]
    return o.select("opening_id", "wall_id")


@query("edit_translate", f"select wall_id, case when wall_id % 3 = 0 then x1 + 5 else x1 end x1, case when wall_id % 3 = 0 then y1 - 2 else y1 end y1, case when wall_id % 3 = 0 then x2 + 5 else x2 end x2, case when wall_id % 3 = 0 then y2 - 2 else y2 end y2 from ({scene.WALLS})")
def _(spark, d):
    return edits.translate_walls(scene.walls(spark, d), F.col("wall_id") % 3 == 0, 5, -2).select("wall_id", *geometry.SEGMENT)


@query("edit_add_wall", f"with w as ({scene.WALLS}), n as (select plan_id, max(wall_id) + 1 wall_id from w group by 1 union all select plan_id, max(wall_id) + 2 from w group by 1) select plan_id, wall_id from n")
def _(spark, d):
    w = scene.walls(spark, d).withColumn("exterior", F.lit(False))
    new = w.select("plan_id").distinct().select("plan_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")).select("plan_id", "ord", *[F.lit(float(v)).alias(c) for c, v in zip(geometry.SEGMENT, (0, 0, 9, 0), strict=True)], F.lit(4.0).alias("thickness"))
    return edits.add_walls(w, new).join(w.select("plan_id", "wall_id"), ["plan_id", "wall_id"], "left_anti").select("plan_id", "wall_id")


@query("set_scale", f"select room_id, {r('floor(abs(' + _area() + ') / 2 * 10 + 0.5e0) / 10 / (12.5e0 * 12.5e0)', 2)} area_m2 from ({scene.POLYGONS})")
def _(spark, d):
    rooms = scene.polygons(spark, d).select("room_id", S.half_up(S.polygon_area(F.col("polygon")), 1).alias("area_px"))
    return edits.with_scale(rooms, 12.5).select("room_id", "area_m2")


@query("orphan_openings", f"select opening_id, wall_id from ({_HOST}) where wall_id % 5 = 0")
def _(spark, d):
    return edits.orphans(_hosted(spark, d), scene.walls(spark, d).where("wall_id % 5 <> 0")).select("opening_id", "wall_id")


def _generated(spark, d):
    """A generated plan for each nation, on the executors."""
    plans = scene.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return generate.masks_of(plans.repartition(max(8, spark.sparkContext.defaultParallelism), "id"), seed=100, size=512)


@query("generated_masks")
def _(spark, d):
    return _generated(spark, d).select("plan_id", "height", "width", F.crc32("data").alias("crc32"))


@query("vectorize_plans")
def _(spark, d):
    t = vectorize.tables(vectorize.vectorize(_generated(spark, d)))
    return geometry.plan_summary(t["room"], t["wall"], t["opening"])


@query("vectorized_openings")
def _(spark, d):
    return vectorize.tables(vectorize.vectorize(_generated(spark, d)))["opening"].select("plan_id", "opening_id", "kind", "cx", "cy", "width", "depth", "angle", "wall_id")


@query("exports_svg")
def _(spark, d):
    docs = vectorize.vectorize(_generated(spark, d))
    out = exports.exported(exports.exported(docs, "svg"), "dxf")
    return out.select("plan_id", F.length("svg").alias("svg_chars"), F.length("dxf").alias("dxf_chars"))


_SVG = '<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(%d,0)"><g class="Space Kitchen"><polygon points="0,0 %d,0 %d,40 0,40"/></g><g class="Wall External"><polygon points="0,0 %d,0 %d,4 0,4"/></g></g></svg>'


@query("svg_polygons", "select p_partkey plan_id, 0 ordinal, 'room' kind, 'Kitchen' subtype, 40.0e0 * (p_size + 10) area from part union all select p_partkey, 1, 'wall', 'External', 4.0e0 * (p_size + 10) from part")
def _(spark, d):
    w = (F.col("p_size") + 10).cast("int")
    svg = F.format_string(_SVG, (F.col("p_partkey") % 30).cast("int"), w, w, w, w)
    shapes = readers.svg_polygons(scene.read(spark, d, "part").select(F.col("p_partkey").alias("plan_id"), svg.alias("svg")))
    return shapes.select("plan_id", "ordinal", "kind", "subtype", S.half_up(S.polygon_area(F.col("points")), 2).alias("area"))


@query("history_prune", "select user_id plan_id, count(*) n from (select user_id, row_number() over (partition by user_id order by event_id desc) k from events) where k <= 101 group by user_id")
def _(spark, d):
    log = scene.read(spark, d, "events").select(F.col("user_id").alias("plan_id"), F.col("event_id").alias("version"), F.col("event_type").alias("op"))
    return edits.history_table(spark, log).groupBy("plan_id").agg(F.count("*").alias("n"))


from floorwright.plans import catalog_functions, catalog_regions, catalog_lines, catalog_streams  # noqa: E402, F401, I001  (register their queries here)
