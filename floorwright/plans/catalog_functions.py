"""Queries of single functions, edits and matches that catalog.py doesn't reach, each with its SQL; importing it registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from floorwright.functions import scalars as S
from floorwright.operators import edits, geometry, metrics, raster
from floorwright.plans import catalog, scene
from floorwright.plans.catalog import _area, query, r, rounded

# ---- functions of one row

_TURNED = f"select opening_id, px, py, width / 2 hw, width / 4 hh, radians((opening_id * 7 % 360)::double) a from ({scene.OPENINGS})"


@query("box_corners", f"""select opening_id, {r('px - cos(a) * hw + sin(a) * hh', 2)} x0, {r('py - sin(a) * hw - cos(a) * hh', 2)} y0, {r('px + cos(a) * hw + sin(a) * hh', 2)} x1,
{r('px + cos(a) * hw - sin(a) * hh', 2)} x2, {r('py + sin(a) * hw + cos(a) * hh', 2)} y2 from ({_TURNED})""")
def _(spark, d):
    box = S.box_corners("px", "py", "width", F.col("width") / 2, (F.col("opening_id") * 7 % 360).cast("double"))
    out = scene.openings(spark, d).select("opening_id", box.alias("b"))
    return out.select("opening_id", F.col("b")[0]["x"].alias("x0"), F.col("b")[0]["y"].alias("y0"), F.col("b")[1]["x"].alias("x1"), F.col("b")[2]["x"].alias("x2"), F.col("b")[2]["y"].alias("y2"))


_BOXES = f"select opening_id, width w, (opening_id % 40)::double h, (opening_id % 720 - 360)::double a from ({scene.OPENINGS})"


@query("long_side_first", f"select opening_id, greatest(w, h) + 1 width, least(w, h) + 1 depth, ((t + 90) % 180 + 180) % 180 - 90 angle from (select *, case when h > w then a + 90 else a end t from ({_BOXES}))")
def _(spark, d):
    side = S.long_side_first("width", (F.col("opening_id") % 40).cast("double"), (F.col("opening_id") % 720 - 360).cast("double"))
    return scene.openings(spark, d).select("opening_id", side.alias("s")).select("opening_id", "s.*")


@query("normal_angle", f"select opening_id, ((a + 90) % 180 + 180) % 180 - 90 angle from ({_BOXES})")
def _(spark, d):
    return scene.openings(spark, d).select("opening_id", S.normal_angle((F.col("opening_id") % 720 - 360).cast("double")).alias("angle"))


_SCALED = f"select wall_id, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) len, (wall_id % 10)::double metres from ({scene.WALLS})"


@query("calibrated", f"select wall_id, {r('case when metres > 0 and len > 0 then len / metres end')} ppm from ({_SCALED})")
def _(spark, d):
    return rounded(scene.walls(spark, d).select("wall_id", S.calibrated(S.length(*geometry.SEGMENT), (F.col("wall_id") % 10).cast("double")).alias("ppm")), "ppm")


@query("shown_sizes", f"""select wall_id, case when s > 0 then printf('%.2f m', px / s) else printf('%.0f px', px) end length, case when s > 0 then printf('%.2f m²', px / (s * s)) else printf('%.0f px²', px) end area
from (select wall_id, x1 + 1 px, case when wall_id % 3 > 0 then 7e0 * (wall_id % 3) end s from ({scene.WALLS}))""")
def _(spark, d):
    s = F.when(F.col("wall_id") % 3 > 0, 7.0 * (F.col("wall_id") % 3))
    return scene.walls(spark, d).select("wall_id", S.shown_length(F.col("x1") + 1, s).alias("length"), S.shown_area(F.col("x1") + 1, s).alias("area"))


@query("text_functions", """select p_partkey, 'g' || p_size tag, 'a &lt;' || p_partkey || '&gt; &amp; &quot;b&quot;' label, 'plan_' || p_partkey || '.v' stem from part""")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    tag = S.local_name(F.concat(F.lit("{http://www.w3.org/2000/svg}g"), "p_size"))
    label = S.xml_escaped(F.concat(F.lit("a <"), k, F.lit('> & "b"')))
    stem = S.stem(F.concat(F.lit("/plans/set.1/plan_"), k, F.lit(".v.png")))
    return scene.read(spark, d, "part").select("p_partkey", tag.alias("tag"), label.alias("label"), stem.alias("stem"))


_SIDES = "select p_partkey, (100 + p_partkey % 700)::double w, (100 + p_size * 20)::double h, least(1, 512 / greatest(100 + p_partkey % 700, 100 + p_size * 20)::double) s from part"


@query("resize_sides", f"select p_partkey, greatest(1, floor(w * s + 0.5))::int width, greatest(1, floor(h * s + 0.5))::int height, {r('s')} scale, (ceil(w / 32) * 32)::int padded from ({_SIDES})")
def _(spark, d):
    w, h = (100 + F.col("p_partkey") % 700).cast("int"), (100 + F.col("p_size") * 20).cast("int")
    out = scene.read(spark, d, "part").select("p_partkey", S.long_side(w, h, 512).alias("s"), S.padded(w).alias("padded"))
    return rounded(out.select("p_partkey", "s.*", "padded"), "scale")


@query("snap_polygon", f"select room_id, 5 vertices, xs[5] last_x, ys[5] last_y, {r('abs(' + _area() + ') / 2', 2)} area from ({scene.POLYGONS})")
def _(spark, d):
    """Every vertex comes twice, the second a hair beside the first, and the ring is closed."""
    p = F.col("polygon")
    twice = F.flatten(F.transform(p, lambda v: F.array(v, F.struct((v["x"] + 1e-8).alias("x"), v["y"].alias("y")))))
    out = scene.polygons(spark, d).select("room_id", S.without_repeats(F.concat(twice, F.slice(p, 1, 1))).alias("q"))
    last = F.element_at("q", -1)
    return out.select("room_id", F.size("q").alias("vertices"), last["x"].alias("last_x"), last["y"].alias("last_y"), S.half_up(S.polygon_area(F.col("q")), 2).alias("area"))


@query("svg_transform", "select p_partkey, 0e0 a, 2e0 b, -2e0 c, 0e0 d, (p_partkey % 50)::double e, p_size::double f from part")
def _(spark, d):
    t = F.format_string("translate(%d, %d) scale(2) rotate(90)", F.col("p_partkey") % 50, F.col("p_size"))
    return rounded(scene.read(spark, d, "part").select("p_partkey", S.affine(t).alias("m")).select("p_partkey", "m.*"), *"abcdef")


# ---- rasters

_RESIZED = f"with p as ({catalog._PIX}), t as (select y.range y, x.range x from range(96) y, range(40) x) select plan_id, t.y, t.x, rid from t join p on p.y = t.y * 64 // 96 and p.x = t.x * 64 // 40"


@query("resize_labels", _RESIZED)
def _(spark, d):
    return raster.resized(scene.rooms(spark, d), 64, 64, 40, 96).select("plan_id", "y", "x", "rid")


_KINDS = "['door', 'window', 'wall', 'railing', 'room']"


@query("painters_order", f"""select plan_id, y, x, arg_max(kind, z * 1000000 + rid) kind from (select plan_id, rid, kind, case kind when 'room' then 0 when 'railing' then 1 when 'wall' then 2 when 'window' then 3 else 4 end z, y, unnest(range(x0, x0 + w)) x
from (select *, {_KINDS}[rid % 5 + 1] kind, unnest(range(y0, y0 + h)) y from ({catalog._RECTS}))) group by plan_id, y, x""")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("door", "window", "wall", "railing", "room"))), (F.col("rid") % 5 + 1).cast("int"))
    px = raster.rectangle_pixels(scene.rectangles(spark, d).withColumn("kind", kind))
    return raster.painted(px.withColumn("z", raster.painters_order(F.col("kind"))), "kind", ["z", "rid"])


_SAMPLES = f"""select plan_id, wall_id, floor(x1 + (x2 - x1) * f - s * (y2 - y1) / ln * o + 0.5)::int x, floor(y1 + (y2 - y1) * f + s * (x2 - x1) / ln * o + 0.5)::int y
from (select plan_id, wall_id, x1 / 8 x1, y1 / 8 y1, x2 / 8 x2, y2 / 8 y2, thickness / 4 * 1.5 + 2 o, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) / 8 ln from ({scene.WALLS})), (select unnest([0.2e0, 0.35e0, 0.5e0, 0.65e0, 0.8e0]) f), (select unnest([1e0, -1e0]) s)"""


@query("exterior_walls", f"""with s as ({_SAMPLES}), p as (select plan_id, y, x, (rid % 3)::int label from ({catalog._PIX})), n as (select distinct plan_id from p)
select plan_id, wall_id, count(*) filter (where x < 0 or y < 0 or x >= 64 or y >= 64 or coalesce(label, 0) = 0) >= 2 exterior from s semi join n using (plan_id) left join p using (plan_id, y, x) group by plan_id, wall_id""")
def _(spark, d):
    px = scene.rooms(spark, d).select("plan_id", "y", "x", (F.col("rid") % 3).cast("int").alias("label"))
    sizes = px.select("plan_id").distinct().withColumns({"width": F.lit(64), "height": F.lit(64)})
    walls = scene.walls(spark, d).join(sizes.hint("merge"), "plan_id", "left_semi")
    small = walls.withColumns({c: F.col(c) / 8 for c in geometry.SEGMENT} | {"thickness": F.col("thickness") / 4})
    return geometry.exterior(small, px, sizes).select("plan_id", "wall_id", "exterior")


# ---- losses

_LOGITS = "select vec_id % 8 plan_id, (vec_id % 2)::double edge, list_transform(embedding[1:5], lambda x: x::double) v, label % 5 t from embeddings"
_CE = f"select t, edge, ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) + list_max(v) norm, v from ({_LOGITS})"
_EDGE_CE = f"select sum(c * w) / greatest(sum(w), 1) ce from (select (0.95e0 * (norm - v[t + 1]) + 0.05e0 * (norm - list_sum(v) / 5)) * case when t = 0 then 0.5e0 else 1e0 end c, 1 + 4 * edge w from ({_CE}))"


def _edge_ce(spark, d):
    own = scene.read(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("edge"), F.slice("embedding", 1, 5).alias("logits"), (F.col("label") % 5).cast("int").alias("target"))
    return metrics.weighted_cross_entropy(own, boost=4.0, smoothing=0.05, class_weight={0: 0.5}, edge="edge")


@query("loss_ce_edges", f"select {r('ce')} ce from ({_EDGE_CE})")
def _(spark, d):
    return rounded(_edge_ce(spark, d), "ce")


@query("loss_total", f"select {r('ce + 1 - dice + 0.4 * ce')} total from ({_EDGE_CE}), (select coalesce(avg((2 * inter + 1) / (p_sum + t_sum + 1)), 1) dice from ({catalog._DICE}) where t_sum > 0)")
def _(spark, d):
    both = _edge_ce(spark, d).crossJoin(metrics.dice_loss(catalog._probs(spark, d)))  # one row each
    return rounded(both.select(metrics.total_loss(F.col("ce"), F.col("dice_loss"), F.col("ce")).alias("total")), "total")


@query("parity_check", f"select {r('max(abs(x - floor(x * 64) / 64))')} max_abs_diff from (select unnest(v) x from ({_LOGITS}))")
def _(spark, d):
    """Logits against the same laid on steps of 1/64."""
    x = scene.read(spark, d, "embeddings").select(F.explode(F.slice("embedding", 1, 5)).alias("x")).select(F.col("x").cast("double").alias("x"))
    return rounded(x.agg(metrics.parity(F.col("x"), F.floor(F.col("x") * 64) / 64).alias("max_abs_diff")), "max_abs_diff")


@query("ema_log", f"""with v as (select user_id, list({{'u': k - 1, 'e': value::double}} order by event_id) l from (select *, row_number() over (partition by user_id order by event_id) k from events) group by user_id)
select user_id, {r("list_reduce(l, lambda a, b: {'u': b.u, 'e': a.e * least(0.999e0, (1e0 + b.u) / (10e0 + b.u)) + b.e * (1e0 - least(0.999e0, (1e0 + b.u) / (10e0 + b.u)))}).e")} ema from v""")
def _(spark, d):
    own = scene.read(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("v"))
    return rounded(own.select("user_id", metrics.ema(F.col("v")).alias("ema")), "ema")


# ---- matching: a fold over the pairs of each plan in order


def _greedy(pairs: str, by: str, left: str, right: str, value: str, order: str) -> str:
    row = f"{{'a': {left}, 'b': {right}, 'v': {value}}}"
    fold = "list_reduce(l, lambda s, x: case when list_contains(list_transform(s, lambda q: q.a), x[1].a) or list_contains(list_transform(s, lambda q: q.b), x[1].b) then s else list_concat(s, x) end)"
    return f"select {by}, m.a, m.b, m.v from (select {by}, unnest({fold}) m from (select {by}, list([{row}] order by {order}) l from ({pairs}) group by {by}))"


_MATCHED = _greedy(f"select plan_id, pred, \"true\" t, iou from ({catalog._OVER}) where iou >= 0.5", "plan_id", "pred", "t", "iou", "iou desc, pred desc, t desc")


@query("match_rooms", f"select plan_id, a pred, b as \"true\", {r('v')} iou from ({_MATCHED})")
def _(spark, d):
    from floorwright.operators import matching

    return rounded(matching.match_rooms(catalog._overlaps(spark, d)), "iou")


@query("exact_count_rate", f"""with m as (select count(*) tp, sum(v) s from ({_MATCHED})), n as (select count(*) n from part), p as (select tp, n, s, tp / n::double q from m, n)
select tp, n n_pred, n n_true, {r('q', 4)} "precision", {r('q', 4)} recall, {r('q', 4)} f1, 1e0 exact_rate, {r('case when tp > 0 then s / tp else 0 end')} mean_iou from p""")
def _(spark, d):
    return rounded(metrics.matching_totals(catalog._plan_scores(spark, d)), "exact_rate", "mean_iou")


_NEAR = f"""select t.plan_id, t.kind, t.opening_id ti, p.opening_id pi, sqrt((p.px - t.px) * (p.px - t.px) + (p.py + 1 - t.py) * (p.py + 1 - t.py)) dist
from ({scene.OPENINGS}) t join ({scene.OPENINGS}) p on p.plan_id = t.plan_id and p.kind = t.kind where t.opening_id % 3 <> 0 and sqrt((p.px - t.px) * (p.px - t.px) + (p.py + 1 - t.py) * (p.py + 1 - t.py)) <= greatest(t.width / 2, 6)"""


@query("match_openings", f"select plan_id, kind, a true_id, b pred_id, {r('v')} dist from ({_greedy(_NEAR, 'plan_id, kind', 'ti', 'pi', 'dist', 'ti, dist, pi desc')})")
def _(spark, d):
    from floorwright.operators import matching

    o = scene.openings(spark, d)
    pred = o.select("plan_id", "kind", F.col("opening_id").alias("pred_id"), F.col("px").alias("x"), (F.col("py") + 1.0).alias("y"))
    true = o.where("opening_id % 3 <> 0").select("plan_id", "kind", F.col("opening_id").alias("true_id"), F.col("px").alias("tx"), F.col("py").alias("ty"), "width")
    return rounded(matching.match_openings(pred, true, ["plan_id", "kind"], 6.0), "dist")


# ---- geometry and edits


@query("long_walls", f"select plan_id, wall_id from ({scene.WALLS}) where sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) >= 8 * thickness")
def _(spark, d):
    return geometry.long_enough(scene.walls(spark, d), 8 * F.col("thickness")).select("plan_id", "wall_id")


@query("opening_wall_fk", f"select plan_id, count(*) n from ({catalog._HOST}) semi join (select plan_id, wall_id from ({scene.WALLS}) where wall_id % 4 <> 0) using (plan_id, wall_id) group by plan_id")
def _(spark, d):
    o = catalog._hosted(spark, d).where("wall_id is not null")
    return o.join(scene.walls(spark, d).where("wall_id % 4 <> 0"), ["plan_id", "wall_id"], "left_semi").groupBy("plan_id").agg(F.count("*").alias("n"))


@query("geojson_features", f"select room_id, plan_id, 6 ring_points, {r('list_sum(xs) + xs[1]', 2)} sum_x, {r('list_sum(ys) + ys[1]', 2)} sum_y from ({scene.POLYGONS})")
def _(spark, d):
    from floorwright.sources import exports

    rooms = scene.polygons(spark, d).withColumn("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))
    out = exports.room_features(rooms).select("room_id", "plan_id", F.from_json(F.get_json_object("feature", "$.geometry.coordinates[0]"), "array<array<double>>").alias("ring"))
    total = lambda k: S.half_up(F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[k]), 2)
    return out.select("room_id", "plan_id", F.size("ring").alias("ring_points"), total(0).alias("sum_x"), total(1).alias("sum_y"))


@query("edit_move_end", f"select wall_id, x1, y1, case when wall_id = 64 then 7e0 else x2 end x2, case when wall_id = 64 then 9e0 else y2 end y2 from ({scene.WALLS})")
def _(spark, d):
    return edits.move_wall_end(scene.walls(spark, d), 1, 64, 1, 7, 9).select("wall_id", *geometry.SEGMENT)


@query("edit_patch", f"select wall_id, case when wall_id = 64 then 11e0 else thickness end thickness from ({scene.WALLS})")
def _(spark, d):
    return edits.patched(scene.walls(spark, d), "wall_id", 1, 64, {"thickness": 11}).select("wall_id", "thickness")


@query("rescale_rooms", f"select room_id, {r('abs(' + _area() + ') / 2 * 1.5e0 * 0.75e0', 1)} area_px, {r('xs[2] * 1.5e0', 2)} x, {r('ys[3] * 0.75e0', 2)} y from ({scene.POLYGONS})")
def _(spark, d):
    rooms = scene.polygons(spark, d).withColumns({"holes": F.array().cast("array<array<struct<x:double,y:double>>>"), "area_px": S.polygon_area(F.col("polygon"))})
    out = geometry.rescaled_rooms(rooms, F.lit(1.5), F.lit(0.75))
    return out.select("room_id", "area_px", F.col("polygon")[1]["x"].alias("x"), F.col("polygon")[2]["y"].alias("y"))


_FEET = f"""with o as ({scene.OPENINGS}), w as ({scene.WALLS}), u as (select o.plan_id, opening_id, px, py, wall_id, thickness, x1, y1, x2, y2, {catalog._U} u from o join w using (plan_id)),
b as (select *, {catalog._DIST} dist, row_number() over (partition by opening_id order by {catalog._DIST}, wall_id) k from u)
select plan_id, opening_id, wall_id, thickness, x1 + u * (x2 - x1) fx, y1 + u * (y2 - y1) fy from b where k = 1 and dist <= 3 * thickness + 6"""


@query("place_doors", f"select plan_id, wall_id, {r('fx', 2)} cx, {r('fy', 2)} cy, {r('3.4e0 * thickness', 2)} width, thickness + 1 depth, 100 + row_number() over (partition by plan_id order by fx, fy, wall_id, opening_id) opening_id from ({_FEET})")
def _(spark, d):
    """Clicks placed as doors behind openings with ids up to 100."""
    feet = geometry.placed_on_wall(scene.openings(spark, d).select("plan_id", "opening_id", "px", "py"), scene.walls(spark, d), ["opening_id"])
    new = edits.placed_openings(feet, "door")
    old = scene.walls(spark, d).select("plan_id").distinct().select(
        "plan_id", F.lit(100).cast("long").alias("opening_id"), F.lit("door").alias("kind"), *[F.lit(0.0).alias(c) for c in ("cx", "cy", "width", "depth", "angle")],
        F.lit(None).cast("long").alias("wall_id"), F.array().cast("array<struct<x:double,y:double>>").alias("polygon"),
    )
    out = edits.add_openings(old, new).where("opening_id > 100")
    return rounded(out.select("plan_id", "wall_id", "cx", "cy", "width", "depth", F.col("opening_id").cast("long")), "cx", "cy", "width", places=2)
