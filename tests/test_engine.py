import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorwright.functions import scalars as S
from floorwright.functions import taxonomy
from floorwright.operators import edits, geometry, matching, metrics, raster, tiles
from floorwright.sources import exports, generate, readers
from floorwright.streaming import metrics as streaming

#: Two rooms drawn at half size, a wall with a sliding door and a handle (decoration), a railing and a window; all moved by (4, 6).
SVG = """<svg xmlns="http://www.w3.org/2000/svg"><g id="storey" transform="translate(4 6)">
<g transform="scale(2)"><g class="Space Bath"><polygon points="1,1 21,1 21,16 1,16"/></g><g class="Space Pantry"><polygon points="24,1 44,1 44,31 24,31"/></g></g>
<g class="Wall"><polygon points="44,2 48,2 48,62 44,62"/><g class="Door Sliding"><polygon points="44,40 48,40 48,52 44,52"/></g><g class="Handle"><polygon points="0,0 60,0 60,60"/></g></g>
<g class="Railing"><polygon points="2,58 40,58 40,62 2,62"/></g><g class="Window Fixed"><polygon points="60,0 80,0 80,3 60,3"/></g></g></svg>"""


def one(df):
    return df.first().asDict(recursive=True)


def test_confusion_matrix(spark):
    counts = {(0, 0): 5, (0, 1): 2, (1, 1): 4, (1, 2): 1, (2, 2): 3, (255, 1): 4}
    rows = [k for k, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "target int, pred int")
    per = metrics.per_class(metrics.confusion(df), 4)
    found = {r.class_id: (r.gt, r.pr, r.iou) for r in per.collect()}
    assert {k: v[:2] for k, v in found.items()} == {0: (7, 5), 1: (5, 6), 2: (3, 4), 3: (0, 0)}
    assert [found[k][2] for k in range(4)] == pytest.approx([5 / 7, 4 / 7, 3 / 4, 0])
    total = one(metrics.summary(per))
    assert total["pixel_acc"] == pytest.approx(12 / 15)
    assert total["mean_acc"] == pytest.approx((5 / 7 + 4 / 5 + 1) / 3)
    nothing = metrics.summary(metrics.per_class(metrics.confusion(df.where("target = 255")), 4))
    assert one(nothing)["miou"] == one(nothing)["pixel_acc"] == 0


def test_edge_map(spark):
    """Bands of six rows: a square of radius 2 meets another band from the fifth row on."""
    df = spark.range(18 * 7).select(F.lit(3).alias("plan_id"), F.floor(F.col("id") / 7).alias("y"), (F.col("id") % 7).alias("x"))
    df = df.withColumn("label", (F.floor(F.col("y") / 6) % 2).cast("int"))
    rows = raster.edge_map(df, 2).groupBy("y").agg(F.min("edge").alias("lo"), F.max("edge").alias("hi")).collect()
    assert {r.y for r in rows if r.lo} == {r.y for r in rows if r.hi} == {4, 5, 6, 7, 10, 11, 12, 13}


def test_affine_and_points(spark):
    df = spark.createDataFrame([("scale(3,2) translate(4,-1)", 1.0, 1.0), ("matrix(0 1 -1 0 7 2)", 2.0, 5.0), ("", 8.0, 9.0), (None, -1.0, 0.5)], "t string, x double, y double")
    rows = df.select(S.applied(S.affine(F.col("t")), F.array(F.struct("x", "y")))[0].alias("p")).collect()
    assert [v for r in rows for v in (r.p.x, r.p.y)] == pytest.approx([15, 0, 2, 4, 8, 9, -1, 0.5])
    pts = spark.createDataFrame([("0.5,1 2 -3e1;7,8",), ("4 4 9",), ("",)], "s string").select(S.points(F.col("s")).alias("p")).collect()
    assert [[tuple(q) for q in r.p] for r in pts] == [[(0.5, 1), (2, -30), (7, 8)], [], []]


def test_room_classes(spark):
    kinds = {"CarPort": (10, 2), "Attic": (11, 2), "Railing": (8, 0), "DraughtLobby": (7, 2), "Sauna": (6, 2)}
    df = spark.createDataFrame([(k,) for k in kinds], "r string")
    rows = df.select("r", taxonomy.room_class(F.col("r"), "cubicasa12").alias("a"), taxonomy.room_class(F.col("r")).alias("b")).collect()
    assert {r.r: (r.a, r.b) for r in rows} == kinds
    with pytest.raises(ValueError, match="unknown taxonomy"):
        taxonomy.taxonomy("fine")


def test_svg_to_mask(spark):
    polys = readers.svg_polygons(spark.createDataFrame([(4, SVG), (5, "<svg><g class='Wall'>"), (6, None)], "plan_id long, svg string"))
    assert sorted((r.plan_id, r.kind, r.subtype) for r in polys.collect()) == [(4, "door", "Sliding"), (4, "railing", ""), (4, "room", "Bath"), (4, "room", "Pantry"), (4, "wall", ""), (4, "window", "Fixed")]
    want = {"coarse": {(20, 20): 2, (40, 70): 2, (66, 20): 0, (20, 50): 1, (50, 50): 3, (7, 70): 4, (75, 90): 0}, "cubicasa12": {(20, 20): 6, (40, 70): 9, (66, 20): 8, (20, 50): 2, (50, 50): 12, (7, 70): 13}}
    for tax, at in want.items():
        r = readers.paint(polys, 80, 100, tax).first()
        mask = np.frombuffer(r.data, np.uint8).reshape(80, 100)
        assert {k: int(mask[k]) for k in at} == at
    bad = readers.svg_errors(spark.createDataFrame([(4, SVG), (5, "<svg><g class='Wall'>"), (6, None)], "plan_id long, svg string")).collect()
    assert [r.plan_id for r in bad] == [5]


def test_views_and_windows():
    """Each view's result turned back lies on the image; weights are largest in the middle and never vanish."""
    x = np.random.default_rng(4).random((1, 3, 6, 6)).astype(np.float32)
    for view, back in tiles.VIEWS:
        assert (back(view(x)) == x).all()
    w = tiles.window(8)
    assert w.max() == pytest.approx(1) and w.min() >= 1e-3 and (w == w.T).all() and (w == w[::-1]).all()
    assert tiles.starts(100, 100) == tiles.starts(40, 100) == [0]
    assert tiles.starts(101, 100) == [0, 1]


def test_snap_merge_and_junctions(spark):
    segs = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 0.0, 4.0), (0, 1, 11.0, 0.5, 20.0, 0.5, 4.0), (0, 2, 22.0, 3.0, 22.0, 30.0, 4.0), (1, 0, 0.0, 0.0, 5.0, 5.0, 2.0)], "plan_id int, seg_id int, x1 double, y1 double, x2 double, y2 double, t double")
    out = geometry.cluster_and_merge(segs, F.lit(1.0), F.lit(2.0)).collect()
    flat = next(r for r in out if r.kind == "H")
    assert (flat.x1, flat.x2, round(flat.y1, 2)) == (0, 20, 0.24)
    assert len(out) == 3
    own = segs.withColumn("kind", S.segment_kind("x1", "y1", "x2", "y2"))
    ends = {(r.plan_id, r.seg_id): r for r in geometry.close_junctions(own, F.lit(4.0)).collect()}
    assert ends[0, 1].x2 == 22
    assert ends[0, 2].y1 == 0.5


def test_greedy_matching(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.95), (0, 2, 1, 0.6), (0, 3, 3, 0.4)], "plan_id long, pred long, true long, iou double")
    assert {(r.pred, r.true) for r in matching.match_rooms(pairs).collect()} == {(1, 2), (2, 1)}
    pred = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 0.0, 0.0), (0, 3, 50.0, 0.0)], "plan_id long, pred_id long, x double, y double")
    true = spark.createDataFrame([(0, 1, 1.0, 0.0, 8.0), (0, 2, 1.0, 0.0, 8.0), (0, 3, 1.0, 0.0, 8.0)], "plan_id long, true_id long, tx double, ty double, width double")
    got = {(r.true_id, r.pred_id) for r in matching.match_openings(pred, true, ["plan_id"], 2.0).collect()}
    assert got == {(1, 2), (2, 1)}


def test_edits(spark):
    rooms = spark.createDataFrame([(0, 0, "room", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [], 100.0, None, (5.0, 5.0))], "plan_id int, room_id int, label string, polygon array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, area_px double, area_m2 double, centroid struct<x:double,y:double>")
    assert one(edits.move_room_vertex(rooms, 0, 0, 2, 20, 10))["area_px"] == 150
    grown = one(edits.insert_room_vertex(rooms, 0, 0, 5, -2))
    assert [p["x"] for p in grown["polygon"]] == [0, 5, 10, 10, 0]
    cut = edits.remove_room_vertex(rooms, 0, 0, 0)
    assert len(one(cut)["polygon"]) == 3
    assert len(one(edits.remove_room_vertex(cut, 0, 0, 0))["polygon"]) == 3
    new = spark.createDataFrame([(0, 1, 1.0, 2.0, 3.0, 5.0), (7, 1, 0.0, 0.0, 2.0, 2.0)], "plan_id int, ord int, ax double, ay double, bx double, by double")
    added = {(r.plan_id, r.room_id): r.area_px for r in edits.add_room_rectangles(rooms, new).collect()}
    assert added == {(0, 0): 100, (0, 1): 6, (7, 0): 4}
    assert one(edits.with_scale(rooms, 5.0))["area_m2"] == 4
    assert one(edits.with_scale(rooms, None))["area_m2"] is None
    assert one(edits.translate_rooms(rooms, F.lit(True), 1, 2))["centroid"] == {"x": 6, "y": 7}


def test_history():
    h = edits.History()
    for _ in range(150):
        h = h.commit()
    assert len(h.versions) == edits.UNDO + 1
    assert h.undo().undo().redo().version == h.version - 1
    assert h.undo().commit().redo().version == h.fresh
    for _ in range(200):
        h = h.undo()
    assert h.at == 0


def test_tiles_and_scores(spark):
    rows = tiles.tiles(spark.createDataFrame([(0, 100, 600)], "plan_id int, height int, width int"), 256).collect()
    assert {(r.ty, r.tx) for r in rows} == {(0, 0), (0, 192), (0, 344)}
    assert tiles.starts(600, 256) == [0, 192, 344]

    def make():
        return lambda x: np.stack([x.mean(1), -x.mean(1)], 1)

    image = np.random.default_rng(0).integers(0, 256, (70, 90, 3), dtype=np.uint8)
    p = tiles.probabilities(image, make(), tile=64, tta=True)
    assert p.shape == (2, 70, 90)
    assert np.allclose(p.sum(0), 1, atol=1e-4)
    assert (tiles.denormalised(tiles.normalised(image)) == image).all()
    df = spark.createDataFrame([(1, 70, 90, bytearray(image.tobytes()))], "plan_id long, height int, width int, data binary")
    assert len(tiles.predict(df, make, tile=64).first().data) == 70 * 90
    with pytest.raises(ValueError):
        tiles.scorer("none")


def test_ema_and_schedule(spark):
    v = [1.0, 2.0, 5.0, 3.0]
    got = spark.createDataFrame([(v,)], "v array<double>").select(metrics.ema(F.col("v")).alias("e")).first().e
    e = v[0]
    for u, x in enumerate(v[1:], 1):
        d = min(0.999, (1 + u) / (10 + u))
        e = e * d + x * (1 - d)
    assert got == pytest.approx(e)
    lr = metrics.lr_schedule(spark.range(26).withColumnRenamed("id", "it"), 0.002, 2400, 150).where("it = 24").first().lr
    assert lr == pytest.approx(0.002 * 25 / 150)


def test_images_masks_and_logs(spark, tmp_path):
    root = tmp_path / "train"
    a = np.arange(12, dtype=np.uint8).reshape(3, 4) % 5
    for kind, px in (("images", np.stack([a] * 3, 2)), ("masks", a)):
        (root / kind).mkdir(parents=True)
        (root / kind / "p.png").write_bytes(exports.png(px))
    pair = readers.folder_pairs(spark, str(tmp_path), "train").first()
    assert bytes(pair["mask"]["data"]) == a.tobytes()
    (tmp_path / "train.txt").write_text("/a/b/  c/\n\nd\n")
    assert [r.folder for r in readers.split_folders(spark, str(tmp_path / "train.txt"), "train").collect()] == ["a/b", "c", "d"]
    (tmp_path / "m.bin").write_bytes(a.tobytes())
    assert readers.raw_masks(spark, str(tmp_path / "m.bin"), 3, 4).first().error is None
    assert readers.raw_masks(spark, str(tmp_path / "m.bin"), 3, 5).first().error
    logs = tmp_path / "log"
    logs.mkdir()
    rows = [{"iter": 1, "lr": 0.1}, {"iter": 5, "eval": {"mIoU": 0.5}}, {"iter": 9, "eval": {"mIoU": 0.5}}]
    (logs / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    card = json.loads(exports.model_card(readers.training_log(spark, str(logs)), {"name": "lite"}).first().card)
    assert card["best"]["iter"] == 5
    q = streaming.best_so_far(streaming.log_tail(spark, str(logs))).writeStream.outputMode("complete").format("memory").queryName("best").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("best").first().iter == 5


def test_streaming_confusion_equals_batch(spark, tmp_path):
    src = tmp_path / "pixels"
    df = spark.range(500).select((F.col("id") % 3).cast("int").alias("target"), (F.col("id") % 4).cast("int").alias("pred"))
    df.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = streaming.confusion(stream).writeStream.outputMode("complete").format("memory").queryName("conf").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("conf").collect())) == sorted(map(tuple, metrics.confusion(df).collect()))


def test_generated_dataset(spark, tmp_path):
    generate.write_dataset(spark, str(tmp_path / "d"), 2, 1, size=64)
    got = {(r.split, r.plan_id): bytes(r.data) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert got["train", 1] == generate.plan_mask(1, 64).tobytes()
    assert got["val", 0] == generate.plan_mask(generate.VALIDATION, 64).tobytes()


def test_shown_and_snapped(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 1.0)], "ax double, ay double, bx double, by double")
    assert one(df.select(edits.axis_snap("ax", "ay", "bx", "by").alias("p")))["p"] == {"x": 10, "y": 0}
    assert df.select(S.shown_length(F.lit(50.0), F.lit(20.0)).alias("s"), S.shown_length(F.lit(50.0), F.lit(None).cast("double")).alias("t")).first()[:] == ("2.50 m", "50 px")
    assert df.select(S.normal_angle(F.lit(-100.0)).alias("a")).first().a == 80
    assert math.isclose(df.select(S.polygon_area(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0))])).alias("a")).first().a, 6)
