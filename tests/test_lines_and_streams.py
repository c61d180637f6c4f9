"""Simplified lines, hulls, the mask cache, keyed best-so-far with a restart, and the commands."""

import json
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from floorwright import cli
from floorwright.operators import lines, raster
from floorwright.sources import readers
from floorwright.streaming import metrics as streaming

R = np.random.default_rng(11)
POINTS = "line long, ord long, x double, y double"


def plain_simplified(p, eps):
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        s, e = todo.pop()
        (x1, y1), (x2, y2) = p[s], p[e]
        size = max(math.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 1e-9)
        off = [(abs((y2 - y1) * p[i][0] - (x2 - x1) * p[i][1] + x2 * y1 - y2 * x1) / size, -i) for i in range(s + 1, e)]
        if off and max(off)[0] > eps:
            m = -max(off)[1]
            keep.add(m)
            todo += [(s, m), (m, e)]
    return sorted(keep)


def test_simplified_lines(spark):
    own = [R.integers(0, 40, (int(n), 2)).astype(float).tolist() for n in (1, 2, 3, 30, 200, 1500)]
    own += [[(k, 0.0) for k in range(50)], [(5.0, 5.0)] * 20, [(k, k % 2 * 4.0) for k in range(60)]]
    rows = [(i, k, *map(float, q)) for i, p in enumerate(own) for k, q in enumerate(p)]
    df = spark.createDataFrame(rows + [(0, None, 1.0, 1.0), (1, 9, None, 1.0)], POINTS)
    got = defaultdict(list)
    for r in lines.simplified(df, ["line"], 3.0).collect():
        got[r.line].append(r.ord)
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_simplified(p, 3.0) for k, p in enumerate(own)}
    assert lines.simplified(df.limit(0), ["line"], 3.0).count() == 0


def plain_hull(points):
    p = sorted(set(points))
    if len(p) < 3:
        return set(p)
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out = set()
    for a in p:
        for b in p:
            if a != b and all(cross(a, b, c) > 0 or cross(a, b, c) == 0 and min(a, b) <= c <= max(a, b) for c in p):
                out |= {a, b}
    return out


def test_hulls_and_least_rectangles(spark):
    sets = [R.integers(0, 12, (n, 2)).tolist() for n in (1, 2, 3, 10, 40)] + [[[k, 2 * k] for k in range(9)], [[1, 1]] * 5, [[3, k] for k in range(7)]]
    turn = math.radians(30)
    sets.append([[100 + x * math.cos(turn) - y * math.sin(turn), 50 + x * math.sin(turn) + y * math.cos(turn)] for x in np.linspace(-10, 10, 21) for y in np.linspace(-3, 3, 7)])
    rows = [(i, 0, float(x), float(y)) for i, s in enumerate(sets) for x, y in s] + [(0, 0, None, 1.0)]
    df = spark.createDataFrame(rows, POINTS)
    hulls = {r.line: [(p.x, p.y) for p in r.hull] for r in lines.hulls(df, ["line"]).collect()}
    for k, s in enumerate(sets[:-1]):
        assert set(hulls[k]) == plain_hull([tuple(map(float, p)) for p in s]) and len(set(hulls[k])) == len(hulls[k])
    rect = {r.line: r for r in lines.least_rectangles(df, ["line"]).collect()}
    last = rect[len(sets) - 1]
    assert np.allclose([last.cx, last.cy, max(last.w, last.h), min(last.w, last.h)], [100, 50, 20, 6], atol=1e-6)
    assert min(abs(last.angle - a) for a in (30, 120, -60, -150)) < 1e-6
    assert rect[0].area == 0 and rect[5].area < 1e-9 and rect[5].w > 0 and lines.hulls(df.limit(0), ["line"]).count() == 0


SVG = '<svg xmlns="http://www.w3.org/2000/svg"><g class="Space Kitchen"><polygon points="0,0 %d,0 %d,9 0,9"/></g></svg>'


def test_masks_are_drawn_once(spark, tmp_path, monkeypatch):
    path, drawn = str(tmp_path / "masks"), []
    whole = readers.paint
    monkeypatch.setattr(readers, "paint", lambda shapes, *a: drawn.append(1) or whole(shapes, *a))
    make = lambda rows: spark.createDataFrame(rows, "plan_id long, svg string")
    first = [(k, SVG % (k + 3, k + 3)) for k in range(6)] + [(7, "no xml"), (8, None), (None, SVG % (1, 1)), (0, SVG % (3, 3))]
    got = {r.plan_id: bytes(r.data) for r in readers.cached_masks(make(first), path, 12, 12).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 7} and sum(got[3]) == 2 * 7 * 10 and sum(got[7]) == 0
    files = sorted((tmp_path / "masks").rglob("*.parquet"))
    assert {r.plan_id: bytes(r.data) for r in readers.cached_masks(make(first), path, 12, 12).collect()} == got
    assert len(drawn) == 1 and sorted((tmp_path / "masks").rglob("*.parquet")) == files
    changed = [(1, SVG % (9, 9)), *first[2:]]
    again = {r.plan_id: bytes(r.data) for r in readers.cached_masks(make(changed), path, 12, 12).collect()}
    assert sum(again[1]) == 2 * 10 * 10 and again[2] == got[2] and len(drawn) == 2
    assert spark.read.parquet(path).count() == 8  # the changed one alone was added
    spark.read.parquet(path).write.mode("append").partitionBy("taxonomy").parquet(path)  # as if two runs had drawn at the same time
    assert readers.cached_masks(make(changed), path, 12, 12).count() == 7
    other = readers.cached_masks(make(changed), path, 12, 12, "cubicasa12").collect()
    assert {r.taxonomy for r in other} == {"cubicasa12"} and len(drawn) == 3


def test_best_of_each_run_goes_on_after_a_restart(spark, tmp_path):
    seen = []

    def put(name, rows):
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / name).write_text("".join(json.dumps(dict(zip(("run", "iter", "miou"), r, strict=True))) + "\n" for r in rows))

    def turn():
        log = spark.readStream.schema("run long, iter long, miou double").json(str(tmp_path / "log"))
        q = streaming.best_by_run(log).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at"))
        q.foreachBatch(lambda b, _: seen.append(sorted(map(tuple, b.collect())))).trigger(availableNow=True).start().awaitTermination()
        out = [x for x in seen if x]
        seen.clear()
        return out

    put("a.json", [(1, 10, 0.5), (1, 20, 0.5), (1, 30, 0.4), (2, 5, None), (None, 1, 0.9), (3, 7, 0.1)])
    assert turn() == [[(1, 10, 0.5), (3, 7, 0.1)]]
    put("b.json", [(1, 40, 0.5), (3, 9, 0.2), (3, 8, 0.2), (2, 6, 0.3)])  # equal isn't better
    assert turn() == [[(2, 6, 0.3), (3, 8, 0.2)]]
    assert turn() == []


def test_edge_sides(spark):
    edges = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 1), (0, 0, 2, 0)], "plan_id long, y int, x int, edge int")
    near = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (0, 0, 2)], "plan_id long, y int, x int")
    got = {r.x: (r.exterior, r.interior) for r in raster.edge_sides(edges, near).collect()}
    assert got == {0: (True, False), 1: (False, True), 2: (False, False)}


def test_evaluate_command(spark, tmp_path):
    pixels = lambda labels: spark.createDataFrame([(0, 0, k, v) for k, v in enumerate(labels)], "plan_id long, y int, x int, label int")
    pixels([0, 1, 1, 1, 2]).write.parquet(str(tmp_path / "pred"))
    pixels([0, 0, 1, 1, 2]).write.parquet(str(tmp_path / "true"))
    cli.main(["evaluate", str(tmp_path / "pred"), str(tmp_path / "true"), "--out", str(tmp_path / "out")])
    row = spark.read.json(str(tmp_path / "out")).first()
    assert abs(row.pixel_acc - 0.8) < 1e-9 and abs(row.miou - (1 / 2 + 2 / 3 + 1) / 3) < 1e-9


def test_vectorize_command(spark, tmp_path):
    mask = np.zeros((64, 64), np.uint8)
    mask[8:56, 8:56] = 1
    mask[14:50, 14:50] = 2
    spark.createDataFrame([(5, 64, 64, bytearray(mask.tobytes()))], "plan_id long, height int, width int, data binary").write.parquet(str(tmp_path / "masks"))
    cli.main(["vectorize", str(tmp_path / "masks"), "--out", str(tmp_path / "docs"), "--formats", "svg", "dxf"])
    row = spark.read.parquet(str(tmp_path / "docs")).first()
    assert row.plan_id == 5 and row.svg.startswith("<svg") and "ROOMS" in row.dxf


def test_predict_command(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli.tiles, "onnx_scorer", lambda path: lambda: lambda x: np.stack([x.mean(1), -x.mean(1)], 1))
    image = np.zeros((40, 50, 3), np.uint8)
    spark.createDataFrame([(1, 40, 50, bytearray(image.tobytes()))], "plan_id long, height int, width int, data binary").write.parquet(str(tmp_path / "images"))
    cli.main(["predict", str(tmp_path / "images"), "model.onnx", "--tile", "32", "--out", str(tmp_path / "labels")])
    assert bytes(spark.read.parquet(str(tmp_path / "labels")).first().data) == b"\1" * 2000
