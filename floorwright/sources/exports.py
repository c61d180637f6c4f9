"""Geometry documents as JSON, GeoJSON, SVG, DXF and PNG; column functions for whole tables of plans."""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Callable
from typing import Any
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorwright.functions import scalars as S
from floorwright.functions import taxonomy


def to_json(g: dict[str, Any]) -> str:
    """The document with each wall's length."""
    walls = [w | {"length": round(float(np.hypot(w["p2"][0] - w["p1"][0], w["p2"][1] - w["p1"][1])), 2)} for w in g["walls"]]
    return json.dumps(g | {"walls": walls})


def from_json(text: str) -> dict[str, Any]:
    """A document again; lengths are derived and go. Without lists of rooms and walls it is no document."""
    g = json.loads(text)
    if not isinstance(g, dict) or not isinstance(g.get("rooms"), list) or not isinstance(g.get("walls"), list):
        raise ValueError("no plan geometry: rooms and walls have to be lists")
    return g | {"walls": [{k: v for k, v in w.items() if k != "length"} for w in g["walls"]], "openings": g.get("openings", [])}


def _ring(poly: list[list[float]]) -> list[list[float]]:
    return poly if not poly or poly[0] == poly[-1] else [*poly, poly[0]]


def to_geojson(g: dict[str, Any]) -> str:
    feature = lambda shape, coordinates, **p: {"type": "Feature", "geometry": {"type": shape, "coordinates": coordinates}, "properties": p}
    out = [feature("Polygon", [_ring(r["polygon"]), *map(_ring, r["holes"])], kind="room", id=r["id"], label=r["label"], area_px=r["area_px"], area_m2=r["area_m2"]) for r in g["rooms"]]
    out += [feature("LineString", [w["p1"], w["p2"]], kind="wall", id=w["id"], thickness=w["thickness"], exterior=w["exterior"]) for w in g["walls"]]
    out += [feature("Polygon", [_ring(o["polygon"])], kind=o["kind"], id=o["id"], width=o["width"], wall_id=o["wall_id"]) for o in g["openings"]]
    return json.dumps({"type": "FeatureCollection", "properties": {"px_per_meter": g.get("px_per_meter")}, "features": out})


def _hex(c: tuple[int, int, int]) -> str:
    return "#%02x%02x%02x" % c


def to_svg(g: dict[str, Any], scale: float = 1.0) -> str:
    """Rooms, walls and openings as one SVG; coordinates to one place, labels escaped."""
    n = lambda v: f"{v * scale:.1f}"
    path = lambda p: "M" + " L".join(f"{n(x)},{n(y)}" for x, y in p) + " Z"
    colors = dict(zip(taxonomy.COARSE.classes, map(_hex, taxonomy.COARSE.colors), strict=True))
    rows = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {n(g["width"])} {n(g["height"])}">']
    for r in g["rooms"]:
        rows.append(f'<path class="room" fill="{colors["room"]}" fill-rule="evenodd" d="{" ".join(map(path, [r["polygon"], *r["holes"]]))}"/>')
        rows.append(f'<text x="{n(r["centroid"][0])}" y="{n(r["centroid"][1])}" text-anchor="middle">{escape(str(r["label"]))}</text>')
    for w in g["walls"]:
        rows.append(f'<line class="wall" stroke="{colors["wall"]}" stroke-width="{max(1.0, w["thickness"]) * scale:.1f}" x1="{n(w["p1"][0])}" y1="{n(w["p1"][1])}" x2="{n(w["p2"][0])}" y2="{n(w["p2"][1])}"/>')
    for o in g["openings"]:
        rows.append(f'<path class="{o["kind"]}" fill="{colors[o["kind"]]}" d="{path(o["polygon"])}"/>')
    return "\n".join([*rows, "</svg>"])


def to_dxf(g: dict[str, Any]) -> str:
    """ASCII DXF (R12) with layers WALLS, ROOMS, DOORS, WINDOWS and LABELS; y points up, units are metres if a scale is known."""
    s = 1 / g["px_per_meter"] if g.get("px_per_meter") else 1.0
    h = g["height"]
    rows: list[str] = []

    def put(*pairs: tuple[int, Any]) -> None:
        rows.extend(str(v) for pair in pairs for v in pair)

    at = lambda p, k=0: ((10 + k, f"{p[0] * s:.4f}"), (20 + k, f"{(h - p[1]) * s:.4f}"))
    put((0, "SECTION"), (2, "ENTITIES"))
    for w in g["walls"]:
        put((0, "LINE"), (8, "WALLS"), *at(w["p1"]), *at(w["p2"], 1))

    def ring(layer: str, poly: list[list[float]]) -> None:
        put((0, "POLYLINE"), (8, layer), (66, 1), (70, 1))
        for p in poly:
            put((0, "VERTEX"), (8, layer), *at(p))
        put((0, "SEQEND"))

    for r in g["rooms"]:
        for p in [r["polygon"], *r["holes"]]:
            ring("ROOMS", p)
        put((0, "TEXT"), (8, "LABELS"), *at(r["centroid"]), (40, f"{12 * s:.4f}"), (1, r["label"]))
    for o in g["openings"]:
        ring("DOORS" if o["kind"] == "door" else "WINDOWS", o["polygon"])
    put((0, "ENDSEC"), (0, "EOF"))
    return "\n".join(rows) + "\n"


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of (h, w), (h, w, 3) or (h, w, 4) bytes."""
    a = np.ascontiguousarray(pixels, np.uint8)
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, c = a.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * c)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_text(pixels: np.ndarray) -> str:
    """A PNG file as base64 text, for a reply."""
    return base64.b64encode(png(pixels)).decode()


def from_png(data: bytes | str) -> np.ndarray:
    """The pixels of a PNG file of 8-bit grey, RGB or RGBA rows (bytes or base64 text); other files raise ValueError."""
    raw = base64.b64decode(data) if isinstance(data, str) else bytes(data)
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    parts, at = {}, 8
    while at + 8 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        parts.setdefault(kind, []).append(raw[at + 8 : at + 8 + n])
        at += n + 12
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if depth != 8 or colour not in (0, 2, 6) or interlaced:
        raise ValueError("only 8-bit grey, RGB and RGBA without interlacing")
    c = {0: 1, 2: 3, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(parts[b"IDAT"])), np.uint8).reshape(h, w * c + 1)
    out = np.zeros((h + 1, w + 1, c), np.int64)  # a row and a column of zeros before the first
    for y, row in enumerate(rows, 1):
        kind, line = row[0], row[1:].reshape(w, c).astype(np.int64)
        if kind == 0:
            out[y, 1:] = line
        elif kind == 1:
            out[y, 1:] = np.cumsum(line, 0) % 256
        elif kind == 2:
            out[y, 1:] = (line + out[y - 1, 1:]) % 256
        else:
            for x in range(1, w + 1):
                a, b, d = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
                near = np.abs([b - d, a - d, a + b - 2 * d])
                guess = (a + b) // 2 if kind == 3 else np.choose(near.argmin(0), [a, b, d])
                out[y, x] = (line[x - 1] + guess) % 256
    return out[1:, 1:].astype(np.uint8).reshape((h, w) if c == 1 else (h, w, c))


def palette_mask(labels: np.ndarray, tax: taxonomy.Taxonomy = taxonomy.COARSE) -> np.ndarray:
    """Labels in their colours, background transparent."""
    colors = np.zeros((256, 4), np.uint8)
    colors[: len(tax.colors), :3] = tax.colors
    colors[1 : len(tax.colors), 3] = 255
    return colors[labels]


def overlay(image: np.ndarray, labels: np.ndarray, tax: taxonomy.Taxonomy = taxonomy.COARSE, share: float = 0.45) -> np.ndarray:
    """The image under the labels' colours."""
    return np.clip((1 - share) * image + share * palette_mask(labels, tax)[..., :3] + 0.5, 0, 255).astype(np.uint8)


FORMATS: dict[str, Callable[[dict[str, Any]], str]] = {"json": to_json, "geojson": to_geojson, "svg": to_svg, "dxf": to_dxf}


def exported(documents: DataFrame, kind: str, column: str = "geometry") -> DataFrame:
    """documents with a column of that name (json, geojson, svg or dxf); null where there is no document."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; there are {sorted(FORMATS)}")
    make = FORMATS[kind]

    @F.pandas_udf("string")
    def render(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else make(from_json(t)))

    return documents.withColumn(kind, render(column))


def documents(rooms: DataFrame, walls: DataFrame, height: int, width: int) -> DataFrame:
    """(plan_id, geometry): plans as geometry documents, from rooms (plan_id, room_id, label, polygon) and walls (plan_id, wall_id, x1, y1, x2, y2, thickness).

    Elements stand in order of their ids. A plan that has only one kind has an empty list of the other; nulls of plan_id
    are passed over. A document is one value, so all of a plan's elements are put together in one place.
    """
    pair = lambda a, b: F.array(F.col(a), F.col(b))
    shape = F.transform("polygon", lambda p: F.array(p["x"], p["y"]))
    centre = S.polygon_centroid(F.col("polygon"))
    none = F.array().cast("array<array<array<double>>>")
    room = F.struct(F.col("room_id").alias("id"), "label", shape.alias("polygon"), none.alias("holes"), S.polygon_area(F.col("polygon")).alias("area_px"), F.lit(None).cast("double").alias("area_m2"), F.array(centre["x"], centre["y"]).alias("centroid"))
    wall = F.struct(F.col("wall_id").alias("id"), pair("x1", "y1").alias("p1"), pair("x2", "y2").alias("p2"), "thickness", F.lit(False).alias("exterior"))
    listed = lambda df, e, name: df.where("plan_id is not null").groupBy("plan_id").agg(F.array_sort(F.collect_list(e)).alias(name))
    both = listed(rooms, room, "rooms").join(listed(walls, wall, "walls"), "plan_id", "full")
    filled = [F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("rooms", "walls")]
    doc = F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(None).cast("double").alias("px_per_meter"), *filled, F.array().cast("array<string>").alias("openings"))
    return both.select("plan_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("geometry"))


def geojson_ring(poly: Column) -> Column:
    """array<array<double>> of a polygon, closed."""
    pts = F.transform(poly, lambda p: F.array(p["x"], p["y"]))
    return F.when(pts[0] == F.element_at(pts, -1), pts).otherwise(F.concat(pts, F.slice(pts, 1, 1)))


def room_features(rooms: DataFrame) -> DataFrame:
    """(plan_id, room_id, feature): GeoJSON features of rooms by column functions alone."""
    shape = F.struct(F.lit("Polygon").alias("type"), F.concat(F.array(geojson_ring(F.col("polygon"))), F.transform("holes", geojson_ring)).alias("coordinates"))
    own = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(F.lit("room").alias("kind"), F.col("room_id").alias("id")).alias("properties"))
    return rooms.select("plan_id", "room_id", F.to_json(own).alias("feature"))


def model_card(log: DataFrame, info: dict[str, Any]) -> DataFrame:
    """One row (card JSON): the evaluation with the largest mIoU and the whole curve, in order of iteration."""
    evals = log.where("eval is not null")
    best = F.max_by(F.struct("iter", "eval"), F.struct(F.col("eval.mIoU"), -F.col("iter"))).alias("best")
    curve = F.sort_array(F.collect_list(F.struct("iter", F.col("eval.mIoU").alias("mIoU")))).alias("curve")
    return evals.agg(best, curve).select(F.to_json(F.struct(F.lit(json.dumps(info)).alias("info"), "best", "curve")).alias("card"))
