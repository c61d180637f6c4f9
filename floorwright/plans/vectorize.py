"""Label masks to plan geometry: one pass of kernels for each plan inside mapInPandas, typed tables out.

A plan is one row, so plans spread over all executors and no plan's pixels are ever shuffled or sent to the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorwright.functions.config import settings
from floorwright.functions.taxonomy import COARSE, Taxonomy
from floorwright.kernels import raster as R
from floorwright.kernels import vector as V


@dataclass(frozen=True)
class VectorizeConfig:
    """The published defaults. Lengths without px are in wall thicknesses."""

    min_room_area: int = 200
    min_opening_area: int = 10
    min_speckle: int = 12
    rdp_room: float = 0.35
    rdp_wall: float = 0.35
    snap_angle_deg: float = 12.0
    merge_offset: float = 0.9
    merge_gap: float = 1.2
    junction_tol: float = 1.6
    spur_len: float = 1.5
    min_wall_len: float = 1.5
    split_radius: float = 1.0
    manhattan: bool = True
    #: Pixels per metre in the space of the result.
    px_per_meter: float | None = None
    connectivity: int = 4


def _r(v: float, places: int = 2) -> float:
    return math.floor(v * 10**places + 0.5) / 10**places


def _pts(poly: list[V.Point]) -> list[list[float]]:
    return [[_r(x), _r(y)] for x, y in poly]


def _thickness(struct: np.ndarray) -> float:
    on = R.distances(struct)[R.thin(struct)]
    return float(min(max(2 * np.median(on), 2), max(4, min(struct.shape) / 8))) if len(on) else 4.0


def _segments(struct: np.ndarray, t: float, cfg: VectorizeConfig) -> list[V.Segment]:
    m = R.close(struct, max(1, int(t / 3 + 0.5)))
    dist = R.distances(m)
    h, w = m.shape
    segs = []
    for path in V.without_spurs(V.paths(R.thin(m)), cfg.spur_len * t):
        line = V.simplified([(float(x), float(y)) for y, x in path], max(1.0, cfg.rdp_wall * t))
        for a, b in zip(line, line[1:], strict=False):
            n = max(2, int(math.dist(a, b)))
            s = np.arange(n) / (n - 1)
            x, y = (np.floor(a[k] + (b[k] - a[k]) * s + 0.5).astype(int) for k in (0, 1))
            one = (*a, *b, 2 * float(np.median(dist[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)])))
            segs.append(V.snapped(one, cfg.snap_angle_deg) if cfg.manhattan else one)
    if cfg.manhattan:
        segs = V.merged(segs, cfg.merge_offset * t, cfg.merge_gap * t)
        segs = V.merged(V.closed_junctions(segs, cfg.junction_tol * t), cfg.merge_offset * t, 0.5)
    return [s for s in segs if V.length(s) >= cfg.min_wall_len * t]


def _exterior(s: V.Segment, labels: np.ndarray) -> bool:
    h, w = labels.shape
    n = V.length(s) or 1.0
    f = np.repeat([0.2, 0.35, 0.5, 0.65, 0.8], 2)
    side = np.tile([1.0, -1.0], 5) * (s[4] * 1.5 + 2)
    x = np.floor(s[0] + (s[2] - s[0]) * f - (s[3] - s[1]) / n * side + 0.5).astype(int)
    y = np.floor(s[1] + (s[3] - s[1]) * f + (s[2] - s[0]) / n * side + 0.5).astype(int)
    out = (x < 0) | (y < 0) | (x >= w) | (y >= h)
    return int((out | (labels[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)] == 0)).sum()) >= 2


def _rooms(labels: np.ndarray, t: float, cfg: VectorizeConfig, tax: Taxonomy) -> list[dict[str, Any]]:
    out: list[dict[str, Any]] = []
    for c in tax.rooms:
        own, areas = R.split_regions(labels == c, cfg.split_radius * t) if cfg.split_radius > 0 else R.components(labels == c)
        for k in np.flatnonzero(areas >= cfg.min_room_area):
            comp = own == k
            poly = V.simplified(V.contour(comp), max(1.0, cfg.rdp_room * t), closed=True)
            if len(poly) < 3:
                continue
            square = (lambda p: V.orthogonal(p, cfg.snap_angle_deg)) if cfg.manhattan else (lambda p: p)
            poly = square(poly)
            gaps, sizes = R.components(~np.pad(comp, 1), 8)
            holes = []
            for g in np.flatnonzero(sizes > 0):
                if g != gaps[0, 0]:
                    ring = V.simplified(V.contour(R.dilate(gaps == g, 1)[1:-1, 1:-1]), max(1.0, cfg.rdp_room * t), closed=True)
                    if len(ring) >= 3 and V.area(ring) > cfg.min_room_area / 2:
                        holes.append(square(ring))
            y, x = np.nonzero(comp)
            out.append({"id": len(out), "label": "room" if tax is COARSE else tax.classes[c], "polygon": _pts(poly), "holes": [_pts(q) for q in holes], "area_px": _r(V.area(poly) - sum(map(V.area, holes)), 1), "area_m2": None, "centroid": [_r(float(x.mean()), 1), _r(float(y.mean()), 1)]})
    return out


def _box(cx: float, cy: float, w: float, h: float, deg: float) -> list[list[float]]:
    a = math.radians(deg)
    ux, uy = math.cos(a), math.sin(a)
    return [[_r(cx + i * ux * w / 2 - j * uy * h / 2), _r(cy + i * uy * w / 2 + j * ux * h / 2)] for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def _host(cx: float, cy: float, walls: list[dict[str, Any]], reach: float) -> int | None:
    if not walls:
        return None
    a, b = (np.array([w[k] for w in walls], float) for k in ("p1", "p2"))
    d = b - a
    sq = (d * d).sum(1)
    u = np.clip(((np.array([cx, cy]) - a) * d).sum(1) / np.where(sq == 0, 1, sq), 0, 1)
    dist = np.hypot(*(np.array([cx, cy]) - a - u[:, None] * d).T)
    k = int(dist.argmin())
    return walls[k]["id"] if dist[k] < reach else None


def _openings(labels: np.ndarray, walls: list[dict[str, Any]], t: float, cfg: VectorizeConfig, tax: Taxonomy) -> list[dict[str, Any]]:
    out: list[dict[str, Any]] = []
    for kind, c in (("door", tax.door), ("window", tax.window)):
        own, areas = R.components(labels == c, 8)
        for k in np.flatnonzero(areas >= cfg.min_opening_area):
            y, x = np.nonzero(own == k)
            cx, cy, w, h, deg = V.least_rectangle(np.stack([x, y], 1))
            w, h = w + 1, h + 1
            if h > w:
                w, h, deg = h, w, deg + 90
            deg = (deg + 90) % 180 - 90
            if cfg.manhattan:
                deg = 0.0 if abs(deg) <= cfg.snap_angle_deg else 90.0 if abs(abs(deg) - 90) <= cfg.snap_angle_deg else deg
            out.append({"id": len(out), "kind": kind, "polygon": _box(cx, cy, w, h, deg), "center": [_r(cx), _r(cy)], "width": _r(w), "depth": _r(h), "angle": _r(deg), "wall_id": _host(cx, cy, walls, 2 * t + 2)})
    return out


def rescaled(g: dict[str, Any], sx: float, sy: float) -> dict[str, Any]:
    """The geometry document in another size; scalar lengths follow the mean of both factors."""
    s = (sx + sy) / 2
    at = lambda p: [_r(p[0] * sx), _r(p[1] * sy)]
    ring = lambda q: [at(p) for p in q]
    return g | {
        "width": int(g["width"] * sx + 0.5), "height": int(g["height"] * sy + 0.5),
        "rooms": [r | {"polygon": ring(r["polygon"]), "holes": [ring(h) for h in r["holes"]], "centroid": at(r["centroid"]), "area_px": _r(r["area_px"] * sx * sy, 1)} for r in g["rooms"]],
        "walls": [w | {"p1": at(w["p1"]), "p2": at(w["p2"]), "thickness": _r(w["thickness"] * s)} for w in g["walls"]],
        "openings": [o | {"polygon": ring(o["polygon"]), "center": at(o["center"]), "width": _r(o["width"] * s), "depth": _r(o["depth"] * s)} for o in g["openings"]],
        "meta": g["meta"] | {"wall_thickness_px": _r(g["meta"]["wall_thickness_px"] * s)},
    }


def vectorized(labels: np.ndarray, cfg: VectorizeConfig = VectorizeConfig(), tax: Taxonomy = COARSE, image_size: tuple[int, int] | None = None) -> dict[str, Any]:
    """The geometry document of a label mask (rows, columns); image_size (width, height): the space of the result."""
    labels = R.clean(np.asarray(labels), len(tax.classes), cfg.min_speckle, cfg.connectivity)
    struct = np.isin(labels, (tax.wall, tax.door, tax.window))
    t = _thickness(struct)
    walls = []
    for s in _segments(struct, t, cfg) if struct.any() else []:
        walls.append({"id": len(walls), "p1": [_r(s[0]), _r(s[1])], "p2": [_r(s[2]), _r(s[3])], "thickness": _r(max(1.0, s[4])), "exterior": _exterior(s, labels)})
    h, w = labels.shape
    g = {"width": w, "height": h, "rooms": _rooms(labels, t, cfg, tax), "walls": walls, "openings": _openings(labels, walls, t, cfg, tax), "wall_polygons": [], "px_per_meter": cfg.px_per_meter, "meta": {"wall_thickness_px": _r(t), "taxonomy": tax.name}}
    if image_size and image_size != (w, h):
        g = rescaled(g, image_size[0] / w, image_size[1] / h)
    if cfg.px_per_meter:
        for r in g["rooms"]:
            r["area_m2"] = _r(r["area_px"] / cfg.px_per_meter**2)
    return g


def summary(g: dict[str, Any]) -> dict[str, float]:
    return {"rooms": len(g["rooms"]), "walls": len(g["walls"]), "doors": sum(o["kind"] == "door" for o in g["openings"]), "windows": sum(o["kind"] == "window" for o in g["openings"]), "total_wall_length_px": _r(sum(math.dist(w["p1"], w["p2"]) for w in g["walls"]), 1), "total_room_area_px": _r(sum(r["area_px"] for r in g["rooms"]), 1)}


def vectorize(masks: DataFrame, cfg: VectorizeConfig = VectorizeConfig(), tax: Taxonomy = COARSE) -> DataFrame:
    """(plan_id, geometry JSON, error) of masks (plan_id, height, width, data: labels row by row); a bad row gets an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                try:
                    out.append((r.plan_id, json.dumps(vectorized(np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width)), cfg, tax)), None))
                except (TypeError, ValueError) as e:
                    out.append((r.plan_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["plan_id", "geometry", "error"])

    return masks.select("plan_id", "height", "width", "data").mapInPandas(run, "plan_id long, geometry string, error string")


WIRE = """width int, height int, px_per_meter double, meta map<string,string>,
rooms array<struct<id:int,label:string,polygon:array<array<double>>,holes:array<array<array<double>>>,area_px:double,area_m2:double,centroid:array<double>>>,
walls array<struct<id:int,p1:array<double>,p2:array<double>,thickness:double,exterior:boolean>>,
openings array<struct<id:int,kind:string,polygon:array<array<double>>,center:array<double>,width:double,depth:double,angle:double,wall_id:int>>"""


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """plan, room, wall and opening tables of documents (plan_id, geometry); points become struct<x,y>."""
    g = documents.where("geometry is not null").select("plan_id", F.from_json("geometry", WIRE).alias("g"))
    pt = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda q: F.transform(q, pt)
    e = lambda k: g.select("plan_id", F.explode(f"g.{k}").alias("e"))
    return {
        "plan": g.select("plan_id", "g.width", "g.height", "g.px_per_meter", "g.meta"),
        "room": e("rooms").select("plan_id", F.col("e.id").alias("room_id"), "e.label", ring("e.polygon").alias("polygon"), F.transform("e.holes", ring).alias("holes"), "e.area_px", "e.area_m2", pt(F.col("e.centroid")).alias("centroid")),
        "wall": e("walls").select("plan_id", F.col("e.id").alias("wall_id"), F.col("e.p1")[0].alias("x1"), F.col("e.p1")[1].alias("y1"), F.col("e.p2")[0].alias("x2"), F.col("e.p2")[1].alias("y2"), "e.thickness", "e.exterior"),
        "opening": e("openings").select("plan_id", F.col("e.id").alias("opening_id"), "e.kind", ring("e.polygon").alias("polygon"), F.col("e.center")[0].alias("cx"), F.col("e.center")[1].alias("cy"), "e.width", "e.depth", "e.angle", "e.wall_id"),
    }


def config(defaults: VectorizeConfig = VectorizeConfig(), values: dict[str, Any] | None = None, overrides: list[str] | None = None) -> VectorizeConfig:
    """Defaults, then values, then "key=value" as settings() reads them; unknown keys raise."""
    base = asdict(defaults)
    unknown = {*(values or {}), *(x.partition("=")[0] for x in overrides or [])} - base.keys()
    if unknown:
        raise TypeError(f"unknown settings {sorted(unknown)}; there are {sorted(base)}")
    return VectorizeConfig(**settings(base, [values or {}], overrides or []))
