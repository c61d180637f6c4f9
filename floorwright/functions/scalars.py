"""Column functions of geometry: lengths, angles, polygons, transforms and rounding. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def half_up(v: Column | str, places: int = 2) -> Column:
    """Rounds halves up, by the same floating point steps in every engine."""
    scale = float(10**places)
    return F.floor(_c(v) * scale + 0.5) / scale


def length(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    return F.sqrt(dx * dx + dy * dy)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point to a segment; one without length counts as its first end."""
    px, py, x1, y1, x2, y2 = map(_c, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    sq = dx * dx + dy * dy
    u = F.when(sq == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.when(sq == 0, 1.0).otherwise(sq))))
    return length(px, py, x1 + u * dx, y1 + u * dy)


def axis_of(x1, y1, x2, y2, degrees: float) -> Column:
    """H, V or D of a direction, within so many degrees of an axis."""
    angle = F.abs(F.degrees(F.atan2(_c(y2) - _c(y1), _c(x2) - _c(x1)))) % 180.0
    return F.when(F.least(angle, 180.0 - angle) <= degrees, "H").when(F.abs(angle - 90.0) <= degrees, "V").otherwise("D")


def segment_kind(x1, y1, x2, y2) -> Column:
    """H, V or D of a segment that is axis-parallel to 1e-6 and not a point."""
    dx, dy = F.abs(_c(x2) - _c(x1)), F.abs(_c(y2) - _c(y1))
    return F.when((dy < 1e-6) & (dx > 0), "H").when((dx < 1e-6) & (dy > 0), "V").otherwise("D")


def snapped(x1, y1, x2, y2, degrees: float) -> Column:
    """struct(x1, y1, x2, y2): the segment laid on the axis it is close to, its lesser end first; else as it is."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    kind = axis_of(x1, y1, x2, y2, degrees)
    my, mx = (y1 + y2) / 2, (x1 + x2) / 2
    make = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    return F.when(kind == "H", make(F.least(x1, x2), my, F.greatest(x1, x2), my)).when(kind == "V", make(mx, F.least(y1, y2), mx, F.greatest(y1, y2))).otherwise(make(x1, y1, x2, y2))


def normal_angle(degrees) -> Column:
    """An angle in [-90, 90)."""
    return F.pmod(_c(degrees) + 90.0, F.lit(180.0)) - 90.0


def long_side_first(w, h, angle) -> Column:
    """struct(width, depth, angle) with pixel extents (+1), the longer side as width."""
    w, h, a = _c(w) + 1, _c(h) + 1, _c(angle)
    return F.struct(F.greatest(w, h).alias("width"), F.least(w, h).alias("depth"), normal_angle(F.when(h > w, a + 90.0).otherwise(a)).alias("angle"))


def box_corners(cx, cy, w, h, degrees) -> Column:
    """The four corners of a turned rectangle, to two places."""
    cx, cy, hw, hh, a = _c(cx), _c(cy), _c(w) / 2, _c(h) / 2, F.radians(_c(degrees))
    ux, uy = F.cos(a), F.sin(a)
    corner = lambda s, t: F.struct(half_up(cx + s * ux * hw - t * uy * hh).alias("x"), half_up(cy + s * uy * hw + t * ux * hh).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def _next(poly: Column, i: Column) -> Column:
    return F.get(poly, (i + 1) % F.size(poly))


def _cross(poly: Column) -> Column:
    """For each edge its part of twice the signed area."""
    return F.transform(poly, lambda p, i: p["x"] * _next(poly, i)["y"] - _next(poly, i)["x"] * p["y"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def polygon_area(poly: Column, holes: Column | None = None) -> Column:
    """Area of array<struct<x,y>>; holes, if given, are taken out."""
    own = F.abs(_total(_cross(poly))) / 2
    return own if holes is None else own - _total(F.transform(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), lambda h: F.abs(_total(_cross(h))) / 2))


def polygon_centroid(poly: Column) -> Column:
    """Area-weighted centre to two places; of a polygon without area the first vertex."""
    twice = _total(_cross(poly))
    part = lambda k: _total(F.transform(poly, lambda p, i: (p[k] + _next(poly, i)[k]) * (p["x"] * _next(poly, i)["y"] - _next(poly, i)["x"] * p["y"])))
    flat = F.abs(twice) < 1e-9
    at = lambda k: F.when(flat, poly[0][k]).otherwise(half_up(part(k) / (3.0 * F.when(flat, 1.0).otherwise(twice))))
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def without_repeats(poly: Column, eps: float = 1e-6) -> Column:
    """Vertices closer than eps to the one before are left out, a last one on the first too."""
    apart = lambda p, q: length(p["x"], p["y"], q["x"], q["y"]) > eps
    kept = F.aggregate(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1), lambda a, p: F.when(apart(F.element_at(a, -1), p), F.concat(a, F.array(p))).otherwise(a))
    return F.when((F.size(kept) > 2) & ~apart(kept[0], F.element_at(kept, -1)), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)


def moved(poly: Column, sx=1.0, sy=1.0, dx=0.0, dy=0.0, places: int | None = 2) -> Column:
    """All points times (sx, sy) plus (dx, dy)."""
    to = (lambda v: half_up(v, places)) if places is not None else (lambda v: v)
    return F.transform(poly, lambda p: F.struct(to(p["x"] * _c(sx) + _c(dx)).alias("x"), to(p["y"] * _c(sy) + _c(dy)).alias("y")))


def square_metres(area, px_per_meter) -> Column:
    """Area in m2 to two places; null without a positive scale."""
    s = _c(px_per_meter)
    return F.when(s > 0, half_up(_c(area) / (s * s)))


def calibrated(wall_length, metres) -> Column:
    """Pixels per metre from a wall of known length; null unless both are positive."""
    return F.when((_c(metres) > 0) & (_c(wall_length) > 0), _c(wall_length) / _c(metres))


def shown_length(px, px_per_meter) -> Column:
    s = _c(px_per_meter)
    return F.when(s > 0, F.format_string("%.2f m", _c(px) / s)).otherwise(F.format_string("%.0f px", _c(px)))


def shown_area(px, px_per_meter) -> Column:
    s = _c(px_per_meter)
    return F.when(s > 0, F.format_string("%.2f m²", _c(px) / (s * s))).otherwise(F.format_string("%.0f px²", _c(px)))


def points(text: Column) -> Column:
    """array<struct<x,y>> of a points list; an odd last number is dropped, fewer than six numbers give none."""
    n = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda i: F.struct(F.get(n, 2 * i).cast("double").alias("x"), F.get(n, 2 * i + 1).cast("double").alias("y")))
    return F.when(F.size(n) >= 6, pairs).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


_AFFINE = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"


def _matrix(a, b, c, d, e, f) -> Column:
    return F.struct(*[_c(v).cast("double").alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def product(m: Column, n: Column) -> Column:
    """First n, then m, as affine maps x' = a x + c y + e, y' = b x + d y + f."""
    return _matrix(m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"], m["a"] * n["c"] + m["c"] * n["d"], m["b"] * n["c"] + m["d"] * n["d"], m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"])


def affine(text: Column) -> Column:
    """The map of a transform list (matrix, translate, scale, rotate, skewX, skewY); null and empty give the identity."""
    step = r"(matrix|translate|scale|rotate|skewX|skewY)\s*\(([^)]*)\)"
    text = F.coalesce(text, F.lit(""))
    names, args = F.regexp_extract_all(text, F.lit(step), 1), F.regexp_extract_all(text, F.lit(step), 2)

    def one(name: Column, arg: Column) -> Column:
        v = F.regexp_extract_all(arg, F.lit(f"({NUMBER})"), 1)
        at = lambda i, other: F.coalesce(F.get(v, F.lit(i)).cast("double"), other if isinstance(other, Column) else F.lit(float(other)))
        r = F.radians(at(0, 0))
        turn = _matrix(F.cos(r), F.sin(r), -F.sin(r), F.cos(r), at(1, 0) - F.cos(r) * at(1, 0) + F.sin(r) * at(2, 0), at(2, 0) - F.sin(r) * at(1, 0) - F.cos(r) * at(2, 0))
        return (
            F.when(name == "matrix", _matrix(*[at(i, d) for i, d in enumerate((1, 0, 0, 1, 0, 0))]))
            .when(name == "translate", _matrix(1, 0, 0, 1, at(0, 0), at(1, 0)))
            .when(name == "scale", _matrix(at(0, 1), 0, 0, at(1, at(0, 1)), 0, 0))
            .when(name == "rotate", turn)
            .when(name == "skewX", _matrix(1, 0, F.tan(r), 1, 0, 0))
            .otherwise(_matrix(1, F.tan(r), 0, 1, 0, 0))
        )

    return F.aggregate(F.zip_with(names, args, one), _matrix(1, 0, 0, 1, 0, 0), product)


def applied(m: Column, poly: Column) -> Column:
    """All points under an affine map."""
    return F.transform(poly, lambda p: F.struct((m["a"] * p["x"] + m["c"] * p["y"] + m["e"]).alias("x"), (m["b"] * p["x"] + m["d"] * p["y"] + m["f"]).alias("y")))


def local_name(tag: Column) -> Column:
    """A tag without its namespace."""
    return F.substring_index(tag, "}", -1)


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def long_side(width, height, most: float, grow: bool = False) -> Column:
    """struct(width, height, scale) after scaling so that the longer side is at most `most` (grow: exactly), 1 px at least."""
    w, h = _c(width).cast("double"), _c(height).cast("double")
    s = F.lit(float(most)) / F.greatest(w, h)
    s = s if grow else F.least(F.lit(1.0), s)
    side = lambda v: F.greatest(F.lit(1), F.floor(v * s + 0.5).cast("int"))
    return F.struct(side(w).alias("width"), side(h).alias("height"), s.alias("scale"))


def padded(side, multiple: int = 32) -> Column:
    """A side filled up to a multiple."""
    return (F.ceil(_c(side) / multiple) * multiple).cast("int")
