"""Vector kernels: skeleton graphs, line simplification, contours, rectangles and segment merging."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

Point = tuple[float, float]
Segment = tuple[float, float, float, float, float]  # x1, y1, x2, y2, thickness


def _links(skeleton: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Neighbours (y, x) of each skeleton pixel; a diagonal one only if no straight one leads there."""
    s = np.pad(np.asarray(skeleton, bool), 1)
    out = {}
    for y, x in np.argwhere(s).tolist():
        near = []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if (dy or dx) and s[y + dy, x + dx] and not (dy and dx and (s[y + dy, x] or s[y, x + dx])):
                    near.append((y + dy - 1, x + dx - 1))
        out[y - 1, x - 1] = near
    return out


def paths(skeleton: np.ndarray) -> list[list[tuple[int, int]]]:
    """Pixel paths (y, x) between nodes (pixels without exactly two neighbours) in order of their starts, then closed loops."""
    links = _links(skeleton)
    nodes = {p for p, n in links.items() if len(n) != 2}
    used: set[frozenset] = set()
    out = []

    def follow(a, b):
        path = [a, b]
        used.add(frozenset((a, b)))
        while path[-1] not in nodes and path[-1] != a:
            here = path[-1]
            onward = [n for n in links[here] if n != path[-2] and frozenset((here, n)) not in used]
            if not onward:
                break
            used.add(frozenset((here, onward[0])))
            path.append(onward[0])
        return path

    for starts in (sorted(nodes), sorted(links.keys() - nodes)):
        for a in starts:
            for b in links[a]:
                if frozenset((a, b)) not in used:
                    out.append(follow(a, b))
    return out


def without_spurs(found: list[list[tuple[int, int]]], least: float) -> list[list[tuple[int, int]]]:
    """Paths without those shorter than least (in pixels) that have a free end, unless it is the only one."""
    ends = Counter(e for p in found for e in (p[0], p[-1]))
    free = lambda p: ends[p[0]] == 1 or ends[p[-1]] == 1
    return [p for p in found if not (free(p) and len(p) < least and len(found) > 1)]


def simplified(points: list[Point], eps: float, closed: bool = False) -> list[Point]:
    """Points that a line within eps needs (Douglas and Peucker); a closed one is cut at the point farthest from its first."""
    if len(points) < 3:
        return list(points)
    p = np.asarray(points, float)
    if closed:
        far = int(((p - p[0]) ** 2).sum(1).argmax())
        a = simplified(points[: far + 1], eps)
        b = simplified([*points[far:], points[0]], eps)
        return a[:-1] + b[:-1]
    keep = {0, len(p) - 1}
    todo = [(0, len(p) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d = p[j] - p[i]
        off = np.abs(d[1] * (p[i + 1 : j, 0] - p[i, 0]) - d[0] * (p[i + 1 : j, 1] - p[i, 1])) / (math.hypot(*d) or 1e-9)
        k = int(off.argmax())
        if off[k] > eps:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return [points[k] for k in sorted(keep)]


def contour(mask: np.ndarray) -> list[Point]:
    """Outer boundary pixels (x, y) of the component that holds the first pixel in raster order, clockwise on the screen."""
    m = np.pad(np.asarray(mask, bool), 1)
    found = np.argwhere(m)
    if not len(found):
        return []
    sy, sx = (int(v) for v in found[0])
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]  # (dy, dx) clockwise from west
    y, x, back, out, second = sy, sx, 0, [], None
    for _ in range(4 * m.size):
        for i in range(1, 9):
            d = (back + i) % 8
            ny, nx = y + around[d][0], x + around[d][1]
            if m[ny, nx]:
                break
        else:
            return [(sx - 1.0, sy - 1.0)]
        if (y, x) == (sy, sx) and second == (ny, nx):
            return out
        second = second or (ny, nx)
        out.append((x - 1.0, y - 1.0))
        before = around[(d - 1) % 8]
        back = around.index((y + before[0] - ny, x + before[1] - nx))
        y, x = ny, nx
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by two sweeps over the sorted points."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def sweep(rows):
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(sweep(p) + sweep(p[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """(cx, cy, w, h, degrees) of the least rectangle around the points that has a hull edge on a side."""
    p = hull(points)
    if len(p) == 1:
        return float(p[0, 0]), float(p[0, 1]), 0.0, 0.0, 0.0
    edge = np.roll(p, -1, 0) - p
    angle = np.arctan2(edge[:, 1], edge[:, 0])[: 1 if len(p) == 2 else None]
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    u, v = p[:, 0] * c + p[:, 1] * s, -p[:, 0] * s + p[:, 1] * c
    w, h = np.ptp(u, axis=1), np.ptp(v, axis=1)
    best = 0
    for k in range(1, len(angle)):
        if w[k] * h[k] < w[best] * h[best] - 1e-9:
            best = k
    mu, mv = (u[best].min() + u[best].max()) / 2, (v[best].min() + v[best].max()) / 2
    cc, ss = float(c[best, 0]), float(s[best, 0])
    return mu * cc - mv * ss, mu * ss + mv * cc, float(w[best]), float(h[best]), math.degrees(angle[best])


def area(poly: list[Point]) -> float:
    p = np.asarray(poly, float)
    q = np.roll(p, -1, 0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2


def _axis(a: Point, b: Point, degrees: float) -> str:
    turn = abs(math.degrees(math.atan2(b[1] - a[1], b[0] - a[0]))) % 180
    return "H" if min(turn, 180 - turn) <= degrees else "V" if abs(turn - 90) <= degrees else "D"


def orthogonal(poly: list[Point], degrees: float) -> list[Point]:
    """The polygon with edges near an axis laid on it; polygons of fewer than four vertices stay."""
    if len(poly) < 4:
        return list(poly)
    kinds = [_axis(p, poly[(i + 1) % len(poly)], degrees) for i, p in enumerate(poly)]
    corners = [p for i, p in enumerate(poly) if kinds[i] == "D" or kinds[i - 1] != kinds[i]]
    if len(corners) < 3:
        return list(poly)
    n = len(corners)
    edges = [(corners[i], corners[(i + 1) % n]) for i in range(n)]
    kinds = [_axis(a, b, degrees) for a, b in edges]
    out: list[Point] = []
    for i, (x, y) in enumerate(corners):
        for j in (i - 1, i):
            (ax, ay), (bx, by) = edges[j]
            if kinds[j] == "H":
                y = (ay + by) / 2
            elif kinds[j] == "V":
                x = (ax + bx) / 2
        if not out or math.dist(out[-1], (x, y)) > 1e-6:
            out.append((x, y))
    if len(out) > 2 and math.dist(out[0], out[-1]) < 1e-6:
        out.pop()
    return out


def snapped(s: Segment, degrees: float) -> Segment:
    x1, y1, x2, y2, t = s
    kind = _axis((x1, y1), (x2, y2), degrees)
    if kind == "H":
        return min(x1, x2), (y1 + y2) / 2, max(x1, x2), (y1 + y2) / 2, t
    if kind == "V":
        return (x1 + x2) / 2, min(y1, y2), (x1 + x2) / 2, max(y1, y2), t
    return s


def _kind(s: Segment) -> str:
    dx, dy = abs(s[2] - s[0]), abs(s[3] - s[1])
    return "H" if dy < 1e-6 < dx or dy < 1e-6 and dx > 0 else "V" if dx < 1e-6 and dy > 0 else "D"


def length(s: Segment) -> float:
    return math.hypot(s[2] - s[0], s[3] - s[1])


def merged(segs: list[Segment], offset: float, gap: float) -> list[Segment]:
    """Collinear segments merged: clusters by a running length-weighted mean of the fixed coordinate, then spans over gaps."""
    out: list[Segment] = []
    for kind, f, lo, hi in (("H", 1, 0, 2), ("V", 0, 1, 3)):
        own = sorted((s for s in segs if _kind(s) == kind), key=lambda s: s[f])
        clusters: list[list[Segment]] = []
        weight = moment = 0.0
        for s in own:
            if clusters and abs(s[f] - moment / max(weight, 1e-6)) <= offset:
                clusters[-1].append(s)
            else:
                clusters.append([s])
                weight = moment = 0.0
            weight += length(s)
            moment += s[f] * length(s)
        for cluster in clusters:
            runs: list[list[Segment]] = []
            reach = -math.inf
            for s in sorted(cluster, key=lambda s: s[lo]):
                if s[lo] > reach + gap:
                    runs.append([])
                    reach = s[hi]
                runs[-1].append(s)
                reach = max(reach, s[hi])
            for run in runs:
                w = sum(map(length, run)) or 1.0
                c, t = (sum(s[k] * length(s) for s in run) / w for k in (f, 4))
                a, b = min(s[lo] for s in run), max(s[hi] for s in run)
                out.append((a, c, b, c, t) if kind == "H" else (c, a, c, b, t))
    return out + [s for s in segs if _kind(s) == "D"]


def closed_junctions(segs: list[Segment], tol: float, rounds: int = 2) -> list[Segment]:
    """Ends moved onto crossing segments nearer than tol: lying ones, then standing ones, in rounds; then oblique ends."""
    groups = {k: np.array([s for s in segs if _kind(s) == k], float).reshape(-1, 5) for k in "HVD"}

    def close(own: np.ndarray, other: np.ndarray, lo: int, hi: int, f: int) -> None:
        if not len(own) or not len(other):
            return
        for end in (lo, hi):
            within = (other[None, :, f] - tol <= own[:, None, f]) & (own[:, None, f] <= other[None, :, f + 2] + tol)
            d = np.where(within, np.abs(other[None, :, lo] - own[:, None, end]), np.inf)
            k = d.argmin(1)
            near = d[np.arange(len(own)), k] < tol
            own[near, end] = other[k[near], lo]

    for _ in range(rounds):
        close(groups["H"], groups["V"], 0, 2, 1)
        close(groups["V"], groups["H"], 1, 3, 0)
    ends = np.concatenate([groups["H"], groups["V"]])[:, :4].reshape(-1, 2)
    for s in groups["D"]:
        for k in (0, 2):
            if len(ends):
                d = np.hypot(ends[:, 0] - s[k], ends[:, 1] - s[k + 1])
                if d.min() < tol:
                    s[k : k + 2] = ends[d.argmin()]
    return [s for k in "HVD" for s in map(tuple, groups[k].tolist()) if length(s) > 0]
