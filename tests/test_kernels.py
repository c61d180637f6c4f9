import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from floorwright.kernels import raster as R
from floorwright.kernels import vector as V
from floorwright.plans import vectorize
from floorwright.sources import exports, generate

masks = arrays(bool, st.tuples(st.integers(1, 9), st.integers(1, 9)))


def test_components_that_touch_at_corners():
    """A board of single squares is as many pieces as squares by sides and one by corners."""
    board = np.indices((6, 7)).sum(0) % 2 == 0
    assert len(R.components(board, 4)[1]) - 1 == board.sum()
    assert len(R.components(board, 8)[1]) - 1 == 1


@settings(max_examples=60, deadline=None)
@given(masks, st.sampled_from([4, 8]))
def test_components_against_flood_fill(m, connectivity):
    labels, areas = R.components(m, connectivity)
    seen = np.zeros(m.shape, int)
    n = 0
    for y, x in np.argwhere(m):
        if seen[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        seen[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (connectivity == 8 or not (dy and dx)) and 0 <= a + dy < m.shape[0] and 0 <= b + dx < m.shape[1] and m[a + dy, b + dx] and not seen[a + dy, b + dx]:
                        seen[a + dy, b + dx] = n
                        todo.append((a + dy, b + dx))
    assert (labels == seen).all()
    assert areas.sum() == m.sum()


@settings(max_examples=60, deadline=None)
@given(masks)
def test_distances_against_all_pairs(m):
    p = np.pad(m, 1)
    off = np.argwhere(~p)
    want = [min(math.dist(q + 1, o) for o in off) if m[tuple(q)] else 0 for q in np.argwhere(np.ones_like(m))]
    assert np.allclose(R.distances(m).ravel(), want)


def test_clean_keeps_what_is_large():
    """A bar of eight pixels stays, a pair and a corner pixel are filled from what is around."""
    a = np.zeros((12, 15), np.uint8)
    a[:, 9:] = 2
    a[5, 0:8] = 3
    a[2, 11:13], a[11, 14] = 1, 3
    out = R.clean(a, 4, 5)
    want = a.copy()
    want[2, 11:13] = want[11, 14] = 2
    assert (out == want).all()


@settings(max_examples=40, deadline=None)
@given(arrays(np.uint8, (7, 8), elements=st.integers(0, 3)), arrays(bool, (7, 8)))
def test_nearest_fill(values, some):
    holes = some
    out = R.nearest_fill(values, holes)
    assert (out[~holes] == values[~holes]).all()
    kept = np.argwhere(~holes)
    for y, x in np.argwhere(holes) if len(kept) else []:
        d = ((kept - (y, x)) ** 2).sum(1)
        assert out[y, x] in {values[tuple(k)] for k in kept[d == d.min()]}


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 9), st.integers(2, 9), st.integers(0, 4), st.integers(0, 4))
def test_contour_of_any_block(h, w, top, left):
    m = np.zeros((top + h + 1, left + w + 2), bool)
    m[top : top + h, left : left + w] = True
    poly = V.simplified(V.contour(m), 0.5, closed=True)
    assert set(map(tuple, poly)) == {(left, top), (left + w - 1, top), (left + w - 1, top + h - 1), (left, top + h - 1)}
    assert V.area(poly) == (w - 1) * (h - 1)


@settings(max_examples=30, deadline=None)
@given(st.floats(-80, 80), st.integers(4, 12), st.integers(1, 3))
def test_least_rectangle_holds_its_points(angle, long, short):
    x, y = np.meshgrid(np.linspace(-long, long, 9), np.linspace(-short, short, 5))
    a = math.radians(angle)
    p = np.stack([7 + x.ravel() * math.cos(a) - y.ravel() * math.sin(a), -3 + x.ravel() * math.sin(a) + y.ravel() * math.cos(a)], 1)
    cx, cy, w, h, _ = V.least_rectangle(p)
    assert (cx, cy) == pytest.approx((7, -3), abs=0.01)
    assert sorted((w, h)) == pytest.approx([2 * short, 2 * long], abs=0.01)


def test_skeleton_paths_of_a_comb():
    """A back with four teeth: three stretches of the back between teeth, and each tooth, the outer two with the back's ends."""
    m = np.zeros((14, 33), bool)
    m[1, 1:32] = True
    for x in (5, 12, 19, 26):
        m[1:12, x] = True
    assert len(V.paths(m)) == 9
    assert len(V.paths(np.zeros((4, 4), bool))) == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(20, 60), st.integers(20, 60), st.lists(st.integers(-2, 2), min_size=8, max_size=8))
def test_orthogonal_of_a_shaken_rectangle(w, h, off):
    ring = [(0 + off[0], 0 + off[1]), (w + off[2], 0 + off[3]), (w + off[4], h + off[5]), (0 + off[6], h + off[7])]
    out = V.orthogonal(ring, 15)
    assert len(out) == 4
    assert all(a[0] == b[0] or a[1] == b[1] for a, b in zip(out, out[1:] + out[:1], strict=True))


def test_merged_and_closed():
    segs = [(0, 0, 10, 0, 4), (11, 0.5, 20, 0.5, 4), (22, 3, 22, 30, 4)]
    flat = V.merged(segs, 1, 2)
    assert [round(v, 2) for v in flat[0]] == [0, 0.24, 20, 0.24, 4]
    closed = V.closed_junctions(flat, 4)
    assert closed[0][2] == 22
    assert closed[1][1] == pytest.approx(0.24, abs=0.01)


def _flat():
    """A flat drawn by hand: two rooms, a wall of 6 px around and one of 4 px between, a door in it and a window in the outer one."""
    m = np.zeros((120, 200), np.uint8)
    m[10:110, 10:190] = 1
    m[16:104, 16:98] = m[16:104, 102:184] = 2
    m[50:66, 98:102] = 3
    m[30:60, 10:16] = 4
    return m


def test_flat_drawn_by_hand():
    g = vectorize.vectorized(_flat())
    assert sorted(round(r["area_px"], -2) for r in g["rooms"]) == pytest.approx([82 * 88, 82 * 88], rel=0.05)
    door, window = (next(o for o in g["openings"] if o["kind"] == k) for k in ("door", "window"))
    assert len(g["openings"]) == 2
    assert (door["center"][0], door["center"][1]) == pytest.approx((99.5, 57.5), abs=2)
    assert (window["center"][0], window["center"][1]) == pytest.approx((12.5, 44.5), abs=2)
    assert (door["width"], window["width"]) == pytest.approx((16, 30), abs=2)
    walls = {w["id"]: w for w in g["walls"]}
    assert walls[window["wall_id"]]["exterior"] and not walls[door["wall_id"]]["exterior"]


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 200))
def test_every_room_of_a_plan_is_found(seed):
    mask = generate.plan_mask(seed, 160)
    g = vectorize.vectorized(mask)
    large = [a for a in R.components(mask == 2)[1][1:] if a >= 100]
    assert len(g["rooms"]) == len(large)
    assert {o["kind"] for o in g["openings"]} <= {"door", "window"}
    wide = vectorize.rescaled(g, 3, 1)
    assert [r["area_px"] for r in wide["rooms"]] == pytest.approx([3 * r["area_px"] for r in g["rooms"]], rel=0.001)


def test_exports():
    g = vectorize.vectorized(generate.plan_mask(1, 256))
    assert exports.from_json(exports.to_json(g)) == g
    assert len(json.loads(exports.to_geojson(g))["features"]) == len(g["rooms"]) + len(g["walls"]) + len(g["openings"])
    assert exports.to_svg(g).startswith("<svg")
    assert len(exports.to_dxf(g)) > 1000
    with pytest.raises(ValueError):
        exports.from_json("{}")


def test_empty_and_blank_masks():
    for a in (np.zeros((20, 30), np.uint8), np.ones((3, 3), np.uint8), np.full((5, 5), 3, np.uint8)):
        assert vectorize.vectorized(a)["width"] == a.shape[1]
