"""What larger tables showed: no table of rows that were made from others goes through the driver."""

from pathlib import Path

import numpy as np
import pytest

from floorwright.operators import scanlines
from floorwright.plans import catalog
from floorwright.sources import readers

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["pair_iou", "match_rooms", "exact_count_rate", "uneven_matches", "edge_sides", "exterior_walls"])
def test_exploded_rows_are_not_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rasters_are_painted_by_runs(spark):
    """Overlapping, oblique and level sides, some of them outside; polygons are dealt out once, and no pixel becomes a row."""
    at = np.random.default_rng(5).integers(-6, 30, (60, 5, 2)).astype(float)
    at[::7, 1, 1] = at[::7, 0, 1]
    kinds = [("room", "Kitchen"), ("wall", "External"), ("door", "Sliding"), ("window", "Fixed"), ("railing", "")]
    rows = [(i // 6, i % 6, *kinds[i % 5], [tuple(map(float, p)) for p in corners]) for i, corners in enumerate(at)]
    df = spark.createDataFrame(rows, "plan_id long, ordinal int, kind string, subtype string, points array<struct<x:double,y:double>>")
    own = readers.paint(df, 20, 24, "cubicasa12")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")
    want = scanlines.rasters(readers.painted_pixels(df, 20, 24, "cubicasa12"), 20, 24, "value")
    assert {r.plan_id: bytes(r.data) for r in own.collect()} == {r.plan_id: bytes(r.data) for r in want.collect()}
