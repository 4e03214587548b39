"""Scenes meet the cached tiles of their sources: whole, in parts or by tiles, with the same result."""

from collections import defaultdict

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tilewright.jobs.queries import QUERIES
from tilewright.operators import tiles

SCENES = "scene_id long, lon double, lat double, zoom double, vw double, vh double, heading double, pitch double"


@pytest.fixture(scope="module")
def tables(spark):
    """A source with few tiles and one with many, scenes of any kind, some without a viewport or a place."""
    rng = np.random.default_rng(4)
    cached = {(int(s), int(z), int(rng.integers(0, 1 << z)), int(rng.integers(0, 1 << z))) for s, n in ((1, 4), (2, 40)) for z in range(7) for _ in range(n)}
    rows = [(k, float(rng.uniform(-180, 180)), float(rng.uniform(-84, 84)), float(rng.uniform(0, 7)), 512.0, 384.0, float(rng.choice([0, 45, 200])), float(rng.choice([0, 30, 55]))) for k in range(60)]
    rows += [(60, float("nan"), 0.0, 2.0, 512.0, 384.0, 0.0, 0.0), (61, 0.0, 0.0, 2.0, 0.0, 384.0, 0.0, 0.0), (62, None, 0.0, 2.0, 512.0, 384.0, 0.0, 0.0), (63, 179.9, 10.0, 0.0, 2000.0, 900.0, 0.0, 0.0), (64, 0.0, 0.0, 2.0, 512.0, 384.0, None, 0.0)]
    cache = spark.createDataFrame([*cached, (1, 3, 2, 2), (1, 3, 2, 2), (1, 25, 0, 0), (1, 2, 4, 0), (None, 1, 0, 0)], "source_id long, z int, x int, y int")
    active = spark.createDataFrame([(r[0], s) for r in rows for s in (1, 2, 3) if (r[0] + s) % 4], "scene_id long, source_id long")
    return cache, spark.createDataFrame(rows, SCENES), active


def told(df):
    return sorted((*r[:6], *[round(v, 6) for v in r[6:]]) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"most": 60}, {"least": 5}, {"most": 60, "least": 5}])
def test_instances_by_source_and_by_tile(spark, tables, how):
    cache, scenes, active = tables
    want = told(tiles.cached_instances(cache, scenes, active, most=0))
    assert len({r[1] for r in want}) == 2 and max(r[5] for r in want) > 64 and len(want) > 500
    assert told(tiles.cached_instances(cache, scenes, active, **how)) == want
    assert told(tiles.cached_instances(cache, None, active.join(scenes, "scene_id"), **how)) == want


def test_instances_are_grouped_where_they_are_made(spark):
    """Scenes are shuffled, not their tiles."""
    df = QUERIES["c12_cached_instances"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_id" in plan and "hashpartitioning(scene_id" not in plan and "Generate explode" in plan


@pytest.mark.parametrize("how", [{}, {"most": 60}, {"least": 5}, {"most": 60, "least": 5}])
def test_coverage_totals_are_those_of_the_parts(spark, tables, how):
    cache, scenes, active = tables
    parts = tiles.exclusive_coverage(tiles.cached_instances(cache, scenes, active), scenes.select("scene_id", F.floor("zoom").cast("int").alias("zoom_level")))
    want = defaultdict(lambda: [0, 0.0])
    for r in parts.collect():
        want[r.scene_id, r.source_id, r.z][0] += 1
        want[r.scene_id, r.source_id, r.z][1] += (r.right - r.left) * (r.bottom - r.top)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.scene_id, r.source_id, r.z): (r.n_parts, r.area) for r in tiles.coverage_totals(cache, scenes, active, **how).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(got) > 200
    assert all(abs(got[k][1] - v[1]) < 1e-6 * v[1] for k, v in want.items())


def test_coverage_totals_have_no_row_for_a_part(spark):
    df = QUERIES["c19_exclusive_coverage"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "SortMergeJoin" not in plan
