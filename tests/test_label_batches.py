"""Labels of a scene are placed as they stream by, in batches that end anywhere."""

import numpy as np

from tilewright.operators import labels

SCHEMA = "scene_id long, symbol_group long, style_order int, sort_key double, seq long, family long, x0 double, y0 double, x1 double, y1 double, padding double, allow_overlap boolean, ignore_placement boolean"


def candidates(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in (None, *range(1, 9)):
        for k in range(5 * (s or 2)):
            x, y = rng.uniform(-300, 300, 2).tolist()
            w, h = rng.uniform(5, 200, 2).tolist()
            place = (None, y, None, y + h) if k == 4 else (x, y, x + w, y + h)
            rows.append((s, k, int(rng.integers(3)), [None, float("nan"), 1.0, 2.0][rng.integers(4)], k, k // 2, *place, float(k % 3), bool(rng.random() < 0.1), bool(rng.random() < 0.1)))
    return rows, spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], SCHEMA)


def test_labels_over_many_batches(spark):
    """Sort keys that are null or no number come last, and a box without a place meets nothing."""
    rows, df = candidates(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.scene_id, r.seq): r.accepted for r in labels.resolve_collisions(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, taken = {}, {}
    last = lambda v: (v is None or v != v, 0.0 if v is None or v != v else v)
    for s, _, _, _, seq, family, x0, y0, x1, y1, pad, free, passes in sorted(rows, key=lambda r: (r[0] or 0, -r[2], last(r[3]), r[4])):
        b, held = None if x0 is None else (x0 - pad, y0 - pad, x1 + pad, y1 + pad), taken.setdefault(s, [])
        want[s, seq] = ok = free or b is None or not any(f != family and t[0] < b[2] and t[2] > b[0] and t[1] < b[3] and t[3] > b[1] for t, f in held)
        if ok and not passes and b is not None:
            held.append((b, family))
    assert got == want and 0 < sum(want.values()) < len(want)


def test_scenes_take_no_call_for_each(spark):
    plan = labels.resolve_collisions(candidates(spark)[1])._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
