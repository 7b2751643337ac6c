"""Grid joins against all pairs; repeated predictions; nearest points of crowded units."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlines.functions.geometry import pair_cost, seg
from chartlines.operators import filters, grid, matching, metrics

LINES = "unit long, line_id long, score double, x1 double, y1 double, x2 double, y2 double"


def lines(rng, unit, n, size=500.0, first=0):
    a = rng.uniform(0, size, (n, 2))
    b = a + rng.uniform(-30, 30, (n, 2))
    return [(unit, first + i, round(float(rng.random()), 3), *map(float, (*a[i], *b[i]))) for i in range(n)]


def some(spark, seed):
    rng = np.random.default_rng(seed)
    gt = [r for u, n in ((1, 3), (2, 400), (3, 60), (4, 0)) for r in lines(rng, u, n)]
    pred = [(u, i, s, x1 + rng.normal(), y1 + rng.normal(), x2 + rng.normal(), y2 + rng.normal()) for u, i, s, x1, y1, x2, y2 in gt] + lines(rng, 2, 50, first=1000) + lines(rng, 4, 2)
    pred += [(2, 5000, 0.5, None, 1.0, 2.0, 3.0), *pred[:3], *pred[20:25]]
    return spark.createDataFrame(pred, LINES), spark.createDataFrame(gt, LINES)


@pytest.mark.parametrize("kind,limit", [("mean_ends", 6.0), ("l2", 9.0), ("l2_swap", 9.0), ("l1", 12.0), ("ends_mae", 3.0), ("midpoint", 5.0), ("squared", 60.0)])
def test_pairs_on_the_grid_are_all_pairs(spark, kind, limit):
    pred, gt = some(spark, 1)
    got = matching.pairs(pred, gt, kind, limit).select("unit", "p", "g", "cost").collect()
    want = matching.pairs(pred, gt, lambda a, b: pair_cost(kind, a, b)).where(F.col("cost") <= limit).select("unit", "p", "g", "cost").collect()
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_nearest_truth_keeps_repeats_and_crowded_units(spark):
    pred, gt = some(spark, 2)
    got = matching.nearest_first_hit(pred, gt, 40.0)
    assert got.count() == pred.count()
    for within in (None, 40.0):
        near = matching.nearest_truth(pred, gt, within=within).where(F.col("cost") < 40).select("unit", "line_id", "g", "cost").distinct().collect()
        met = matching.pairs(pred, gt, lambda a, b: pair_cost("squared", a, b)).groupBy("unit", F.col("p").alias("line_id")).agg(F.min(F.struct("cost", "g")).alias("b"))
        want = met.select("unit", "line_id", "b.g", "b.cost").where(F.col("cost") < 40).collect()
        assert sorted(near) == sorted(want)
    # a prediction twice: the second one finds its truth taken
    one = spark.createDataFrame([(9, 0, 0.5, 0.0, 0.0, 9.0, 9.0)] * 2, LINES)
    assert sorted(r["tp"] for r in matching.nearest_first_hit(one, one.limit(1), 5.0).collect()) == [0, 1]


def test_oriented_pairs_and_junctions_on_the_grid(spark, monkeypatch):
    pred, gt = some(spark, 3)
    pred = pred.dropDuplicates(["unit", "line_id"])
    found = {}
    for crowd in (0, 10**9):
        monkeypatch.setattr(grid.met_on_grid, "__defaults__", (crowd,))
        monkeypatch.setattr(grid.near_segments, "__defaults__", (crowd,))
        monkeypatch.setattr(grid.near_rows, "__defaults__", (crowd,))
        spots = gt.select("unit", F.col("y1").alias("y"), F.col("x1").alias("x")).union(gt.select("unit", "y2", "x2"))
        ends = metrics.junction_offsets(pred, spots, 10.0).collect()
        found[crowd] = (sorted(matching.oriented_match(pred, gt).collect()), sorted(filters.near_junctions(pred, spots, 2.0).select("unit", "line_id").collect()), sorted((r["unit"], round(r["mean"], 9), round(r["std"], 9)) for r in ends))
    assert found[0] == found[10**9] and all(len(x) > 2 for x in found[0][:2])


def test_nearest_points_of_crowded_units(spark):
    rng = np.random.default_rng(4)
    point = lambda u, n, s: [(u, i, *map(float, rng.uniform(0, s, 2))) for i in range(n)]
    a, b = point(1, 5, 9) + point(2, 200, 100) + [(2, 900, 5000.0, -5000.0)] + point(3, 2, 5), point(1, 4, 9) + point(2, 300, 100) + [(5, 1, 0.0, 0.0)] + [(2, 800, 400.0, 50.0)]
    schema = "unit long, id long, x double, y double"
    got = {(r["unit"], r["i"]): r["d"] for r in grid.nearest_points(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    want = {(u, i): min(float(np.hypot(x - p, y - q)) for v, _, p, q in b if v == u) for u, i, x, y in a if any(v == u for v, *_ in b)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_unit_of_100_000_segments_meets_on_the_grid(spark):
    n = 100_000
    spot = lambda s: [(F.pmod(F.xxhash64("line_id", F.lit(s + k)), F.lit(20_000)) / 2.0).alias(c) for k, c in enumerate(("x1", "y1"))]
    gt = spark.range(n).select(F.lit(1).alias("unit"), F.col("id").alias("line_id"), F.lit(0.5).alias("score")).select("*", *spot(0)).withColumns({"x2": F.col("x1") + 20, "y2": F.col("y1") + 5})
    pred = gt.withColumns({c: F.col(c) + 0.5 for c in seg()})
    met = matching.pairs(pred, gt, "mean_ends", 4.0)
    assert met.where(F.col("p") == F.col("g")).count() == n
    # rows that share a cell, before the cost is looked at: a few for each pair, not one for every pair of the unit
    p, g = matching._sides(pred, gt, ("unit",))
    shared = grid.near_rows(p, g, grid.middle("p_"), grid.middle("g_"), grid.reach("mean_ends", 4.0), ["unit"]).count()
    assert shared <= 3 * met.count()


@pytest.mark.parametrize("samples", [16, 40])
def test_result_kinds_meet_the_mask_once(spark, samples):
    pred, gt = some(spark, 5)
    pred = pred.where("x1 is not null").dropDuplicates(["unit", "line_id"])
    mask = gt.select("unit", F.floor(F.col("y1") / 7).alias("y"), F.floor(F.col("x1") / 7).alias("x")).union(gt.select("unit", F.floor(F.col("y2") / 7), F.floor(F.col("x2") / 7)))
    got = filters.result_kinds(pred, mask, 0.3, 0.1, samples, 7.0)
    pre = filters.by_score(pred, 0.3)
    masked = filters.share_on_mask(pre, mask, samples, 7.0).where("share >= 0.1").select(pred.columns)
    want = {"pre": pre, "mask": masked, "post": filters.clip_overlaps(pre), "mask_post": filters.clip_overlaps(masked)}
    for kind, rows in want.items():
        found = sorted(got.where(F.col("kind") == kind).select(pred.columns).collect())
        assert found and found == sorted(rows.collect())
    # the mask is joined before, to a table that is kept, not once for each kind
    assert "Join" not in got._jdf.queryExecution().toString()
