"""Work on many units of a batch at once gives what work on one after another gives."""

from __future__ import annotations

import numpy as np
import pandas as pd

from chartlines.operators import _numpy as N

LINES = "unit long, image_id long, category string, crop_id int, line_id long, x1 double, y1 double, x2 double, y2 double, score double"


def test_stitching_takes_the_nearest_free_line_in_small_and_large_crops():  # F25, F33
    rng = np.random.default_rng(1)
    for n in (5, 90):
        points = rng.integers(0, 12, (n, 2)).astype(float)
        ends = [tuple(e) for e in rng.integers(0, 12, (n, 2)).astype(float)]
        points[1] = np.nan
        listed = N.take_free_points([tuple(p) for p in points], ends, 4.0)
        assert listed == N.take_free_points(points, ends, 4.0) and len(listed) == len({j for _, j in listed}) and 1 not in {j for _, j in listed}
        free = set(range(n))
        for p, j in listed:
            gap = ((points - ends[p]) ** 2).sum(1)
            assert j == min((k for k in free if gap[k] <= 16), key=lambda k: (gap[k], k))
            free.discard(j)
        starts, stops = points[:, 0], [e[0] for e in ends] * 2
        few, many = N.take_nearest(starts.tolist(), stops, 1), N.take_nearest(starts, stops, 1)
        assert few == many and [ok for _, ok, _ in few] == [True] * (n - 1) + [False] * (n + 1)


def test_a_line_without_coordinates_is_not_stitched(spark):  # F25, F33
    from chartlines.operators import joins

    rows = [(k, 1, "A", k, i, 0.0, y, 5.0, y, 1.0) for k, i, y in ((0, 0, 1.0), (1, 0, None), (1, 1, 3.0))]
    df = spark.createDataFrame(rows, LINES)
    assert [(r["crop_id"], r["y1"], r["match_ok"]) for r in joins.stitch_with_limit(df, 5.0).orderBy("crop_id").collect()] == [(0, 1.0, True), (1, 3.0, True)]
    assert sorted((r["path_id"], r["step"], r["y1"]) for r in joins.stitch_global(df.where("y1 is not null"), 5.5).collect()) == [(0, 0, 1.0), (0, 1, 3.0)]
    assert joins.stitch_global(df, 5.0).count() == 3


def test_few_rows_are_matched_as_many_are():  # F35, F39
    rng = np.random.default_rng(2)
    for _ in range(300):
        cost = rng.integers(0, 6, rng.integers(1, 8, 2)).astype(float)
        few = cost if cost.shape[0] <= cost.shape[1] else cost.T
        a, b = N._paths(few), N._paths_of_few(few.tolist())
        assert all(np.array_equal(np.asarray(x), np.asarray(y)) for x, y in zip(a, b))
        assert N.optimal_few(cost.tolist()) == N.optimal_pairs(cost)


def test_a_line_without_coordinates_ends_the_matching_and_has_no_partner(spark):  # F35, F39
    from chartlines.operators import matching

    pred = spark.createDataFrame([(1, 1, "A", 0, i, x, x, x, x, 1.0) for i, x in enumerate((0.0, None, 5.0))], LINES)
    gt = spark.createDataFrame([(1, 1, "A", 0, i, x, x, x, x, 1.0) for i, x in enumerate((5.0, 0.0, 9.0))], LINES)
    assert sorted((r["p"], r["g"]) for r in matching.optimal_match(pred, gt).collect()) == [(0, 1), (2, 0)]


def test_suppression_of_many_units_at_once_is_that_of_each(monkeypatch):  # F34, F36
    rng = np.random.default_rng(3)
    units = np.repeat(np.arange(40), rng.integers(1, 9, 40))
    lines, scores = rng.integers(0, 6, (len(units), 4)).astype(float), rng.integers(0, 3, len(units)) / 3
    for drops in (N.nearer(lines, 3.0), N.collinear(lines, 30.0, 3.0, 0.5)):
        kept = []
        for u in np.unique(units):
            left = [int(i) for i in sorted(np.flatnonzero(units == u), key=lambda i: (-scores[i], i))]
            while left:
                kept.append(left[0])
                gone = drops(np.full(len(left) - 1, left[0]), np.array(left[1:], np.int64))
                left = [i for i, g in zip(left[1:], gone) if not g]
        for pairs in (1 << 18, 20, 1):
            monkeypatch.setattr(N, "PAIRS", pairs)
            assert N.kept_of(units, scores, drops).tolist() == sorted(kept)


class _State:
    """State of one key that counts its calls."""

    def __init__(self):
        self.lists, self.values, self.timers, self.calls = {}, {}, set(), 0

    def getListState(self, name, _):
        rows = self.lists.setdefault(name, [])
        return type("L", (), {"appendList": lambda _s, x: self._call(rows.extend, x), "get": lambda _s: iter(list(rows)), "clear": lambda _s: rows.clear()})()

    def getValueState(self, name, _):
        v = self.values
        return type("V", (), {"exists": lambda _s: name in v, "get": lambda _s: v[name], "update": lambda _s, x: v.__setitem__(name, x), "clear": lambda _s: v.pop(name, None)})()

    def _call(self, do, *args):
        self.calls += 1
        do(*args)

    def registerTimer(self, at):
        self._call(self.timers.add, at)

    def deleteTimer(self, at):
        self._call(self.timers.discard, at)


def test_a_bucket_holds_many_units_and_hands_on_those_that_are_whole():  # F18
    from types import SimpleNamespace

    from chartlines.streaming.incremental import WholeUnits

    state = _State()
    held = WholeUnits(["_bucket", "_ms", "unit", "line_id", "ts"], ["unit", "line_id"], "unit", 30)
    held.init(state)
    arrive = lambda rows: held.handleInputRows((0,), iter([pd.DataFrame([(0, ms, u, i, None) for u, i, ms in rows])]), None)
    arrive([(u, 0, 100 + u) for u in range(1000)])
    arrive([(5, 1, 5000), (2000, 0, 90)])
    assert state.calls < 10 and state.timers == {120}

    def fire(watermark):
        state.timers = {t for t in state.timers if t > watermark}
        out = list(held.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), None))
        return {(r.unit, r.line_id) for f in out for r in f.itertuples()}

    assert fire(500) == {(2000, 0)} | {(u, 0) for u in range(371) if u != 5} and state.timers == {501}
    assert fire(9000) == {(5, 0), (5, 1)} | {(u, 0) for u in range(371, 1000)} and not state.timers and not state.lists["rows"] and not state.values


def test_sampled_gaps_hold_few_points_at_a_time_and_are_worked_out_once(spark, monkeypatch):  # F32, F40
    from chartlines.operators import matching

    rows = np.concatenate([np.random.default_rng(4).uniform(0, 90, (60, 8)), [[1, 1, 1, 1, 4, 5, 4, 5]]])
    whole = N.least_sampled_gaps(rows, 3.0, 5, 200)
    at = lambda r: [r[:2] + (r[2:] - r[:2]) * t for t in (np.linspace(0, 1, int(np.clip(np.ceil(np.hypot(*(r[2:] - r[:2])) / 3), 5, 200))) if np.hypot(*(r[2:] - r[:2])) > 0 else [0.0])]
    assert np.allclose(whole, [min(np.hypot(*(p - q)) for p in at(r[:4]) for q in at(r[4:])) for r in rows])
    monkeypatch.setattr(N, "BLOCK_POINTS", 7)
    assert np.array_equal(N.least_sampled_gaps(rows, 3.0, 5, 200), whole)
    pred = spark.createDataFrame([(1, 1, "A", 0, i, x, x, x, x, 1.0) for i, x in enumerate((0.0, None, 5.0))], LINES)
    found = matching.nearest_first_hit(pred, pred.drop("score"), 3.0, matching.sampled_cost)
    assert sorted((r["line_id"], r["tp"]) for r in found.collect()) == [(0, 1), (1, 0), (2, 1)]
    usual = found._jdf.queryExecution().optimizedPlan().toString()
    assert usual.count("ArrowEvalPython") <= 2  # one for usual units, one for large ones
