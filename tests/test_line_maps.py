"""Anti-aliased line maps walked cell by cell, halved maps against a dense spline, hard negatives, potentials, depths, units in pieces."""

from __future__ import annotations

import datetime as dt
import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from chartlines.operators import _numpy as N
from chartlines.operators import joins, labels, matching
from chartlines.streaming import incremental

LINES = "unit long, line_id long, x1 double, y1 double, x2 double, y2 double"


def walked(r, c, r1, c1):
    """Cells of a smooth line, step by step with an error term, and the neighbours it touches."""
    dr, dc, sr, sc = abs(r1 - r), abs(c1 - c), np.sign(r1 - r), np.sign(c1 - c)
    e, size, out = dc - dr, np.hypot(dr, dc) or 1.0, {}
    while True:
        out[(r, c)] = 1 - abs(e - dc + dr) / size
        across, down = 2 * e >= -dc, 2 * e <= dr
        if across and c == c1:
            return out
        if across and e + dr < size:
            out[(r + sr, c)] = 1 - abs(e + dr) / size
        if down and r == r1:
            return out
        if down and dc - e < size:
            out[(r, c + sc)] = 1 - abs(dc - e) / size
        r, c, e = r + sr * down, c + sc * across, e - dr * across + dc * down


def test_smooth_cells_are_those_of_a_walk():
    rng = np.random.default_rng(1)
    ends = [*itertools.product(range(6), repeat=4), *(tuple(v) for v in rng.integers(0, 128, (300, 4)).tolist())]
    for y1, x1, y2, x2 in ends:
        y, x, value = N.smooth_cells(y1, x1, y2, x2)
        want = walked(y1, x1, y2, x2)
        assert {(int(a), int(b)): round(float(v), 9) for a, b, v in zip(y, x, value)} == {(int(a), int(b)): round(float(v), 9) for (a, b), v in want.items()}


def test_halved_maps_pass_through_cells_and_keep_cubics():
    rng = np.random.default_rng(2)
    full = rng.random((16, 16))
    half = N.halved(full)
    assert half.shape == (8, 8)
    for a, b in ((0, 0), (0, -1), (-1, 0), (-1, -1)):
        assert abs(half[a, b] - full[a, b]) < 1e-9
    assert np.allclose(N.halved(np.full((16, 16), 3.0)), 3.0)
    # far from the edges a cubic spline keeps a straight slope
    slope = np.add.outer(np.arange(64.0), 2 * np.arange(64.0))
    at = np.arange(32) * 63 / 31
    assert np.abs(N.halved(slope) - np.add.outer(at, 2 * at))[8:-8, 8:-8].max() < 1e-3


def test_hard_negatives_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(u, i, *map(float, rng.uniform(-5, 230, 4).round(1))) for u in range(3) for i in range(4)]
    frame = spark.createDataFrame(rows, LINES)
    juncs = labels.junctions(frame)
    linked, cells = labels.edges(frame, juncs), labels.line_cells(frame)
    got = {(r["unit"], r["u"], r["v"]): r["score"] for r in labels.hard_negatives(linked, juncs, cells, 10).collect()}
    spots, known = {}, {(r["unit"], r["u"], r["v"]) for r in linked.collect()}
    for r in juncs.collect():
        spots.setdefault(r["unit"], {})[r["junc_id"]] = tuple(min(max(v / 1.75, 0), 128 - 1e-4) for v in (r["y"], r["x"]))
    assert len(got) == 30
    for u in range(3):
        full = np.zeros((128, 128))
        for _, _, x1, y1, x2, y2 in (r for r in rows if r[0] == u):
            ends = [int(min(max(v / 1.75, 0), 128 - 1e-4)) for v in (y1, x1, y2, x2)]
            for (y, x), v in walked(*ends).items():
                full[y, x] = max(full[y, x], v)
        half = N.halved(full)
        want = {}
        for a, b in itertools.combinations(sorted(spots[u]), 2):
            if (u, a, b) not in known:
                line = walked(*(int(v / 2) for v in (*spots[u][a], *spots[u][b])))
                want[(u, a, b)] = np.mean([min(v, half[y, x]) for (y, x), v in line.items()])
        best = sorted(want, key=lambda k: (-round(want[k], 12), k))[:10]
        assert sorted(best) == sorted(k for k in got if k[0] == u) and all(abs(got[k] - want[k]) < 1e-9 for k in best)


def test_line_maps_are_drawn_without_shuffling_cells(spark):
    rng = np.random.default_rng(5)
    ends = rng.integers(0, 128, (40, 4))
    of, y, x, value = N.smooth_lines(*ends.T)
    for i, line in enumerate(ends.tolist()):
        assert sorted(zip(y[of == i].tolist(), x[of == i].tolist(), value[of == i].tolist())) == sorted(zip(*(c.tolist() for c in N.smooth_cells(*line))))
    rows = [(u, i, *map(float, rng.uniform(-5, 230, 4).round(1))) for u in range(5) for i in range(6)]
    frame = spark.createDataFrame([*rows, (7, 0, 3.0, 3.0, 3.0, 3.0)], LINES)
    want = {}
    for u, _, x1, y1, x2, y2 in [*rows, (7, 0, 3.0, 3.0, 3.0, 3.0)]:
        for (a, b), v in walked(*(int(min(max(c / 1.75, 0), 128 - 1e-4)) for c in (y1, x1, y2, x2))).items():
            want[(u, a, b)] = max(want.get((u, a, b), 0), v)
    cells = labels.line_cells(frame)
    got = {(r["unit"], r["y"], r["x"]): r["value"] for r in cells.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    # what is shuffled are segments, as Spark deals them to the tasks that draw them
    assert "Generate" not in cells._jdf.queryExecution().toString()
    juncs = labels.junctions(frame)
    linked = labels.edges(frame, juncs)
    told = lambda lines: sorted((r["unit"], r["u"], r["v"], round(r["score"], 9)) for r in labels.hard_negatives(linked, juncs, lines, 10).collect())
    assert told(frame) == told(cells)


def test_line_maps_are_summed_up_where_they_are_drawn(spark, monkeypatch):
    monkeypatch.setattr(labels, "MAPS", 3)
    rng = np.random.default_rng(17)
    rows = [(u, i, *map(float, rng.uniform(-20, 240, 4))) for u in range(11) for i in range(1 + u % 4)] + [(20, 0, 5.0, 5.0, 5.0, 5.0)]
    frame = spark.createDataFrame(rows, "unit long, line_id long, x1 double, y1 double, x2 double, y2 double")
    cells = {}
    for r in labels.line_cells(frame).collect():
        cells.setdefault(r["unit"], []).append((r["y"], r["x"], r["value"]))
    sums = labels.line_map_sums(frame)
    assert "Aggregate" not in sums._jdf.queryExecution().toString()  # no cell leaves its task
    found = {r["unit"]: r for r in sums.collect()}
    assert found.keys() == cells.keys() and len(found) == 12
    for u, own in cells.items():
        assert (found[u]["n_cells"], found[u]["top"], found[u]["far"]) == (len(own), min(c[0] for c in own), max(c[1] for c in own))
        assert abs(found[u]["total"] - sum(c[2] for c in own)) < 1e-9 and abs(found[u]["placed"] - sum(v * (y * 128 + x) for y, x, v in own)) < 1e-6


def test_potentials_prove_only_optimal_matchings(spark):
    rng = np.random.default_rng(4)
    schema = "unit long, line_id long, score double, x1 double, y1 double, x2 double, y2 double"
    side = lambda n: [(u, i, 0.5, *map(float, rng.uniform(0, 50, 4))) for u in range(6) for i in range(n + u % 3)]
    pred, gt = spark.createDataFrame(side(3), schema), spark.createDataFrame(side(4), schema)
    potentials = matching.optimal_potentials(pred, gt)
    assert all(r["one_to_one"] and r["feasible"] and r["tight"] for r in matching.certified(pred, gt, potentials).collect())
    wrong = matching.certified(pred, gt, potentials.withColumn("potential", F.col("potential") + F.when(F.col("id") == 0, 1.0).otherwise(0.0))).collect()
    assert not any(r["feasible"] and r["tight"] for r in wrong)


def test_proofs_shuffle_segments_and_not_pairs(spark):
    rng = np.random.default_rng(15)
    schema = "unit long, line_id long, score double, x1 double, y1 double, x2 double, y2 double"
    side = lambda n: [(u, i, 0.5, *map(float, rng.uniform(0, 50, 4))) for u in range(5) for i in range(n + u)]
    pred, gt = (spark.createDataFrame(rows, schema) for rows in (side(4) + [(9, 0, 0.5, 1.0, 1.0, 1.0, 1.0)], side(2) + [(8, 0, 0.5, 1.0, 1.0, 1.0, 1.0)]))
    for kind in ("l2", "ends_mae", "squared"):
        potentials = matching.optimal_potentials(pred, gt, kind)
        found = matching.certified(pred, gt, potentials, kind)
        assert {r["unit"]: r["n_pairs"] for r in found.collect() if r["one_to_one"] and r["feasible"] and r["tight"]} == {u: 2 + u for u in range(5)}
    assert "Join" not in potentials._jdf.queryExecution().toString()
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", found._jdf.queryExecution().executedPlan().toString())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert keys and all("," not in k for k in keys) and all("unit" in line and line.count(" = ") == 1 for line in plan.splitlines() if "Join " in line)
    # a null coordinate is near nothing, and no matching waits for it
    torn = pred.withColumn("x1", F.when((F.col("unit") != 1) | (F.col("line_id") > 0), F.col("x1")))
    assert matching.optimal_potentials(torn, gt).where("unit = 1").count() == 8


def test_equal_ends_are_spread_in_order(spark):
    values = np.array([5.0, 1.0, 5.0, 5.0, 5.0, 1.0, 2.0])
    assert np.allclose(N.spread_ties(values, 0.1), [5.0, 1.0, 5.1, 4.9, 5.2, 1.1, 2.0])
    frame = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k long, i long, y double")
    assert np.allclose([r["y"] for r in joins.spread_ties(frame, ["k"], "y", ["i"]).orderBy("i").collect()], N.spread_ties(values, 0.1))


def test_losses_of_depths(spark):
    pred = spark.createDataFrame([(1, 0, 0.0, 0.0, -2.0, 0.9), (1, 1, 5.0, 0.0, -3.0, 0.8), (1, 2, 0.1, 0.0, -9.0, 0.1), (2, 0, 50.0, 50.0, -1.0, 0.5)], "unit long, id long, x double, y double, z double, score double")
    truth = spark.createDataFrame([(1, 0, 0.0, 1.0, -1.0), (1, 1, 5.0, 1.0, -6.0), (2, 0, 0.0, 0.0, -1.0)], "unit long, junc_id long, x double, y double, z double")
    got = {r["unit"]: r for r in labels.depth_losses(pred, truth, 3.0).collect()}
    s = np.log([2.0, 3.0]) - np.log([1.0, 6.0])
    assert got[1]["n"] == 2 and abs(got[1]["l1"] - 2.0) < 1e-12 and abs(got[1]["l2"] - 5.0) < 1e-12 and abs(got[1]["sil"] - s.var()) < 1e-12
    assert (got[2]["n"], got[2]["l1"], got[2]["sil"]) == (0, 0.0, 0.0)
    # in space the second vertex is too deep
    assert {r["unit"]: r["n"] for r in labels.depth_losses(pred, truth, 3.0, solid=True).collect()}[1] == 1


def test_units_in_pieces_over_batches_and_a_restart(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    schema = "unit long, line_id long, score double, x1 double, y1 double, x2 double, y2 double, ts timestamp"
    row = lambda u, i, minutes, y=0.0: (u, i, 0.9 - i / 10, 0.0, y, 9.0, y, at(minutes))
    batches = [
        [row(1, 0, 0), row(2, 0, 10)],
        [row(1, 1, 5, 50.0), row(1, 0, 6), row(3, 0, 60)],  # the rest of unit 1, and a repeat
        [row(4, 0, 200)],
        [row(5, 0, 210)],
        [row(2, 1, 11), row(6, 0, 220)],  # much too late for unit 2
    ]
    gt = spark.createDataFrame([(u, 0, 0.0, 0.0, 9.0, 0.0) for u in range(1, 7)], "unit long, line_id long, x1 double, y1 double, x2 double, y2 double")
    with_two = 2
    for some in (batches[:with_two], batches[with_two:]):
        for rows in some:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        incremental.score_pieces(arriving, gt, 5.0, str(tmp_path), late="20 minutes", quiet="30 minutes")
    done = sorted((r["unit"], r["line_id"], r["tp"]) for r in spark.read.parquet(f"{tmp_path}/scored").collect())
    assert done == [(1, 0, 1), (1, 1, 0), (2, 0, 1), (3, 0, 1)]  # units 4 to 6 are still open


def test_alignment_on_tiles_of_bits_equals_cells_drawn_one_by_one(spark):
    from chartlines.operators import metrics

    rng = np.random.default_rng(3)
    lines = np.concatenate([np.round(rng.uniform(-60, 300, (80, 4)) * 2) / 2, [[0.5, 0.5, 0.5, 2.5], [7, 7, 7, 7]]])
    units = np.arange(len(lines)) % 9
    mask = {(int(u), int(y), int(x)) for u, y, x in zip(rng.integers(0, 8, 4000), rng.integers(-10, 50, 4000), rng.integers(-10, 50, 4000))}
    cells = {}
    for u, line in zip(units.tolist(), lines / 7.0):
        n = int(max(abs(line[2] - line[0]), abs(line[3] - line[1]))) + 1
        t = np.linspace(0, 1, n)
        cells.setdefault(u, set()).update((int(np.rint(line[1] + s * (line[3] - line[1]))), int(np.rint(line[0] + s * (line[2] - line[0])))) for s in t)
    frame = spark.createDataFrame([(u, i, *map(float, line)) for i, (u, line) in enumerate(zip(units.tolist(), lines))] + [(1, 999, None, 1.0, 2.0, 3.0)], "unit long, line_id long, x1 double, y1 double, x2 double, y2 double")
    spots = spark.createDataFrame(sorted(mask) * 2, "unit long, y long, x long")
    found = {r["unit"]: r["alignment"] for r in metrics.line_alignment(frame, spots, 7.0).collect()}
    assert found == {u: sum((u, *c) in mask for c in own) / len(own) for u, own in cells.items()} and found[8] == 0
    plan = metrics.line_alignment(frame, spots, 7.0)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan
