"""The library's operators on worked cases and against brute force."""

from __future__ import annotations

import itertools
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlines.functions import geometry as G
from chartlines.functions import keys as K
from chartlines.functions import text as T
from chartlines.operators import _numpy as N
from chartlines.operators import clusters, filters, joins, matching, metrics, precision, reshaping
from chartlines.sources import files

SEG = "unit long, line_id long, x1 double, y1 double, x2 double, y2 double, score double"


def seg(spark, rows):
    return spark.createDataFrame([(u, i, float(a), float(b), float(c), float(d), float(s)) for u, i, a, b, c, d, s in rows], SEG)


# --- numpy helpers


def test_optimal_pairs_are_the_cheapest():
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        cost = rng.random((n, m))
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        at = (lambda i, j: cost[i, j]) if n <= m else (lambda i, j: cost[j, i])
        best = min(sum(at(i, j) for i, j in zip(small, p)) for p in itertools.permutations(large, len(small)))
        pairs = N.optimal_pairs(cost)
        assert len(pairs) == min(n, m) and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9
    assert N.optimal_pairs(np.zeros((0, 3))) == []
    greedy = N.greedy_pairs(np.array([[1.0, 2.0], [2.0, 100.0]]))
    assert greedy == [(0, 0), (1, 1)] and N.optimal_pairs(np.array([[1.0, 2.0], [2.0, 100.0]])) == [(0, 1), (1, 0)]


def test_peaks_of_plateaus_borders_and_distance():
    assert N.peaks(np.array([5, 1, 3, 3, 3, 1, 9.0]), 0, 1).tolist() == [3]
    assert N.peaks(np.array([0, 4, 0, 5, 0, 1, 0.0]), 2, 3).tolist() == [3]
    assert N.peaks(np.zeros(5), 0, 1).tolist() == []


def test_transport_of_shifted_points():
    a = np.array([[0.0, 0], [1, 0], [2, 0]])
    assert abs(N.earth_movers(a, a + [3, 4]) - 5) < 1e-9
    assert N.earth_movers(a, a[:0]) != N.earth_movers(a, a[:0])
    assert abs(N.quantile_distance(a[:, 0], a[:, 0] + 2) - 2) < 1e-9 and N.sliced_distance(a, a) == 0


# --- matching


def test_first_hit_keeps_the_rule_for_taken_truths(spark):
    gt = seg(spark, [(1, 0, 0, 0, 10, 0, 1), (1, 1, 0, 3, 10, 3, 1)])
    pred = seg(spark, [(1, 0, 0, 0, 10, 0, 0.9), (1, 1, 0, 1, 10, 1, 0.8), (2, 0, 0, 0, 1, 1, 0.5)])
    tp = {(r["unit"], r["line_id"]): r["tp"] for r in matching.nearest_first_hit(pred, gt, 50.0).collect()}
    assert tp == {(1, 0): 1, (1, 1): 0, (2, 0): 0}
    assert matching.greedy_match(pred, gt, 5.0).count() == 2


def test_thresholds_at_the_limit(spark):
    gt, pred = seg(spark, [(1, 0, 0, 0, 10, 0, 1)]), seg(spark, [(1, 0, 0, 3, 10, 4, 1)])
    assert matching.nearest_first_hit(pred, gt, 25.0).first()["tp"] == 0
    assert matching.greedy_match(pred, gt, 3.5).count() == 1 and matching.greedy_match(pred, gt, 3.49).count() == 0


def test_ends_may_be_swapped(spark):
    gt, pred = seg(spark, [(1, 0, 0, 0, 10, 5, 1)]), seg(spark, [(1, 0, 10, 5, 0, 0, 1)])
    costs = {k: matching.pairs(pred, gt, lambda a, b, k=k: G.pair_cost(k, a, b)).first()["cost"] for k in ("mean_ends", "l2", "squared", "midpoint")}
    assert costs["mean_ends"] == costs["squared"] == costs["midpoint"] == 0 and costs["l2"] > 20
    assert G.orient(pred).first()["x1"] == 0


def test_optimal_drops_pairs_after_or_before(spark):
    gt = seg(spark, [(1, 0, 0, 0, 0, 0, 1), (1, 1, 0, 6, 0, 6, 1)])
    pred = seg(spark, [(1, 0, 0, 2, 0, 2, 1), (1, 1, 0, -9, 0, -9, 1)])
    after, before = (matching.optimal_match(pred, gt, 6.0, "l2", gate).count() for gate in (False, True))
    assert (after, before) == (0, 1) or before >= after


def test_average_precision_is_the_same_over_any_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(int(u), i, round(float(s), 1), int(t)) for i, (u, s, t) in enumerate(zip(rng.integers(0, 9, 300), rng.random(300), rng.integers(0, 2, 300)))]
    df = spark.createDataFrame(rows, "unit long, line_id long, score double, tp int").withColumn("tau", F.lit(1.0))
    totals = spark.createDataFrame([(1.0, 200), (2.0, 5)], "tau double, n_gt long")
    ordered = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    hits, best, area = np.cumsum([r[3] for r in ordered]), 0.0, 0.0
    prec = hits / np.arange(1, 301)
    for i in range(299, -1, -1):
        best = max(best, prec[i])
        area += ordered[i][3] * best
    order, back = [F.desc("score"), F.asc("unit"), F.asc("line_id")], [F.asc("score"), F.desc("unit"), F.desc("line_id")]
    for n in (1, 5):
        got = {r["tau"]: r["ap"] for r in precision.average_precision(df.repartition(n), totals, ["tau"], order, back, empty=0.0).collect()}
        assert abs(got[1.0] - area / 200) < 1e-9 and got[2.0] == 0.0


# --- filters, joins, reshaping


def test_suppression_keeps_the_best(spark):
    rows = [(1, 0, 0, 0, 10, 0, 0.5), (1, 1, 0, 1, 10, 1, 0.9), (1, 2, 0, 50, 10, 50, 0.1), (2, 0, 0, 0, 10, 0, 0.2)]
    assert sorted((r["unit"], r["line_id"]) for r in filters.suppress(seg(spark, rows), 2.0).collect()) == [(1, 1), (1, 2), (2, 0)]
    assert sorted((r["unit"], r["line_id"]) for r in filters.drop_near_copies(seg(spark, rows), 1.5).collect()) == [(1, 0), (1, 2), (2, 0)]
    assert filters.suppress(seg(spark, []), 2.0).count() == 0


def test_clipping_trims_and_drops(spark):
    rows = [(1, 0, 0, 0, 100, 0, 0.9), (1, 1, 50, 0, 150, 0, 0.8), (1, 2, 10, 0, 20, 0, 0.7), (1, 3, 0, 40, 100, 40, 0.6)]
    got = {r["line_id"]: (r["x1"], r["x2"]) for r in filters.clip_overlaps(seg(spark, rows), 0.0, 2.0).collect()}
    assert got == {0: (0.0, 100.0), 1: (100.0, 150.0), 3: (0.0, 100.0)}


def test_padding_ends_at_the_first_repetition(spark):
    rows = [(1, 0, 1, 1, 2, 2, 1), (1, 1, 3, 3, 4, 4, 1), (1, 2, 1, 1, 2, 2, 1), (1, 3, 3, 3, 4, 4, 1), (2, 0, 1, 1, 2, 2, 1), (2, 1, 5, 5, 6, 6, 1)]
    assert filters.cut_padding(seg(spark, rows)).count() == 4


def test_names_and_keys(spark):
    names = [("image_1_crop_3",), ("image_3_crop_1",), ("image_12_red_crop_2",), ("other",), (None,)]
    df = spark.createDataFrame(names, "name string")
    got = df.select(K.image_id(F.col("name")), K.crop_id(F.col("name")), K.category_code(F.col("name")), K.token_key(F.col("name")), K.crop_first(F.col("name"))).collect()
    assert got[0][3] == got[1][3] and got[0][:2] != got[1][:2]
    assert tuple(got[2])[:3] == (12, 2, "red") and got[2][4] == "image_12_crop_2_red" and got[3][0] is None


def test_answers_of_every_shape(spark):
    texts = ['{"lines": [[1,2,3,4],[1,2]]}', "Sure: [[1,2,3,4]]", '{"lines": {"c": [[1,2,3,4]]}}', 'x {"lines": {"c": {"red": [[1,2,3,4]]}}} y', "broken [1,", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.answer_lines(F.col("t"))).collect()]
    assert got[:4] == [[[1.0, 2.0, 3.0, 4.0]]] * 4 and got[4] is None and got[5] is None


def test_constant_columns_and_gaps(spark):
    cells = spark.createDataFrame([(1, i, "a", 5.0, "x") for i in range(3)], "dataset_id long, row_id long, column_name string, value double, category string")
    assert {r["norm"] for r in reshaping.normalise(cells).collect()} == {None}
    axes = spark.createDataFrame([(1, x) for x in (0.0, 0.2, 0.4, 0.6)], "image_id long, x double")
    assert reshaping.gap_clusters(axes, "image_id", "x", 0.25).count() == 1
    assert reshaping.spaced_values(axes, "image_id", "x", 0.25).count() == 2


def test_split_takes_whole_groups_of_exact_number(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 103)
    got = {r["part"]: (r["n"], r["rows"]) for r in reshaping.split_by_group(rows, "g", 0.8).groupBy("part").agg(F.countDistinct("g").alias("n"), F.count("*").alias("rows")).collect()}
    assert got["train"][0] == 82 and got["valid"][0] == 21 and sum(v[1] for v in got.values()) == 1000


def test_round_trip_of_a_table(spark):
    rng = np.random.default_rng(4)
    data = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rng.permutation(300).reshape(100, 3))]
    wide = spark.createDataFrame(data, "row_id long, a double, b double, c double")
    cut = reshaping.row_segments(wide, ["a", "b", "c"], 224.0, "row_id")
    segments = cut.select(F.lit(1).cast("long").alias("image_id"), F.lit("x").alias("category"), "crop_id", F.col("row_id").alias("unit"), F.col("row_id").alias("line_id"), "x1", "y1", "x2", "y2")
    paths = {}
    for r in joins.stitch_with_limit(segments, 0.5).collect():
        paths.setdefault(r["path_id"], {})[r["crop_id"]] = (r["y1"], r["y2"])
    assert sorted((p[0][0], p[0][1], p[1][1]) for p in paths.values()) == sorted(d[1:] for d in data)
    assert joins.stitch(segments, 2, 0.5).count() == 200


def test_hue_ranges_equal_density_clusters(spark):
    rng = np.random.default_rng(5)
    hues = np.concatenate([rng.integers(10, 20, 400), rng.integers(60, 66, 300), rng.integers(0, 180, 40)])
    pixels = spark.createDataFrame([(1, int(h)) for h in hues], "image_id long, h int")
    got = sorted((r["lo"], r["hi"], r["n"]) for r in clusters.hue_ranges(clusters.hue_histogram(pixels, ["image_id"]), ["image_id"], 3, 60).collect())
    core = [h for h in range(180) if (np.abs(hues - h) <= 3).sum() >= 60 and (hues == h).any()]
    assert len(got) == 1 + sum(b - a > 3 for a, b in zip(core, core[1:]))
    assert sum(n for _, _, n in got) == sum(any(abs(h - c) <= 3 for c in core) for h in hues)


# --- files


def test_readers(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "a.json").write_text(json.dumps({"filename": "image_1", "lines": {"crop_1": {"red": [[0, 1, 2, 3]], "blue": [[4, 5, 6, 7]]}}}))
    (tmp_path / "meta" / "b.json").write_text(json.dumps({"filename": "image_2", "lines": {"crop_1": [[0, 1, 2, 3], [1, 2]]}}))
    got = sorted(map(tuple, files.read_plot_metadata(spark, str(tmp_path / "meta")).select("filename", "category", "y2").collect()), key=str)
    assert got == [("image_1", "blue", 7.0), ("image_1", "red", 3.0), ("image_2", None, 3.0)]
    (tmp_path / "list.json").write_text(json.dumps([{"filename": "f", "lines": [[9, 9, 9, 9]]}, {"filename": "f", "lines": [[1, 2, 3, 4], [5]]}]))
    assert [r["y2"] for r in files.read_segment_lists(spark, str(tmp_path / "list.json")).collect()] == [4.0]
    (tmp_path / "p.json").write_text(json.dumps({"filename": "image_4_crop_2_red_pre", "lines": [[[9, 1], [2, 3.456]]]}))
    row = files.read_predictions(spark, str(tmp_path / "p.json")).first()
    assert (row["image_id"], row["crop_id"], row["x1"], row["y1"], row["x2"]) == (4, 2, 2.0, 3.46, 9.0)
    np.savez(tmp_path / "n.npz", lines=np.array([[[1, 2], [3, 4]]]))
    (tmp_path / "bad.npz").write_bytes(b"no")
    npz = files.read_npz_lines(spark, str(tmp_path)).collect()
    assert sorted((r["x1"], r["y1"], r["score"]) for r in npz if r["error"] is None) == [(2.0, 1.0, 1.0)] and sum(r["error"] is not None for r in npz) == 1
    (tmp_path / "s.svg").write_text('<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(10,5)" stroke="red"><path d="M0 0L1 2H5"/><line x1="0" y1="0" x2="3" y2="3" stroke="blue"/></g></svg>')
    svg = files.read_svg_segments(spark, str(tmp_path)).collect()
    assert sorted((r["stroke"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in svg) == [("blue", 10.0, 5.0, 13.0, 8.0), ("red", 10.0, 5.0, 11.0, 7.0), ("red", 11.0, 7.0, 15.0, 7.0)]


def test_entry_gives_rows_and_registry_is_consistent(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("bins", [180, 72])
def test_dense_histogram_has_every_bin(spark, bins):
    pixels = spark.createDataFrame([(1, 0), (1, 179)], "image_id long, h int")
    rows = clusters.hue_histogram(pixels, ["image_id"], bins, dense=True).collect()
    assert len(rows) == bins and sum(r["n"] for r in rows) == 2


def test_hues_mixtures_and_centres(spark):
    from chartlines.operators import palettes

    rng = np.random.default_rng(6)
    hues = np.concatenate([rng.normal(30, 2, 500), rng.normal(120, 3, 300)]).astype(int)
    hist = clusters.hue_histogram(spark.createDataFrame([(1, int(h)) for h in hues], "image_id long, h int"), ["image_id"])
    mixed = sorted((r["centre"], r["share"]) for r in palettes.hue_mixture(hist, ["image_id"]).collect())
    assert len(mixed) >= 2 and abs(mixed[0][0] - 29.5) < 2 and abs(mixed[-1][0] - 119.5) < 3
    wide = clusters.hue_histogram(spark.createDataFrame([(1, int(h)) for h in hues], "image_id long, h int"), ["image_id"], 72)
    named = palettes.distinct_hues(palettes.prominent_hues(wide, ["image_id"]), ["image_id"]).collect()
    assert [r["category"] for r in named] == [f"cat{i + 1}" for i in range(len(named))] and len(named) >= 2
    colours = spark.createDataFrame([(1, 10 + i % 3, 10, 10, 5) for i in range(3)] + [(1, 200, 200, 200 + i, 2) for i in range(4)], "image_id long, r int, g int, b int, n long")
    centres = palettes.colour_centres(colours, ["image_id"], 2)
    assert sorted(r["n"] for r in centres.collect()) == [8.0, 15.0]
    assert palettes.assign_centres(colours, centres, ["image_id"]).groupBy("centre_no").count().count() == 2
    axes = spark.createDataFrame([(1, y, x) for x in (20, 100, 900, 912, 1500, 1890, 1990) for y in range(40)] + [(1, 3, x) for x in range(2000)], "image_id long, y int, x int")
    # the first and the last stand at the borders, 912 too near to 900
    found = [r["x"] for r in palettes.vertical_axes(axes).orderBy("x").collect()]
    assert len(found) == 4 and all(abs(a - b) <= 6 for a, b in zip(found, (100, 906, 1500, 1890)))


def test_earth_movers_of_unequal_sets(spark):
    rng = np.random.default_rng(22)
    for n, m in [(1, 4), (5, 7), (6, 4), (9, 8), (25, 26)]:
        a, b = rng.integers(0, 9, (n, 2)).astype(float), rng.uniform(0, 9, (m, 2))
        x, y = np.repeat(a, m, 0), np.repeat(b, n, 0)
        cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        assert abs(N.earth_movers(a, b) - sum(cost[i, j] for i, j in N.optimal_pairs(cost)) / (n * m)) < 1e-9
    points = lambda n: spark.createDataFrame([(1, i, float(i), 0.0) for i in range(n)], "unit long, id long, x double, y double")
    found = metrics.transport_distances(points(25), points(26)).first()
    assert abs(found["emd"] - 0.5) < 1e-9


def sample_points(s, step=3.0, least=5, most=200):
    d = s[2:] - s[:2]
    size = np.hypot(*d)
    n = 1 if size < 1e-9 else int(np.clip(np.ceil(size / step), least, most))
    return s[:2] + (np.linspace(0, 1, n)[:, None] if n > 1 else np.zeros((1, 1))) * d


def test_sampled_cost_is_the_least_of_all_point_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(0, 0, 0, 0, 60, 60, 1), (0, 1, 5, 5, 5, 5, 1), (0, 2, 0, 0, 900, 1, 1), *[(0, 3 + i, *rng.uniform(0, 90, 4).round(2), 1) for i in range(9)]]
    gts = [(0, 0, 0, 60, 60, 0, 1), (0, 1, 30, 0.6, 90, 0.6, 1), (0, 2, 7, 7, 7, 7, 1), *[(0, 3 + i, *rng.uniform(0, 90, 4).round(2), 1) for i in range(9)]]
    got = matching.pairs(seg(spark, rows), seg(spark, gts), matching.sampled_cost).collect()
    lines = lambda rs: {r[1]: np.array(r[2:6], float) for r in rs}
    a, b = lines(rows), lines(gts)
    assert len(got) == len(rows) * len(gts)
    for r in got:
        p, q = sample_points(a[r["p"]]), sample_points(b[r["g"]])
        assert abs(np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)).min() - r["cost"]) < 1e-9
    nulls = matching.pairs(seg(spark, rows[:1]), seg(spark, gts[:1]).withColumn("x1", F.lit(None).cast("double")), matching.sampled_cost).first()
    assert nulls["cost"] is None


def test_equal_neighbours_are_both_damped(spark):
    from chartlines.operators import labels

    cells = spark.createDataFrame([(1, 0, 0, 0.4), (1, 0, 1, 0.4), (1, 5, 5, 0.1), (2, 0, 0, 0.5), (2, 1, 1, 0.2)], "unit long, y long, x long, score double")
    tops = lambda df: {(r["unit"], r["y"], r["x"]) for r in df.where("top").collect()}
    assert tops(labels.damp(cells)) == {(1, 5, 5), (2, 0, 0)}
    assert tops(labels.damp(cells, ties_stay=True)) == {(1, 5, 5), (2, 0, 0), (1, 0, 0), (1, 0, 1)}


def test_clipping_leaves_a_covering_line_and_trims_ends():
    lines = np.array([[10, 0, 20, 0], [0, 0, 100, 0], [15, 0, 40, 0], [0, 50, 9, 50], [2, 50, 5, 50], [0, 50, 9, 50]], float)
    at, kept = N.clip_collinear(lines, np.array([9, 8, 7, 6, 5, 4.0]), 1.0)
    # the second holds the first inside and stays whole; the third then lies under it, the fifth under the fourth
    assert at.tolist() == [0, 1, 3] and kept.tolist() == lines[[0, 1, 3]].tolist()
    at, kept = N.clip_collinear(np.array([[0, 0, 10, 0], [6, 0.5, 20, 0.5]], float), np.array([2, 1.0]), 1.0)
    assert at.tolist() == [0, 1] and kept[1].tolist() == [10, 0.5, 20, 0.5]


def test_density_clusters_match_brute_force():
    rng = np.random.default_rng(8)
    x = np.unique(np.concatenate([rng.normal(c, 4, (60, 3)) for c in (0, 40, 47)]).round(), axis=0)
    n = rng.integers(1, 9, len(x)).astype(float)
    of = N.density_clusters(x, n, 5.0, 25)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 25
    core = near @ n >= 25
    group = np.arange(len(x))
    for _ in range(len(x)):
        group = np.array([min(group[near[i] & core]) if core[i] else group[i] for i in range(len(x))])
    assert all((of[i] == of[j]) == (group[i] == group[j]) for i, j in itertools.combinations(np.flatnonzero(core), 2))
    for i in np.flatnonzero(~core):
        owners = near[i] & core
        assert (of[i] == -1) == (not owners.any()) and (of[i] == -1 or of[i] in of[owners])
    assert N.density_clusters(np.zeros((0, 3)), np.zeros(0), 5.0, 1).tolist() == []


def test_dominant_hues_leave_out_background_and_greys(spark):
    from chartlines.operators import palettes

    rows = [(1, y, x, *((255, 255, 255) if y < 20 else (200, 10, 10) if y < 24 else (10, 10, 200) if y < 27 else (90, 92, 91))) for y in range(30) for x in range(30)]
    found = palettes.dominant_hues(spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int"), ["image_id"], 8.0, 20, 1).collect()
    assert [(r["category"], round(r["hue"], 3)) for r in sorted(found, key=lambda r: r["hue"])] == [("cat1", 0.0), ("cat2", 0.667)]


def test_strict_and_global_pairs_are_the_cheapest(spark):
    rng = np.random.default_rng(21)
    make = lambda n: [(u, i, "ab"[i % 2], *rng.uniform(0, 50, 4).round(1)) for u in range(4) for i in range(n)]
    schema = "unit long, line_id long, category string, x1 double, y1 double, x2 double, y2 double"
    gts, preds = make(4), make(3)
    table = lambda rows: spark.createDataFrame([(r[0], r[1], r[2], *map(float, r[3:])) for r in rows], schema).withColumn("image_id", F.col("unit") % 2)
    found = {(r["scope"], r["image_id"]): r for r in metrics.strict_and_global(table(preds).withColumn("score", F.lit(1.0)), table(gts), ["image_id", "unit", "category"], "image_id").collect()}

    def least(key):
        total, n = 0.0, 0
        for k in {key(r) for r in gts}:
            a, b = ([np.array(r[3:], float) for r in rows if key(r) == k] for rows in (preds, gts))
            if len(a) <= len(b):
                total += min(sum(np.abs(p - b[j]).sum() for p, j in zip(a, order)) for order in itertools.permutations(range(len(b)), len(a)))
            n += min(len(a), len(b))
        return total, n

    strict = [least(lambda r, i=i: (r[0] % 2 == i) and (r[0], r[2])) for i in (0, 1)]
    for i in (0, 1):
        r = found["strict", i]
        assert (r["gt_lines"], r["pred_lines"], r["matched"]) == (8, 6, 6)
    sums = [found["strict", i]["mae_xy"] * 4 * 6 for i in (0, 1)]
    whole = least(lambda r: (r[0], r[2]))
    assert whole[1] == 12 and abs(sum(sums) - whole[0]) < 1e-6 and strict
    assert found["global", 0]["matched"] == 6 and found["global", 0]["mae_xy"] * 24 <= sums[0] + 1e-9


def test_merged_crops_and_chain_on_empty_sides(spark):
    from chartlines.operators import chains

    gt = seg(spark, [(1, 0, 0, 0, 10, 10, 1), (2, 0, 0, 0, 10, 10, 1), (2, 1, 0, 30, 10, 30, 1)]).withColumn("crop", F.lit("c"))
    pred = seg(spark, [(1, 0, 0, 0, 10, 10, 0.9), (2, 0, 0, 1, 10, 11, 0.8), (2, 1, 0, 90, 10, 90, 0.5)]).withColumn("crop", F.lit("c"))
    r = chains.merged_crops(pred, gt, "crop", 10.0).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 1) and r["ap"] == 0.5  # both truths at 0 are one, as are both predictions
    mask = spark.createDataFrame([(1, 0, 0), (1, 10, 10)], "unit long, y long, x long")
    got = {r["unit"]: r["ap"] for r in chains.evaluation_chain(pred.drop("crop"), gt.drop("crop"), mask).collect()}
    assert got == {1: 100.0, 2: 0.0}
    assert chains.merged_crops(pred.limit(0), gt.limit(0), "crop").collect()[0]["tp"] == 0


def test_nearest_colour_in_blocks_and_branching(spark):
    colours = spark.createDataFrame([(f"c{i:02}", i / 40, 0.5, 0.5) for i in range(37)], "category string, h double, s double, v double")
    rows = spark.createDataFrame([(i, (i * 7 % 100) / 100, 0.5, 0.4) for i in range(50)], "id long, h double, s double, v double")
    whole = joins.nearest_colour(rows, colours, [], ["id"])
    assert len(joins.in_blocks(colours, 10)) == 4
    most, joins.BROADCAST_ROWS = joins.BROADCAST_ROWS, 10
    try:
        joins.in_blocks.__defaults__ = (10,)
        parts = joins.nearest_colour(rows, colours, [], ["id"])
        pick = lambda df: {r["id"]: (r["category"], round(r["colour_distance"], 9)) for r in df.collect()}
        assert pick(whole) == pick(parts)
    finally:
        joins.BROADCAST_ROWS = most
        joins.in_blocks.__defaults__ = (most,)
    segments = spark.createDataFrame([(1, 1, "a", 0, 0, 0.0, 10.0), (2, 1, "a", 1, 0, 11.0, 20.0), (2, 1, "a", 1, 1, 9.0, 70.0), (2, 1, "a", 1, 2, 50.0, 60.0)], "unit long, image_id long, category string, crop_id int, line_id long, y1 double, y2 double")
    got = {(r["path_id"], r["crop_id"]): (r["y1"], r["y2"]) for r in joins.stitch_branching(segments, 2, 5.0).collect()}
    assert got == {(0, 0): (0.0, 10.0), (0, 1): (11.0, 20.0), (1, 0): (0.0, 10.0), (1, 1): (9.0, 70.0), (2, 0): (None, None), (2, 1): (50.0, 60.0)}
    assert {r["path_id"] for r in joins.stitch_branching(segments, 2, 5.0, births=False).collect()} == {0, 1}


def test_predictors_are_tried_again(spark):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def __call__(self, row):
            self.calls += 1
            if row["id"] == 1 and self.calls % 2 or row["id"] == 2:
                raise ValueError("503")
            import pandas as pd

            return pd.DataFrame({"id": [row["id"]], "n": [1]})

    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long").coalesce(1)
    got = {r["id"]: (r["n"], r["error"]) for r in files.predict(rows, Flaky, "id long, n long, error string", attempts=3, wait=0.0, transient=lambda e: "503" in str(e)).collect()}
    assert got[1] == (1, None) and got[2] == (None, "503") and got[3] == (1, None)


def test_ground_truth_of_large_sets_comes_in_parts(spark):
    rows = [(d, i, "ab"[i % 2], float(i), float(-i), 3.0) for d, n in ((0, 5), (1, 400)) for i in range(n)]
    wide = spark.createDataFrame(rows, "dataset_id long, row_id long, category string, p double, q double, r double")
    found = reshaping.ground_truth(wide, ["p", "q", "r"], most=50).collect()
    assert sum(r["dataset_id"] == 0 for r in found) == 1 and sum(r["dataset_id"] == 1 for r in found) > 4
    largest = max(len(ls) for r in found for crop in r["lines"].values() for ls in crop.values())
    assert largest < 60
    lines = sorted((ls, c) for r in found if r["dataset_id"] == 1 for c, many in r["lines"]["crop_1"].items() for ls in many)
    assert len(lines) == 400 and lines[0][0] == [0.0, 0.0, 224.0, 300.0] and lines[-1][0] == [0.0, 300.0, 224.0, 0.0]
    assert all(ls[1] is not None and ls[3] is None for r in found if r["dataset_id"] == 0 for many in r["lines"]["crop_2"].values() for ls in many)


def test_shares_on_masks_are_looked_up_within_units(spark):
    rng = np.random.default_rng(3)
    cells = {(int(u), int(y), int(x)) for u, y, x in zip(rng.integers(0, 4, 900), rng.integers(-12, 20, 900), rng.integers(-12, 20, 900))}
    mask = spark.createDataFrame(sorted(cells) + [(9, 1, 1)], "unit long, y long, x long")
    ends = rng.uniform(-15, 22, (200, 4)).round(2)
    rows = [(i % 5, i, *e, 1) for i, e in enumerate(ends.tolist())]  # unit 4 has no mask
    lines = seg(spark, rows)
    got = {r["line_id"]: r["share"] for r in filters.share_on_mask(lines, mask, 16, 1.0).collect()}
    for u, i, x1, y1, x2, y2, _ in rows:
        points = [(u, round(y1 + k / 15.0 * (y2 - y1)), round(x1 + k / 15.0 * (x2 - x1))) for k in range(16)]
        assert got[i] == sum(p in cells for p in points) / 16
    both = {r["line_id"] for r in filters.ends_on_mask(lines, mask, 1.0).collect()}
    assert both == {i for u, i, x1, y1, x2, y2, _ in rows if (u, np.floor(y1), np.floor(x1)) in cells and (u, np.floor(y2), np.floor(x2)) in cells}
    plan = filters.share_on_mask(lines, mask, 16, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(unit#\d+L?, y#", plan)


def test_predictors_may_return_lists(spark):
    def factory():
        def run(row):
            if row["id"] == 2:
                raise ValueError("none")
            return {"id": [row["id"]] * row["n"], "big": [2**60 + 1] * row["n"]}

        return run

    rows = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "id long, n int").coalesce(1)
    got = [tuple(r) for r in files.predict(rows, factory, "id long, big long, error string").collect()]
    assert got == [(1, 2**60 + 1, None), (1, 2**60 + 1, None), (2, None, "none")]


def test_oriented_costs_agree_to_the_last_bit(spark):
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 225, (3000, 8)).astype(float).tolist()
    names = [f"{p}_{c}" for p in "pg" for c in G.COORDS]
    p, g = G.seg("p_"), G.seg("g_")
    got = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(*names, G.symmetric_distance(p, g).alias("cost"), G.overlap(p, g).alias("share")).collect()

    def off(px, py, s):
        dx, dy, x, y = s[2] - s[0], s[3] - s[1], px - s[0], py - s[1]
        t = max(0.0, min(1.0, (x * dx + y * dy) / (dx * dx + dy * dy)))
        return np.sqrt((x - t * dx) * (x - t * dx) + (y - t * dy) * (y - t * dy))

    def common(a, b):
        la, lb = (np.sqrt((s[2] - s[0]) * (s[2] - s[0]) + (s[3] - s[1]) * (s[3] - s[1])) for s in (a, b))
        at = [((a[i] - b[0]) * (b[2] - b[0]) + (a[i + 1] - b[1]) * (b[3] - b[1])) / lb for i in (0, 2)]
        return la <= lb, max(0.0, min(max(at), lb) - max(min(at), 0.0)) / la

    for r in got:
        a, b = list(r)[:4], list(r)[4:8]
        assert r["cost"] == (off(*a[:2], b) + off(*a[2:], b) + off(*b[:2], a) + off(*b[2:], a)) / 4
        short, share = common(b, a)
        assert r["share"] == (share if short else common(a, b)[1])


def test_units_may_return_columns(spark):
    from chartlines.operators.units import each_unit

    rows = spark.createDataFrame([(u, i, float(i)) for u in range(500) for i in range(u % 4 + 1)], "unit long, line_id long, y double")

    def run(unit):
        keep = unit["line_id"] % 2 == 1
        return {"unit": unit["unit"][keep], "id": [int(i) if i > 1 else None for i in unit["line_id"][keep]], "y": np.where(unit["y"] > 1, np.nan, unit["y"])[keep]}

    found = each_unit(rows.repartition(7), ["line_id"], run, "unit long, id long, y double").orderBy("unit", "id").collect()
    assert [tuple(r) for r in found] == sorted(((u, i if i > 1 else None, None if i > 1 else float(i)) for u in range(500) for i in range(u % 4 + 1) if i % 2), key=lambda r: (r[0], r[1] or -1))
    none = each_unit(rows.where("line_id = 0"), ["line_id"], run, "unit long, id long, y double")
    assert none.collect() == []


def test_levels_share_one_ranking(spark):
    rng = np.random.default_rng(12)
    rows = [(i % 3, i, round(float(rng.random()), 1), int(v)) for i, v in enumerate(rng.integers(0, 8, 200))]
    marked = spark.createDataFrame(rows, "unit long, line_id long, score double, _levels long")
    order, back = [F.desc("score"), F.asc("unit"), F.asc("line_id")], [F.asc("score"), F.desc("unit"), F.desc("line_id")]
    totals = spark.createDataFrame([(150,)], "n_gt long")
    for n in (1, 7):
        got = {r["tau"]: r for r in precision.precision_of_levels(marked.repartition(n), totals, "tau", [1.0, 2.0, 3.0], order, back).collect()}
        for i, tau in enumerate((1.0, 2.0, 3.0)):
            one = marked.withColumn("tp", F.shiftright("_levels", i).bitwiseAND(F.lit(1).cast("long")).cast("int")).withColumn("tau", F.lit(tau))
            want = precision.average_precision(one, totals.withColumn("tau", F.lit(tau)), ["tau"], order, back, empty=0.0).first()["ap"]
            assert abs(got[tau]["ap"] - want) < 1e-12 and got[tau]["tp"] == sum(v >> i & 1 for *_, v in rows) and got[tau]["n"] == 200
    none = precision.precision_of_levels(marked.limit(0), totals, "tau", [1.0], order, back, empty=0.0).collect()
    assert [(r["ap"], r["tp"], r["n"]) for r in none] == [(0.0, 0, 0)]


def test_masks_are_counted_by_unit_without_shuffling_cells(spark):
    rng = np.random.default_rng(13)
    cells = lambda: {(int(u), int(y), int(x)) for u, y, x in rng.integers(0, (6, 20, 20), (500, 3))}
    p, g = cells(), {c for c in cells() if c[0] != 5}
    frame = lambda c: spark.createDataFrame(sorted(c) * 2, "unit long, y long, x long")
    dims = spark.createDataFrame([(u, 20, 20) for u in range(8)], "unit long, h int, w int")
    counted = metrics.mask_counts(frame(p), frame(g), dims, ["unit"])
    own = lambda c, u: sum(k[0] == u for k in c)
    assert {r["unit"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in counted.collect()} == {u: (own(p & g, u), own(p - g, u), own(g - p, u), 400 - own(p | g, u)) for u in range(8)}
    assert "FullOuter" not in counted._jdf.queryExecution().toString()


def test_damping_and_proposals_stay_with_their_unit(spark):
    from chartlines.operators import labels

    rng = np.random.default_rng(14)
    spots = sorted({(int(u), int(y), int(x)) for u, y, x in rng.integers((0, -4, -4), (3, 5, 5), (120, 3))})
    score = {s: float(v) for s, v in zip(spots, rng.integers(1, 9, len(spots)) / 8)}
    cells = spark.createDataFrame([(*s, v) for s, v in score.items()] + [(0, None, 1, 0.1), (None, 0, 0, 0.1), (None, 0, 1, 0.1)], "unit long, y long, x long, score double")
    around = lambda u, y, x: [score[(u, y + a, x + b)] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (u, y + a, x + b) in score]
    top = {s: all(score[s] >= v for v in around(*s)) for s in spots}
    damped = labels.damp(cells, ties_stay=True)
    assert "Generate" not in damped._jdf.queryExecution().toString()
    found = {(r["unit"], r["y"], r["x"]): (r["top"], r["score"]) for r in damped.collect()}
    assert len(found) == len(spots) + 3 and all(found[s] == (top[s], score[s] * (1 if top[s] else 0.6)) for s in spots)
    assert all(t for (u, y, _), (t, _) in found.items() if u is None or y is None)

    juncs = [(u, i, float(x), float(y)) for u in range(3) for i, (x, y) in enumerate(rng.integers(-4, 5, (9, 2)))]
    linked = sorted({(u, *sorted(rng.choice(9, 2, replace=False).tolist())) for u in (0, 1) for _ in range(60)})
    pairs = labels.proposals(cells.dropna(), spark.createDataFrame(juncs, "unit long, junc_id long, x double, y double"), spark.createDataFrame(linked * 2, "unit long, u long, v long"), 6, 0.2, 3.0, 1.0)
    want = {}
    for u in range(3):
        best = sorted((s for s in spots if s[0] == u and top[s] and score[s] > 0.2), key=lambda s: (-score[s], s))[:6]
        near = [min(((np.hypot(s[2] - (x - 0.5), s[1] - (y - 0.5)), i) for v, i, x, y in juncs if v == u and np.hypot(s[2] - (x - 0.5), s[1] - (y - 0.5)) <= 3.0), default=(0, None))[1] for s in best]
        want |= {(u, a, b): int(None not in (near[a], near[b]) and (u, *sorted((near[a], near[b]))) in linked) for a in range(len(best)) for b in range(a + 1, len(best))}
    rows = pairs.collect()
    assert len(rows) == len(want) and {(r["unit"], r["u"], r["v"]): r["label"] for r in rows} == want and 0 < sum(want.values()) < len(want)
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", pairs._jdf.queryExecution().executedPlan().toString())
    assert keys and all("," not in k for k in keys)


def test_transport_of_many_units_side_by_side_is_that_of_each(spark):
    rng = np.random.default_rng(16)
    for n, m in ((1, 1), (1, 3), (4, 2), (5, 5), (6, 7), (14, 3)):
        a, b = rng.integers(0, 9, (20, n, 2)).astype(float), rng.integers(0, 9, (20, m, 2)).astype(float)
        assert np.allclose(N.earth_movers_of_many(a, b), [N.earth_movers(p, q) for p, q in zip(a, b)], rtol=0, atol=1e-9)
        assert np.allclose(N.sliced_distances(a, b), [N.sliced_distance(p, q) for p, q in zip(a, b)], rtol=0, atol=1e-9)
        a[3, 0, 1] = np.nan
        assert np.flatnonzero(np.isnan(N.earth_movers_of_many(a, b))).tolist() == [3]
    sets = {u: tuple(rng.uniform(0, 9, (int(k), 2)) for k in rng.integers(0, 5, 2)) for u in range(40)}
    points = lambda side: spark.createDataFrame([(u, i, *map(float, p)) for u, s in sets.items() for i, p in enumerate(s[side])] + ([(99, 0, None, 1.0)] if side else [(99, 0, 2.0, 3.0)]), "unit long, id long, x double, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r["unit"]: r for r in metrics.transport_distances(points(0), points(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(found) == {u for u, (a, b) in sets.items() if len(a) + len(b)} | {99}
    assert (found[99]["w1_y"], found[99]["w1_x"], found[99]["sliced"], found[99]["emd"]) == (2.0, None, None, None)
    for u, (a, b) in sets.items():
        want = (N.quantile_distance(a[:, 0], b[:, 0]), N.quantile_distance(a[:, 1], b[:, 1]), N.sliced_distance(a, b), N.earth_movers(a, b)) if len(a) and len(b) else (None,) * 4
        got = tuple(found[u][c] for c in ("w1_x", "w1_y", "sliced", "emd")) if u in found else (None,) * 4
        assert all(g == w if w is None else abs(g - w) < 1e-9 for g, w in zip(got, want))
