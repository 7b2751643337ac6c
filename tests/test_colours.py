"""k found on planted colours, centres of a reference crop, silhouettes and nearest centres against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlines.operators import _numpy as N
from chartlines.operators import palettes as P


def planted(rng, k, n, image, crop, spread=0.0):
    base = [(220, 30, 30), (30, 200, 60), (40, 60, 230), (230, 200, 20), (200, 30, 200)][:k]
    return [(image, crop, *(int(np.clip(round(v + rng.normal(scale=spread)), 0, 255)) for v in base[rng.integers(k)])) for _ in range(n)]


@pytest.mark.parametrize("space", ["ab", "lab", "rgb"])
def test_k_of_planted_colours_is_found_on_the_fullest_crop(spark, space):
    rng = np.random.default_rng(1)
    rows = planted(rng, 4, 900, 1, 2) + planted(rng, 2, 300, 1, 1) + planted(rng, 3, 500, 2, 5) + planted(rng, 3, 500, 2, 7) + planted(rng, 1, 20, 2, 9)
    pixels = spark.createDataFrame(rows, "image_id long, crop_id int, r int, g int, b int")
    assert [tuple(r) for r in P.reference_crop(pixels).orderBy("image_id").collect()] == [(1, 2, 900), (2, 5, 500)]
    found = P.categories_from_reference(pixels, space)
    assert {(r["image_id"], r["k"]) for r in found.collect()} == {(1, 4), (2, 3)}
    # a crop that was not learnt from: each planted colour has a centre of its own
    assert found.where("image_id = 1 and crop_id = 1").select("centre_no").distinct().count() == 2
    assert found.agg(F.sum("n")).first()[0] == len(rows)


def test_silhouette_and_centres_against_loops(spark):
    rng = np.random.default_rng(2)
    x, n = rng.normal(size=(60, 5)) + rng.integers(0, 3, 60)[:, None] * 4, rng.integers(1, 5, 60).astype(float)
    of = rng.integers(0, 3, 60)
    many = np.repeat(np.arange(60), n.astype(int))
    total = 0.0
    for i in many:
        mean = {c: [np.linalg.norm(x[i] - x[j]) for j in many if of[j] == c] for c in range(3)}
        inside = sum(mean[of[i]]) / max(len(mean[of[i]]) - 1, 1)
        outside = min(np.mean(mean[c]) for c in range(3) if c != of[i])
        total += (outside - inside) / max(outside, inside)
    assert abs(N.silhouette(x, n, of, block=700) - total / len(many)) < 1e-9
    frame = spark.createDataFrame([(1, v.tolist(), float(w)) for v, w in zip(x, n)] + [(2, [1.0, 2.0], 3.0)], "g long, v array<double>, n double")
    centres = P.feature_centres(frame, ["g"], 3).collect()
    assert len(centres) == 4 and abs(sum(r["n"] for r in centres) - n.sum() - 3) < 1e-9
    best = min(N.settle(x, n, x[rng.choice(60, 3, replace=False)], 50)[2] for _ in range(40))
    assert centres[0]["inertia"] <= best * 1.001 or centres[-1]["inertia"] <= best * 1.001
    near = P.nearest_centres(frame.where("g = 1"), spark.createDataFrame([(r["g"], r["centre_no"], r["centre"]) for r in centres], "g long, centre_no int, centre array<double>"), ["g"]).collect()
    c = np.array([r["centre"] for r in sorted((r for r in centres if r["g"] == 1), key=lambda r: r["centre_no"])])
    assert all(r["centre_no"] == int(((np.array(r["v"]) - c) ** 2).sum(1).argmin()) for r in near)


def test_hues_wrap_in_their_space(spark):
    frame = spark.createDataFrame([(255, 0, 8), (255, 8, 0), (0, 255, 0)], "r int, g int, b int").select(P.features("hue").alias("v"))
    a, b, c = (np.array(r["v"]) for r in frame.collect())
    assert np.linalg.norm(a - b) < 0.1 < 1 < np.linalg.norm(a - c)


def test_red_edges_files_and_strong_red(spark):
    from chartlines.functions import colour as C
    from chartlines.operators import joins as J

    colours = spark.createDataFrame([(1, "a", 0.1, 1.0, 1.0), (1, "b", 0.8, 1.0, 1.0)], "image_id long, category string, h double, s double, v double")
    rows = spark.createDataFrame([(1, 0, 0.01, 1.0, 1.0), (1, 1, 0.95, 1.0, 1.0), (1, 2, 0.45, 1.0, 1.0), (1, 3, None, 1.0, 1.0), (2, 4, 0.5, 1.0, 1.0)], "image_id long, line_id long, h double, s double, v double")
    got = {r["line_id"]: (r["category"], r["within_tol"]) for r in J.nearest_colour_red_edge(rows, colours, ["image_id"], ["line_id"]).collect()}
    assert got == {0: ("a", True), 1: ("b", True), 2: ("a", False), 3: ("a", None)}  # 2 ties, 4 has no colours

    cats = spark.createDataFrame([(i, c) for i in (1, 2, 3, 4) for c in ("x", "y", "z")], "image_id long, category string")
    own = spark.createDataFrame([(1, "x", 1.25, 2.0, None), (1, "unused", 0.0, 0.0, 0.0)], "image_id long, category string, h double, s double, v double")
    dominant = spark.createDataFrame([("2.png", "cat10", 0.9, 1.0, 1.0), ("2.png", "cat2", 0.2, -1.0, 1.0), ("r2.png", "cat1", 0.5, 1.0, 1.0), ("r3.png", "odd", None, 1.0, 1.0), ("r1.png", "cat1", 0.1, 1.0, 1.0)], "file string, name string, h double, s double, v double")
    got = {(r["image_id"], r["category"]): (r["h"], r["s"], r["v"], r["taken_from"]) for r in C.colours_of_files(cats, own, dominant).collect()}
    first, second = (0.2, 0.0, 1.0, "2.png"), (0.9, 1.0, 1.0, "2.png")
    assert got == {(1, "x"): (0.25, 1.0, 1.0, "own"), (2, "x"): first, (2, "y"): second, (2, "z"): first, **{(3, c): (0.0, 1.0, 1.0, "r3.png") for c in "xyz"}}

    pixels = spark.createDataFrame([(2, 200, 200), (175, 200, 200), (2, 70, 200), (90, 200, 200), (90, 40, 200)], "h int, s int, v int")
    assert sorted(tuple(r) for r in C.coloured(pixels).collect()) == [(2, 70, 200), (90, 200, 200)] and C.coloured(pixels, drop_red=False).count() == 4


def test_density_clusters_hold_no_list_of_neighbours():
    import tracemalloc

    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.uniform(0, 40, (9_000, 3))), [[200.0, 0, 0], [203, 0, 0]]])
    n = np.ones(len(x))
    tracemalloc.start()
    of = N.density_clusters(x, n, 16.0, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and of[:9_000].tolist() == [0] * 9_000 and of[9_000:].tolist() == [-1, -1]


def test_density_clusters_against_loops_at_every_density():
    rng = np.random.default_rng(6)
    for t in range(12):
        x = np.round(rng.uniform(0, (30, 80, 200)[t % 3], (150, 3)))
        n, least = rng.integers(1, 6, 150).astype(float), (1, 12, 40, 90)[t % 4]
        gap = ((x[:, None] - x[None]) ** 2).sum(2)
        core = ((gap <= 64) * n).sum(1) >= least
        want, number = np.full(150, -1), 0
        for i in np.flatnonzero(core):
            if want[i] < 0:
                todo = [i]
                while todo:
                    want[todo] = number
                    todo = np.flatnonzero(core & (want < 0) & (gap[todo] <= 64).any(0)).tolist()
                number += 1
        for i in np.flatnonzero(~core):
            near = [(gap[i, j], j) for j in np.flatnonzero(core) if gap[i, j] <= 64]
            want[i] = want[min(near)[1]] if near else -1
        assert N.density_clusters(x, n, 8.0, least, block=(40, 1 << 20)[t % 2]).tolist() == want.tolist()


def test_centres_alone_are_those_of_judged_ones(spark):
    rng = np.random.default_rng(8)
    rows = [(g, *map(int, c), int(n)) for g in range(3) for c, n in zip(np.unique(rng.integers(0, 256, (400, 3)), axis=0), rng.integers(1, 9, 400))] + [(9, 1, 2, 3, 4)]
    colours = spark.createDataFrame(rows, "g long, r int, g2 int, b int, n long").withColumnRenamed("g", "image").withColumnRenamed("g2", "g")
    both = P.colour_centres(colours, ["image"], 4).collect()
    alone = P.colour_centres(colours, ["image"], 4, judged=False)
    assert sorted(map(tuple, alone.collect())) == sorted(tuple(r)[:6] for r in both) and len(both) == 13
    assert alone.columns == ["image", "centre_no", "r", "g", "b", "n"]
    # a large group: its silhouette would take billions of distances
    many = spark.range(400_000).selectExpr("0L image", "cast(id % 256 as int) r", "cast(id div 256 % 256 as int) g", "cast(id div 65536 as int) b", "id % 7 + 1 n")
    assert P.colour_centres(many, ["image"], 3, judged=False).agg(F.sum("n")).first()[0] == many.agg(F.sum("n")).first()[0]


def test_silhouette_is_worked_out_by_parts_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(P, "PART", 37)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 3, (150, 2)) + rng.integers(0, 3, (150, 1)) * 9
    rows = [(g, v.tolist(), float(n)) for g in (None, 1) for v, n in zip(np.vstack([x, x[:20]]) + (g or 0), rng.integers(1, 4, 170))]
    found = {r["g"]: r for r in P.feature_centres(spark.createDataFrame(rows, "g int, v array<double>, n double"), ["g"], 3).collect()}
    assert set(found) == {None, 1}
    for g, row in found.items():
        v, n = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        order = np.lexsort((*v.T[::-1], -n))
        v, n = v[order], n[order]
        of = N.separate(v, n, 3, 40)[1]
        far, mass = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), np.bincount(of, n)
        total = 0.0
        for i in range(len(v)):
            mean = [(far[i] * n)[of == c].sum() / (mass[c] - (c == of[i])) for c in range(3)]
            best = min(m for c, m in enumerate(mean) if c != of[i])
            total += n[i] * (best - mean[of[i]]) / max(best, mean[of[i]])
        assert abs(row["silhouette"] - total / n.sum()) < 1e-9


def test_large_groups_come_whole_in_their_own_types(spark):
    from chartlines.operators.units import each_large_group

    rows = [(g, s, i, [float(i), 2.0]) for g, s, n in ((None, "a", 5), (1, "a", 23), (1, None, 3), (2, "b", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g long, s string, i int, v array<double>").repartition(3)

    def run(group: dict) -> dict:
        assert set(group) == {"i", "v"} and group["i"].dtype == np.int32 and group["v"].shape == (len(group["i"]), 2)
        assert (np.diff(group["i"]) < 0).all() and (group["v"][:, 0] == group["i"]).all()
        return {"n": [len(group.pop("i"))]}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = sorted(map(tuple, each_large_group(frame, ["g", "s"], [F.desc("i")], run, "n long").collect()), key=str)
        assert each_large_group(frame.limit(0), ["g"], ["i"], run, "n long").collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted([(None, "a", 5), (1, "a", 23), (1, None, 3), (2, "b", 1)], key=str)


def test_means_and_clusters_hold_little_more_than_their_points():
    import tracemalloc

    rng = np.random.default_rng(6)
    x, n = rng.normal(size=(200_000, 2)), np.ones(200_000)
    centres = N.spread_seeds(x, n, 6, 0)
    tracemalloc.start()
    try:
        _, of, inertia = N.settle(x, n, centres, 2)
        N.separation(x, n, centres, of)
        assert tracemalloc.get_traced_memory()[1] < 14e6
    finally:
        tracemalloc.stop()
    assert abs(inertia - sum(((x[of == c] - N.settle(x, n, centres, 2)[0][c]) ** 2).sum() for c in range(6))) < 1e-6 * inertia
    # whole numbers are clustered as they are; cells far apart are not looked at one by one
    grid = np.stack(np.meshgrid(*[np.arange(0, 60, 2)] * 3), -1).reshape(-1, 3).astype(np.int16)
    of = N.density_clusters(np.concatenate([grid, grid + 200]), np.ones(2 * len(grid)), 24.0, 20)
    assert (of[: len(grid)] == 0).all() and (of[len(grid) :] == 1).all()
