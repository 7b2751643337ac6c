"""NPZ units, SVG matrices and axes, CSV headers: written, read back, and on odd files."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlines.sources import files, npz, svg


def units(spark, rows):
    return spark.createDataFrame(rows, npz.SCHEMA)


def test_npz_units_come_back_as_written(spark, tmp_path):
    npz.register(spark)
    rows = [
        ("a", [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]], [0.5, 0.25], 4, 6, [(1, 2), (3, 5), (9, 9)], [[1.0, 2.0], [3.0, 4.0]], [(0, 1)], []),
        ("b", [], [], None, None, None, None, None, None),
        ("c", None, None, 2, 2, [], None, None, [(0, 3)]),
    ]
    folder = f"file://{tmp_path}/units"
    units(spark, rows).repartition(3).write.format("npz_units").mode("append").save(folder)
    read = spark.read.format("npz_units").option("task_bytes", "1").load(folder)
    assert read.rdd.getNumPartitions() == 3
    got = {r["name"]: r for r in read.collect()}
    assert got["a"]["lines"] == rows[0][1] and got["a"]["score"] == [0.5, 0.25] and got["a"]["junctions"] == [[1.0, 2.0], [3.0, 4.0]]
    assert sorted((s["y"], s["x"]) for s in got["a"]["mask"]) == [(1, 2), (3, 5)] and [(p["u"], p["v"]) for p in got["a"]["linked"]] == [(0, 1)] and got["a"]["unlinked"] == []
    assert got["b"]["lines"] == [] and got["b"]["mask"] is None
    assert got["c"]["lines"] is None and got["c"]["mask"] == [] and (got["c"]["h"], got["c"]["w"]) == (2, 2)
    np.savez(tmp_path / "units" / "d.npz", lpos=np.array([[[1.0, 2.0, 0.0], [3.0, 4.0, 0.0]]]))
    assert {r["name"]: r["lines"] for r in spark.read.format("npz_units").load(folder).collect()}["d"] == [[2.0, 1.0, 4.0, 3.0]]


def test_npz_units_in_archives_come_back_in_small_batches(spark, tmp_path, monkeypatch):
    npz.register(spark)
    folder = f"file://{tmp_path}/units"
    rows = [(f"u{i}", [[1.0 * i, 2.0, 3.0, 4.0]] * (i % 3) if i % 5 else None, [0.5] * (i % 3) if i % 5 else None, 8, 8, [(i % 8, 3), (1, i % 7)] if i % 4 else None, [[1.0, 2.0]] if i % 2 else None, [(0, i)] if i % 2 else [], None) for i in range(60)]
    units(spark, rows).repartition(2).write.format("npz_units").option("archive", "true").mode("append").save(folder)
    assert len(list((tmp_path / "units").glob("*.npz.tar"))) == 2 and not list((tmp_path / "units").glob("*.npz"))
    got = {r["name"]: r for r in spark.read.format("npz_units").load(folder).collect()}
    assert len(got) == 60
    for name, lines, score, h, w, mask, junctions, linked, unlinked in rows:
        r = got[name]
        assert (r["lines"], r["score"], r["h"], r["w"], r["junctions"]) == (lines, score, h, w, junctions)
        assert sorted((s["y"], s["x"]) for s in r["mask"]) == sorted(set(mask or [])) and [(p["u"], p["v"]) for p in r["linked"]] == linked and r["unlinked"] is None
    # what a task hands on is bounded by bytes, not by rows
    monkeypatch.setattr(npz, "BATCH_BYTES", 64)
    reader = npz.NpzReader(folder, 1 << 20)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in batches) == 60 and max(b.num_rows for b in batches) <= 4


def test_npz_files_are_published_only_on_success(spark, tmp_path):
    npz.register(spark)
    folder = f"file://{tmp_path}/units"
    units(spark, [("old", [], [], None, None, None, None, None, None)]).write.format("npz_units").mode("append").save(folder)
    bad = units(spark, [(f"n{i}", [[1.0, 2.0, 3.0, 4.0]], [1.0], None, None, None, None, None, None) for i in range(20)]).repartition(4)
    bad = bad.withColumn("h", F.when(F.col("name") == "n7", F.raise_error(F.lit("broken row"))).otherwise(F.col("h")).cast("int"))
    with pytest.raises(Exception):
        bad.write.format("npz_units").mode("append").save(folder)
    assert [r["name"] for r in spark.read.format("npz_units").load(folder).collect()] == ["old"]


def test_transforms_units_and_paths():
    m = svg.matrix("translate(10, 5) scale(2) rotate(90) matrix(1,0,0,1,3,4) skewX(45) nothing(1)")
    p = np.array([1.0, 2.0])
    p = np.array([p[0] + p[1], p[1]])  # skewed
    p = p + (3, 4)
    p = np.array([-p[1], p[0]]) * 2 + (10, 5)
    assert np.allclose(m @ (1, 2, 1), (*p, 1))
    turned = svg.matrix("rotate(180 5 5)") @ (1, 1, 1)
    assert np.allclose(turned, (9, 9, 1))
    assert math.isclose(svg.pixels("25.4mm"), 96) and svg.pixels("72pt") == 96 and svg.pixels("10%") is None and svg.pixels(None) is None
    assert svg.path_pieces("M0 0 10,0 v5 h-10 z m1 1 l2-1") == [(0, 0, 10, 0), (10, 0, 10, 5), (10, 5, 0, 5), (0, 5, 0, 0), (1, 1, 3, 0)]
    assert svg.path_pieces("M0 0 C1 1 2 2 3 3 q1 1 2 0") == [(0, 0, 3, 3), (3, 3, 5, 3)] and svg.path_pieces("") == []


def test_axes_and_crops_of_a_chart(spark, tmp_path):
    rule = lambda x, y2=50: f'<line aria-roledescription="rule mark" x1="{x}" x2="{x}" y1="0" y2="{y2}"/>'
    mark = lambda a, b, c: f'<path aria-roledescription="line mark" style="fill:none; stroke: rgb({c})" d="M{a} L{b}"/>'
    body = rule(0) + rule(0.2) + rule(50) + rule(70, 0) + mark("0,1", "50,9", "1, 2, 3") + mark("0.1,2", "50.05,8", "9,9,9") + mark("0,5", "0,9", "1,2,3")
    text = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="10 0 100 100" width="200px" height="100"><g aria-roledescription="group mark" transform="translate(10,4)">{body}</g></svg>'
    (tmp_path / "a.svg").write_text(text)
    (tmp_path / "b.svg").write_text("<svg")
    pieces = svg.read_svg_segments(spark, str(tmp_path))
    assert [r["file"][-5:] for r in pieces.where("error is not null").collect()] == ["b.svg"]
    assert [(r["axis_no"], r["x"]) for r in svg.axes_of_rules(pieces).orderBy("axis_no").collect()] == [(0, 0.0), (1, 100.0)]
    axes = svg.axes_of_ends(pieces, 0.25)
    assert [round(r["x"], 4) for r in axes.orderBy("axis_no").collect()] == [0.05, 100.05]
    crops = svg.chart_crops(pieces, axes, spark.createDataFrame([("one", 1, 2, 3)], "category string, r int, g int, b int"), from_top=True, slack=0.3)
    got = sorted(tuple(r) for r in crops.select("crop_id", "category", "x1", "y1", "x2", "y2").collect())
    assert got == [(1, "one", -0.05, 1.0, 99.95, 9.0), (1, "unknown", 0.15, 2.0, 100.05, 8.0)]


def test_csv_sets_with_their_own_headers(spark, tmp_path):
    (tmp_path / "set_1.csv").write_text('a,"b, c",Category\n1,2.5,x\nn/a,4,y\n')
    (tmp_path / "set_2.csv").write_text("﻿Category,d\nz,7\n", encoding="utf-8")
    (tmp_path / "set_3.csv").write_text("")
    (tmp_path / "set_4.csv").write_text("only,a,header\n")
    got = sorted((r["dataset_id"], r["column"], r["value"], r["number"], r["category"]) for r in files.read_csv_cells(spark, str(tmp_path)).collect())
    assert got == sorted([(1, "a", "1", 1.0, "x"), (1, "b, c", "2.5", 2.5, "x"), (1, "a", "n/a", None, "y"), (1, "b, c", "4", 4.0, "y"), (2, "d", "7", 7.0, "z")])
    assert files.csv_headers(spark, str(tmp_path)).count() == 3  # Spark lists no empty file


def test_charts_written_many_in_a_file_read_as_single_files(spark, tmp_path):
    text = '<svg viewBox="0 0 10 10" width="20" height="20"><g transform="translate({i},1) rotate(90)"><line x1="{i}" x2="3" y2="4"/>\n<path d="M0 0 1 2"/></g></svg>'
    charts = {f"image_id={i}": text.replace("{i}", str(i)) if i % 7 else "no chart" for i in range(300)}
    (tmp_path / "single").mkdir()
    for name, chart in charts.items():
        (tmp_path / "single" / f"{name}.svg").write_text(chart)
    svg.write_svg_lines(spark.createDataFrame(list(charts.items()), "file string, text string").coalesce(3), str(tmp_path / "lines"))
    assert len(list((tmp_path / "lines").glob("part-*"))) <= 3
    rows = lambda pieces: sorted((r["file"].rsplit("/", 1)[-1].removesuffix(".svg"), *map(str, r[1:])) for r in pieces.collect())
    found = rows(svg.read_svg_lines(spark, str(tmp_path / "lines")))
    assert len(found) == 2 * 257 + 43 and found == rows(svg.read_svg_segments(spark, str(tmp_path / "single")))
