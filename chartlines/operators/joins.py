"""Joins by key, by fallback, by nearness, by interval, and stitching of crops."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlines.functions.colour import circular_distance
from chartlines.functions.geometry import distance
from chartlines.functions.keys import base_key, image_id
from chartlines.operators import _numpy as N
from chartlines.operators.units import spans, whole_units


def presence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: both, only_a or only_b."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both")
    return left.join(right, keys, "full_outer").select(*keys, state.alias("state"))


def best_row(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def hsv_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Distance of colours h, s, v in 0-1; hue goes round."""
    return F.sqrt(circular_distance(a["h"], b["h"]) ** 2 + (a["s"] - b["s"]) ** 2 + (a["v"] - b["v"]) ** 2)


#: Rows of a small side that are broadcast at a time; a larger one takes more passes over the other side.
BROADCAST_ROWS = 10_000


def in_blocks(small: DataFrame, most: int = BROADCAST_ROWS) -> list[DataFrame]:
    """small in parts of about `most` rows, each fit for a broadcast."""
    parts = max(1, -(-small.count() // most))
    of = F.pmod(F.xxhash64(*[small[c] for c in small.columns]), F.lit(parts))
    return [small] if parts == 1 else [small.where(of == i) for i in range(parts)]


def nearest_colour(rows: DataFrame, colours: DataFrame, keys: list[str], row_id: list[str], tolerance: float = 0.1) -> DataFrame:
    """rows with category, colour_distance and within_tol of the nearest colour (category, h, s, v) with the same keys; ties by name."""
    c = colours.select(*keys, "category", *(F.col(x).alias(f"c_{x}") for x in "hsv"))
    gap = hsv_distance({x: F.col(x) for x in "hsv"}, {x: F.col(f"c_{x}") for x in "hsv"})
    best = lambda met: best_row(met.withColumn("colour_distance", gap), row_id, F.asc("colour_distance"), F.asc("category"))
    bare = rows.drop("category")
    if keys:
        found = best(bare.join(c, keys))
    else:
        parts = [best(bare.join(F.broadcast(block), how="left")) for block in in_blocks(c)]
        found = parts[0] if len(parts) == 1 else best_row(reduce(DataFrame.unionByName, parts), row_id, F.asc_nulls_last("colour_distance"), F.asc("category"))
    return found.withColumn("within_tol", F.col("colour_distance") <= tolerance).drop("c_h", "c_s", "c_v")


def nearest_colour_red_edge(rows: DataFrame, colours: DataFrame, keys: list[str], row_id: list[str], tolerance: float = 0.1, low: float = 0.07, high: float = 0.9) -> DataFrame:
    """rows with category, colour_distance and within_tol of the nearest colour (category, h, s, v) with the same keys, red hues drawn to an edge.

    Hue up to low becomes the smallest hue of the colours with those keys, hue above
    high their largest; distances are plain, not round the circle. The nearest colour
    is taken beyond the tolerance too, within_tol tells. Rows whose keys have no
    colours stay out; ties by name.
    """
    c = colours.select(*keys, "category", *(F.col(x).alias(f"c_{x}") for x in "hsv"))
    edges = colours.groupBy(*keys).agg(F.min("h").alias("_low"), F.max("h").alias("_high"))
    hue = F.when(F.col("h") <= low, F.col("_low")).when(F.col("h") > high, F.col("_high")).otherwise(F.col("h"))
    gap = F.sqrt((F.col("_h") - F.col("c_h")) ** 2 + (F.col("s") - F.col("c_s")) ** 2 + (F.col("v") - F.col("c_v")) ** 2)
    met = rows.drop("category").join(edges, keys).withColumn("_h", hue).join(c, keys).withColumn("colour_distance", gap)
    found = best_row(met, row_id, F.asc_nulls_last("colour_distance"), F.asc("category"))
    return found.withColumn("within_tol", F.col("colour_distance") < tolerance).drop("c_h", "c_s", "c_v", "_h", "_low", "_high")


def with_fallback(rows: DataFrame, exact: DataFrame, general: DataFrame, keys: list[str], fewer: list[str], value: str) -> DataFrame:
    """rows with value from exact by keys, else from general by fewer keys, and matched: exact, general or null."""
    out = rows.join(exact.select(*keys, F.col(value).alias("_e")), keys, "left").join(general.select(*fewer, F.col(value).alias("_g")), fewer, "left")
    how = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_g").isNotNull(), "general")
    return out.withColumn(value, F.coalesce("_e", "_g")).withColumn("matched", how).drop("_e", "_g")


def to_axis_interval(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """segments with the crop_id of the box (image_id, crop_id, left_x, right_x) that holds both ends, moved to its left edge; segments without width are dropped."""
    wide = segments.where(F.abs(F.col("x1") - F.col("x2")) >= 1e-9).drop("crop_id")
    met = wide.join(boxes, "image_id").where((F.least("x1", "x2") >= F.col("left_x")) & (F.greatest("x1", "x2") <= F.col("right_x")))
    return met.withColumns({c: F.col(c) - F.col("left_x") for c in ("x1", "x2")}).drop("left_x", "right_x")


def overridden(rows: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows whose value is replaced where overrides has their keys."""
    return rows.join(overrides.select(*keys, F.col(value).alias("_o"), F.lit(True).alias("_has")), keys, "left").withColumn(value, F.when(F.col("_has"), F.col("_o")).otherwise(F.col(value))).drop("_o", "_has")


def segment_colour(segments: DataFrame, pixels: DataFrame) -> DataFrame:
    """segments with r, g, b: mean of the pixels at start, middle and end; outside counts as black."""
    spots = F.array(*[F.struct(F.floor(y).alias("y"), F.floor(x).alias("x")) for x, y in ((F.col("x1"), F.col("y1")), ((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2), (F.col("x2"), F.col("y2")))])
    at = segments.select("image_id", "crop_id", "unit", "line_id", F.explode(spots).alias("s")).select("image_id", "crop_id", "unit", "line_id", "s.y", "s.x")
    seen = at.join(pixels.select("image_id", "crop_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "r", "g", "b"), ["image_id", "crop_id", "y", "x"], "left")
    return seen.groupBy("unit", "line_id").agg(*(F.avg(F.coalesce(c, F.lit(0))).alias(c) for c in "rgb"))


def nearest_value(rows: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, v, row) with near, the point (keys, v, point) of the nearest v with their keys, and gap, the distance; on ties the smaller point. Null both where there is none.

    Both sides are sorted together by v: the nearest point is the last one up to a row
    or the first one from it on, so no pairs are formed.
    """
    once = points.where(F.col("v").isNotNull()).groupBy(*keys, "v").agg(F.min("point").alias("point"))
    both = rows.withColumn("p", F.lit(None).cast(_struct_of(once))).unionByName(once.select(*keys, "v", F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.struct("v", "point").alias("p")))
    upto = Window.partitionBy(*keys).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("below", F.last("p", ignorenulls=True).over(upto.orderBy("v"))).withColumn("above", F.last("p", ignorenulls=True).over(upto.orderBy(F.desc("v"))))
    of = lambda c: F.when(F.col(c).isNotNull() & F.col("v").isNotNull(), F.struct(F.abs(F.col(f"{c}.v") - F.col("v")).alias("gap"), F.col(f"{c}.point").alias("point")))
    best = seen.where(F.col("row").isNotNull()).withColumn("_b", F.least(of("below"), of("above")))
    return best.select(*keys, "v", "row", F.col("_b.point").alias("near"), F.col("_b.gap").alias("gap"))


def _struct_of(points: DataFrame):
    return points.select(F.struct("v", "point").alias("p")).schema["p"].dataType


def stitch(segments: DataFrame, crops: int, threshold: float = 5.0, keep_all: bool = False, carry: bool = False) -> DataFrame:
    """Long paths image_id, category, unit, path_id, crop_id, y1, y2, match_dist from crop 0 on.

    Each path goes on with the segment of the next crop whose start is nearest to its
    end (ties to the smaller unit and line_id), within threshold; segments may serve many
    paths. A path without one ends and is dropped, or with keep_all goes on with
    null, or with carry from its last value.
    """
    keys = ["image_id", "category"]
    first = segments.where(F.col("crop_id") == 0)
    begun = F.array(F.struct(F.lit(0).alias("crop_id"), "y1", "y2", F.lit(0.0).alias("match_dist")))
    paths = first.select(*keys, F.col("y2").alias("v"), F.struct("unit", F.col("line_id").alias("path_id"), begun.alias("parts")).alias("row"))
    for crop in range(1, crops):
        ahead = segments.where(F.col("crop_id") == crop).select(*keys, F.col("y1").alias("v"), F.struct("unit", "line_id", "y1", "y2").alias("point"))
        met = nearest_value(paths, ahead, keys).withColumn("ok", F.coalesce(F.col("gap") <= threshold, F.lit(False)))
        if not keep_all:
            met = met.where("ok")
        flat = F.when(F.lit(carry), F.col("v"))
        end, start = F.when(F.col("ok"), F.col("near.y2")).otherwise(flat), F.when(F.col("ok"), F.col("near.y1")).otherwise(flat)
        part = F.struct(F.lit(crop).alias("crop_id"), start.alias("y1"), end.alias("y2"), F.when(F.col("ok"), F.col("gap")).alias("match_dist"))
        paths = met.select(*keys, end.alias("v"), F.struct("row.unit", "row.path_id", F.concat("row.parts", F.array(part)).alias("parts")).alias("row"))
    return paths.select(*keys, "row.unit", "row.path_id", F.explode("row.parts").alias("p")).select(*keys, "unit", "path_id", "p.*")


def stitch_branching(segments: DataFrame, crops: int, threshold: float = 5.0, births: bool = True) -> DataFrame:
    """Long paths image_id, category, unit, path_id, crop_id, y1, y2: one for each segment of the last crop, named after it.

    Each segment of a crop goes on from the path of the crop before whose end is nearest
    to its start (ties to the smaller unit and line_id), within threshold; paths may branch. One without
    such a path begins a new one, null in the crops before, or is dropped without births.
    """
    keys = ["image_id", "category"]
    named = lambda crop: segments.where(F.col("crop_id") == crop)
    begun = lambda crop: F.struct(F.lit(crop).alias("crop_id"), "y1", "y2")
    paths = named(0).select(*keys, F.col("y2").alias("v"), F.struct("unit", "line_id", F.array(begun(0)).alias("parts")).alias("point"))
    for crop in range(1, crops):
        here = named(crop).select(*keys, F.col("y1").alias("v"), F.struct("unit", "line_id", begun(crop).alias("part")).alias("row"))
        met = nearest_value(here, paths, keys).withColumn("ok", F.coalesce(F.col("gap") <= threshold, F.lit(False)))
        if not births:
            met = met.where("ok")
        none = F.array(*[F.struct(F.lit(k).alias("crop_id"), F.lit(None).cast("double").alias("y1"), F.lit(None).cast("double").alias("y2")) for k in range(crop)])
        parts = F.concat(F.when(F.col("ok"), F.col("near.parts")).otherwise(none), F.array("row.part"))
        paths = met.select(*keys, F.col("row.part.y2").alias("v"), F.struct("row.unit", "row.line_id", parts.alias("parts")).alias("point"))
    return paths.select(*keys, "point.unit", F.col("point.line_id").alias("path_id"), F.explode("point.parts").alias("p")).select(*keys, "unit", "path_id", "p.*")


def with_metadata(rows: DataFrame, metadata: DataFrame, name: Column) -> DataFrame:
    """rows with the columns of metadata (base and others) of the base key of their name; null where there is none."""
    return rows.withColumn("_base", base_key(name)).join(metadata.withColumnRenamed("base", "_base"), "_base", "left").drop("_base")


def by_image_entry(rows: DataFrame, entries: DataFrame, name: Column, order: str) -> DataFrame:
    """rows with the first entry (name, order and others), by order, of the image in their name; rows without one are dropped."""
    first = best_row(entries.withColumn("_image", image_id(F.col("name"))).where(F.col("_image").isNotNull()), ["_image"], F.asc(order))
    return rows.withColumn("_image", image_id(name)).join(first.drop("name"), "_image").drop("_image")


def category_of_stroke(rows: DataFrame, colours: DataFrame, missing: str = "unknown") -> DataFrame:
    """rows (r, g, b) with the category of the first colour (place, category, r, g, b) equal to theirs, else `missing`."""
    first = colours.groupBy("r", "g", "b").agg(F.min_by("category", "place").alias("category"))
    return rows.drop("category").join(first, ["r", "g", "b"], "left").withColumn("category", F.coalesce("category", F.lit(missing)))


def category_of_midpoint(segments: DataFrame, pixels: DataFrame, ranges: DataFrame, keys: list[str], margin: int = 5) -> DataFrame:
    """segments with cluster of the first range (keys, cluster, lo, hi) that holds the hue of the pixel under their midpoint; those without one are dropped. A pixel given several times counts for its first range."""
    mid = lambda a, b: ((F.col(a).cast("long") + F.col(b).cast("long")) / 2).cast("long")
    spot = segments.withColumn("_y", mid("y1", "y2")).withColumn("_x", mid("x1", "x2"))
    seen = pixels.select(*keys, F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), "h").distinct()
    met = spot.join(seen, [*keys, "_y", "_x"]).join(ranges.select(*keys, "cluster", "lo", "hi"), keys).where(F.col("h").between(F.col("lo") - margin, F.col("hi") + margin))
    return met.groupBy(*segments.columns).agg(F.min("cluster").alias("cluster"))


def spread_ties(rows: DataFrame, keys: list[str], value: str, order: list[str], eps: float = 0.1) -> DataFrame:
    """rows with `value` moved apart where rows of the same keys have the same one: in order, by 0, eps, -eps, 2 eps, -2 eps, ...; nulls stay."""
    place = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)) - 1
    step = F.floor((place + 1) / 2) * F.when(place % 2 == 1, F.lit(eps)).otherwise(F.lit(-eps))
    return rows.withColumn(value, F.col(value) + step)


def stitch_with_limit(segments: DataFrame, threshold: float = 5.0, max_reuse: int = 1, eps: float = 0.1) -> DataFrame:
    """Paths that always take the nearest next segment still allowed (used fewer than max_reuse times), with match_ok and match_dist.

    If all are used up the nearest one is taken all the same, match_ok false. Ends that
    are equal are spread by multiples of eps (see spread_ties), for the choice and
    match_dist only. Paths
    choose in order of their first segment's y1 and line_id. Crops keep their own
    numbers; a gap stays a gap.
    """
    rows = segments.withColumn("unit_key", F.concat_ws("|", "image_id", "category")).select("unit_key", "image_id", "category", "crop_id", "line_id", "y1", "y2")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        crop, line, y1, y2 = (rows[c].tolist() for c in ("crop_id", "line_id", "y1", "y2"))
        starts, out = rows["y1"].to_numpy(float), []
        for a, b in spans(rows["unit_key"].to_numpy()):
            ends: list[float] | None = None
            for s, e in N.runs(crop, a, b):
                if ends is None:
                    first = sorted(range(s, e), key=lambda i: (y1[i] != y1[i], y1[i] if y1[i] == y1[i] else 0.0, line[i]))
                    ends = [y2[i] for i in first]
                    out += [(i, p, True, 0.0) for p, i in enumerate(first)]
                    continue
                taken = N.take_nearest(y1[s:e] if e - s <= N.FEW else starts[s:e], N.spread_few_ties(ends, eps), max_reuse)
                out += [(s + j, p, free and gap <= threshold, gap) for p, (j, free, gap) in enumerate(taken)]
                ends = [y2[s + j] for j, _, _ in taken]
        at, p, ok, dist = zip(*out)
        return rows.iloc[np.array(at)][["image_id", "category", "crop_id", "y1", "y2"]].assign(path_id=np.array(p), match_ok=np.array(ok), match_dist=np.array(dist))

    return whole_units(rows, ["crop_id", "line_id"], work, "image_id long, category string, crop_id int, y1 double, y2 double, path_id long, match_ok boolean, match_dist double", key="unit_key").select(
        "image_id", "category", "path_id", "crop_id", "y1", "y2", "match_ok", "match_dist"
    )


def stitch_global(segments: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Lines stitched end to start by distance in global coordinates, each segment used once; leftovers begin new lines: image_id, category, path_id, step, x1, y1, x2, y2."""
    rows = segments.withColumn("unit_key", F.concat_ws("|", "image_id", "category")).select("unit_key", "image_id", "category", "crop_id", "unit", "line_id", "x1", "y1", "x2", "y2")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        crop, x1, y1, x2, y2 = (rows[c].tolist() for c in ("crop_id", "x1", "y1", "x2", "y2"))
        starts, out = rows[["x1", "y1"]].to_numpy(float), []
        for a, b in spans(rows["unit_key"].to_numpy()):
            ends: list[tuple[float, float]] = []
            steps: list[int] = []
            for s, e in N.runs(crop, a, b):
                points = list(zip(x1[s:e], y1[s:e])) if e - s <= N.FEW else starts[s:e]
                taken = N.take_free_points(points, ends, threshold)
                for p, j in taken:
                    steps[p] += 1
                    ends[p] = (x2[s + j], y2[s + j])
                    out.append((s + j, p, steps[p]))
                used = {j for _, j in taken}
                for i in range(s, e):
                    if i - s not in used:
                        out.append((i, len(ends), 0))
                        ends.append((x2[i], y2[i]))
                        steps.append(0)
        at, p, n = (np.array(v) for v in zip(*out))
        return rows.iloc[at][["image_id", "category", "x1", "y1", "x2", "y2"]].assign(path_id=p, step=n)

    return whole_units(rows, ["crop_id", "unit", "line_id"], work, "image_id long, category string, x1 double, y1 double, x2 double, y2 double, path_id long, step int", key="unit_key").select(
        "image_id", "category", "path_id", "step", "x1", "y1", "x2", "y2"
    )


def nearest_point(rows: DataFrame, points: DataFrame, key: str, row_id: list[str], cap: float | None = None) -> DataFrame:
    """rows (x, y) with the distance to the nearest point (px, py) with their key; cap where there is none or beyond it."""
    near = rows.join(points.select(key, "px", "py"), key, "left").groupBy(key, *row_id).agg(F.min(distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).alias("d"))
    return near if cap is None else near.withColumn("d", F.least(F.coalesce("d", F.lit(cap)), F.lit(cap)))
