"""Tables to axes and segments and back: normalising, folding, ticks, splits, samples, clusters of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlines.sources.shared import numbered


def column_stats(cells: DataFrame) -> DataFrame:
    """dataset_id, column_name, min, max, mean, sequential: the last is the running half mean over categories in order of name."""
    by_category = cells.groupBy("dataset_id", "column_name", "category").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("s"), F.count("value").alias("n"))
    means = F.array_sort(F.collect_list(F.struct("category", (F.col("s") / F.col("n")).alias("m"))))
    half = F.aggregate(means, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x["m"]).otherwise((a + x["m"]) / 2))
    return by_category.groupBy("dataset_id", "column_name").agg(F.min("lo").alias("min"), F.max("hi").alias("max"), (F.sum("s") / F.sum("n")).alias("mean"), half.alias("sequential"))


def category_stats(cells: DataFrame, height: float = 300.0) -> DataFrame:
    """Mean, population deviation and mean +- deviation of the normalised values' pixel positions, by category and column."""
    placed = pixel_positions(normalise(cells), height)
    out = placed.groupBy("dataset_id", "category", "column_name").agg(F.avg("position").alias("mean"), F.stddev_pop("position").alias("std"))
    return out.withColumn("lower", F.col("mean") - F.col("std")).withColumn("upper", F.col("mean") + F.col("std"))


def normalise(cells: DataFrame, reverse: bool = False, by: tuple[str, ...] = ("dataset_id", "column_name")) -> DataFrame:
    """cells with norm: value scaled to 0-1 between the group's extremes, from 1 to 0 with reverse; null for a constant group."""
    ends = cells.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    up = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return cells.join(ends, list(by)).withColumn("norm", 1 - up if reverse else up).drop("_lo", "_hi")


def pixel_positions(normed: DataFrame, height: float = 300.0) -> DataFrame:
    return normed.withColumn("position", height - F.col("norm") * height)


def fold(wide: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Long form: keys, column_name, value."""
    return wide.unpivot(list(keys), columns, "column_name", "value")


def spread(cells: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Wide form over known columns; missing values are null."""
    return cells.groupBy(*keys).pivot("column_name", columns).agg(F.first("value"))


def row_segments(wide: DataFrame, columns: list[str], width: float = 224.0, *keys: str) -> DataFrame:
    """keys, crop_id, x1, y1, x2, y2: each row's polyline cut between neighbouring axes, in order of column name; no shuffle."""
    names = sorted(columns)
    pairs = F.array(*[F.struct(F.lit(i).alias("crop_id"), F.col(a).cast("double").alias("y1"), F.col(b).cast("double").alias("y2")) for i, (a, b) in enumerate(zip(names, names[1:]))])
    return wide.select(*keys, F.explode(pairs).alias("s")).select(*keys, "s.crop_id", F.lit(0.0).alias("x1"), "s.y1", F.lit(width).alias("x2"), "s.y2")


def neighbouring_axes(axes: DataFrame, min_width: float = 0.0) -> DataFrame:
    """image_id, crop_id, left_x, right_x: boxes between an image's neighbouring axes, wider than min_width, numbered from 1."""
    w = Window.partitionBy("image_id").orderBy("x")
    boxes = axes.select("image_id", F.col("x").alias("left_x"), F.lead("x").over(w).alias("right_x")).where(F.col("right_x") - F.col("left_x") > min_width)
    return boxes.withColumn("crop_id", F.row_number().over(Window.partitionBy("image_id").orderBy("left_x")))


def ticks(cells: DataFrame, n: int = 8) -> DataFrame:
    """dataset_id, column_name, tick, label: n values evenly spaced from the column's minimum to its maximum, with one digit."""
    ends = cells.groupBy("dataset_id", "column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = ends.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("tick") / (n - 1)
    return at.select("dataset_id", "column_name", "tick", value.alias("value"), F.format_string("%.1f", value).alias("label"))


def ground_truth(wide: DataFrame, columns: list[str], *keys: str, height: float = 300.0, most: int = 10_000) -> DataFrame:
    """dataset_id, part, lines: map crop -> category -> array of segments, computed from its table; one record for each data set of up to `most` rows, larger ones in parts of about `most` rows each."""
    ends = wide.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_rows"), *(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    up = lambda c: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
    part = F.pmod(F.xxhash64("row_id"), F.ceil(F.col("_rows") / most)).alias("part")
    placed = wide.join(ends, "dataset_id").select("dataset_id", part, "category", *((height - up(c) * height).alias(c) for c in columns))
    segments = row_segments(placed, columns, 224.0, "dataset_id", "part", "category")
    lines = segments.groupBy("dataset_id", "part", "crop_id", "category").agg(F.sort_array(F.collect_list(F.array("x1", "y1", "x2", "y2"))).alias("lines"))
    by_crop = lines.groupBy("dataset_id", "part", "crop_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "lines"))).alias("m"))
    return by_crop.groupBy("dataset_id", "part").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("crop_"), F.col("crop_id") + 1), "m"))).alias("lines"))


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """value, n, share of each value, most frequent first."""
    n = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), how="left").select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def duplicate_offsets(rows: DataFrame, keys: list[str], value: str, eps: float = 0.01, centred: bool = False) -> DataFrame:
    """rows with offset for equal values of a group: 0, +eps, -eps, +2 eps ..., or evenly around 0 with centred; ordered by row_id."""
    w = Window.partitionBy(*keys, value)
    k, n = F.row_number().over(w.orderBy("row_id")) - 1, F.count(F.lit(1)).over(w)
    step = F.ceil(k / 2.0) * F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    return rows.withColumn("offset", (k - (n - 1) / 2.0) * eps if centred else F.when(k == 0, 0.0).otherwise(step * eps))


def split_by_group(rows: DataFrame, group: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """rows with part, train or valid: whole groups, the first floor(share * n) in order of a hash are train.

    Places come from a count of the hash's upper bits, so no task ranks all groups:
    only the bin that holds the border is ranked.
    """
    groups = rows.select(group).distinct().withColumn("_h", F.xxhash64(group, F.lit(seed))).withColumn("_bin", F.shiftright("_h", 52))
    bins = groups.groupBy("_bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = bins.select("_bin", before.alias("_before"), F.floor(total * share).alias("_take"))  # 4096 bins at most
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_h", group))
    marked = groups.join(F.broadcast(placed), "_bin").withColumn("part", F.when(rank + F.col("_before") <= F.col("_take"), "train").otherwise("valid"))
    return rows.join(marked.select(group, "part"), group)


def top_n(rows: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def gap_clusters(rows: DataFrame, key: str, value: str, eps: float) -> DataFrame:
    """key, cluster, mean, n: sorted values cut where the gap to the value before exceeds eps."""
    w = Window.partitionBy(key).orderBy(value)
    fresh = F.coalesce((F.col(value) - F.lag(value).over(w) > eps).cast("int"), F.lit(0))
    numbered = rows.select(key, value).withColumn("_f", fresh).withColumn("cluster", F.sum("_f").over(w))
    return numbered.groupBy(key, "cluster").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def spaced_values(rows: DataFrame, key: str, value: str, gap: float) -> DataFrame:
    """key, value: smallest value first, each later one only if more than gap above the last kept."""
    keep = F.aggregate(F.array_sort(F.collect_set(value)), F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(F.concat(F.array(F.lit(0.0)), a), -1) > gap), F.concat(a, F.array(x))).otherwise(a))
    return rows.groupBy(key).agg(keep.alias("kept")).select(key, F.explode("kept").alias("value"))


def style_draw(plots: DataFrame, key: str, choices: DataFrame, seed: int = 0) -> DataFrame:
    """key, value drawn by the weights of choices (value, weight: the options of a style, one row each) from a hash of key that any engine can repeat: the first 12 digits of md5(key:seed)."""
    options = choices.agg(F.array_sort(F.collect_list(F.struct("value", F.col("weight").cast("double").alias("weight")))).alias("_o"))
    total = F.aggregate("_o", F.lit(0.0), lambda a, o: a + o["weight"])
    pick = F.aggregate(
        "_o",
        F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast(choices.schema["value"].dataType).alias("value"), F.lit(False).alias("done")),
        lambda a, o: F.when(a["done"], a).otherwise(F.struct((a["sum"] + o["weight"]).alias("sum"), o["value"].alias("value"), (F.col("_u") * F.col("_t") < a["sum"] + o["weight"]).alias("done"))),
        lambda a: a["value"],
    )
    u = md5_share(F.col(key), seed)
    return plots.select(key, u.alias("_u")).join(F.broadcast(options.withColumn("_t", total)), how="left").select(key, pick.alias("value"))


def distinct_draw(plots: DataFrame, key: str, n: Column, pool: int = 30, seed: int = 0) -> DataFrame:
    """key, place, hue: n hues drawn without replacement from i / pool, in the order of md5(key:seed:i)."""
    named = lambda i: F.struct(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), i.cast("string"))).alias("m"), i.alias("i"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(pool - 1)), named))
    return plots.select(key, F.posexplode(F.slice(order, F.lit(1), n)).alias("place", "d")).select(key, "place", (F.col("d.i") / F.lit(float(pool))).alias("hue"))


def md5_share(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 12 hex digits of md5(key:seed)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def distinct_frames(frames: DataFrame, key: str, gap: float = 0.5) -> DataFrame:
    """key, x, y of frames in order of x and y, each dropped that lies within gap of the last kept one both ways."""

    def fold(kept: Column, f: Column) -> Column:
        last = F.element_at(kept, -1)
        far = (F.abs(f["x"] - last["x"]) > gap) | (F.abs(f["y"] - last["y"]) > gap)
        return F.when((F.size(kept) == 0), F.array(f)).when(far, F.array_append(kept, f)).otherwise(kept)

    rows = frames.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("fs"))
    return rows.select(key, F.explode(F.aggregate("fs", F.array().cast("array<struct<x:double,y:double>>"), fold)).alias("f")).select(key, "f.x", "f.y")


def first_share(rows: DataFrame, key: str, share: float = 1.0) -> DataFrame:
    """rows of the first share of distinct keys, in order of key; the number is rounded down."""
    names = numbered(rows.select(key).where(F.col(key).isNotNull()).distinct(), "_place", F.col(key))
    n = names.count()
    return rows.join(names.where(F.col("_place") <= int(n * share)).select(key), key, "left_semi")
