"""Hue histograms and what is found in them: ranges, peaks, thresholds; lines by votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartlines.operators import _numpy as N
from chartlines.operators.units import each_group

HUES = 180


def hue_histogram(pixels: DataFrame, keys: list[str], bins: int = HUES, weight: str | None = None, dense: bool = False) -> DataFrame:
    """keys, bin, n of hues in 0-179; n adds up weight if given; dense has a row for every bin."""
    counted = pixels.groupBy(*keys, F.floor(F.col("h") * bins / HUES).cast("int").alias("bin")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    if not dense:
        return counted
    every = counted.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counted, [*keys, "bin"], "left").fillna(0, ["n"])


def hue_ranges(histogram: DataFrame, keys: list[str], eps: int = 5, least: int = 200) -> DataFrame:
    """keys, cluster, lo, hi, centre, n: density clusters of hues, exact on the histogram.

    A bin is a core if the bins within eps hold `least` pixels; cores not more than
    eps apart are one cluster; other bins within eps of a core join the nearest one,
    the lower on ties.
    """
    w = Window.partitionBy(*keys).orderBy("bin")
    near = histogram.withColumn("_around", F.sum("n").over(w.rangeBetween(-eps, eps)))
    cores = near.where(F.col("_around") >= least).withColumn("_f", F.coalesce((F.col("bin") - F.lag("bin").over(w) > eps).cast("int"), F.lit(0))).withColumn("cluster", F.sum("_f").over(w))
    c = cores.select(*keys, F.col("bin").alias("_core"), "cluster")
    met = histogram.join(c, keys).where(F.abs(F.col("bin") - F.col("_core")) <= eps)
    owned = met.groupBy(*keys, "bin", "n").agg(F.min_by("cluster", F.struct(F.abs(F.col("bin") - F.col("_core")), F.col("_core"))).alias("cluster"))
    return owned.groupBy(*keys, "cluster").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), (F.sum(F.col("bin") * F.col("n")) / F.sum("n")).alias("centre"), F.sum("n").alias("n"))


def hue_peaks(histogram: DataFrame, keys: list[str], share: float = 0.1, distance: int = 10, bins: int = HUES) -> DataFrame:
    """keys, bin, n of local maxima of at least share of the highest bin, at least distance apart, from a histogram of at most `bins` rows a group."""

    def find(rows: dict[str, np.ndarray]) -> pd.DataFrame:
        hist = np.zeros(bins)
        hist[rows["bin"]] = rows["n"]
        at = N.peaks(hist, share * hist.max(), distance)
        return pd.DataFrame({"bin": at, "n": hist[at]})

    return each_group(histogram, keys, ["bin"], find, "bin int, n double")


def near_peaks(histogram: DataFrame, peaks: DataFrame, keys: list[str], tol: int = 10) -> DataFrame:
    """The bins of a histogram within tol of a peak (keys, bin)."""
    at = peaks.select(*keys, F.col("bin").alias("_peak"))
    met = histogram.join(at, keys).where(F.abs(F.col("bin") - F.col("_peak")) <= tol)
    return met.select(histogram.columns).distinct()


def top_bins(histogram: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """keys, bin, n of the k highest bins of each group; the higher bin on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("bin"))
    return histogram.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def settled_peaks(peaks: DataFrame, keys: list[str], red: int = 10, near: int = 15, bins: int = HUES) -> DataFrame:
    """keys, bin: peaks with a red one (0) added where none lies within red of either end, and close ones merged.

    In order, a peak goes if it lies within near of the last one kept, or if both lie
    near opposite ends. If 0 stands first, peaks near the upper end go; else, if the
    last bin stands last, those near 0.
    """
    last = bins - 1
    found = F.array_sort(F.collect_set("bin"))
    reds = lambda p: (p <= red) | (p >= bins - red)
    with_red = F.when(F.exists("ps", reds), F.col("ps")).otherwise(F.array_sort(F.array_append("ps", F.lit(0))))

    def merge(kept, p):
        before = F.element_at(kept, -1)
        close = (p - before <= near) | ((p < near) & (before > last - near)) | ((before < near) & (p > last - near))
        return F.when(F.size(kept) == 0, F.array(p)).when(close, kept).otherwise(F.array_append(kept, p))

    merged = F.aggregate("ps", F.array().cast("array<int>"), merge)
    zero, end = F.element_at("ps", 1) == 0, F.element_at("ps", -1) == last
    # the first peak left is 0 or the last is the end: the other end's peaks are the same red
    rest = F.when(zero & F.exists("ps", lambda p: (p >= bins - near) & (p != 0)), F.filter("ps", lambda p: p < bins - near)).when(end & F.exists("ps", lambda p: (p <= near) & (p != last)), F.filter("ps", lambda p: p > near)).otherwise(F.col("ps"))
    rows = peaks.groupBy(*keys).agg(found.cast("array<int>").alias("ps")).withColumn("ps", with_red).withColumn("ps", merged)
    return rows.select(*keys, F.explode(rest).alias("bin"))


def assign_ranges(pixels: DataFrame, ranges: DataFrame, keys: list[str], margin: int = 5) -> DataFrame:
    """pixels with cluster of the range (keys, cluster, lo, hi) that holds their hue, widened by margin; the first cluster if several."""
    met = pixels.join(ranges.select(*keys, "cluster", "lo", "hi"), keys).where((F.col("h") >= F.col("lo") - margin) & (F.col("h") <= F.col("hi") + margin))
    rest = [c for c in pixels.columns]
    return met.groupBy(*rest).agg(F.min("cluster").alias("cluster"))


def best_crop(ranges: DataFrame) -> DataFrame:
    """image_id, crop_id, clusters: the crop with most clusters of each image, the first on ties."""
    n = ranges.groupBy("image_id", "crop_id").agg(F.count(F.lit(1)).alias("clusters"))
    w = Window.partitionBy("image_id").orderBy(F.desc("clusters"), "crop_id")
    return n.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def numbered_by_hue(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("category_no", F.row_number().over(Window.partitionBy("image_id", "crop_id").orderBy("centre")))


def otsu(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold: the bin up to which pixels are dark, with the largest variance between both parts; the first on ties."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("bin") * F.col("n")
    rows = histogram.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(mass).over(up)).withColumn("w", F.sum("n").over(w)).withColumn("s", F.sum(mass).over(w))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - F.try_divide(F.col("s") - F.col("s0"), w1)
    spread = F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0))
    return rows.withColumn("_v", F.round(spread, 3)).groupBy(*keys).agg(F.min_by("bin", F.struct((-F.col("_v")).alias("v"), "bin")).alias("threshold"))


def hough_votes(pixels: DataFrame, keys: list[str], step: int = 3, top: int = 5) -> DataFrame:
    """keys, theta, rho, votes: the most voted lines x cos + y sin = rho of foreground pixels, theta in steps of degrees."""
    theta = F.explode(F.sequence(F.lit(0), F.lit(179), F.lit(step)))
    cast = pixels.select(*keys, "y", "x", theta.alias("theta"))
    rho = F.rint(F.col("x") * F.cos(F.radians("theta")) + F.col("y") * F.sin(F.radians("theta"))).cast("int")
    votes = cast.groupBy(*keys, "theta", rho.alias("rho")).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), "theta", "rho")
    return votes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def background(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, g, b, n: the most frequent colour; the smallest on ties."""
    n = pixels.groupBy(*keys, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "r", "g", "b")).alias("c")).select(*keys, "c.r", "c.g", "c.b", (-F.col("c.m")).alias("n"))


def has_black(pixels: DataFrame, limit: float = 0.01, dark: int = 30) -> DataFrame:
    """image_id, black: whether any crop has more than limit of dark pixels."""
    share = pixels.groupBy("image_id", "crop_id").agg(F.avg((F.col("v") < dark).cast("int")).alias("s"))
    return share.groupBy("image_id").agg(F.bool_or(F.col("s") > limit).alias("black"))
