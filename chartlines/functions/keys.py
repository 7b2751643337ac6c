"""Keys held in names such as image_7_crop_2_cat: parsed once into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlines.sources.shared import numbered


def _number(name: Column, pattern: str) -> Column:
    return F.regexp_extract(name, pattern, 1).try_cast("int")


def image_id(name: Column) -> Column:
    """Number after `image_`; null if there is none."""
    return _number(name, r"image_(\d+)")


def crop_id(name: Column) -> Column:
    """Number after `crop_` or `crop`; null if there is none."""
    return _number(name, r"crop_?(\d+)")


def category_code(name: Column) -> Column:
    """The tokens that are neither image, crop nor their numbers, in order; null if none is left."""
    rest = F.regexp_replace(name, r"(^|_)(image|crop)_?\d+", "")
    return F.nullif(F.array_join(F.filter(F.split(rest, "_"), lambda t: t != ""), "_"), F.lit(""))


def token_key(name: Column) -> Column:
    """Lower-case tokens sorted, so that their order doesn't matter; different images can share it."""
    return F.array_join(F.array_sort(F.split(F.lower(name), "_")), "_")


def base_key(name: Column) -> Column:
    """The name without its crop."""
    return F.regexp_replace(F.lower(name), r"_?crop_?\d+", "")


def crop_key(name: Column) -> Column:
    """The first four tokens: image_<i>_crop_<k>."""
    return F.substring_index(name, "_", 4)


def crop_first(name: Column) -> Column:
    """image_<i>_<cat>_crop_<k> as image_<i>_crop_<k>_<cat>; other names as they are."""
    return F.regexp_replace(name, r"^image_(\d+)_(.+)_crop_(\d+)$", "image_$1_crop_$3_$2")


def result_tag(name: Column) -> Column:
    """pre, mask, post or mask_post at the end of a name; null if there is none."""
    return F.nullif(F.regexp_extract(name, r"_(mask_post|pre|mask|post)$", 1), F.lit(""))


def first_number(name: Column) -> Column:
    return _number(name, r"(\d+)")


def with_category_ids(rows: DataFrame, known: DataFrame, label: str = "label") -> DataFrame:
    """rows with cat_id from known (label, cat_id); new labels are numbered on, in order of label."""
    fresh = rows.select(label).where(F.col(label).isNotNull()).distinct().join(known.select(label), label, "left_anti")
    last = known.agg(F.coalesce(F.max("cat_id"), F.lit(-1)).alias("last"))
    numbered_on = numbered(fresh, "_place", F.col(label)).join(F.broadcast(last), how="left").select(label, (F.col("last") + F.col("_place")).alias("cat_id"))
    return rows.join(known.select(label, "cat_id").unionByName(numbered_on), label, "left")
