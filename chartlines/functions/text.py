"""Forgiving casts and segments out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words read as true and as false.
YES_WORDS = ("yes", "true", "1", "y")
NO_WORDS = ("no", "false", "0", "n")
LINES = "array<array<double>>"


def to_bool(x: Column) -> Column:
    """True or false for a yes or no word; null for anything else."""
    word = F.lower(F.trim(x))
    return F.when(word.isin(*YES_WORDS), True).when(word.isin(*NO_WORDS), False)


def parse_rgb(x: Column) -> Column:
    """Array of three whole numbers out of text such as (12, 34, 56); null unless there are three."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)")), lambda d: d.try_cast("int"))
    return F.when(F.size(found) == 3, found)


def to_number(x: Column) -> Column:
    return x.try_cast("double")


def safe_json(x: Column) -> Column:
    """Variant of the JSON in a text: all of it, else from the first { to the last }, else from [ to ]; null if none parses."""
    inner = lambda pattern: F.try_parse_json(F.nullif(F.regexp_extract(x, pattern, 0), F.lit("")))
    return F.coalesce(F.try_parse_json(x), inner(r"(?s)\{.*\}"), inner(r"(?s)\[.*\]"))


def answer_lines(x: Column) -> Column:
    """Flat segments (arrays of four) of a model's answer, whichever shape it has.

    Shapes: {"lines": [[..]]}, [[..]], {"lines": {crop: [[..]]}}, {"lines": {crop: {category: [[..]]}}}.
    Entries without exactly four numbers are dropped; null if no shape fits.
    """
    value = safe_json(x)
    get = lambda path, kind: F.try_variant_get(value, path, kind)
    flat = F.coalesce(get("$.lines", LINES), get("$", LINES))
    by_crop = F.flatten(F.map_values(get("$.lines", f"map<string,{LINES}>")))
    deep = F.flatten(F.transform(F.map_values(get("$.lines", f"map<string,map<string,{LINES}>>")), lambda m: F.flatten(F.map_values(m))))
    return F.filter(F.coalesce(flat, by_crop, deep), lambda s: (F.size(s) == 4) & ~F.exists(s, lambda v: v.isNull()))
