"""Masks as one row a unit: cells packed into tiles of 8 x 8 bits, so that points are looked up without a row for each point or cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column of packed().
TILES = "_tiles"


def _tile(y: Column, x: Column) -> Column:
    return F.shiftleft(F.shiftright(y, 3), 32).bitwiseOR(F.shiftright(x, 3).bitwiseAND(F.lit(0xFFFFFFFF)))


def _bit(y: Column, x: Column) -> Column:
    return (y.bitwiseAND(F.lit(7)) * 8 + x.bitwiseAND(F.lit(7))).cast("int")


def tiles(cells: DataFrame) -> DataFrame:
    """unit, tile, word: the bits of cells (unit, y, x) by tile; y and x within 2^33 of 0, nulls left out. Cells that repeat count once."""
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    bits = cells.where(y.isNotNull() & x.isNotNull()).select("unit", _tile(y, x).alias("tile"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(y, x)).alias("word"))
    return bits.groupBy("unit", "tile").agg(F.bit_or("word").alias("word"))


def packed(mask: DataFrame) -> DataFrame:
    """unit, _tiles of a mask (unit, y, x): map from tile to its bits (see tiles). Both steps group by unit first, so cells dealt by unit are not shuffled again."""
    return tiles(mask).groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("tile", "word"))).alias(TILES))


def bits_in_tiles(words: str, tiles: str) -> Column:
    """How many bits of a unit's word (column words, of tile) are in its _tiles."""
    return F.coalesce(F.bit_count(F.col(words).bitwiseAND(F.try_element_at(F.col(TILES), F.col(tiles)))), F.lit(0))


def on_tiles(y: Column, x: Column) -> Column:
    """1 if the cell (y, x) is in the unit's _tiles, else 0, also where either is null."""
    y, x = y.cast("long"), x.cast("long")
    return F.coalesce(F.call_function("bit_get", F.try_element_at(F.col(TILES), _tile(y, x)), _bit(y, x)).cast("int"), F.lit(0))
