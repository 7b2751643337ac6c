"""Pairs of a unit that lie near each other: an equi-join on the cells of a grid, not all pairs of the unit.

One side has one cell for each row, the other all cells around it in which a partner
can lie, so each pair meets once. A unit's grid pays from some rows on: units in
which the second side has no more than CROWD are joined whole, in the same join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlines.functions.geometry import distance
from chartlines.sources.shared import keep

#: Rows of a unit up to which the nine cells around each cost more than they save.
CROWD = 32
_GRID = ["_grid", "_cy", "_cx"]


def reach(kind: str, limit: float) -> float:
    """How far apart the midpoints of two segments can lie whose cost (see geometry.pair_cost) is no more than limit; swapped ends share a midpoint."""
    shares = {"mean_ends": 1.0, "midpoint": 1.0, "l2": 0.5, "l2_swap": 0.5, "l1": 0.5, "ends_mae": 2.0}
    return (limit / 2) ** 0.5 if kind == "squared" else shares[kind] * limit


def _cell(y: Column, x: Column, size: float | Column) -> list[Column]:
    return [F.floor(y / size), F.floor(x / size)]


def _spot(grid: int, cy: Column, cx: Column) -> Column:
    return F.struct(F.lit(grid).alias("_grid"), cy.cast("long").alias("_cy"), cx.cast("long").alias("_cx"))


def _around(y: Column, x: Column, size: float | Column) -> Column:
    cy, cx = _cell(y, x, size)
    return F.array(*[_spot(1, cy + dy, cx + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])


def around_segment(s: dict[str, Column], radius: float) -> tuple[Column, float]:
    """Cells in which a point within radius of a segment can lie, and their size: those around points set every radius along it."""
    size = radius * 1.5
    steps = F.ceil(distance(s["x1"], s["y1"], s["x2"], s["y2"]) / radius).cast("int")
    at = lambda a, b, i: a + (b - a) * F.try_divide(i.cast("double"), steps)
    along = lambda i: _around(F.coalesce(at(s["y1"], s["y2"], i), s["y1"]), F.coalesce(at(s["x1"], s["x2"], i), s["x1"]), size)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.coalesce(steps, F.lit(0))), along))), size


def large_units(rows: DataFrame, keys: list[str], crowd: int = CROWD) -> DataFrame:
    """keys of the units with more than crowd rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).drop("_n")


def met_on_grid(p: DataFrame, g: DataFrame, p_cell: Column, g_cells: Column, keys: list[str], crowd: int = CROWD) -> DataFrame:
    """p joined to g by keys, pairs of large units only where p_cell is one of g_cells; a condition put on the result becomes part of the join."""
    marked = g.join(large_units(g, keys, crowd).withColumn("_big", F.lit(True)), keys, "left")
    whole = _spot(0, F.lit(0), F.lit(0))
    placed = marked.withColumn("_c", F.explode(F.when(F.col("_big"), g_cells).otherwise(F.array(whole)))).select(*g.columns, "_c.*")
    asked = p.withColumn("_c", F.explode(F.array(whole, p_cell))).select(*p.columns, "_c.*")
    return asked.join(placed, [*keys, *_GRID]).drop(*_GRID)


def near_rows(p: DataFrame, g: DataFrame, p_at: tuple[Column, Column], g_at: tuple[Column, Column], radius: float, keys: list[str], crowd: int = CROWD) -> DataFrame:
    """p joined to g by keys: all pairs whose points (y, x) lie within radius of each other, each once, and others."""
    size = max(radius, 1e-9)
    cy, cx = _cell(*p_at, size)
    return met_on_grid(p, g, _spot(1, cy, cx), _around(*g_at, size), keys, crowd)


def near_segments(p: DataFrame, g: DataFrame, end: tuple[Column, Column], s: dict[str, Column], radius: float, keys: list[str], crowd: int = CROWD) -> DataFrame:
    """p joined to g by keys: all pairs in which end (y, x) of p lies within radius of segment s of g, each once, and others."""
    cells, size = around_segment(s, max(radius, 1e-9))
    cy, cx = _cell(*end, size)
    return met_on_grid(p, g, _spot(1, cy, cx), cells, keys, crowd)


def middle(prefix: str) -> tuple[Column, Column]:
    c = lambda a: F.col(f"{prefix}{a}")
    return (c("y1") + c("y2")) / 2, (c("x1") + c("x2")) / 2


def nearest_points(a: DataFrame, b: DataFrame, crowd: int = CROWD) -> DataFrame:
    """unit, i, d: the distance of each point of a (unit, id, x, y; id is unique in its unit) to the nearest one of b.

    Units in which b has no more than crowd points compare all. In others cells begin
    at the size that holds four points of b on average, and double until a point is found
    within one cell's size; points of units without b are left out.
    """
    p = a.select("unit", F.col("id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay")).where(F.col("ax").isNotNull() & F.col("ay").isNotNull())
    q = b.select("unit", F.col("x").alias("bx"), F.col("y").alias("by")).where(F.col("x").isNotNull() & F.col("y").isNotNull()).distinct()
    d = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    width, height = F.max("bx") - F.min("bx"), F.max("by") - F.min("by")
    n = F.count(F.lit(1))
    size = F.greatest(2 * F.sqrt(width * height / n), F.greatest(width, height) / n, F.lit(1e-6))
    large = keep(q.groupBy("unit").agg(n.alias("n"), size.alias("size")).where(F.col("n") > crowd).select("unit", "size"), "large")
    small = p.join(q.join(large, "unit", "left_anti"), "unit").groupBy("unit", "i").agg(F.min(d).alias("d"))
    found, left = small, keep(p.join(large, "unit"), "left")
    dots = q.join(large.select("unit"), "unit", "left_semi")
    grow = 1.0
    while not left.isEmpty():
        step = F.col("size") * grow
        asked = left.withColumn("_c", _spot(1, *_cell(F.col("ay"), F.col("ax"), step)))
        placed = dots.join(large, "unit").withColumn("_c", F.explode(_around(F.col("by"), F.col("bx"), step))).drop("size")
        met = keep(asked.join(placed, ["unit", "_c"]).groupBy("unit", "i").agg(F.min(d).alias("d"), F.first("size").alias("size")), "met")
        done = met.where(F.col("d") <= step).select("unit", "i", "d")
        found = found.unionByName(done)
        left = keep(left.join(done, ["unit", "i"], "left_anti"), "left")
        grow *= 2
    return found
