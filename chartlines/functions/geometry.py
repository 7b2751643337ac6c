"""Column expressions on segments x1, y1, x2, y2; the frame of the coordinates is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COORDS = ("x1", "y1", "x2", "y2")
#: Frames of the coordinates in pixels.
CROP_HEIGHT, SQUARE, HEATMAP = 321.0, 224.0, 128.0


def seg(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in COORDS}


def orient(df: DataFrame, by: str = "x") -> DataFrame:
    """Segments with the leftmost end first, the upper one on ties; by="y" orders by y, then x."""
    s = seg()
    first, second = (("x1", "x2"), ("y1", "y2")) if by == "x" else (("y1", "y2"), ("x1", "x2"))
    swap = (s[first[0]] > s[first[1]]) | ((s[first[0]] == s[first[1]]) & (s[second[0]] > s[second[1]]))
    return df.withColumns({a: F.when(swap, s[b]).otherwise(s[a]) for a, b in zip(COORDS, ("x2", "y2", "x1", "y1"), strict=True)})


def to_yx(df: DataFrame) -> DataFrame:
    return df.withColumn("line", F.array(F.array("y1", "x1"), F.array("y2", "x2")))


def length(s: dict[str, Column]) -> Column:
    return F.sqrt((s["x2"] - s["x1"]) ** 2 + (s["y2"] - s["y1"]) ** 2)


def angle(s: dict[str, Column]) -> Column:
    """Undirected angle in [0, 180)."""
    return (signed_angle(s) + 180.0) % 180.0


def signed_angle(s: dict[str, Column]) -> Column:
    return F.degrees(F.atan2(s["y2"] - s["y1"], s["x2"] - s["x1"]))


def angle_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 180.0 - d)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)


def point_segment_distance(px: Column, py: Column, s: dict[str, Column]) -> Column:
    """Distance of a point to a segment; to its end for a segment without length."""
    dx, dy, x, y = s["x2"] - s["x1"], s["y2"] - s["y1"], px - s["x1"], py - s["y1"]
    along = F.coalesce(F.try_divide(x * dx + y * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    # from the first end, as in the SQL: distances that tie there tie here, to the last bit
    return distance(x, y, t * dx, t * dy)


def symmetric_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean distance of the four ends to the other segment."""
    ends = [point_segment_distance(s[f"x{i}"], s[f"y{i}"], o) for s, o in ((a, b), (b, a)) for i in (1, 2)]
    return (ends[0] + ends[1] + ends[2] + ends[3]) / 4


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of the shorter segment's shadow on the longer one's direction that both cover."""
    la, lb = length(a), length(b)
    long = {c: F.when(la >= lb, a[c]).otherwise(b[c]) for c in COORDS}
    short = {c: F.when(la >= lb, b[c]).otherwise(a[c]) for c in COORDS}
    size = F.greatest(la, lb)
    at = lambda i: F.try_divide((short[f"x{i}"] - long["x1"]) * (long["x2"] - long["x1"]) + (short[f"y{i}"] - long["y1"]) * (long["y2"] - long["y1"]), size)
    lo, hi = F.least(at(1), at(2)), F.greatest(at(1), at(2))
    both = F.greatest(F.lit(0.0), F.least(hi, size) - F.greatest(lo, F.lit(0.0)))
    return F.coalesce(F.try_divide(both, F.least(la, lb)), F.lit(0.0))


def x_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Common part of the x ranges over the shorter range; 0 if one has no width."""
    lo = lambda s: F.least(s["x1"], s["x2"])
    hi = lambda s: F.greatest(s["x1"], s["x2"])
    both = F.greatest(F.lit(0.0), F.least(hi(a), hi(b)) - F.greatest(lo(a), lo(b)))
    return F.coalesce(F.try_divide(both, F.least(hi(a) - lo(a), hi(b) - lo(b))), F.lit(0.0))


def pair_cost(kind: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Cost of a pair of segments.

    mean_ends: mean end distance in the better order; l2: sum of end distances;
    l2_swap: that in the better order; l1: sum of coordinate differences; ends_mae:
    mean coordinate difference in the better order; midpoint: distance of midpoints;
    squared: squared end distances in the better order.
    """
    d = lambda i, j: distance(a[f"x{i}"], a[f"y{i}"], b[f"x{j}"], b[f"y{j}"])
    q = lambda i, j: (a[f"x{i}"] - b[f"x{j}"]) ** 2 + (a[f"y{i}"] - b[f"y{j}"]) ** 2
    l1 = lambda i, j: F.abs(a[f"x{i}"] - b[f"x{j}"]) + F.abs(a[f"y{i}"] - b[f"y{j}"])
    match kind:
        case "mean_ends":
            return F.least(d(1, 1) + d(2, 2), d(1, 2) + d(2, 1)) / 2
        case "l2":
            return d(1, 1) + d(2, 2)
        case "l2_swap":
            return F.least(d(1, 1) + d(2, 2), d(1, 2) + d(2, 1))
        case "l1":
            return l1(1, 1) + l1(2, 2)
        case "ends_mae":
            return F.least(l1(1, 1) + l1(2, 2), l1(1, 2) + l1(2, 1)) / 4
        case "midpoint":
            return distance((a["x1"] + a["x2"]) / 2, (a["y1"] + a["y2"]) / 2, (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)
        case "squared":
            return F.least(q(1, 1) + q(2, 2), q(1, 2) + q(2, 1))
    raise ValueError(f"no such cost: {kind}")


def to_square(df: DataFrame, height: float = CROP_HEIGHT, size: float = SQUARE) -> DataFrame:
    """Crop coordinates scaled so that x2 becomes size and the crop's height size, to two digits; null where x2 is 0."""
    sx, sy = F.try_divide(F.lit(size), F.col("x2")), F.lit(size / height)
    return df.withColumns({c: F.round(F.col(c) * (sx if c[0] == "x" else sy), 2) for c in COORDS})


def rescale(df: DataFrame, sx: float, sy: float) -> DataFrame:
    return df.withColumns({c: F.col(c) * (sx if c[0] == "x" else sy) for c in COORDS})


def rescale_by_own_extent(df: DataFrame, unit: str = "unit", size: float = SQUARE) -> DataFrame:
    """Each unit's segments scaled so that its largest x and y become size; null where that is 0."""
    w = Window.partitionBy(unit)
    mx, my = F.max(F.greatest("x1", "x2")).over(w), F.max(F.greatest("y1", "y2")).over(w)
    return df.withColumns({c: F.try_divide(F.col(c) * size, mx if c[0] == "x" else my) for c in COORDS})


def crop_offset(df: DataFrame, width: float = SQUARE) -> DataFrame:
    """Segments shifted by the width of the crops before theirs, in order of crop."""
    shift = (F.dense_rank().over(Window.partitionBy("image_id").orderBy("crop_id")) - 1) * F.lit(width)
    return df.withColumns({c: F.col(c) + shift for c in ("x1", "x2")})


def clip(df: DataFrame, width: float, height: float, absurd: float = 10.0) -> DataFrame:
    """Coordinates clamped to the image; segments reaching beyond absurd times its size are dropped."""
    wild = F.greatest(F.abs("x1"), F.abs("x2")) > absurd * width
    wild = wild | (F.greatest(F.abs("y1"), F.abs("y2")) > absurd * height)
    most = {"x": width - 1, "y": height - 1}
    return df.where(~wild).withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(most[c[0]]), F.col(c))) for c in COORDS})


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def flips(df: DataFrame, width: float, height: float) -> DataFrame:
    """Four copies of each segment: as it is, flipped left-right, top-bottom and both; flip tells which (0-3)."""
    many = df.withColumn("flip", F.explode(F.array(*map(F.lit, range(4)))))
    lr, tb = F.col("flip") % 2 == 1, F.col("flip") >= 2
    turned = {c: F.when(lr if c[0] == "x" else tb, (width if c[0] == "x" else height) - F.col(c)).otherwise(F.col(c)) for c in COORDS}
    return many.withColumns(turned)


def random_swap(df: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
    """Ends swapped for about half of the segments, chosen by a hash of the keys that any engine can repeat: the first 12 hex digits of md5(keys:seed)."""
    digits = F.substring(F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.lit(str(seed)))), 1, 12)
    swap = F.conv(digits, 16, 10).cast("long") < (1 << 47)
    return df.withColumns({a: F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in zip(COORDS, ("x2", "y2", "x1", "y1"), strict=True)})
