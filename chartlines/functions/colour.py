"""Colour expressions: HSV and RGB, palettes, background and foreground rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Struct r, g, b (0-255, cut to whole numbers) of h, s, v in 0-1."""
    sector, f = F.floor(h * 6), h * 6 - F.floor(h * 6)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    k = F.pmod(sector, F.lit(6))
    pick = lambda *parts: F.element_at(F.array(*parts), (k + 1).cast("int"))
    whole = lambda c: (c * 255).cast("int")
    return F.struct(whole(pick(v, q, p, p, t, v)).alias("r"), whole(pick(t, v, v, q, p, p)).alias("g"), whole(pick(p, p, t, v, v, q)).alias("b"))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Struct h (0-1), s (0-1), v (0-1) of r, g, b in 0-255."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.struct(F.when(span == 0, 0.0).otherwise(turn / 6).alias("h"), F.when(top == 0, 0.0).otherwise(span / top).alias("s"), top.alias("v"))


def is_grey_or_white(r: Column, g: Column, b: Column, spread: int = 15, white: int = 240) -> Column:
    return (F.greatest(r, g, b) - F.least(r, g, b) < spread) | (F.least(r, g, b) > white)


def hue_pool(n: int) -> Column:
    """Array of n hues i / n."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / F.lit(n))


def circular_distance(a: Column, b: Column, period: float = 1.0) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(d, period - d)


def hue_range(pixels: DataFrame, *keys: str, period: int = 180) -> DataFrame:
    """lo, hi, wraps of the hues of each group: the shorter of the plain range and that of hues shifted by half a turn."""
    shifted = F.pmod(F.col("h") + period // 2, F.lit(period))
    found = pixels.groupBy(*keys).agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min(shifted).alias("c"), F.max(shifted).alias("d"))
    wraps = F.col("d") - F.col("c") < F.col("b") - F.col("a")
    back = lambda c: F.pmod(F.col(c) + period - period // 2, F.lit(period))
    return found.select(*keys, F.when(wraps, back("c")).otherwise(F.col("a")).alias("lo"), F.when(wraps, back("d")).otherwise(F.col("b")).alias("hi"), wraps.alias("wraps"))


def whiten_background(pixels: DataFrame, dark: float = 70, spread: float = 15) -> DataFrame:
    """Dark grey pixels (mean under dark, deviation under spread) made white."""
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    std = F.sqrt(((F.col("r") - mean) ** 2 + (F.col("g") - mean) ** 2 + (F.col("b") - mean) ** 2) / 3.0)
    grey = (mean < dark) & (std < spread)
    return pixels.withColumns({c: F.when(grey, 255).otherwise(F.col(c)) for c in "rgb"})


def foreground(pixels: DataFrame, rule: str = "sum", limit: float | None = None) -> DataFrame:
    """Pixels of the foreground. sum: r + g + b under 750; sv: s and v at least 50; s: s over 50; v: v over 0; grey: grey under 250."""
    r, g, b = (F.col(c) for c in "rgb") if rule in ("sum", "grey") else (None,) * 3
    rules = {
        "sum": lambda: r + g + b < (limit or 750),
        "grey": lambda: 0.299 * r + 0.587 * g + 0.114 * b < (limit or 250),
        "sv": lambda: (F.col("s") >= (limit or 50)) & (F.col("v") >= (limit or 50)),
        "s": lambda: F.col("s") > (limit or 50),
        "v": lambda: F.col("v") > (limit or 0),
    }
    return pixels.where(rules[rule]())


def coloured(pixels: DataFrame, s_min: float = 40, v_min: float = 40, drop_red: bool = True, red: tuple[float, float] = (8, 172), red_s: float = 80, red_v: float = 60) -> DataFrame:
    """Pixels (h in 0-179, s and v in 0-255) above s_min and v_min; with drop_red none of strong red, as rules between crops have: hue outside of red, s over red_s and v over red_v."""
    strong = ((F.col("h") < red[0]) | (F.col("h") > red[1])) & (F.col("s") > red_s) & (F.col("v") > red_v)
    kept = (F.col("s") > s_min) & (F.col("v") > v_min)
    return pixels.where(kept & ~strong if drop_red else kept)


def default_palette(categories: DataFrame, *keys: str) -> DataFrame:
    """Hue i / n for category i of n, in order of name, within each group of keys."""
    w = Window.partitionBy(*keys)
    return categories.withColumn("hue", (F.row_number().over(w.orderBy("category")) - 1) / F.count(F.lit(1)).over(w))


def cycled_palette(categories: DataFrame, palette: DataFrame, *keys: str) -> DataFrame:
    """Colours of palette (place from 0, colour) given in turn to categories sorted by name."""
    size = palette.agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("category")) - 1
    numbered = categories.withColumn("i", place).join(F.broadcast(size), how="left").withColumn("place", F.pmod("i", "n"))
    return numbered.join(palette, "place", "left").drop("i", "n", "place")


def colours_of_files(categories: DataFrame, own: DataFrame, dominant: DataFrame) -> DataFrame:
    """image_id, category, h, s, v, taken_from: colours of the categories (image_id, category) of each image.

    An image takes those of its own (image_id, category, h, s, v) where it has one for
    any of its categories, the others then stay out. Else it takes the dominant ones
    (file, name, h, s, v) of <image_id>.png, else of r<image_id>.png, in order of the
    numbers in names cat1, cat2, ... (other names last), in turn for its categories in
    order of name. Images with neither have no rows. Hue is taken modulo 1, s and v are
    held in 0-1; missing h counts as 0, s and v as 1. All windows are on one image or file.
    """
    level = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    tidy = lambda t: t.withColumns({"h": F.pmod(F.coalesce("h", F.lit(0.0)), F.lit(1.0)), "s": level("s"), "v": level("v")})
    cats = categories.select("image_id", "category").distinct()
    mine = cats.join(tidy(own).select("image_id", "category", "h", "s", "v"), ["image_id", "category"]).withColumn("taken_from", F.lit("own"))
    rest = cats.join(mine.select("image_id").distinct(), "image_id", "left_anti")
    names = F.posexplode(F.array(F.concat(F.col("image_id").cast("string"), F.lit(".png")), F.concat(F.lit("r"), F.col("image_id").cast("string"), F.lit(".png")))).alias("turn", "file")
    files = rest.select("image_id").distinct().select("image_id", names).join(dominant.select("file").distinct(), "file")
    chosen = files.groupBy("image_id").agg(F.min_by("file", "turn").alias("file"))
    number = F.coalesce(F.regexp_extract("name", r"^cat(\d+)$", 1).try_cast("long"), F.lit(10**9))
    listed = Window.partitionBy("file")
    placed = tidy(dominant).withColumn("place", F.row_number().over(listed.orderBy(number, "name")) - 1).withColumn("n", F.count(F.lit(1)).over(listed))
    sizes = placed.where(F.col("place") == 0).select("file", "n")
    ranked = rest.withColumn("i", F.row_number().over(Window.partitionBy("image_id").orderBy("category")) - 1)
    turns = ranked.join(chosen, "image_id").join(sizes, "file").withColumn("place", F.pmod("i", "n"))
    theirs = turns.join(placed.select("file", "place", "h", "s", "v"), ["file", "place"]).withColumn("taken_from", F.col("file"))
    cols = ["image_id", "category", "h", "s", "v", "taken_from"]
    return mine.select(*cols).unionByName(theirs.select(*cols))


#: Linear sRGB to XYZ of D65, the white point, and the constants of CIE Lab.
_XYZ = {"x": (0.412453, 0.357580, 0.180423), "y": (0.212671, 0.715160, 0.072169), "z": (0.019334, 0.119193, 0.950227)}
_WHITE = {"x": 0.950456, "y": 1.0, "z": 1.088754}
_CUT, _SLOPE, _OFFSET, _DARK = 0.008856, 7.787, 16 / 116, 903.3


def rgb_to_lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """l (0-100), a, b of sRGB in 0-255."""
    flat = lambda c: F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92)
    channels = [flat(c) for c in (r, g, b)]
    t = {k: sum((w * c for w, c in zip(ws, channels)), F.lit(0.0)) / _WHITE[k] for k, ws in _XYZ.items()}
    f = {k: F.when(v > _CUT, F.pow(v, F.lit(1 / 3))).otherwise(_SLOPE * v + _OFFSET) for k, v in t.items()}
    light = F.when(t["y"] > _CUT, 116 * f["y"] - 16).otherwise(_DARK * t["y"])
    return {"l": light, "a": 500 * (f["x"] - f["y"]), "b": 200 * (f["y"] - f["z"])}
