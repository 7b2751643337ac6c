"""Segments of SVG files in pixels, and from them the axes and crops of a chart.

Parsing is a helper within tasks: it walks a file's tree with the affine matrix of
what stands above, and gives a row for each straight piece. Axes, crops and
categories are made of these rows by DataFrame operators.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FLOAT = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_NUMBER, _PATH, _STEP = re.compile(_FLOAT), re.compile(_FLOAT + r"|[A-Za-z]"), re.compile(r"(\w+)\s*\(([^)]*)\)")
_LENGTH = re.compile(rf"\s*({_FLOAT})\s*([a-z%]*)")
#: Pixels of an absolute unit of CSS.
UNITS = {"": 1.0, "px": 1.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6, "pt": 96 / 72, "pc": 16.0}
#: How many numbers a path command takes for one step.
_TAKES = {"M": 2, "L": 2, "T": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "A": 7}
#: Pieces that a task hands on at once.
PIECES = 10_000


def _floats(text: str | None) -> list[float]:
    return [float(v) for v in _NUMBER.findall(text or "")]


def pixels(length: str | None) -> float | None:
    """A length in pixels; null for shares and unknown units."""
    found = _LENGTH.fullmatch((length or "").strip().lower())
    return float(found[1]) * UNITS[found[2]] if found and found[2] in UNITS else None


def matrix(transform: str | None) -> np.ndarray:
    """The affine matrix of a list of transforms, the first one outermost; those of unknown name or wrong length are left out."""
    out = np.eye(3)
    for name, inner in _STEP.findall(transform or ""):
        v, own = _floats(inner), np.eye(3)
        match name.lower(), len(v):
            case "translate", 1 | 2:
                own[:2, 2] = (*v, 0.0)[:2]
            case "scale", 1 | 2:
                own[0, 0], own[1, 1] = v[0], v[-1]
            case "matrix", 6:
                own[:2] = np.array(v).reshape(3, 2).T
            case "rotate", 1 | 3:
                c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
                own[:2, :2] = [[c, -s], [s, c]]
                if len(v) == 3:
                    own[:2, 2] = np.array(v[1:]) - own[:2, :2] @ np.array(v[1:])
            case "skewx", 1:
                own[0, 1] = math.tan(math.radians(v[0]))
            case "skewy", 1:
                own[1, 0] = math.tan(math.radians(v[0]))
        out = out @ own
    return out


def view(root) -> np.ndarray:
    """From the units of the root's viewBox to pixels; as it is where one is missing."""
    box, w, h = _floats(root.get("viewBox")), pixels(root.get("width")), pixels(root.get("height"))
    if len(box) != 4 or w is None or h is None or not box[2] or not box[3]:
        return np.eye(3)
    sx, sy = w / box[2], h / box[3]
    return np.array([[sx, 0, -box[0] * sx], [0, sy, -box[1] * sy], [0, 0, 1.0]])


def path_pieces(d: str | None) -> list[tuple[float, float, float, float]]:
    """Straight pieces of a path; curves count as the line between their ends, and a closed part as closed."""
    out, at, start, mode, held = [], (0.0, 0.0), (0.0, 0.0), "", []
    for token in _PATH.findall(d or ""):
        if token.isalpha():
            mode, held = token, []
            if token in "zZ":
                if at != start:
                    out.append((*at, *start))
                at = start
            continue
        held.append(float(token))
        kind = mode.upper()
        if len(held) < _TAKES.get(kind, 10**9):
            continue
        base = at if mode.islower() else (0.0, 0.0)
        x = base[0] + (held[-2] if kind not in "HV" else held[0]) if kind != "V" else at[0]
        y = base[1] + held[-1] if kind != "H" else at[1]
        if kind == "M":
            start, mode = (x, y), "l" if mode == "m" else "L"  # further pairs are lines
        else:
            out.append((*at, x, y))
        at, held = (x, y), []
    return out


def _pieces(node) -> list[tuple[float, float, float, float]]:
    match node.tag.rsplit("}", 1)[-1]:
        case "line":
            return [tuple(pixels(node.get(c)) or 0.0 for c in ("x1", "y1", "x2", "y2"))]
        case "polyline" | "polygon" as kind:
            v = _floats(node.get("points"))
            points = list(zip(v[0::2], v[1::2]))
            return [(*a, *b) for a, b in zip(points, points[1:] + points[: kind == "polygon"])]
        case "path":
            return path_pieces(node.get("d"))
    return []


def _stroke(node, above: str | None) -> str | None:
    style = re.search(r"(?:^|;)\s*stroke\s*:\s*([^;]+)", node.get("style") or "")
    return node.get("stroke") or (style[1].strip() if style else above)


def segments(text: str) -> tuple[list[tuple], float | None]:
    """role, stroke, x1, y1, x2, y2 of all straight pieces of a file, in pixels, and the height at which the first group of marks begins."""
    root = ElementTree.fromstring(text)
    out, top = [], None
    px = view(root)
    stack = [(root, matrix(root.get("transform")), None)]
    while stack:
        node, above, stroke = stack.pop()
        role = (node.get("aria-roledescription") or "").lower()
        if top is None and node.tag.endswith("g") and ("group mark" in role or "layer mark" in role):
            top = float(above[1, 2])
        stroke = _stroke(node, stroke)
        found = _pieces(node)
        if found:
            # plain floats: arrays of two points cost more than the sums
            (a, b, c), (d, e, f) = (px @ above)[:2].tolist()
            for x1, y1, x2, y2 in found:
                out.append((role or None, stroke, a * x1 + b * y1 + c, d * x1 + e * y1 + f, a * x2 + b * y2 + c, d * x2 + e * y2 + f))
        stack += [(child, above @ matrix(child.get("transform")) if child.get("transform") else above, stroke) for child in reversed(node)]
    return out, top


_COLUMNS = "file string, line_id long, role string, stroke string, x1 double, y1 double, x2 double, y2 double, top double, error string"


def svg_segments(files: DataFrame) -> DataFrame:
    """file, line_id, role, stroke, x1 .. y2, top, error of the straight pieces of paths, lines, polylines and polygons in SVG texts (file, text).

    Coordinates are pixels: transforms (translate, scale, rotate, skew, matrix) are put
    together down the tree, then the root's viewBox is laid on its width and height, in
    any absolute unit. role is what the element calls itself ("line mark", "rule mark"),
    top the height of the first group of marks. A text that can't be read gives a row with error.
    """
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def rows_of(path: str, text: str) -> list[tuple]:
        try:
            rows, top = segments(text)
        except (ElementTree.ParseError, ValueError) as e:
            return [(path, *[None] * 8, str(e)[:200])]
        return [(path, i, *row, top, None) for i, row in enumerate(rows)]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple] = []
            for path, text in batch.itertuples(index=False):
                held += rows_of(path, text)
                if len(held) >= PIECES:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=names)

    return files.select("file", "text").mapInPandas(parse, _COLUMNS)


def read_svg_segments(spark: SparkSession, folder: str, glob: str = "*.svg") -> DataFrame:
    """svg_segments of SVG files, one chart each; file is the path."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return svg_segments(files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def write_svg_lines(charts: DataFrame, folder: str) -> None:
    """Charts (file, text) as JSON lines, many in a file: a file for each of millions of charts takes longer to open than to read."""
    charts.select("file", "text").write.json(folder)


def read_svg_lines(spark: SparkSession, folder: str) -> DataFrame:
    """svg_segments of what write_svg_lines has written."""
    return svg_segments(spark.read.schema("file string, text string").json(folder))


def axes_of_rules(pieces: DataFrame, eps: float = 0.75) -> DataFrame:
    """file, axis_no (from 0), x: upright rule marks that run downwards, left to right, each more than eps from the last one kept."""
    upright = pieces.where((F.col("role") == "rule mark") & (F.abs(F.col("x1") - F.col("x2")) <= 1e-9 * (1 + F.abs("x1"))) & (F.col("y2") > F.col("y1")))
    none = F.array().cast("array<double>")
    kept = F.aggregate(F.array_sort(F.collect_list("x1")), none, lambda a, x: F.when((F.size(a) == 0) | (x - F.coalesce(F.get(a, F.size(a) - 1), x) > eps), F.concat(a, F.array(x))).otherwise(a))
    return upright.groupBy("file").agg(kept.alias("xs")).select("file", F.posexplode("xs").alias("axis_no", "x"))


def axes_of_ends(pieces: DataFrame, eps: float = 0.25) -> DataFrame:
    """file, axis_no (from 0), x: means of the clusters of line marks' end points, a cluster ending where the next x is more than eps away."""
    marks = pieces.where(F.col("role") == "line mark")
    xs = marks.select("file", F.explode(F.array("x1", "x2")).alias("x"))
    along = Window.partitionBy("file").orderBy("x")
    told = xs.withColumn("fresh", F.coalesce((F.col("x") - F.lag("x").over(along) > eps).cast("int"), F.lit(0)))
    numbered = told.withColumn("axis_no", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("file", F.col("axis_no").cast("int").alias("axis_no")).agg(F.avg("x").alias("x"))


def chart_crops(pieces: DataFrame, axes: DataFrame, colours: DataFrame | None = None, from_top: bool = False, slack: float = 1e-6) -> DataFrame:
    """file, crop_id (from 1), category, x1 .. y2: line marks by the two neighbouring axes they lie between, x counted from the left one, all to two digits.

    Upright lines are left out. colours (category, r, g, b) name the strokes rgb(r, g, b);
    others, and all without colours, are unknown. Ends may lie slack outside, as an
    axis that is a mean of ends differs from them by rounding. from_top counts y from the group of marks.
    """
    along = Window.partitionBy("file").orderBy("axis_no")
    spans = axes.select("file", (F.col("axis_no") + 1).alias("crop_id"), F.col("x").alias("left"), F.lead("x").over(along).alias("right")).where(F.col("right").isNotNull())
    marks = pieces.where((F.col("role") == "line mark") & (F.abs(F.col("x1") - F.col("x2")) >= 1e-9))
    inside = lambda c: (F.col("left") - slack <= F.col(c)) & (F.col(c) <= F.col("right") + slack)
    met = marks.join(spans, "file").where(inside("x1") & inside("x2"))
    down = F.coalesce("top", F.lit(0.0)) if from_top else F.lit(0.0)
    at = {"x1": F.col("x1") - F.col("left"), "y1": F.col("y1") - down, "x2": F.col("x2") - F.col("left"), "y2": F.col("y2") - down}
    if colours is None:
        named = met.withColumn("category", F.lit("unknown"))
    else:
        rgb = F.transform(F.split(F.regexp_extract("stroke", r"rgb\(([^)]*)\)", 1), ","), lambda v: F.floor(F.trim(v).try_cast("double")))
        told = met.withColumn("_rgb", rgb).withColumns({f"_{c}": F.get("_rgb", F.lit(i)) for i, c in enumerate("rgb")})
        names = colours.groupBy(*(F.floor(c).alias(f"_{c}") for c in "rgb")).agg(F.min("category").alias("category"))
        named = told.join(names, ["_r", "_g", "_b"], "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    return named.select("file", "crop_id", "category", "line_id", *(F.round(v, 2).alias(c) for c, v in at.items()))
