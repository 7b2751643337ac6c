"""Readers and writers of the file shapes that chart data comes in."""

from __future__ import annotations

import csv
import re
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chartlines.functions.keys import crop_id, image_id
from chartlines.sources.shared import keep
from chartlines.sources.svg import read_svg_segments  # noqa: F401

SEGMENT = "array<array<double>>"


def read_csv_sets(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV data sets under a folder, with dataset_id out of the file's name; files share a header."""
    return spark.read.csv(folder, header=True, inferSchema=True).withColumn("dataset_id", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).try_cast("long"))


def csv_headers(spark: SparkSession, folder: str) -> DataFrame:
    """path, header of all CSV files under a folder; only the first line of each is read. Files without a byte have no row."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            heads = []
            for path in batch["path"]:
                system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                with system.open_input_stream(name) as f:
                    held = b""
                    while b"\n" not in held and (more := f.read(4096)):
                        held += more
                heads.append(held.split(b"\n", 1)[0].decode("utf-8-sig", "replace").rstrip("\r"))
            yield pd.DataFrame({"path": batch["path"], "header": heads})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.mapInPandas(first, "path string, header string")


def read_csv_cells(spark: SparkSession, folder: str, dataset: str = r"(\d+)\.csv$") -> DataFrame:
    """dataset_id, row_id, column, value, number, category of all CSV data sets under a folder, whose headers may differ.

    Files are grouped by header; each group is read once, by a schema of its header, and
    brought into long form. category is the column of that name in any case, number the
    value as a double or null, dataset_id what `dataset` finds in the path, row_id unique.
    Empty files and those that hold a header only give no rows.
    """
    groups = csv_headers(spark, folder).where(F.trim("header") != "").groupBy("header").agg(F.collect_list("path").alias("paths")).collect()  # paths, as Spark's own listing has them
    kind = "dataset_id long, row_id long, column string, value string, number double, category string"
    out = spark.createDataFrame([], kind)
    for i, group in enumerate(sorted(groups, key=lambda g: g["header"])):
        names = next(csv.reader([group["header"]]))
        label = [k for k, n in enumerate(names) if n.strip().lower() == "category"][:1]
        read = spark.read.schema(", ".join(f"c{k} string" for k in range(len(names)))).csv(group["paths"], header=True, enforceSchema=True)
        cells = F.explode(F.array(*[F.struct(F.lit(n.strip()).alias("column"), F.col(f"c{k}").alias("value")) for k, n in enumerate(names) if k not in label])).alias("c")
        category = F.col(f"c{label[0]}") if label else F.lit(None).cast("string")
        numbered = read.withColumn("row_id", F.monotonically_increasing_id() + F.lit(i) * F.lit(1 << 53)).withColumn("dataset_id", F.regexp_extract(F.col("_metadata.file_path"), dataset, 1).try_cast("long"))
        if len(names) > len(label):
            out = out.unionByName(numbered.select("dataset_id", "row_id", cells, category.alias("category")).select("dataset_id", "row_id", "c.column", "c.value", F.col("c.value").try_cast("double").alias("number"), "category"))
    return out


def read_plot_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """filename, crop, category, line_id, x1 .. y2 of plot metadata; the older shape without categories gives null ones."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.try_parse_json("value").alias("j"))
    get = lambda path, kind: F.try_variant_get("j", path, kind)
    crops = rows.select(get("$.filename", "string").alias("filename"), F.explode(get("$.lines", "map<string,variant>")).alias("crop", "v"))
    of = lambda kind: F.try_variant_get("v", "$", kind)
    old = F.when(of(SEGMENT).isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("key"), of(SEGMENT).alias("value"))))
    crops = crops.select("filename", "crop", F.coalesce(old, F.map_entries(of(f"map<string,{SEGMENT}>"))).alias("cats"))
    cats = crops.select("filename", "crop", F.explode("cats").alias("k"))
    return _flat(cats.select("filename", "crop", F.col("k.key").alias("category"), F.posexplode("k.value").alias("line_id", "l")))


def _flat(rows: DataFrame, line: str = "l") -> DataFrame:
    good = rows.where(F.size(line) == 4)
    return good.withColumns({c: F.col(line)[i] for i, c in enumerate(("x1", "y1", "x2", "y2"))}).drop(line)


def read_segment_lists(spark: SparkSession, folder: str) -> DataFrame:
    """filename, line_id, x1 .. y2 of [{filename, lines}] or {"images": [..]}; lines that aren't four numbers are dropped, the last duplicate of a name wins."""
    rows = spark.read.text(folder, wholetext=True).select(F.try_parse_json("value").alias("j"))
    kind = f"array<struct<filename:string,lines:{SEGMENT}>>"
    both = rows.select(F.posexplode(F.coalesce(F.try_variant_get("j", "$", kind), F.try_variant_get("j", "$.images", kind))).alias("n", "e"))
    last = both.groupBy("e.filename").agg(F.max_by("e.lines", "n").alias("ls"))
    return _flat(last.select("filename", F.posexplode("ls").alias("line_id", "l")))


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """image_id, crop_id, filename, line_id, x1 .. y2 (two digits, leftmost end first) of {filename, lines: [[[x,y],[x,y]]]}."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.try_parse_json("value").alias("j"))
    named = rows.select(F.try_variant_get("j", "$.filename", "string").alias("filename"), F.posexplode(F.try_variant_get("j", "$.lines", f"array<{SEGMENT}>")).alias("line_id", "l"))
    swap = F.col("l")[0][0] > F.col("l")[1][0]
    at = lambda i, k: F.round(F.when(swap, F.col("l")[1 - i][k]).otherwise(F.col("l")[i][k]), 2)
    return named.select(image_id(F.col("filename")).alias("image_id"), crop_id(F.col("filename")).alias("crop_id"), "filename", "line_id", at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(1, 0).alias("x2"), at(1, 1).alias("y2"))


def read_npz_lines(spark: SparkSession, folder: str) -> DataFrame:
    """file, line_id, x1 .. y2, score of NPZ files with lines (or lpos) as (y, x) pairs; the score is 1 where there is none. A file that can't be read gives a row with error."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for path, content in batch.itertuples(index=False):
                try:
                    data = np.load(io.BytesIO(content))
                    lines = np.asarray(data["lines"] if "lines" in data else data["lpos"][:, :, :2], float).reshape(-1, 2, 2)
                    score = np.asarray(data["score"], float) if "score" in data else np.ones(len(lines))
                    yield pd.DataFrame({"file": path, "line_id": np.arange(len(lines)), "x1": lines[:, 0, 1], "y1": lines[:, 0, 0], "x2": lines[:, 1, 1], "y2": lines[:, 1, 0], "score": score[: len(lines)], "error": None})
                except (ValueError, KeyError, OSError) as e:
                    yield pd.DataFrame([[path, None, None, None, None, None, None, str(e)[:200]]], columns=["file", "line_id", "x1", "y1", "x2", "y2", "score", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(load, "file string, line_id long, x1 double, y1 double, x2 double, y2 double, score double, error string")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """file, y, x, r, g, b of the pixels of all images under a folder."""

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for origin, h, w, channels, data in batch.itertuples(index=False):
                a = np.frombuffer(data, np.uint8).reshape(h, w, channels)
                a = np.repeat(a, 3, 2) if channels == 1 else a
                y, x = np.indices((h, w))
                yield pd.DataFrame({"file": origin, "y": y.ravel(), "x": x.ravel(), **{c: a[:, :, 2 - i].ravel().astype(int) for i, c in enumerate("rgb")}})

    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(folder)
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(pixels, "file string, y int, x int, r int, g int, b int")


def write_combined_json(segments: DataFrame, folder: str, name: Column) -> None:
    """One JSON object {filename, lines} for each name, in order of name."""
    lines = segments.groupBy(name.alias("filename")).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_id", F.array("x1", "y1", "x2", "y2").alias("l")))), lambda s: s["l"]).alias("lines"))
    lines.orderBy("filename").write.json(folder)


def read_distribution_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """A measured distribution sheet (CSV with a header): names stripped of blanks, in lower case and with _ for what stands between words; all values as text, for the forgiving casts of functions.text."""
    sheet = spark.read.csv(folder, header=True)
    return sheet.toDF(*[re.sub(r"\W+", "_", c.strip().lower()).strip("_") for c in sheet.columns])


def write_reports(counts: DataFrame, folder: str, base: str, crop: str) -> None:
    """per_crop and per_base as CSV and a summary as JSON, of tp, fp, fn, tn by crop: sums and mean scores at each level."""
    from chartlines.operators.metrics import micro_macro

    rolled = keep(micro_macro(counts, base, crop), "report")
    for level, name in ((0, "per_crop"), (1, "per_base")):
        rolled.where(F.col("level") == level).write.mode("overwrite").csv(f"{folder}/{name}", header=True)
    rolled.where(F.col("level") == 2).drop(base, crop).write.mode("overwrite").json(f"{folder}/summary")


def write_by(rows: DataFrame, folder: str, *keys: str) -> None:
    """One table for each value of keys (an image, a category), as Parquet under folder/key=value; rows of one value come from one task."""
    rows.repartition(*keys).write.partitionBy(*keys).mode("overwrite").parquet(folder)


def predict(images: DataFrame, factory, schema: str, attempts: int = 1, wait: float = 2.0, transient=lambda e: False) -> DataFrame:
    """Rows that a user's predictor, or feature extractor, gives for each row of images; factory() is called once for each task.

    A failure that transient(error) calls passing is tried again, attempts times in
    all, after wait, 2 * wait, 4 * wait ... seconds. Other failures, and the last one,
    become a row with error. A predictor returns a DataFrame, or a dict of lists, which
    costs less for each row; a batch's rows become one DataFrame.
    """

    names = StructType.fromDDL(schema).names

    def tried(predictor, row: dict) -> dict[str, list]:
        for turn in range(attempts):
            try:
                out = predictor(row)
                found = {n: list(out[n]) for n in names if n != "error"}
                return found | {"error": [None] * max(map(len, found.values()), default=0)}
            except Exception as e:  # noqa: BLE001  the predictor is the user's
                if turn + 1 == attempts or not transient(e):
                    return {n: [str(e)[:500] if n == "error" else row.get(n)] for n in names}
                time.sleep(wait * 2**turn)
        raise ValueError("attempts must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = factory()
        for batch in batches:
            found = [tried(predictor, row) for row in batch.to_dict("records")]
            # objects: whole numbers beside nulls stay whole
            yield pd.DataFrame({n: pd.Series([v for f in found for v in f[n]], dtype=object) for n in names})

    return images.mapInPandas(run, schema)
