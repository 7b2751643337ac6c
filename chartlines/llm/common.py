"""What the corpus operators share: tables, words, row keys and tables kept in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where it is unset and driver and tasks are one process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (known or f"file:///tmp/chartlines-{spark.sparkContext.applicationId}").rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/chartlines/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def clear_kept(spark: SparkSession) -> None:
    """Delete what this application has kept so far; results not yet collected or written can't be worked out any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/chartlines/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps neither recompute it nor depend on an executor."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once; inside a lambda a plain column expression is worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_key(*columns: Column) -> Column:
    """A 128-bit key of a row's columns, nulls told apart from empty strings; rows equal in all of them share it."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.md5(F.concat(*sized)))


def learn_row(doc_id: Column) -> Column:
    """True for documents whose labels may be learnt from; false for those held out, a null doc_id among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def fitting(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Which rows, in order, are taken if their sizes together may not pass limit: one that doesn't fit is left out and the next ones are tried."""
    taken, total = np.zeros(len(sizes), bool), 0
    for i, n in enumerate(sizes.tolist()):
        if total + n <= limit:
            taken[i], total = True, total + n
    return taken
