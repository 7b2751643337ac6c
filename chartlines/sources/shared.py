"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and driver and tasks are one process."""
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
    """df written as Parquet in the shared folder and read back: lineage ends there."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with their place (from 1) in an order over all of them: numbered within ranges, what stands before a range coming from a table with one row a range."""
    parts = keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    heads = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = heads.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_before")
