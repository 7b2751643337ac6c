"""Synthetic tables, reproducible under any partitioning: each data set has its own random stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlines.operators.reshaping import style_draw


def synthetic_sets(ids: DataFrame, seed: int = 0, n_rows: str = "n_rows", n_columns: str = "n_columns", n_categories: str = "n_categories") -> DataFrame:
    """dataset_id, row_id, column_name, value, category for each row of ids (dataset_id, n_rows, n_columns, n_categories).

    Columns share a covariance 0.9 * A A'; categories have means of their own, ten
    times as wide; columns are scaled by 1, 10, 100 or 1000 and every other one is
    rounded. A data set depends on seed and dataset_id alone.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dataset, rows, columns, categories in batch.itertuples(index=False):
                rng = np.random.default_rng([seed, int(dataset)])
                a = rng.normal(size=(columns, columns))
                means = rng.normal(size=(categories, columns)) * 10
                category = rng.integers(0, categories, rows)
                values = means[category] + rng.multivariate_normal(np.zeros(columns), 0.9 * a @ a.T, rows, method="cholesky") if rows else np.zeros((0, columns))
                values = values * rng.permutation(np.resize([1, 10, 100, 1000], columns))
                values[:, 1::2] = np.round(values[:, 1::2])
                yield pd.DataFrame({"dataset_id": dataset, "row_id": np.repeat(np.arange(rows), columns), "column_name": np.tile([f"c{k}" for k in range(columns)], rows), "value": values.ravel(), "category": np.repeat([f"cat{c}" for c in category], columns)})

    return ids.select("dataset_id", n_rows, n_columns, n_categories).mapInPandas(make, "dataset_id long, row_id long, column_name string, value double, category string")


def drawn_sizes(ids: DataFrame, shares: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """ids with a column drawn from shares (value, share: one row for each size) by a hash of dataset_id and name."""
    drawn = style_draw(ids.withColumn("_key", F.concat_ws("/", "dataset_id", F.lit(name))), "_key", shares.select("value", F.col("share").alias("weight")), seed)
    return ids.withColumn("_key", F.concat_ws("/", "dataset_id", F.lit(name))).join(drawn.distinct().withColumnRenamed("value", name), "_key", "left").drop("_key")
