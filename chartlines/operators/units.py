"""Order-dependent work on one unit at a time, streamed over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

Arrays = dict[str, np.ndarray]


def stacked(found: list[Arrays | pd.DataFrame]) -> pd.DataFrame:
    """One DataFrame of the rows of all: tables, or columns as arrays or lists. Columns cost little; a DataFrame for each unit costs more than most work on a unit."""
    if isinstance(found[0], pd.DataFrame):
        return pd.concat([f for f in found if len(f)] or found[:1], ignore_index=True)
    column = lambda c: np.concatenate([np.asarray(f[c]) for f in found if len(f[c])] or [np.asarray(found[0][c])])
    return pd.DataFrame({c: column(c) for c in found[0]}, copy=False)


def spans(units: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each stretch of equal values."""
    edges = np.concatenate([[0], np.flatnonzero(units[1:] != units[:-1]) + 1, [len(units)]]).tolist()
    return list(zip(edges, edges[1:]))


def each_unit(df: DataFrame, order: list, run: Callable[[Arrays], Arrays | pd.DataFrame | np.ndarray], schema: str | None = None, key: str = "unit") -> DataFrame:
    """run(columns of one unit, in order) for every unit: the rows it returns (columns of one length, or a DataFrame), or those at the places it returns.

    Partitions are dealt by unit and sorted; a task holds one Arrow batch and one
    unit at a time, and no group costs a call of its own into Spark.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        found = [(a, run({c: v[a:b] for c, v in columns.items()})) for a, b in spans(columns[key])]
        if schema is None:
            return rows.iloc[np.concatenate([a + at for a, at in found]).astype(np.int64)]
        return stacked([f for _, f in found])

    return whole_units(df, order, work, schema or df.schema, key)


def whole_units(df: DataFrame, order: list, work: Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]], schema, key: str = "unit", at_once: int = 0) -> DataFrame:
    """work(rows of some whole units, by unit and in order) over all units; of small units, so many that they have about at_once rows. What work yields piece by piece is not held together."""
    sorted_rows = df.repartition(key).sortWithinPartitions(key, *order)
    told = lambda found: (found,) if isinstance(found, pd.DataFrame) else found

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            if not len(batch):
                continue
            held += len(batch)
            if held < at_once or left and (batch[key].iloc[-1] == left[0][key].iloc[0]):
                left.append(batch)  # too few rows, or a unit longer than the batch
                continue
            rows = pd.concat([*left, batch], ignore_index=True) if left else batch
            units = rows[key].to_numpy()
            cut = int(np.flatnonzero(units != units[-1])[-1]) + 1 if units[0] != units[-1] else 0
            left, held = [rows.iloc[cut:]], len(rows) - cut
            if cut:
                yield from told(work(rows.iloc[:cut]))
        if left:
            yield from told(work(pd.concat(left, ignore_index=True)))

    return sorted_rows.mapInPandas(stream, schema)


def each_group(df: DataFrame, keys: list[str], order: list, run: Callable[[Arrays], Arrays | pd.DataFrame], columns: str) -> DataFrame:
    """keys and the columns that run gives for the rows of each group of keys, in order; as each_unit, for several keys or keys of any type."""
    named = df.withColumn("_group", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))

    def work(rows: Arrays) -> pd.DataFrame:
        out = run(rows)
        n = len(out) if isinstance(out, pd.DataFrame) else len(next(iter(out.values())))
        own = {k: [rows[k][0]] * n for k in keys}
        return pd.DataFrame(own).join(out) if isinstance(out, pd.DataFrame) else own | out

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return each_unit(named, order, work, f"{kinds}, {columns}", key="_group")


def each_large_group(df: DataFrame, keys: list[str], order: list, run: Callable[[Arrays], Arrays | pd.DataFrame], columns: str) -> DataFrame:
    """As each_group, for groups of many rows: a task holds the columns of one group but its keys, in their own types; arrays of one length come as one two-dimensional array. run may take columns out of what it is given, so that they go."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = _parse_datatype_string(f"{kinds}, {columns}")
    out, names = to_arrow_schema(schema), [c for c in df.columns if c not in keys]
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def plain(column: pa.Array) -> np.ndarray:
        if pa.types.is_list(column.type):
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return column.to_numpy(zero_copy_only=False)

    def finish(own: tuple, pieces: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        rows = {c: np.concatenate(pieces.pop(c)) for c in names}  # a column's pieces go before the next is joined
        found = run(rows)
        table = found if isinstance(found, pd.DataFrame) else pd.DataFrame(found)
        for i, k in enumerate(keys):
            table.insert(i, k, pd.Series([own[i]] * len(table), dtype=object))
        return pa.RecordBatch.from_pandas(table, schema=out, preserve_index=False)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = lambda i: tuple(batch.column(k)[i].as_py() for k in keys)
            if at(0) == at(batch.num_rows - 1):  # rows are sorted
                cuts = [0, batch.num_rows]
            else:
                every = list(zip(*(batch.column(k).to_pylist() for k in keys)))
                cuts = [0, *(i for i in range(1, len(every)) if every[i] != every[i - 1]), len(every)]
            for a, b in zip(cuts, cuts[1:]):
                if own is not None and at(a) != own:
                    yield finish(own, pieces)
                    pieces = {}
                own = at(a)
                for c in names:
                    pieces.setdefault(c, []).append(plain(batch.column(c).slice(a, b - a)).copy())
        if own is not None:
            yield finish(own, pieces)

    return dealt.mapInArrow(stream, schema)
