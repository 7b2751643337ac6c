"""The library's tables derived from the given ones, by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: True segments: one for each line of an order; unit = order, image = four orders, crop = order within it.
GT = """
SELECT unit, CAST(floor(unit / 4) AS BIGINT) AS image_id, CAST(unit % 4 AS INT) AS crop_id, category, line_id,
       CAST(sk % 20 AS DOUBLE) AS x1, CAST(qty * 4 AS DOUBLE) AS y1, CAST(224 - sk % 17 AS DOUBLE) AS x2, CAST(pk % 224 AS DOUBLE) AS y2, pk, sk
FROM (SELECT l_orderkey AS unit, l_returnflag AS category, l_partkey AS pk, l_suppkey AS sk, l_quantity AS qty,
             CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS line_id
      FROM {lineitem})
"""
#: Predicted segments: true ones with a jitter, some missing, some ends swapped, and some that are not there.
PRED = f"""
SELECT unit, image_id, crop_id, category, line_id, CASE WHEN sk % 2 = 0 THEN x2 ELSE x1 END AS x1, CASE WHEN sk % 2 = 0 THEN y2 ELSE y1 END AS y1,
       CASE WHEN sk % 2 = 0 THEN x1 ELSE x2 END AS x2, CASE WHEN sk % 2 = 0 THEN y1 ELSE y2 END AS y2,
       CAST((pk * 7919 + line_id * 31) % 1000 AS DOUBLE) / 1000 AS score, pk, sk
FROM (SELECT unit, image_id, crop_id, category, line_id, x1, y1 + ((pk * 37 + sk * 11) % 13 - 6) AS y1, x2, y2 - ((pk * 37 + sk * 11) % 5 - 2) AS y2, pk, sk
      FROM ({GT}) WHERE pk % 7 <> 0
      UNION ALL
      SELECT unit, image_id, crop_id, category, line_id + 1000 AS line_id, x1 + 1, CAST((pk * 13) % 224 AS DOUBLE) AS y1, x2 - 1, CAST((pk * 29) % 224 AS DOUBLE) AS y2, pk, sk
      FROM ({GT}) WHERE pk % 5 = 0)
"""
#: Mask cells of 7 pixels along most true segments.
MASK = f"""
SELECT DISTINCT unit, CAST(floor((y1 + (y2 - y1) * i / 15) / 7 + 0.5) AS BIGINT) AS y, CAST(floor((x1 + (x2 - x1) * i / 15) / 7 + 0.5) AS BIGINT) AS x
FROM ({GT}) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15)) AS steps(i) WHERE pk % 3 <> 0
"""
#: Pixels of ten images of three crops; hues gather around five values.
PIXELS = """
SELECT CAST(l_suppkey % 10 AS BIGINT) AS image_id, CAST(l_linenumber % 3 AS INT) AS crop_id, CAST(l_orderkey % 300 AS INT) AS y, CAST((l_partkey * 7 + l_linenumber) % 224 AS INT) AS x,
       CAST(((l_suppkey % 5) * 36 + (l_partkey * l_linenumber) % 9 + CASE WHEN l_suppkey % 5 = 0 THEN 176 ELSE 0 END) % 180 AS INT) AS h,
       CAST(l_quantity * 5 AS INT) AS s, CAST(l_partkey % 256 AS INT) AS v,
       CAST(l_partkey % 256 AS INT) AS r, CAST((l_partkey * 3 + l_suppkey) % 256 AS INT) AS g, CAST((l_suppkey * 5 + l_orderkey) % 256 AS INT) AS b
FROM {lineitem}
"""
#: Names of files with their key inside, in three orders of tokens.
NAMES = """
SELECT l_orderkey AS id, l_linenumber AS n, CASE CAST(l_partkey % 3 AS INT)
  WHEN 0 THEN concat('image_', CAST(l_orderkey AS VARCHAR(20)), '_crop_', CAST(l_linenumber AS VARCHAR(20)), '_', l_returnflag)
  WHEN 1 THEN concat('image_', CAST(l_orderkey AS VARCHAR(20)), '_', l_returnflag, '_crop_', CAST(l_linenumber AS VARCHAR(20)))
  ELSE concat('image_', CAST(l_orderkey AS VARCHAR(20)), '_crop_', CAST(l_linenumber AS VARCHAR(20)), '_', l_linestatus, '_mask_post') END AS name
FROM {lineitem}
"""
#: Tabular rows in long form: ten data sets of four columns.
CELLS = """
SELECT dataset_id, row_id, column_name, CASE column_name WHEN 'discount' THEN d WHEN 'price' THEN p WHEN 'quantity' THEN q ELSE t END AS value, category
FROM (SELECT CAST(l_suppkey % 10 AS BIGINT) AS dataset_id, l_returnflag AS category, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t,
             CAST(row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS row_id
      FROM {lineitem}) CROSS JOIN (VALUES ('discount'), ('price'), ('quantity'), ('tax')) AS columns_of(column_name)
"""
#: Wide form of the same rows.
WIDE = """
SELECT CAST(l_suppkey % 10 AS BIGINT) AS dataset_id, l_returnflag AS category, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
       CAST(row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS row_id
FROM {lineitem}
"""


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, lineitem=source(spark, sf_dir, "lineitem"))


def ctes(**tables: str) -> str:
    """WITH clause that names the given derivations, for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({s.replace('{lineitem}', 'lineitem')})" for n, s in tables.items()) + "\n"


def kept_sql(rows: str, near: str, order: str) -> str:
    """SQL tables nl and kept (unit, line_id) for WITH RECURSIVE: lines of `rows` taken one after another in order, each taking out those for which near (of a and b) holds."""
    return f"""ko AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY {order}) AS o FROM {rows}),
nl AS MATERIALIZED (SELECT a.unit, a.line_id, a.o, list(b.line_id) AS near FROM ko a JOIN ko b ON a.unit = b.unit AND ({near}) GROUP BY ALL),
kr AS (SELECT DISTINCT unit, []::BIGINT[] AS ids, []::BIGINT[] AS dead FROM nl UNION ALL
  SELECT kr.unit, list_append(any_value(ids), arg_min(nl.line_id, nl.o)), list_concat(any_value(dead), arg_min(nl.near, nl.o)) FROM kr JOIN nl ON nl.unit = kr.unit WHERE NOT list_contains(dead, nl.line_id) GROUP BY kr.unit),
kept AS (SELECT DISTINCT unit, unnest(ids) AS line_id FROM kr)
"""
