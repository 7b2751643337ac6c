"""Queries on reshaping, statistics, windows and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartlines.operators import reshaping as R
from chartlines.plans.canonical import CELLS, GT, PRED, WIDE, ctes, derived
from chartlines.queries import query

COLUMNS = ["discount", "price", "quantity", "tax"]
_E = "e AS (SELECT dataset_id, column_name, min(value) AS lo, max(value) AS hi FROM cells GROUP BY ALL)"


@query(ctes(cells=CELLS) + """, c AS (SELECT dataset_id, column_name, category, avg(value) AS m FROM cells GROUP BY ALL), l AS (SELECT dataset_id, column_name, list(m ORDER BY category) AS ms FROM c GROUP BY ALL)
SELECT a.dataset_id, a.column_name, min, max, round(mean, 6) AS mean, round(list_reduce(ms, lambda x, y: (x + y) / 2), 6) AS sequential
FROM (SELECT dataset_id, column_name, min(value) AS min, max(value) AS max, avg(value) AS mean FROM cells GROUP BY ALL) a JOIN l ON a.dataset_id = l.dataset_id AND a.column_name = l.column_name
""")
def a1_column_stats(spark, sf):
    return R.column_stats(derived(spark, sf, CELLS)).select("dataset_id", "column_name", "min", "max", F.round("mean", 6).alias("mean"), F.round("sequential", 6).alias("sequential"))


@query(ctes(cells=CELLS) + f""", {_E}
SELECT c.dataset_id, category, c.column_name, round(avg(p), 5) AS mean, round(stddev_pop(p), 5) AS std, round(avg(p) - stddev_pop(p), 5) AS lower, round(avg(p) + stddev_pop(p), 5) AS upper
FROM (SELECT cells.*, 300 - (value - lo) / (hi - lo) * 300 AS p FROM cells JOIN e ON cells.dataset_id = e.dataset_id AND cells.column_name = e.column_name) c GROUP BY ALL
""")
def a2_category_stats(spark, sf):
    return R.category_stats(derived(spark, sf, CELLS)).select("dataset_id", "category", "column_name", *(F.round(c, 5).alias(c) for c in ("mean", "std", "lower", "upper")))


@query("SELECT p_size AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM part GROUP BY p_size")
def a3_value_shares(spark, sf):
    return R.value_shares(spark.read.parquet(f"{sf}/part.parquet"), "p_size").select("value", "n", F.round("share", 8).alias("share"))


@query(ctes(cells=CELLS) + "SELECT dataset_id, column_name, coalesce(round(avg(value) FILTER (WHERE category = 'A'), 5), 0) AS \"A\", coalesce(round(avg(value) FILTER (WHERE category = 'N'), 5), 0) AS \"N\", coalesce(round(avg(value) FILTER (WHERE category = 'R'), 5), 0) AS \"R\" FROM cells GROUP BY ALL")
def a4_pivot(spark, sf):
    return derived(spark, sf, CELLS).groupBy("dataset_id", "column_name").pivot("category", ["A", "N", "R"]).agg(F.round(F.avg("value"), 5)).fillna(0)


@query(ctes(cells=CELLS) + f", {_E} SELECT c.dataset_id, c.row_id, c.column_name, round((value - lo) / (hi - lo), 8) AS norm, round(1 - (value - lo) / (hi - lo), 8) AS back, round(300 - (value - lo) / (hi - lo) * 300, 6) AS position FROM cells c JOIN e ON c.dataset_id = e.dataset_id AND c.column_name = e.column_name")
def r1_r2_normalise(spark, sf):
    cells = derived(spark, sf, CELLS)
    up = R.pixel_positions(R.normalise(cells))
    return up.select("dataset_id", "row_id", "column_name", F.round("norm", 8).alias("norm"), F.round(1 - F.col("norm"), 8).alias("back"), F.round("position", 6).alias("position"))


@query(ctes(cells=CELLS) + ", e AS (SELECT dataset_id, min(value) AS lo, max(value) AS hi FROM cells GROUP BY ALL) SELECT c.dataset_id, row_id, column_name, round(1 - (value - lo) / (hi - lo), 8) AS norm FROM cells c JOIN e ON c.dataset_id = e.dataset_id")
def r1_normalise_global(spark, sf):
    return R.normalise(derived(spark, sf, CELLS), reverse=True, by=("dataset_id",)).select("dataset_id", "row_id", "column_name", F.round("norm", 8).alias("norm"))


@query(ctes(cells=CELLS) + "SELECT dataset_id, row_id, category, column_name, value FROM cells")
def r3_fold(spark, sf):
    return R.fold(derived(spark, sf, WIDE), COLUMNS, "dataset_id", "row_id", "category")


@query(ctes(wide=WIDE) + "SELECT dataset_id, row_id, discount, price, quantity, tax FROM wide")
def r4_spread(spark, sf):
    return R.spread(derived(spark, sf, CELLS), COLUMNS, "dataset_id", "row_id")


@query(ctes(cells=CELLS) + f", {_E} SELECT dataset_id, column_name, i AS tick, round(lo + (hi - lo) * i / 7, 6) AS value FROM e CROSS JOIN (SELECT unnest(range(8)) AS i)")
def r5_ticks(spark, sf):
    return R.ticks(derived(spark, sf, CELLS)).select("dataset_id", "column_name", "tick", F.round("value", 6).alias("value"))


@query(ctes(wide=WIDE) + """SELECT dataset_id, row_id, 0 AS crop_id, 0.0::DOUBLE AS x1, discount AS y1, 224.0::DOUBLE AS x2, price AS y2 FROM wide UNION ALL
SELECT dataset_id, row_id, 1, 0.0, price, 224.0, quantity FROM wide UNION ALL SELECT dataset_id, row_id, 2, 0.0, quantity, 224.0, tax FROM wide""")
def w5_row_segments(spark, sf):
    return R.row_segments(derived(spark, sf, WIDE), COLUMNS, 224.0, "dataset_id", "row_id")


@query(ctes(cells=CELLS) + "SELECT dataset_id, 'crop_' || crop AS crop, category, count(*) AS n FROM (SELECT DISTINCT dataset_id, row_id, category FROM cells) CROSS JOIN (SELECT unnest([1, 2, 3]) AS crop) GROUP BY ALL")
def r7_ground_truth(spark, sf):
    found = R.ground_truth(derived(spark, sf, WIDE), COLUMNS)
    crops = found.select("dataset_id", F.explode("lines").alias("crop", "m"))
    sizes = crops.select("dataset_id", "crop", F.explode("m").alias("category", "ls")).select("dataset_id", "crop", "category", F.size("ls").alias("n"))
    return sizes.groupBy("dataset_id", "crop", "category").agg(F.sum("n").alias("n"))


_AXES = "SELECT DISTINCT l_suppkey % 40 AS image_id, CAST(l_partkey % 600 AS DOUBLE) AS x FROM {lineitem} WHERE l_partkey % 11 = 0"


@query(ctes(a=_AXES) + ", b AS (SELECT image_id, x AS left_x, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS right_x FROM a) SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY left_x) AS crop_id FROM b WHERE right_x - left_x > 10")
def w4_neighbouring_axes(spark, sf):
    return R.neighbouring_axes(derived(spark, sf, _AXES), 10.0)


@query(ctes(a=_AXES) + ", f AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY image_id ORDER BY x) > 3 THEN 1 ELSE 0 END AS f FROM a), c AS (SELECT *, sum(f) OVER (PARTITION BY image_id ORDER BY x) AS cluster FROM f) SELECT image_id, cluster, round(avg(x), 6) AS mean, count(*) AS n FROM c GROUP BY ALL")
def n1_gap_clusters(spark, sf):
    return R.gap_clusters(derived(spark, sf, _AXES), "image_id", "x", 3.0).withColumn("mean", F.round("mean", 6))


@query("WITH RECURSIVE " + ctes(a=_AXES)[5:] + """, k AS (SELECT image_id, min(x) AS x FROM a GROUP BY image_id UNION ALL SELECT k.image_id, (SELECT min(a.x) FROM a WHERE a.image_id = k.image_id AND a.x - k.x > 20) FROM k WHERE k.x IS NOT NULL)
SELECT image_id, x AS value FROM k WHERE x IS NOT NULL""")
def n2_spaced_values(spark, sf):
    return R.spaced_values(derived(spark, sf, _AXES), "image_id", "x", 20.0)


_DUP = "SELECT CAST(l_suppkey % 10 AS BIGINT) AS dataset_id, l_quantity AS value, CAST(row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS row_id FROM {lineitem}"


@query(ctes(d=_DUP) + ", r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, value ORDER BY row_id) - 1 AS k, count(*) OVER (PARTITION BY dataset_id, value) AS n FROM d) SELECT dataset_id, row_id, round(CASE WHEN k = 0 THEN 0 ELSE ceil(k / 2) * CASE WHEN k % 2 = 1 THEN 0.01 ELSE -0.01 END END, 6) AS spread, round((k - (n - 1) / 2) * 0.01, 6) AS centred FROM r")
def w10_duplicate_offsets(spark, sf):
    rows = derived(spark, sf, _DUP)
    plain = R.duplicate_offsets(rows, ["dataset_id"], "value").withColumnRenamed("offset", "spread")
    return R.duplicate_offsets(plain, ["dataset_id"], "value", centred=True).select("dataset_id", "row_id", F.round("spread", 6).alias("spread"), F.round("offset", 6).alias("centred"))


@query(ctes(pred=PRED) + "SELECT unit, line_id, score FROM pred QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, line_id) <= 2")
def w11_top_n(spark, sf):
    return R.top_n(derived(spark, sf, PRED), 2, ["unit"], F.desc("score"), F.asc("line_id")).select("unit", "line_id", "score")


@query(ctes(gt=GT) + ", n AS (SELECT count(DISTINCT image_id) AS n FROM gt) SELECT 'train' AS part, CAST(floor(n * 0.8) AS BIGINT) AS images, CAST(floor(n * 0.8) AS BIGINT) AS whole, (SELECT count(*) FROM gt) AS rows FROM n UNION ALL SELECT 'valid', n - CAST(floor(n * 0.8) AS BIGINT), n - CAST(floor(n * 0.8) AS BIGINT), (SELECT count(*) FROM gt) FROM n")
def w12_split_by_group(spark, sf):
    gt = derived(spark, sf, GT)
    split = R.split_by_group(gt, "image_id")
    # whole: images all of whose lines are in the part
    sizes = gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("all"))
    held = split.groupBy("part", "image_id").agg(F.count(F.lit(1)).alias("n")).join(sizes, "image_id")
    total = held.agg(F.sum("n").alias("rows"))
    return held.groupBy("part").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("n") == F.col("all")).alias("whole")).join(F.broadcast(total), how="left")


@query(ctes(gt=GT) + """, c AS (SELECT r_name AS value, r_regionkey + 1 AS weight FROM region), w AS (SELECT value, sum(weight) OVER (ORDER BY value) AS hi, sum(weight) OVER () AS total FROM c),
u AS (SELECT image_id, ('0x' || substr(md5(image_id || ':0'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM (SELECT DISTINCT image_id FROM gt)) SELECT image_id, arg_min(value, hi) AS value FROM u JOIN w ON u * total < hi GROUP BY image_id""")
def g4_style_draw(spark, sf):
    plots = derived(spark, sf, GT).select("image_id").distinct()
    choices = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("value"), (F.col("r_regionkey") + 1).alias("weight"))
    return R.style_draw(plots, "image_id", choices)


@query(ctes(gt=GT) + """, p AS (SELECT image_id, count(DISTINCT category) AS n FROM gt GROUP BY image_id) SELECT image_id, k - 1 AS place, i / 30.0::DOUBLE AS hue
FROM (SELECT image_id, n, i, row_number() OVER (PARTITION BY image_id ORDER BY md5(image_id || ':0:' || i)) AS k FROM p CROSS JOIN (SELECT unnest(range(30)) AS i)) WHERE k <= n""")
def g4_distinct_draw(spark, sf):
    plots = derived(spark, sf, GT).groupBy("image_id").agg(F.countDistinct("category").cast("int").alias("n"))
    return R.distinct_draw(plots, "image_id", F.col("n"))


@query(ctes(gt=GT, pred=PRED) + "SELECT unit, 'gt' AS source FROM gt INTERSECT SELECT unit, 'gt' FROM pred UNION ALL (SELECT unit, 'missing' FROM gt EXCEPT SELECT unit, 'missing' FROM pred)")
def u2_u4_key_sets(spark, sf):
    a, b = (derived(spark, sf, t).select("unit") for t in (GT, PRED))
    return a.intersect(b).withColumn("source", F.lit("gt")).unionByName(a.subtract(b).withColumn("source", F.lit("missing")))


@query(ctes(gt=GT, pred=PRED) + "SELECT unit, line_id, CAST(NULL AS DOUBLE) AS score, 'real' AS source FROM gt UNION ALL SELECT unit, line_id, score, 'predicted' FROM pred")
def u1_u5_stacked(spark, sf):
    gt = derived(spark, sf, GT).select("unit", "line_id", F.lit("real").alias("source"))
    return gt.unionByName(derived(spark, sf, PRED).select("unit", "line_id", "score", F.lit("predicted").alias("source")), allowMissingColumns=True)


@query(ctes(gt=GT) + "SELECT image_id, count(*) AS lines, count(DISTINCT crop_id) AS crops, min(y1) AS lo, max(y2) AS hi FROM gt GROUP BY image_id")
def a26_a29_counts_and_range(spark, sf):
    return derived(spark, sf, GT).groupBy("image_id").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("crop_id").alias("crops"), F.min("y1").alias("lo"), F.max("y2").alias("hi"))


_FRAMES = "SELECT DISTINCT l_suppkey % 40 AS image_id, CAST(l_partkey % 90 AS DOUBLE) / 4 AS x, CAST(l_linenumber AS DOUBLE) / 4 AS y FROM {lineitem}"


@query("WITH RECURSIVE " + ctes(f=_FRAMES)[5:] + """, k AS (SELECT image_id, min((x, y)) AS p FROM f GROUP BY image_id UNION ALL
SELECT k.image_id, (SELECT min((f.x, f.y)) FROM f WHERE f.image_id = k.image_id AND (f.x, f.y) > k.p AND (abs(f.x - k.p[1]) > 0.5 OR abs(f.y - k.p[2]) > 0.5)) FROM k WHERE k.p IS NOT NULL) SELECT image_id, p[1] AS x, p[2] AS y FROM k WHERE p IS NOT NULL""")
def n3_distinct_frames(spark, sf):
    return R.distinct_frames(derived(spark, sf, _FRAMES), "image_id")


@query(ctes(gt=GT) + ", n AS (SELECT image_id, row_number() OVER (ORDER BY image_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM gt)) SELECT unit, line_id FROM gt SEMI JOIN (SELECT image_id FROM n WHERE k <= floor(n * 0.1)) USING (image_id)")
def w15_first_share(spark, sf):
    return R.first_share(derived(spark, sf, GT), "image_id", 0.1).select("unit", "line_id")
