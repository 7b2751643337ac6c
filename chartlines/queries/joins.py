"""Queries on joins and stitching."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartlines.operators import joins as J
from chartlines.operators import reshaping as R
from chartlines.plans.canonical import GT, NAMES, PIXELS, PRED, ctes, derived, source
from chartlines.queries import colours, query

_COLOURS = "SELECT DISTINCT l_suppkey % 10 AS image_id, concat('c', CAST(l_suppkey % 5 AS VARCHAR(9))) AS category, CAST(l_suppkey % 5 AS DOUBLE) / 5 AS h, 0.6 + CAST(0 AS DOUBLE) AS s, 0.7 + CAST(0 AS DOUBLE) AS v FROM {lineitem}"


@query(ctes(gt=GT, pred=PRED) + "SELECT coalesce(a.unit, b.unit) AS unit, CASE WHEN a.unit IS NULL THEN 'only_b' WHEN b.unit IS NULL THEN 'only_a' ELSE 'both' END AS state FROM (SELECT DISTINCT unit FROM gt) a FULL JOIN (SELECT DISTINCT unit FROM pred) b ON a.unit = b.unit")
def j1_presence(spark, sf):
    return J.presence(derived(spark, sf, GT), derived(spark, sf, PRED), ["unit"])


@query(ctes(gt=GT, pred=PRED) + "SELECT image_id, crop_id, category, count(*) AS lines FROM gt SEMI JOIN pred USING (image_id, crop_id, category) GROUP BY ALL")
def j2_j3_matched_keys(spark, sf):
    keys = ["image_id", "crop_id", "category"]
    return derived(spark, sf, GT).join(derived(spark, sf, PRED), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"))


_EX = "SELECT image_id, crop_id, category, min(pk) AS value FROM ({gt}) WHERE pk % 3 = 0 GROUP BY image_id, crop_id, category"
_GE = "SELECT image_id, crop_id, min(sk) AS value FROM ({gt}) WHERE sk % 2 = 0 GROUP BY image_id, crop_id"


@query(ctes(gt=GT, pred=PRED) + ", ex AS (" + _EX.format(gt="SELECT * FROM gt") + "), ge AS (" + _GE.format(gt="SELECT * FROM gt") + """)
SELECT unit, line_id, coalesce(e.value, g.value) AS value, CASE WHEN e.value IS NOT NULL THEN 'exact' WHEN g.value IS NOT NULL THEN 'general' END AS matched
FROM pred p LEFT JOIN ex e ON p.image_id = e.image_id AND p.crop_id = e.crop_id AND p.category = e.category LEFT JOIN ge g ON p.image_id = g.image_id AND p.crop_id = g.crop_id""")
def j5_with_fallback(spark, sf):
    exact, general = derived(spark, sf, _EX.format(gt=GT)), derived(spark, sf, _GE.format(gt=GT))
    found = J.with_fallback(derived(spark, sf, PRED), exact, general, ["image_id", "crop_id", "category"], ["image_id", "crop_id"], "value")
    return found.select("unit", "line_id", "value", "matched")


_HSV = "SELECT unit, line_id, image_id % 10 AS image_id, CAST(pk % 180 AS DOUBLE) / 180 AS h, CAST(pk % 7 AS DOUBLE) / 7 AS s, CAST(sk % 9 AS DOUBLE) / 9 AS v FROM ({gt})"
_GAP = "sqrt(least(abs(r.h-c.h), 1-abs(r.h-c.h))*least(abs(r.h-c.h), 1-abs(r.h-c.h))+(r.s-c.s)*(r.s-c.s)+(r.v-c.v)*(r.v-c.v))"


@query(ctes(gt=GT, c=_COLOURS) + ", r AS (" + _HSV.format(gt="SELECT * FROM gt") + f") SELECT unit, line_id, c.category, round({_GAP}, 6) AS colour_distance, {_GAP} <= 0.3 AS within_tol FROM r JOIN c ON r.image_id = c.image_id QUALIFY row_number() OVER (PARTITION BY unit, line_id ORDER BY {_GAP}, c.category) = 1")
def j6_j8_nearest_colour(spark, sf):
    found = J.nearest_colour(derived(spark, sf, _HSV.format(gt=GT)), derived(spark, sf, _COLOURS), ["image_id"], ["unit", "line_id"], 0.3)
    return found.select("unit", "line_id", "category", F.round("colour_distance", 6).alias("colour_distance"), "within_tol")


@query(ctes(gt=GT, c=_COLOURS) + ", r AS (" + _HSV.format(gt="SELECT * FROM gt") + """), e AS (SELECT image_id, min(h) AS lo, max(h) AS hi FROM c GROUP BY image_id),
m AS (SELECT r.*, CASE WHEN h <= 0.07 THEN lo WHEN h > 0.9 THEN hi ELSE h END AS mh FROM r JOIN e USING (image_id)),
d AS (SELECT unit, line_id, c.category, sqrt((mh-c.h)*(mh-c.h)+(m.s-c.s)*(m.s-c.s)+(m.v-c.v)*(m.v-c.v)) AS d FROM m JOIN c USING (image_id))
SELECT unit, line_id, category, round(d, 6) AS colour_distance, d < 0.3 AS within_tol FROM d QUALIFY row_number() OVER (PARTITION BY unit, line_id ORDER BY d, category) = 1""")
def j6_red_edge(spark, sf):
    found = J.nearest_colour_red_edge(derived(spark, sf, _HSV.format(gt=GT)), derived(spark, sf, _COLOURS), ["image_id"], ["unit", "line_id"], 0.3)
    return found.select("unit", "line_id", "category", F.round("colour_distance", 6).alias("colour_distance"), "within_tol")


_AX = "SELECT DISTINCT image_id, CAST(floor(x1 / 5) * 45 AS DOUBLE) AS x FROM ({gt})"
_WIDE = "SELECT unit, line_id, image_id, x1 * 10 AS x1, y1, x1 * 10 + (pk % 30) AS x2, y2 FROM ({gt})"


@query(ctes(gt=GT) + ", a AS (" + _AX.format(gt="SELECT * FROM gt") + "), s AS (" + _WIDE.format(gt="SELECT * FROM gt") + """), b AS (SELECT image_id, x AS l, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS r FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY l) AS crop_id FROM b WHERE r - l > 0)
SELECT unit, line_id, crop_id, x1 - l AS x1, x2 - l AS x2 FROM s JOIN n ON s.image_id = n.image_id WHERE abs(x1 - x2) >= 1e-9 AND least(x1, x2) >= l AND greatest(x1, x2) <= r""")
def j7_axis_interval(spark, sf):
    boxes = R.neighbouring_axes(derived(spark, sf, _AX.format(gt=GT)))
    return J.to_axis_interval(derived(spark, sf, _WIDE.format(gt=GT)), boxes).select("unit", "line_id", "crop_id", "x1", "x2")


@query(ctes(gt=GT) + "SELECT unit, line_id, CASE WHEN unit % 5 = 0 THEN -1.0 ELSE y1 END AS y1 FROM gt")
def j20_overridden(spark, sf):
    gt = derived(spark, sf, GT)
    new = gt.where(F.col("unit") % 5 == 0).select("unit", F.lit(-1.0).alias("y1")).distinct()
    return J.overridden(gt, new, ["unit"], "y1").select("unit", "line_id", "y1")


_SPOT = "SELECT unit, line_id, image_id % 10 AS image_id, crop_id % 3 AS crop_id, x1, y1, x2, y2 FROM ({gt})"
_PX1 = "SELECT image_id, crop_id, y, x, min(r) AS r, min(g) AS g, min(b) AS b FROM ({px}) GROUP BY image_id, crop_id, y, x"


@query(ctes(gt=GT, px=PIXELS) + ", q AS (" + _PX1.format(px="SELECT * FROM px") + "), s AS (" + _SPOT.format(gt="SELECT * FROM gt") + """), t AS (SELECT unit, line_id, image_id, crop_id, floor(y1) AS y, floor(x1) AS x FROM s UNION ALL SELECT unit, line_id, image_id, crop_id, floor((y1+y2)/2), floor((x1+x2)/2) FROM s UNION ALL SELECT unit, line_id, image_id, crop_id, floor(y2), floor(x2) FROM s)
SELECT unit, line_id, round(avg(coalesce(r, 0)), 5) AS r, round(avg(coalesce(g, 0)), 5) AS g, round(avg(coalesce(b, 0)), 5) AS b FROM t LEFT JOIN q ON t.image_id = q.image_id AND t.crop_id = q.crop_id AND t.y = q.y AND t.x = q.x GROUP BY ALL""")
def p28_segment_colour(spark, sf):
    pixels = derived(spark, sf, _PX1.format(px=PIXELS))
    found = J.segment_colour(derived(spark, sf, _SPOT.format(gt=GT)), pixels)
    return found.select("unit", "line_id", *(F.round(c, 5).alias(c) for c in "rgb"))


_STEP = "SELECT n.image_id, n.category, n.unit, n.path_id, arg_min(s.y1, (abs(s.y1 - n.e), s.unit, s.line_id)) AS y1, arg_min(s.y2, (abs(s.y1 - n.e), s.unit, s.line_id)) AS e, min(abs(s.y1 - n.e)) AS d FROM {a} n JOIN gt s ON n.image_id = s.image_id AND n.category = s.category AND s.crop_id = {k} AND abs(s.y1 - n.e) <= 30 GROUP BY ALL"


@query(ctes(gt=GT) + ", a0 AS (SELECT image_id, category, unit, line_id AS path_id, y1, y2 AS e, 0.0::DOUBLE AS d FROM gt WHERE crop_id = 0), a1 AS (" + _STEP.format(a="a0", k=1) + "), a2 AS (" + _STEP.format(a="a1", k=2) + """)
SELECT x.image_id, x.category, x.unit, x.path_id, x.crop_id, x.y1, x.y2, x.match_dist FROM (SELECT *, 0 AS crop_id, e AS y2, d AS match_dist FROM a0 UNION ALL SELECT *, 1, e, d FROM a1 UNION ALL SELECT *, 2, e, d FROM a2) x SEMI JOIN a2 USING (image_id, category, unit, path_id)""")
def j13_stitch(spark, sf):
    return J.stitch(derived(spark, sf, GT), 3, 30.0)


_ALL = "SELECT *, coalesce(y2, last) AS e FROM (SELECT n.image_id, n.category, n.unit, n.path_id, n.e AS last, arg_min(s.y1, (abs(s.y1 - n.e), s.unit, s.line_id)) AS y1, arg_min(s.y2, (abs(s.y1 - n.e), s.unit, s.line_id)) AS y2, min(abs(s.y1 - n.e)) AS match_dist FROM {a} n LEFT JOIN gt s ON n.image_id = s.image_id AND n.category = s.category AND s.crop_id = {k} AND abs(s.y1 - n.e) <= 30 GROUP BY ALL)"


@query(ctes(gt=GT) + ", a0 AS (SELECT image_id, category, unit, line_id AS path_id, y1, y2, 0.0::DOUBLE AS match_dist, y2 AS e FROM gt WHERE crop_id = 0), a1 AS (" + _ALL.format(a="a0", k=1) + "), a2 AS (" + _ALL.format(a="a1", k=2) + """)
SELECT image_id, category, unit, path_id, 0 AS crop_id, y1, y2, match_dist FROM a0 UNION ALL SELECT image_id, category, unit, path_id, 1, coalesce(y1, last), e, match_dist FROM a1 UNION ALL SELECT image_id, category, unit, path_id, 2, coalesce(y1, last), e, match_dist FROM a2""")
def j14_stitch_keep_all(spark, sf):
    return J.stitch(derived(spark, sf, GT), 3, 30.0, keep_all=True, carry=True)


_BEFORE = "SELECT s.image_id, s.category, s.unit, s.line_id, s.y1, s.y2, arg_min(n.unit, (abs(s.y1 - n.y2), n.unit, n.line_id)) AS bu, arg_min(n.line_id, (abs(s.y1 - n.y2), n.unit, n.line_id)) AS bl FROM gt s LEFT JOIN gt n ON n.image_id = s.image_id AND n.category = s.category AND n.crop_id = {k} - 1 AND abs(s.y1 - n.y2) <= 10 WHERE s.crop_id = {k} GROUP BY ALL"


@query(ctes(gt=GT) + ", s1 AS (" + _BEFORE.format(k=1) + "), s2 AS (" + _BEFORE.format(k=2) + """)
SELECT s2.image_id, s2.category, s2.unit, s2.line_id AS path_id, 2 AS crop_id, s2.y1, s2.y2 FROM s2 UNION ALL
SELECT s2.image_id, s2.category, s2.unit, s2.line_id, 1, s1.y1, s1.y2 FROM s2 LEFT JOIN s1 ON s1.unit = s2.bu AND s1.line_id = s2.bl UNION ALL
SELECT s2.image_id, s2.category, s2.unit, s2.line_id, 0, g.y1, g.y2 FROM s2 LEFT JOIN s1 ON s1.unit = s2.bu AND s1.line_id = s2.bl LEFT JOIN gt g ON g.unit = s1.bu AND g.line_id = s1.bl""")
def j15_stitch_branching(spark, sf):
    return J.stitch_branching(derived(spark, sf, GT), 3, 10.0)


@query(ctes(n=NAMES) + r""", m AS (SELECT 'image_' || o_orderkey || '_r' AS base, max(o_totalprice) AS price FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT id, n, name, price FROM n LEFT JOIN m ON m.base = regexp_replace(lower(name), '_?crop_?\d+', '', 'g')""")
def j4_with_metadata(spark, sf):
    metadata = source(spark, sf, "orders").where(F.col("o_orderkey") % 2 == 0).groupBy(F.concat(F.lit("image_"), "o_orderkey", F.lit("_r")).alias("base")).agg(F.max("o_totalprice").alias("price"))
    return J.with_metadata(derived(spark, sf, NAMES).select("id", "n", "name"), metadata, F.col("name"))


@query(ctes(n=NAMES) + r""", e AS (SELECT o_orderkey AS id, o_totalprice AS price, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_totalprice) AS k FROM orders) SELECT n.id, n, name, price FROM n JOIN e ON e.id = n.id AND k = 1""")
def j19_entry_of_image(spark, sf):
    entries = source(spark, sf, "orders").select(F.concat(F.lit("image_"), "o_orderkey", F.lit("_all")).alias("name"), F.col("o_totalprice").alias("price"))
    return J.by_image_entry(derived(spark, sf, NAMES).select("id", "n", "name"), entries, F.col("name"), "price")


@query(ctes(px=PIXELS) + ", c AS (SELECT r, g, b, arg_min('cat' || v, v) AS category FROM px WHERE v % 2 = 0 AND s > 100 GROUP BY ALL) SELECT r, g, b, coalesce(category, 'unknown') AS category, count(*) AS n FROM px LEFT JOIN c USING (r, g, b) GROUP BY ALL")
def j10_category_of_stroke(spark, sf):
    px = derived(spark, sf, PIXELS)
    colours = px.where("v % 2 = 0 AND s > 100").select("r", "g", "b", F.col("v").alias("place"), F.concat(F.lit("cat"), "v").alias("category"))
    return J.category_of_stroke(px, colours).groupBy("r", "g", "b", "category").agg(F.count(F.lit(1)).alias("n"))


@query(ctes(gt=GT, px=PIXELS) + ", " + colours._RANGES + ", s AS (" + _SPOT.format(gt="SELECT * FROM gt") + """), p AS (SELECT DISTINCT image_id, crop_id, y, x, h FROM px)
SELECT unit, line_id, min(cluster) AS cluster FROM s JOIN p ON s.image_id = p.image_id AND s.crop_id = p.crop_id AND p.y = CAST(floor((y1 + y2) / 2) AS BIGINT) AND p.x = CAST(floor((x1 + x2) / 2) AS BIGINT)
JOIN ranges r ON r.image_id = s.image_id AND r.crop_id = s.crop_id AND h BETWEEN lo - 1 AND hi + 1 GROUP BY ALL""")
def j9_category_of_midpoint(spark, sf):
    found = J.category_of_midpoint(derived(spark, sf, _SPOT.format(gt=GT)), derived(spark, sf, PIXELS), colours._ranges(spark, sf), ["image_id", "crop_id"], 1)
    return found.select("unit", "line_id", "cluster")


@query()
def j16_stitch_with_limit(spark, sf):
    return J.stitch_with_limit(derived(spark, sf, GT), 30.0, 1)


@query(ctes(gt=GT) + ", n AS (SELECT *, row_number() OVER (PARTITION BY image_id, category, y2 ORDER BY unit, line_id) - 1 AS k FROM gt) SELECT unit, line_id, round(y2 + CASE WHEN k % 2 = 1 THEN (k + 1) // 2 * 0.1 ELSE -(k // 2) * 0.1 END, 6) AS y2 FROM n")
def j16_spread_ties(spark, sf):
    spread = J.spread_ties(derived(spark, sf, GT), ["image_id", "category"], "y2", ["unit", "line_id"])
    return spread.select("unit", "line_id", F.round("y2", 6).alias("y2"))


@query("WITH RECURSIVE " + ctes(gt=GT)[5:] + """, sh AS (SELECT *, 224 * (dense_rank() OVER (PARTITION BY image_id ORDER BY crop_id) - 1) AS dx FROM gt),
sg AS (SELECT image_id, category, crop_id, x1 + dx AS x1, y1, x2 + dx AS x2, y2,
  row_number() OVER (PARTITION BY image_id, category ORDER BY crop_id, unit, line_id) AS i, dense_rank() OVER (PARTITION BY image_id, category ORDER BY crop_id) AS ci FROM sh),
cr AS MATERIALIZED (SELECT image_id, category, ci, list({'i': i, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY i) AS sg FROM sg GROUP BY ALL),
st AS (SELECT image_id, category, CAST(1 AS BIGINT) AS ci, CAST(1 AS BIGINT) AS p, CAST(0 AS BIGINT) AS np, []::STRUCT(x DOUBLE, y DOUBLE, n INT)[] AS ends, []::BIGINT[] AS taken, []::STRUCT(p BIGINT, s INT, i BIGINT)[] AS made FROM cr WHERE ci = 1
  UNION ALL SELECT image_id, category, CASE WHEN p > np THEN ci + 1 ELSE ci END, CASE WHEN p > np THEN 1 ELSE p + 1 END, CASE WHEN p > np THEN np + len(free) ELSE np END,
    CASE WHEN p > np THEN list_concat(ends, list_transform(free, lambda z: {'x': z.x2, 'y': z.y2, 'n': 0::INT})) WHEN best IS NULL THEN ends ELSE list_concat(ends[1 : p - 1], [{'x': best.x2, 'y': best.y2, 'n': (ends[p].n + 1)::INT}], ends[p + 1 :]) END,
    CASE WHEN p > np THEN []::BIGINT[] WHEN best IS NULL THEN taken ELSE list_append(taken, best.i) END,
    CASE WHEN p > np THEN list_concat(made, list_transform(free, lambda z, k: {'p': (np + k - 1)::BIGINT, 's': 0::INT, 'i': z.i::BIGINT})) WHEN best IS NULL THEN made ELSE list_append(made, {'p': (p - 1)::BIGINT, 's': (ends[p].n + 1)::INT, 'i': best.i::BIGINT}) END
  FROM (SELECT *, CASE WHEN p <= np THEN list_sort(list_filter(list_transform(free, lambda z: {'d': (z.x1 - ends[p].x) * (z.x1 - ends[p].x) + (z.y1 - ends[p].y) * (z.y1 - ends[p].y), 'i': z.i, 'x2': z.x2, 'y2': z.y2}), lambda z: z.d <= 1600))[1] END AS best
        FROM (SELECT st.*, list_filter(cr.sg, lambda z: NOT list_contains(taken, z.i)) AS free FROM st JOIN cr ON cr.image_id = st.image_id AND cr.category = st.category AND cr.ci = st.ci))),
done AS (SELECT image_id, category, unnest(made) AS m FROM st WHERE p = 1 QUALIFY ci = max(ci) OVER (PARTITION BY image_id, category))
SELECT sg.image_id, sg.category, m.p AS path_id, m.s AS step, x1, y1, x2, y2 FROM done JOIN sg ON sg.image_id = done.image_id AND sg.category = done.category AND sg.i = m.i""")
def j17_stitch_global(spark, sf):
    from chartlines.functions.geometry import crop_offset

    return J.stitch_global(crop_offset(derived(spark, sf, GT)), 40.0)


@query(ctes(gt=GT, pred=PRED) + ", e AS (SELECT DISTINCT unit, x1 AS px, y1 AS py FROM pred) SELECT g.unit, g.line_id, round(least(coalesce(min(sqrt((x1-px)*(x1-px)+(y1-py)*(y1-py))), 30), 30), 6) AS d FROM gt g LEFT JOIN e ON g.unit = e.unit GROUP BY ALL")
def j12_nearest_point(spark, sf):
    points = derived(spark, sf, PRED).select("unit", F.col("x1").alias("px"), F.col("y1").alias("py")).distinct()
    rows = derived(spark, sf, GT).select("unit", "line_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return J.nearest_point(rows, points, "unit", ["line_id"], 30.0).select("unit", "line_id", F.round("d", 6).alias("d"))
