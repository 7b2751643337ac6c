"""Queries on keys, geometry and filters of segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartlines.functions import geometry as G
from chartlines.functions import keys as K
from chartlines.operators import filters
from chartlines.plans.canonical import GT, MASK, NAMES, PRED, ctes, derived, kept_sql
from chartlines.queries import query

_R = "round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2"


def _coords(df, *keys, digits=4):
    return df.select(*keys, *(F.round(c, digits).alias(c) for c in G.COORDS))


@query(ctes(n=NAMES) + r"""
SELECT id, n, name, TRY_CAST(regexp_extract(name, 'image_(\d+)', 1) AS INT) AS image_id, TRY_CAST(regexp_extract(name, 'crop_?(\d+)', 1) AS INT) AS crop_id,
  nullif(array_to_string(list_filter(string_split(regexp_replace(name, '(^|_)(image|crop)_?\d+', '', 'g'), '_'), lambda t: t <> ''), '_'), '') AS code,
  array_to_string(list_sort(string_split(lower(name), '_')), '_') AS token_key, regexp_replace(lower(name), '_?crop_?\d+', '', 'g') AS base_key,
  array_to_string(string_split(name, '_')[1:4], '_') AS crop_key, regexp_replace(name, '^image_(\d+)_(.+)_crop_(\d+)$', 'image_\1_crop_\3_\2') AS crop_first,
  nullif(regexp_extract(name, '_(mask_post|pre|mask|post)$', 1), '') AS tag, TRY_CAST(regexp_extract(name, '(\d+)', 1) AS INT) AS first_number
FROM n
""")
def p1_p6_parse_names(spark, sf):
    name = F.col("name")
    return derived(spark, sf, NAMES).select("id", "n", "name", K.image_id(name).alias("image_id"), K.crop_id(name).alias("crop_id"), K.category_code(name).alias("code"), K.token_key(name).alias("token_key"), K.base_key(name).alias("base_key"), K.crop_key(name).alias("crop_key"), K.crop_first(name).alias("crop_first"), K.result_tag(name).alias("tag"), K.first_number(name).alias("first_number"))


@query(ctes(n=NAMES) + r"""
, k AS (SELECT DISTINCT CASE WHEN category = 'A' THEN 'A' ELSE 'N' END AS label, CASE WHEN category = 'A' THEN 0 ELSE 1 END AS cat_id FROM (SELECT l_returnflag AS category FROM lineitem)),
c AS (SELECT id, n, nullif(array_to_string(list_filter(string_split(regexp_replace(name, '(^|_)(image|crop)_?\d+', '', 'g'), '_'), lambda t: t <> ''), '_'), '') AS label FROM n),
f AS (SELECT label, 1 + row_number() OVER (ORDER BY label) AS cat_id FROM (SELECT DISTINCT label FROM c WHERE label IS NOT NULL AND label NOT IN (SELECT label FROM k)))
SELECT c.label, cat_id, count(*) AS rows FROM c JOIN (SELECT * FROM k UNION ALL SELECT * FROM f) USING (label) GROUP BY ALL
""")
def p7_category_ids(spark, sf):
    rows = derived(spark, sf, NAMES).select(K.category_code(F.col("name")).alias("label"))
    known = derived(spark, sf, GT).select(F.when(F.col("category") == "A", "A").otherwise("N").alias("label"), F.when(F.col("category") == "A", 0).otherwise(1).alias("cat_id")).distinct()
    return K.with_category_ids(rows, known).groupBy("label", "cat_id").agg(F.count(F.lit(1)).alias("rows"))


_ORIENTED = """SELECT unit, line_id, CASE WHEN sw THEN x2 ELSE x1 END AS x1, CASE WHEN sw THEN y2 ELSE y1 END AS y1, CASE WHEN sw THEN x1 ELSE x2 END AS x2, CASE WHEN sw THEN y1 ELSE y2 END AS y2, score, image_id, crop_id, category
FROM (SELECT *, x1 > x2 OR (x1 = x2 AND y1 > y2) AS sw FROM pred)"""


@query(ctes(pred=PRED) + f"SELECT unit, line_id, x1, y1, x2, y2 FROM ({_ORIENTED})")
def p8_orient(spark, sf):
    return G.orient(derived(spark, sf, PRED)).select("unit", "line_id", *G.COORDS)


@query(ctes(pred=PRED) + """
SELECT unit, line_id, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS length, round(a, 6) AS signed, round(CASE WHEN a - 180 * floor(a / 180) = 180 THEN 0 ELSE a - 180 * floor(a / 180) END, 6) AS angle
FROM (SELECT *, degrees(atan2(y2 - y1, x2 - x1)) AS a FROM pred)
""")
def p10_p11_length_and_angle(spark, sf):
    s = G.seg()
    return derived(spark, sf, PRED).select("unit", "line_id", F.round(G.length(s), 6).alias("length"), F.round(G.signed_angle(s), 6).alias("signed"), F.round(G.angle(s), 6).alias("angle"))


_PAIRS = """(SELECT p.unit, p.line_id AS p, g.line_id AS g, p.x1 AS a, p.y1 AS b, p.x2 AS c, p.y2 AS d, g.x1 AS e, g.y1 AS f, g.x2 AS h, g.y2 AS k FROM pred p JOIN gt g ON p.unit = g.unit)"""
_D11, _D22, _D12, _D21 = "sqrt((a-e)*(a-e)+(b-f)*(b-f))", "sqrt((c-h)*(c-h)+(d-k)*(d-k))", "sqrt((a-h)*(a-h)+(b-k)*(b-k))", "sqrt((c-e)*(c-e)+(d-f)*(d-f))"


def _pairs(spark, sf):
    p = derived(spark, sf, PRED).select("unit", F.col("line_id").alias("p"), *(F.col(c).alias(f"p_{c}") for c in G.COORDS))
    g = derived(spark, sf, GT).select("unit", F.col("line_id").alias("g"), *(F.col(c).alias(f"g_{c}") for c in G.COORDS))
    return p.join(g, "unit"), G.seg("p_"), G.seg("g_")


@query(ctes(gt=GT, pred=PRED) + f"""
SELECT unit, p, g, round(least({_D11} + {_D22}, {_D12} + {_D21}) / 2, 5) AS mean_ends, round({_D11} + {_D22}, 5) AS l2, round(least({_D11} + {_D22}, {_D12} + {_D21}), 5) AS l2_swap,
  round(abs(a-e)+abs(b-f)+abs(c-h)+abs(d-k), 5) AS l1, round(least(abs(a-e)+abs(b-f)+abs(c-h)+abs(d-k), abs(a-h)+abs(b-k)+abs(c-e)+abs(d-f)) / 4, 5) AS ends_mae,
  round(sqrt(((a+c)/2-(e+h)/2)*((a+c)/2-(e+h)/2) + ((b+d)/2-(f+k)/2)*((b+d)/2-(f+k)/2)), 5) AS midpoint,
  round(least((a-e)*(a-e)+(b-f)*(b-f)+(c-h)*(c-h)+(d-k)*(d-k), (a-h)*(a-h)+(b-k)*(b-k)+(c-e)*(c-e)+(d-f)*(d-f)), 5) AS squared
FROM {_PAIRS}
""")
def p13_pair_costs(spark, sf):
    met, a, b = _pairs(spark, sf)
    kinds = ("mean_ends", "l2", "l2_swap", "l1", "ends_mae", "midpoint", "squared")
    return met.select("unit", "p", "g", *(F.round(G.pair_cost(k, a, b), 5).alias(k) for k in kinds))


_PT = "sqrt(({px}-({x1}+{t}*({x2}-{x1})))*({px}-({x1}+{t}*({x2}-{x1}))) + ({py}-({y1}+{t}*({y2}-{y1})))*({py}-({y1}+{t}*({y2}-{y1}))))"


def _pt(px, py, x1, y1, x2, y2):
    t = f"greatest(0.0, least(1.0, (({px}-{x1})*({x2}-{x1})+({py}-{y1})*({y2}-{y1}))/(({x2}-{x1})*({x2}-{x1})+({y2}-{y1})*({y2}-{y1}))))"
    return _PT.format(px=px, py=py, x1=x1, y1=y1, x2=x2, y2=y2, t=t)


@query(ctes(gt=GT, pred=PRED) + f"""
SELECT unit, p, g, round(({_pt('a','b','e','f','h','k')} + {_pt('c','d','e','f','h','k')} + {_pt('e','f','a','b','c','d')} + {_pt('h','k','a','b','c','d')}) / 4, 5) AS symmetric,
  round(greatest(0.0, least(greatest(a,c), greatest(e,h)) - greatest(least(a,c), least(e,h))) / least(greatest(a,c)-least(a,c), greatest(e,h)-least(e,h)), 5) AS x_overlap
FROM {_PAIRS}
""")
def p12_segment_distances(spark, sf):
    met, a, b = _pairs(spark, sf)
    return met.select("unit", "p", "g", F.round(G.symmetric_distance(a, b), 5).alias("symmetric"), F.round(G.x_overlap(a, b), 5).alias("x_overlap"))


@query(ctes(gt=GT) + "SELECT unit, line_id, round(x1 * (224 / x2), 2) AS x1, round(y1 * (224 / 321.0::DOUBLE), 2) AS y1, round(x2 * (224 / x2), 2) AS x2, round(y2 * (224 / 321.0::DOUBLE), 2) AS y2 FROM gt")
def p14_to_square(spark, sf):
    return G.to_square(derived(spark, sf, GT)).select("unit", "line_id", *G.COORDS)


@query(ctes(gt=GT) + """
SELECT unit, line_id, round(x1 * 224 / mx, 4) AS x1, round(y1 * 224 / my, 4) AS y1, round(x2 * 224 / mx, 4) AS x2, round(y2 * 224 / my, 4) AS y2
FROM (SELECT *, max(greatest(x1, x2)) OVER (PARTITION BY unit) AS mx, max(greatest(y1, y2)) OVER (PARTITION BY unit) AS my FROM gt)
""")
def p15_rescale_by_own_extent(spark, sf):
    return _coords(G.rescale_by_own_extent(derived(spark, sf, GT)), "unit", "line_id")


@query(ctes(gt=GT) + "SELECT unit, line_id, x1 + o AS x1, y1, x2 + o AS x2, y2 FROM (SELECT *, (dense_rank() OVER (PARTITION BY image_id ORDER BY crop_id) - 1) * 224 AS o FROM gt)")
def p15_crop_offset(spark, sf):
    return G.crop_offset(derived(spark, sf, GT)).select("unit", "line_id", *G.COORDS)


@query(ctes(gt=GT) + "SELECT unit, line_id, greatest(0.0, least(99.0, x1)) AS x1, greatest(0.0, least(119.0, y1)) AS y1, greatest(0.0, least(99.0, x2)) AS x2, greatest(0.0, least(119.0, y2)) AS y2 FROM gt WHERE greatest(abs(x1), abs(x2)) <= 220 AND greatest(abs(y1), abs(y2)) <= 264")
def p16_clip(spark, sf):
    return G.clip(derived(spark, sf, GT), 100.0, 120.0, 2.2).select("unit", "line_id", *G.COORDS)


@query(ctes(gt=GT) + """
SELECT unit, line_id, flip, CASE WHEN flip % 2 = 1 THEN 224 - x1 ELSE x1 END AS x1, CASE WHEN flip >= 2 THEN 224 - y1 ELSE y1 END AS y1, CASE WHEN flip % 2 = 1 THEN 224 - x2 ELSE x2 END AS x2, CASE WHEN flip >= 2 THEN 224 - y2 ELSE y2 END AS y2
FROM gt CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(flip)
""")
def p22_flips(spark, sf):
    return G.flips(derived(spark, sf, GT), 224.0, 224.0).select("unit", "line_id", "flip", *G.COORDS)


@query(ctes(gt=GT) + "SELECT unit, line_id, CASE WHEN s THEN x2 ELSE x1 END AS x1, CASE WHEN s THEN y2 ELSE y1 END AS y1, CASE WHEN s THEN x1 ELSE x2 END AS x2, CASE WHEN s THEN y1 ELSE y2 END AS y2 FROM (SELECT *, ('0x' || substr(md5(unit || ':' || line_id || ':0'), 1, 12))::BIGINT < 140737488355328 AS s FROM gt)")
def p23_random_swap(spark, sf):
    return G.random_swap(derived(spark, sf, GT), "unit", "line_id").select("unit", "line_id", *G.COORDS)


@query(ctes(gt=GT) + "SELECT unit, line_id, y1 AS a, x1 AS b, y2 AS c, x2 AS d, floor(y1 / 8 + 0.5) AS rounded FROM gt")
def p9_p17_yx_and_rounding(spark, sf):
    rows = G.to_yx(derived(spark, sf, GT))
    return rows.select("unit", "line_id", *(F.col("line")[i][j].alias(n) for n, i, j in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))), G.round_half_up(F.col("y1") / 8).cast("double").alias("rounded"))


@query(ctes(pred=PRED) + "SELECT unit, line_id, score FROM pred WHERE score >= 0.4")
def f1_by_score(spark, sf):
    return filters.by_score(derived(spark, sf, PRED), 0.4).select("unit", "line_id", "score")


@query(ctes(pred=PRED, mask=MASK) + """
SELECT unit, line_id FROM pred p WHERE EXISTS (SELECT 1 FROM mask m WHERE m.unit = p.unit AND m.y = floor(p.y1 / 7) AND m.x = floor(p.x1 / 7))
  AND EXISTS (SELECT 1 FROM mask m WHERE m.unit = p.unit AND m.y = floor(p.y2 / 7) AND m.x = floor(p.x2 / 7))
""")
def f2_ends_on_mask(spark, sf):
    return filters.ends_on_mask(derived(spark, sf, PRED), derived(spark, sf, MASK), 7.0).select("unit", "line_id")


@query(ctes(pred=PRED, mask=MASK) + """
SELECT unit, line_id, round(avg(hit), 6) AS share FROM (
  SELECT c.unit, c.line_id, CASE WHEN m.unit IS NULL THEN 0 ELSE 1 END AS hit FROM (
    SELECT unit, line_id, CAST(round_even((x1 + CAST(i AS DOUBLE) / 15.0::DOUBLE * (x2 - x1)) / 7, 0) AS BIGINT) AS x, CAST(round_even((y1 + CAST(i AS DOUBLE) / 15.0::DOUBLE * (y2 - y1)) / 7, 0) AS BIGINT) AS y
    FROM pred CROSS JOIN (SELECT unnest(range(16)) AS i)) c LEFT JOIN mask m ON c.unit = m.unit AND c.x = m.x AND c.y = m.y)
GROUP BY unit, line_id HAVING avg(hit) >= 0.5
""")
def f3_share_on_mask(spark, sf):
    found = filters.share_on_mask(derived(spark, sf, PRED), derived(spark, sf, MASK), 16, 7.0)
    return found.where(F.col("share") >= 0.5).select("unit", "line_id", F.round("share", 6).alias("share"))


@query(ctes(gt=GT, pred=PRED) + """
, j AS (SELECT unit, x1 AS x, y1 AS y FROM gt UNION SELECT unit, x2, y2 FROM gt)
SELECT p.unit, p.line_id FROM pred p JOIN j ON p.unit = j.unit GROUP BY p.unit, p.line_id, x1, y1, x2, y2
HAVING min(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))) <= 3 AND min(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) <= 3
""")
def f4_near_junctions(spark, sf):
    gt = derived(spark, sf, GT)
    spots = gt.select("unit", F.col("x1").alias("x"), F.col("y1").alias("y")).union(gt.select("unit", "x2", "y2")).distinct()
    return filters.near_junctions(derived(spark, sf, PRED), spots, 3.0).select("unit", "line_id")


_PADDED = "SELECT unit, line_id, x1, y1, x2, y2 FROM ({gt}) UNION ALL SELECT unit, line_id + 50, x1, y1, x2, y2 FROM ({gt}) WHERE unit % 2 = 0"


@query(ctes(gt=GT) + ", p AS (" + _PADDED.format(gt="SELECT * FROM gt") + """),
h AS (SELECT unit, min(b.line_id) AS stop FROM p a JOIN p b USING (unit) WHERE a.line_id = 0 AND b.line_id > 0 AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2 GROUP BY unit)
SELECT p.unit, count(*) AS rows, max(line_id) AS last FROM p LEFT JOIN h ON p.unit = h.unit WHERE stop IS NULL OR line_id < stop GROUP BY p.unit
""")
def f5_cut_padding(spark, sf):
    rows = derived(spark, sf, _PADDED.format(gt=GT))
    return filters.cut_padding(rows).groupBy("unit").agg(F.count(F.lit(1)).alias("rows"), F.max("line_id").alias("last"))


_KEYED = "round_even(x1 / 30, 0) AS a, round_even(y1 / 30, 0) AS b, round_even(x2 / 30, 0) AS c, round_even(y2 / 30, 0) AS d"


@query(ctes(pred=PRED) + f"SELECT unit, line_id FROM (SELECT unit, line_id, row_number() OVER (PARTITION BY unit, a, b, c, d ORDER BY line_id) AS n FROM (SELECT unit, line_id, {_KEYED} FROM pred)) WHERE n = 1")
def d1_dedupe_quantised(spark, sf):
    return filters.dedupe_quantised(derived(spark, sf, PRED), 30.0).select("unit", "line_id")


@query(ctes(pred=PRED) + f"SELECT unit, line_id FROM (SELECT unit, line_id, row_number() OVER (PARTITION BY unit, least((a, b), (c, d)), greatest((a, b), (c, d)) ORDER BY line_id) AS n FROM (SELECT unit, line_id, {_KEYED} FROM pred)) WHERE n = 1")
def d2_dedupe_unordered(spark, sf):
    return filters.dedupe_quantised(derived(spark, sf, PRED), 30.0, unordered=True).select("unit", "line_id")


_AB = {f"{i}{j}": f"sqrt((a.x{i}-b.x{j})*(a.x{i}-b.x{j})+(a.y{i}-b.y{j})*(a.y{i}-b.y{j}))" for i in (1, 2) for j in (1, 2)}


@query("WITH RECURSIVE " + ctes(pred=PRED)[5:] + ", " + kept_sql("pred", f"least({_AB['11']}+{_AB['22']}, {_AB['12']}+{_AB['21']}) / 2 < 12", "score DESC, line_id") + "SELECT p.unit, p.line_id, score FROM pred p SEMI JOIN kept k ON k.unit = p.unit AND k.line_id = p.line_id")
def d3_suppress(spark, sf):
    return filters.suppress(derived(spark, sf, PRED), 12.0).select("unit", "line_id", "score")


@query()
def d3_suppress_collinear(spark, sf):
    return filters.suppress_collinear(derived(spark, sf, PRED), 8.0, 10.0, 0.5).select("unit", "line_id", "score")


@query()
def d4_clip_overlaps(spark, sf):
    return _coords(filters.clip_overlaps(derived(spark, sf, PRED), 0.0, 6.0), "unit", "line_id")


@query("WITH RECURSIVE " + ctes(pred=PRED)[5:] + ", " + kept_sql("pred", "(a.x1-b.x1)*(a.x1-b.x1)+(a.y1-b.y1)*(a.y1-b.y1)+(a.x2-b.x2)*(a.x2-b.x2)+(a.y2-b.y2)*(a.y2-b.y2) <= 144", "line_id") + "SELECT unit, line_id FROM kept")
def d5_drop_near_copies(spark, sf):
    return filters.drop_near_copies(derived(spark, sf, PRED), 12.0).select("unit", "line_id")


@query()
def f7_result_kinds(spark, sf):
    return filters.result_kinds(derived(spark, sf, PRED), derived(spark, sf, MASK), 0.3, 0.5, 16, 7.0).select("kind", "unit", "line_id", "score")
