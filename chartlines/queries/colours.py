"""Queries on colours, hue clusters and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlines.functions import colour as C
from chartlines.operators import clusters as K
from chartlines.operators import palettes as P
from chartlines.plans.canonical import PIXELS, ctes, derived, kept_sql
from chartlines.queries import query

KEYS = ["image_id", "crop_id"]
_H = "h AS (SELECT image_id, crop_id, h AS bin, count(*) AS n FROM px GROUP BY ALL)"


@query(ctes(px=PIXELS) + "SELECT image_id, crop_id, CAST(floor(h * 72 / 180) AS INT) AS bin, sum(s) AS n FROM px GROUP BY ALL")
def a15_hue_histogram(spark, sf):
    return K.hue_histogram(derived(spark, sf, PIXELS), KEYS, 72, "s")


_RANGES = _H + """, a AS (SELECT *, sum(n) OVER (PARTITION BY image_id, crop_id ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS r FROM h),
f AS (SELECT image_id, crop_id, bin, CASE WHEN bin - lag(bin) OVER (PARTITION BY image_id, crop_id ORDER BY bin) > 2 THEN 1 ELSE 0 END AS f FROM a WHERE r >= 120),
c AS (SELECT image_id, crop_id, bin AS core, sum(f) OVER (PARTITION BY image_id, crop_id ORDER BY bin) AS cluster FROM f),
o AS (SELECT h.image_id, h.crop_id, bin, n, arg_min(cluster, (abs(bin - core), core)) AS cluster FROM h JOIN c ON h.image_id = c.image_id AND h.crop_id = c.crop_id AND abs(bin - core) <= 2 GROUP BY ALL),
ranges AS (SELECT image_id, crop_id, cluster, min(bin) AS lo, max(bin) AS hi, round(sum(bin * n) / sum(n), 6) AS centre, sum(n) AS n FROM o GROUP BY ALL)
"""


def _ranges(spark, sf):
    return K.hue_ranges(K.hue_histogram(derived(spark, sf, PIXELS), KEYS), KEYS, 2, 120)


@query(ctes(px=PIXELS) + ", " + _RANGES + "SELECT * FROM ranges")
def c1_hue_ranges(spark, sf):
    return _ranges(spark, sf).withColumn("centre", F.round("centre", 6))


@query(ctes(px=PIXELS) + ", " + _RANGES + "SELECT * FROM (SELECT image_id, crop_id, count(*) AS clusters FROM ranges GROUP BY image_id, crop_id) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY clusters DESC, crop_id) = 1")
def a17_best_crop(spark, sf):
    return K.best_crop(_ranges(spark, sf))


@query(ctes(px=PIXELS) + ", " + _RANGES + "SELECT image_id, crop_id, cluster, row_number() OVER (PARTITION BY image_id, crop_id ORDER BY centre) AS category_no FROM ranges")
def w14_numbered_by_hue(spark, sf):
    return K.numbered_by_hue(_ranges(spark, sf)).select(*KEYS, "cluster", "category_no")


@query(ctes(px=PIXELS) + ", " + _RANGES + "SELECT image_id, crop_id, cluster, count(*) AS pixels FROM (SELECT p.image_id, p.crop_id, p.y, p.x, p.h, min(cluster) AS cluster FROM (SELECT DISTINCT image_id, crop_id, y, x, h FROM px WHERE s >= 50 AND v >= 50) p JOIN ranges r ON p.image_id = r.image_id AND p.crop_id = r.crop_id AND p.h BETWEEN lo - 1 AND hi + 1 GROUP BY ALL) GROUP BY ALL")
def c8_assign_ranges(spark, sf):
    pixels = C.foreground(derived(spark, sf, PIXELS), "sv").select(*KEYS, "y", "x", "h").distinct()
    return K.assign_ranges(pixels, _ranges(spark, sf), KEYS, 1).groupBy(*KEYS, "cluster").agg(F.count(F.lit(1)).alias("pixels"))


def _peaks(share: float, distance: int) -> str:
    """SQL tables for WITH RECURSIVE up to pk (image_id, crop_id, bin, n): middles of plateaus above both sides, the higher first claiming distance bins."""
    return f"""{_H}, dn AS (SELECT g.image_id, g.crop_id, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id, crop_id FROM h) g CROSS JOIN (SELECT unnest(range(180)) AS bin) b LEFT JOIN h ON h.image_id = g.image_id AND h.crop_id = g.crop_id AND h.bin = b.bin),
fl AS (SELECT *, CASE WHEN n <> lag(n) OVER (PARTITION BY image_id, crop_id ORDER BY bin) THEN 1 ELSE 0 END AS f FROM dn), ru AS (SELECT *, sum(f) OVER (PARTITION BY image_id, crop_id ORDER BY bin) AS r FROM fl),
pl AS (SELECT image_id, crop_id, r, min(bin) AS i, max(bin) AS j, any_value(n) AS n FROM ru GROUP BY ALL), nb AS (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b, max(n) OVER (PARTITION BY image_id, crop_id) AS top FROM pl WINDOW w AS (PARTITION BY image_id, crop_id ORDER BY r)),
tp AS (SELECT image_id * 10 + crop_id AS unit, (i + j) // 2 AS line_id, n FROM nb WHERE n > a AND n > b AND n >= {share} * top), {kept_sql("tp", f"abs(a.line_id - b.line_id) < {distance}", "n DESC, line_id DESC")},
pk AS (SELECT CAST(floor(tp.unit / 10) AS BIGINT) AS image_id, tp.unit % 10 AS crop_id, tp.line_id AS bin, n FROM tp SEMI JOIN kept ON kept.unit = tp.unit AND kept.line_id = tp.line_id)
"""


@query("WITH RECURSIVE " + ctes(px=PIXELS)[5:] + ", " + _peaks(0.3, 10) + "SELECT * FROM pk")
def w6_hue_peaks(spark, sf):
    return K.hue_peaks(K.hue_histogram(derived(spark, sf, PIXELS), KEYS), KEYS, 0.3, 10)


@query("WITH RECURSIVE " + ctes(px=PIXELS)[5:] + ", " + _peaks(0.05, 5) + ", near AS (SELECT DISTINCT h.* FROM h JOIN pk ON h.image_id = pk.image_id AND h.crop_id = pk.crop_id AND abs(h.bin - pk.bin) <= 1), " + _RANGES.replace(_H + ", ", "").replace("FROM h)", "FROM near)").replace("FROM h JOIN", "FROM near h JOIN") + "SELECT * FROM ranges")
def c2_ranges_near_peaks(spark, sf):
    hist = K.hue_histogram(derived(spark, sf, PIXELS), KEYS)
    near = K.near_peaks(hist, K.hue_peaks(hist, KEYS, 0.05, 5), KEYS, 1)
    return K.hue_ranges(near, KEYS, 2, 120).withColumn("centre", F.round("centre", 6))


_SETTLED = """, tb AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY image_id, crop_id ORDER BY n DESC, bin DESC) <= 12),
rd AS (SELECT image_id, crop_id, bin FROM tb UNION SELECT image_id, crop_id, 0 FROM tb GROUP BY ALL HAVING count(*) FILTER (WHERE bin <= 10 OR bin >= 170) = 0),
mk AS (SELECT image_id, crop_id, min(bin) AS bin FROM rd GROUP BY ALL UNION ALL
  SELECT mk.image_id, mk.crop_id, (SELECT min(rd.bin) FROM rd WHERE rd.image_id = mk.image_id AND rd.crop_id = mk.crop_id AND rd.bin - mk.bin > 15 AND NOT (mk.bin < 15 AND rd.bin > 164)) FROM mk WHERE mk.bin IS NOT NULL),
st AS (SELECT *, min(bin) OVER w AS lo, max(bin) OVER w AS hi FROM mk WHERE bin IS NOT NULL WINDOW w AS (PARTITION BY image_id, crop_id))
SELECT image_id, crop_id, bin FROM st WHERE CASE WHEN lo = 0 AND hi >= 165 THEN bin < 165 WHEN hi = 179 AND lo <= 15 THEN bin > 15 ELSE true END"""


@query("WITH RECURSIVE " + ctes(px=PIXELS)[5:] + ", " + _H + _SETTLED)
def w8_settled_peaks(spark, sf):
    return K.settled_peaks(K.top_bins(K.hue_histogram(derived(spark, sf, PIXELS), KEYS), KEYS, 12), KEYS)


@query(ctes(px=PIXELS) + """, h AS (SELECT image_id, v AS bin, count(*) AS n FROM px GROUP BY ALL), w AS (SELECT *, sum(n) OVER u AS w0, sum(bin * n) OVER u AS s0, sum(n) OVER (PARTITION BY image_id) AS w, sum(bin * n) OVER (PARTITION BY image_id) AS s FROM h WINDOW u AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
v AS (SELECT image_id, bin, round(CASE WHEN w = w0 THEN 0 ELSE CAST(w0 AS DOUBLE) * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) END, 3) AS v FROM w) SELECT image_id, arg_min(bin, (-v, bin)) AS threshold FROM v GROUP BY image_id""")
def c9_otsu(spark, sf):
    hist = derived(spark, sf, PIXELS).groupBy("image_id", F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return K.otsu(hist, ["image_id"])


@query(ctes(px=PIXELS) + "SELECT image_id, theta, rho, votes FROM (SELECT image_id, theta, CAST(round_even(x * cos(radians(theta)) + y * sin(radians(theta)), 0) AS INT) AS rho, count(*) AS votes FROM (SELECT * FROM px WHERE v > 200) CROSS JOIN (SELECT unnest(range(0, 180, 3)) AS theta) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, theta, rho) <= 5")
def c11_hough_votes(spark, sf):
    return K.hough_votes(C.foreground(derived(spark, sf, PIXELS), "v", 200), ["image_id"])


@query(ctes(px=PIXELS) + "SELECT * FROM (SELECT image_id, r, g, b, count(*) AS n FROM px GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) = 1")
def a16_background(spark, sf):
    return K.background(derived(spark, sf, PIXELS), ["image_id"])


@query(ctes(px=PIXELS) + "SELECT image_id, bool_or(s > 0.117) AS black FROM (SELECT image_id, crop_id, avg(CASE WHEN v < 30 THEN 1 ELSE 0 END) AS s FROM px GROUP BY ALL) GROUP BY image_id")
def a18_has_black(spark, sf):
    return K.has_black(derived(spark, sf, PIXELS), 0.117)


@query(ctes(px=PIXELS) + """, m AS (SELECT *, (r + g + b) / 3.0::DOUBLE AS m FROM px), k AS (SELECT *, m < 120 AND sqrt(((r-m)*(r-m)+(g-m)*(g-m)+(b-m)*(b-m))/3) < 60 AS k FROM m)
SELECT image_id, sum(CASE WHEN k THEN 255 ELSE r END) AS r, sum(CASE WHEN k THEN 255 ELSE g END) AS g, sum(CASE WHEN k THEN 255 ELSE b END) AS b, count(*) FILTER (WHERE CASE WHEN k THEN 765 ELSE r + g + b END < 750) AS foreground FROM k GROUP BY image_id""")
def p25_p26_background_and_foreground(spark, sf):
    white = C.whiten_background(derived(spark, sf, PIXELS), 120, 60)
    fore = C.foreground(white).groupBy("image_id").agg(F.count(F.lit(1)).alias("foreground"))
    return white.groupBy("image_id").agg(*(F.sum(c).alias(c) for c in "rgb")).join(fore, "image_id")


@query(ctes(px=PIXELS) + """, d AS (SELECT image_id, crop_id, min(h) AS a, max(h) AS b, min((h + 90) % 180) AS c, max((h + 90) % 180) AS d FROM px WHERE h NOT BETWEEN 40 AND 150 GROUP BY ALL)
SELECT image_id, crop_id, CASE WHEN d - c < b - a THEN (c + 90) % 180 ELSE a END AS lo, CASE WHEN d - c < b - a THEN (d + 90) % 180 ELSE b END AS hi, d - c < b - a AS wraps FROM d""")
def p24_hue_range(spark, sf):
    return C.hue_range(derived(spark, sf, PIXELS).where(~F.col("h").between(40, 150)), *KEYS)


@query(ctes(px=PIXELS) + """, q AS (SELECT DISTINCT r, g, b, greatest(r, g, b) / 255.0::DOUBLE AS v, (greatest(r, g, b) - least(r, g, b)) / 255.0::DOUBLE AS d FROM px)
SELECT r, g, b, round(v, 4) AS v, round(CASE WHEN v = 0 THEN 0 ELSE d / v END + 0.0000001, 4) AS s, greatest(r, g, b) - least(r, g, b) < 15 OR least(r, g, b) > 240 AS grey,
  round(CASE WHEN d = 0 THEN 0 WHEN r >= greatest(g, b) THEN (6 + (g - b) / (255.0::DOUBLE * d)) / 6 - floor((6 + (g - b) / (255.0::DOUBLE * d)) / 6) WHEN g >= b THEN (2 + (b - r) / (255.0::DOUBLE * d)) / 6 ELSE (4 + (r - g) / (255.0::DOUBLE * d)) / 6 END + 0.0000001, 4) AS h FROM q""")
def p21_colours(spark, sf):
    r, g, b = (F.col(c) for c in "rgb")
    rows = derived(spark, sf, PIXELS).select("r", "g", "b").distinct()
    hsv = C.rgb_to_hsv(r, g, b)
    return rows.select("r", "g", "b", F.round(hsv["v"], 4).alias("v"), F.round(hsv["s"] + 0.0000001, 4).alias("s"), F.round(hsv["h"] + 0.0000001, 4).alias("h"), C.is_grey_or_white(r, g, b).alias("grey"))


@query(ctes(px=PIXELS).replace("WITH", "WITH RECURSIVE", 1) + """, hb AS (SELECT image_id, CAST(floor(h * 72 / 180) AS INT) AS bin, CAST(sum(s) AS DOUBLE) AS n FROM px GROUP BY ALL),
dn AS (SELECT g.image_id, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM hb) g CROSS JOIN (SELECT unnest(range(72)) AS bin) b LEFT JOIN hb ON hb.image_id = g.image_id AND hb.bin = b.bin),
tp AS (SELECT a.image_id, (a.bin + 0.5::DOUBLE) / 72 AS hue, a.n, row_number() OVER (PARTITION BY a.image_id ORDER BY a.n DESC, a.bin) AS o
       FROM dn a JOIN dn l ON l.image_id = a.image_id AND l.bin = (a.bin + 71) % 72 JOIN dn r ON r.image_id = a.image_id AND r.bin = (a.bin + 1) % 72 WHERE a.n > l.n AND a.n >= r.n AND a.n > 0),
gr AS (SELECT image_id, o, n AS top, [hue] AS hs, [n] AS ws FROM tp WHERE o = 1
  UNION ALL SELECT image_id, o, top,
    CASE WHEN m = 0 THEN list_append(hs, hue) ELSE list_concat(hs[1 : m - 1], [(hs[m] * ws[m] + hue * n) / (ws[m] + n)], hs[m + 1 :]) END,
    CASE WHEN m = 0 THEN list_append(ws, n) ELSE list_concat(ws[1 : m - 1], [ws[m] + n], ws[m + 1 :]) END
  FROM (SELECT gr.image_id, tp.o, top, hs, ws, hue, n, coalesce(list_position(list_transform(hs, lambda x: least(abs(hue - x), 1 - abs(hue - x)) <= 0.05::DOUBLE), true), 0) AS m
        FROM gr JOIN tp ON tp.image_id = gr.image_id AND tp.o = gr.o + 1)),
un AS (SELECT image_id, top, unnest(hs) AS hue, unnest(ws) AS w, unnest(range(len(hs))) AS i FROM gr QUALIFY o = max(o) OVER (PARTITION BY image_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w DESC, i) AS place FROM un),
so AS (SELECT image_id, list_sort(list(DISTINCT hue)) AS hs FROM rk WHERE place = 1 OR (place <= 8 AND w >= 0.18::DOUBLE * top) GROUP BY image_id),
ch AS (SELECT image_id, hs, 2 AS i, [hs[1]] AS k FROM so UNION ALL SELECT image_id, hs, i + 1, CASE WHEN hs[i] - k[len(k)] > 0.03::DOUBLE THEN list_append(k, hs[i]) ELSE k END FROM ch WHERE i <= len(hs))
SELECT image_id, 'cat' || unnest(range(1, len(k) + 1)) AS category, round(unnest(k), 9) AS hue FROM ch WHERE i > len(hs)""")
def w7_w9_prominent_hues(spark, sf):
    hist = K.hue_histogram(derived(spark, sf, PIXELS), ["image_id"], 72, "s")
    return P.distinct_hues(P.prominent_hues(hist, ["image_id"]), ["image_id"]).withColumn("hue", F.round("hue", 9))


@query()
def c3_hue_mixture(spark, sf):
    return P.hue_mixture(K.hue_histogram(derived(spark, sf, PIXELS), KEYS), KEYS)


@query()
def c4_c5_colour_centres(spark, sf):
    colours = derived(spark, sf, PIXELS).groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    centres = P.colour_centres(colours, ["image_id"], 4, judged=False)
    return P.assign_centres(colours, centres, ["image_id"]).groupBy("image_id", "centre_no").agg(F.sum("n").alias("pixels"))


@query()
def c10_vertical_axes(spark, sf):
    dark = derived(spark, sf, PIXELS).where("v < 60")
    return P.vertical_axes(dark, 0.1, 20)


_LIN = "CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END AS l{c}"


@query(ctes(px=PIXELS) + ", q AS (SELECT DISTINCT r, g, b, " + ", ".join(_LIN.format(c=c) for c in "rgb") + """ FROM px), t AS (SELECT r, g, b, (0.412453*lr+0.357580*lg+0.180423*lb)/0.950456 AS x, 0.212671*lr+0.715160*lg+0.072169*lb AS y, (0.019334*lr+0.119193*lg+0.950227*lb)/1.088754 AS z FROM q),
f AS (SELECT *, """ + ", ".join(f"CASE WHEN {k} > 0.008856 THEN pow({k}, 1/3.0::DOUBLE) ELSE 7.787*{k}+16/116.0::DOUBLE END AS f{k}" for k in "xyz") + """ FROM t) SELECT r, g, b, round(CASE WHEN y > 0.008856 THEN 116*fy-16 ELSE 903.3*y END, 4) AS l, round(500*(fx-fy), 4) AS aa, round(200*(fy-fz), 4) AS bb FROM f""")
def c6_lab_values(spark, sf):
    lab = C.rgb_to_lab(*(F.col(c) for c in "rgb"))
    return derived(spark, sf, PIXELS).select("r", "g", "b").distinct().select("r", "g", "b", F.round(lab["l"], 4).alias("l"), F.round(lab["a"], 4).alias("aa"), F.round(lab["b"], 4).alias("bb"))


@query()
def c6_lab_clusters(spark, sf):
    lab = C.rgb_to_lab(*(F.col(c) for c in "rgb"))
    fore = C.foreground(derived(spark, sf, PIXELS), "sv")
    colours = fore.groupBy("image_id", F.round(lab["l"] * 2.55).alias("l"), F.round(lab["a"] + 128).alias("a"), F.round(lab["b"] + 128).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return P.colour_clusters(colours, ["image_id"], ("l", "a", "b"), 14.0, 12)


@query()
def c7_dominant_hues(spark, sf):
    return P.dominant_hues(derived(spark, sf, PIXELS), ["image_id"], 24.0, 20, 1)


@query()
def a28_space_scores(spark, sf):
    colours = derived(spark, sf, PIXELS).groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    spaces = reduce(DataFrame.unionByName, [colours.select(F.lit(s).alias("space"), "image_id", P.features(s).alias("v"), "n") for s in P.FEATURE_SPACES])
    scores = P.feature_centres(spaces, ["space", "image_id"], 4).select("space", "image_id", "inertia", "silhouette").distinct()
    return scores.groupBy("space").agg(F.count(F.lit(1)).alias("images"), F.avg("inertia").alias("inertia"), F.avg(F.nanvl("silhouette", F.lit(None))).alias("silhouette"))


@query(ctes(px=PIXELS) + """, n AS (SELECT image_id, crop_id, count(*) AS n FROM px WHERE s >= 50 AND v >= 50 GROUP BY ALL)
SELECT image_id, crop_id, n FROM n QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, crop_id) = 1""")
def a17_reference_crop(spark, sf):
    return P.reference_crop(C.foreground(derived(spark, sf, PIXELS), "sv"))


@query()
def c5_categories_from_reference(spark, sf):
    found = P.categories_from_reference(C.foreground(derived(spark, sf, PIXELS), "sv"))
    return found.groupBy("image_id", "crop_id", "k", "centre_no").agg(F.count(F.lit(1)).alias("colours"), F.sum("n").alias("pixels"))


_CENTRES = {"lab": ((30.0, 20.0, -40.0), (60.0, -30.0, 30.0), (75.0, 5.0, 60.0)), "rgb": ((10.0, 200.0, 90.0), (240.0, 30.0, 30.0))}


@query(ctes(px=PIXELS) + ", q AS (SELECT DISTINCT r, g, b, " + ", ".join(_LIN.format(c=c) for c in "rgb") + """ FROM px), t AS (SELECT r, g, b, (0.412453*lr+0.357580*lg+0.180423*lb)/0.950456 AS x, 0.212671*lr+0.715160*lg+0.072169*lb AS y, (0.019334*lr+0.119193*lg+0.950227*lb)/1.088754 AS z FROM q),
f AS (SELECT *, """ + ", ".join(f"CASE WHEN {k} > 0.008856 THEN pow({k}, 1/3.0::DOUBLE) ELSE 7.787*{k}+16/116.0::DOUBLE END AS f{k}" for k in "xyz") + """ FROM t),
lab AS (SELECT r, g, b, CASE WHEN y > 0.008856 THEN 116*fy-16 ELSE 903.3*y END AS l, 500*(fx-fy) AS aa, 200*(fy-fz) AS bb FROM f),
d AS (SELECT r, g, b, 'lab' AS space, i, round((l-p)*(l-p)+(aa-q)*(aa-q)+(bb-s)*(bb-s), 9) AS d FROM lab CROSS JOIN (VALUES (0, 30.0::DOUBLE, 20.0::DOUBLE, -40.0::DOUBLE), (1, 60, -30, 30), (2, 75, 5, 60)) AS c(i, p, q, s)
  UNION ALL SELECT r, g, b, 'rgb', i, round((r-p)*(r-p)+(g-q)*(g-q)+(b-s)*(b-s), 9) FROM q CROSS JOIN (VALUES (0, 10.0::DOUBLE, 200.0::DOUBLE, 90.0::DOUBLE), (1, 240, 30, 30)) AS c(i, p, q, s))
SELECT space, r, g, b, arg_min(i, (d, i)) AS centre_no FROM d GROUP BY space, r, g, b""")
def c6_nearest_centres(spark, sf):
    centres = spark.createDataFrame([(s, i, list(c)) for s, cs in _CENTRES.items() for i, c in enumerate(cs)], "space string, centre_no int, centre array<double>")
    colours = derived(spark, sf, PIXELS).select("r", "g", "b").distinct()
    points = reduce(DataFrame.unionByName, [colours.select(F.lit(s).alias("space"), "r", "g", "b", P.features(s).alias("v")) for s in _CENTRES])
    return P.nearest_centres(points, centres, ["space"]).select("space", "r", "g", "b", "centre_no")


@query(ctes(px=PIXELS) + ", c AS (SELECT DISTINCT image_id, 'c' || (h // 20) AS category FROM px), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY category) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM c) SELECT image_id, category, round(i / n, 8) AS hue, CASE i % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS colour FROM n")
def p27_palettes(spark, sf):
    cats = derived(spark, sf, PIXELS).select("image_id", F.concat(F.lit("c"), F.floor(F.col("h") / 20)).alias("category")).distinct()
    palette = spark.createDataFrame([(0, "red"), (1, "green"), (2, "blue")], "place long, colour string")
    return C.cycled_palette(C.default_palette(cats, "image_id"), palette, "image_id").select("image_id", "category", F.round("hue", 8).alias("hue"), "colour")


@query(ctes(px=PIXELS) + "SELECT image_id, crop_id, h, count(*) AS pixels FROM px WHERE s > 40 AND v > 40 AND NOT ((h < 8 OR h > 172) AND s > 80 AND v > 60) GROUP BY ALL")
def f6_coloured_without_red(spark, sf):
    return C.coloured(derived(spark, sf, PIXELS)).groupBy(*KEYS, "h").agg(F.count(F.lit(1)).alias("pixels"))


_CATS = "SELECT DISTINCT CAST(floor(l_orderkey / 4) AS BIGINT) AS image_id, concat('c', CAST(l_partkey % 7 AS VARCHAR(9))) AS category FROM {lineitem}"
_OWN = "SELECT DISTINCT CAST(floor(l_orderkey / 4) AS BIGINT) AS image_id, concat('c', CAST(l_partkey % 7 AS VARCHAR(9))) AS category, CAST(l_partkey % 7 AS DOUBLE) / 4 AS h, CAST(l_partkey % 7 AS DOUBLE) / 5 AS s, CAST(NULL AS DOUBLE) AS v FROM {lineitem} WHERE floor(l_orderkey / 4) % 3 = 0 AND l_partkey % 7 < 5"
_DOMINANT = """SELECT DISTINCT concat(CASE WHEN l_orderkey % 2 = 0 THEN 'r' ELSE '' END, CAST(CAST(floor(l_orderkey / 4) AS BIGINT) AS VARCHAR(20)), '.png') AS file, concat('cat', CAST(l_linenumber * 3 AS VARCHAR(9))) AS name,
       CAST(l_linenumber AS DOUBLE) / 4 AS h, CAST(l_linenumber AS DOUBLE) / 5 AS s, CAST(l_linenumber AS DOUBLE) / 8 AS v FROM {lineitem} WHERE floor(l_orderkey / 4) % 5 <> 0"""


@query(ctes(cats=_CATS, own=_OWN, dom=_DOMINANT) + """, mine AS (SELECT image_id, category, h, s, v, 'own' AS taken_from FROM cats JOIN own USING (image_id, category)),
rest AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY category) - 1 AS i FROM cats WHERE image_id NOT IN (SELECT image_id FROM mine)),
f AS (SELECT image_id, CASE WHEN image_id || '.png' IN (SELECT file FROM dom) THEN image_id || '.png' ELSE 'r' || image_id || '.png' END AS file FROM (SELECT DISTINCT image_id FROM rest)),
p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY CAST(substr(name, 4) AS INT)) - 1 AS place, count(*) OVER (PARTITION BY file) AS n FROM dom),
a AS (SELECT * FROM mine UNION ALL SELECT rest.image_id, category, h, s, v, p.file FROM rest JOIN f USING (image_id) JOIN p ON p.file = f.file AND p.place = rest.i % p.n)
SELECT image_id, category, round(h - floor(h), 6) AS h, round(least(greatest(coalesce(s, 1), 0), 1), 6) AS s, round(least(greatest(coalesce(v, 1), 0), 1), 6) AS v, taken_from FROM a""")
def j18_colours_of_files(spark, sf):
    found = C.colours_of_files(*(derived(spark, sf, t) for t in (_CATS, _OWN, _DOMINANT)))
    return found.select("image_id", "category", *(F.round(c, 6).alias(c) for c in "hsv"), "taken_from")
