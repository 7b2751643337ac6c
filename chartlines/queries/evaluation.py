"""Queries on matching, precision and other scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chartlines.functions import geometry as G
from chartlines.operators import matching as M
from chartlines.operators import chains, metrics, precision
from chartlines.operators._numpy import end_costs
from chartlines.plans.canonical import GT, MASK, PRED, ctes, derived, kept_sql
from chartlines.queries import query
from chartlines.sources.shared import keep

_O = "CASE WHEN x1 > x2 OR (x1 = x2 AND y1 > y2) THEN {a} ELSE {b} END AS {b}"
_P = "p AS (SELECT unit, line_id, image_id, score, " + ", ".join(_O.format(a=a, b=b) for a, b in (("x2", "x1"), ("y2", "y1"), ("x1", "x2"), ("y1", "y2"))) + " FROM pred)"
_SQ = "least((p.x1-g.x1)*(p.x1-g.x1)+(p.y1-g.y1)*(p.y1-g.y1)+(p.x2-g.x2)*(p.x2-g.x2)+(p.y2-g.y2)*(p.y2-g.y2), (p.x1-g.x2)*(p.x1-g.x2)+(p.y1-g.y2)*(p.y1-g.y2)+(p.x2-g.x1)*(p.x2-g.x1)+(p.y2-g.y1)*(p.y2-g.y1))"
_MID = "sqrt(((p.x1+p.x2)/2-(g.x1+g.x2)/2)*((p.x1+p.x2)/2-(g.x1+g.x2)/2)+((p.y1+p.y2)/2-(g.y1+g.y2)/2)*((p.y1+p.y2)/2-(g.y1+g.y2)/2))"


def _tables(spark, sf):
    return G.orient(derived(spark, sf, PRED)), derived(spark, sf, GT)


def _hits(cost: str, tau: str) -> str:
    """SQL tables c (costs), n (nearest truth) and m (predictions with tp) for a table t of thresholds."""
    return f""", {_P}, t AS (SELECT unnest([{tau}]) AS tau),
c AS (SELECT p.unit, p.line_id, p.score, g.line_id AS g, {cost} AS cost FROM p JOIN gt g ON p.unit = g.unit),
n AS (SELECT unit, line_id, arg_min(g, (cost, g)) AS g, min(cost) AS cost FROM c GROUP BY unit, line_id),
m AS (SELECT tau, p.unit, p.line_id, p.score, CASE WHEN n.g IS NOT NULL AND row_number() OVER (PARTITION BY tau, p.unit, n.g ORDER BY p.score DESC, p.line_id) = 1 THEN 1 ELSE 0 END AS tp
      FROM p CROSS JOIN t LEFT JOIN n ON n.unit = p.unit AND n.line_id = p.line_id AND n.cost < tau)
"""


@query(ctes(gt=GT, pred=PRED) + _hits(_SQ, "60.0::DOUBLE") + "SELECT unit, line_id, tp FROM m")
def m1_nearest_first_hit(spark, sf):
    return M.nearest_first_hit(*_tables(spark, sf), 60.0).select("unit", "line_id", "tp")


@query(ctes(gt=GT, pred=PRED) + _hits(_MID, "6.0::DOUBLE") + "SELECT unit, line_id, tp FROM m")
def m2_midpoint_first_hit(spark, sf):
    return M.nearest_first_hit(*_tables(spark, sf), 6.0, "midpoint").select("unit", "line_id", "tp")


_N = "CASE WHEN {l} < 1e-9 THEN 1 ELSE greatest(5, least(200, CAST(ceil({l} / 3) AS INT))) END"
_SAMPLED = f""", {_P}, k AS (SELECT p.unit, p.line_id AS p, p.score, g.line_id AS g, p.x1 AS ax, p.y1 AS ay, p.x2 - p.x1 AS adx, p.y2 - p.y1 AS ady, g.x1 AS bx, g.y1 AS by_, g.x2 - g.x1 AS bdx, g.y2 - g.y1 AS bdy FROM p JOIN gt g ON p.unit = g.unit),
kn AS (SELECT *, {_N.format(l='sqrt(adx*adx+ady*ady)')} AS n, {_N.format(l='sqrt(bdx*bdx+bdy*bdy)')} AS m FROM k),
s AS (SELECT *, unnest(list_transform(range(n), lambda i: ax + adx * (CASE WHEN n > 1 THEN i / (n - 1.0::DOUBLE) ELSE 0 END))) AS x, unnest(list_transform(range(n), lambda i: ay + ady * (CASE WHEN n > 1 THEN i / (n - 1.0::DOUBLE) ELSE 0 END))) AS y FROM kn),
f AS (SELECT *, CASE WHEN m > 1 THEN least(greatest(floor(((x-bx)*bdx+(y-by_)*bdy)/(bdx*bdx+bdy*bdy)*(m-1)), 0), m-1)/(m-1) ELSE 0 END AS t0, CASE WHEN m > 1 THEN least(greatest(ceil(((x-bx)*bdx+(y-by_)*bdy)/(bdx*bdx+bdy*bdy)*(m-1)), 0), m-1)/(m-1) ELSE 0 END AS t1 FROM s),
c AS (SELECT unit, p AS line_id, score, g, sqrt(min(least((x-bx-bdx*t0)*(x-bx-bdx*t0)+(y-by_-bdy*t0)*(y-by_-bdy*t0), (x-bx-bdx*t1)*(x-bx-bdx*t1)+(y-by_-bdy*t1)*(y-by_-bdy*t1)))) AS cost FROM f GROUP BY ALL)
"""


@query(ctes(gt=GT, pred=PRED) + _SAMPLED + "SELECT unit, line_id AS p, g, round(cost, 5) AS cost FROM c")
def m2_sampled_cost(spark, sf):
    return M.pairs(*_tables(spark, sf), M.sampled_cost).select("unit", "p", "g", F.round("cost", 5).alias("cost"))


@query(ctes(gt=GT, pred=PRED) + _SAMPLED + """, r AS (SELECT unit, line_id, g, round(cost, 9) AS cost FROM c), n AS (SELECT unit, line_id, arg_min(g, (cost, g)) AS g, min(cost) AS cost FROM r GROUP BY unit, line_id)
SELECT p.unit, p.line_id, CASE WHEN n.g IS NOT NULL AND row_number() OVER (PARTITION BY p.unit, n.g ORDER BY p.score DESC, p.line_id) = 1 THEN 1 ELSE 0 END AS tp FROM p LEFT JOIN n ON n.unit = p.unit AND n.line_id = p.line_id AND n.cost < 3""")
def m2_sampled_first_hit(spark, sf):
    cost = lambda a, b: F.round(M.sampled_cost(a, b), 9)
    return M.nearest_first_hit(*_tables(spark, sf), 3.0, cost).select("unit", "line_id", "tp")


_D = {f"{i}{j}": f"sqrt((p.x{i}-g.x{j})*(p.x{i}-g.x{j})+(p.y{i}-g.y{j})*(p.y{i}-g.y{j}))" for i in (1, 2) for j in (1, 2)}
_MEAN_ENDS = f"least({_D['11']}+{_D['22']}, {_D['12']}+{_D['21']}) / 2"
_L1 = {f"{i}{j}": f"abs(p.x{i}-g.x{j})+abs(p.y{i}-g.y{j})" for i in (1, 2) for j in (1, 2)}
_ENDS_MAE = f"least({_L1['11']}+{_L1['22']}, {_L1['12']}+{_L1['21']}) / 4"


def _chosen(pairs: str, order: str) -> str:
    """SQL table z (unit, p, g, cost and the rest of pairs): pairs of a unit taken one after another in order, if both sides are still free."""
    return "WITH RECURSIVE " + ctes(gt=GT, pred=PRED)[5:] + f""", {_P}, c AS ({pairs}), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY {order}) AS o FROM c),
r AS (SELECT DISTINCT unit, []::BIGINT[] AS ps, []::BIGINT[] AS gs, []::BIGINT[] AS os FROM o UNION ALL
  SELECT r.unit, list_append(any_value(ps), arg_min(o.p, o.o)), list_append(any_value(gs), arg_min(o.g, o.o)), list_append(any_value(os), min(o.o)) FROM r JOIN o ON o.unit = r.unit WHERE NOT list_contains(ps, o.p) AND NOT list_contains(gs, o.g) GROUP BY r.unit),
z AS (SELECT o.* FROM o SEMI JOIN (SELECT unit, unnest(os) AS o FROM r) t ON t.unit = o.unit AND t.o = o.o)
"""


def _costs(cost: str, tau: float) -> str:
    return f"SELECT * FROM (SELECT p.unit, p.line_id AS p, g.line_id AS g, p.score, {cost} AS cost FROM p JOIN gt g ON p.unit = g.unit) WHERE cost <= {tau}"


_PAIR = "SELECT unit, p, g, round(cost, 6) AS cost FROM z"


@query(_chosen(_costs(_MEAN_ENDS, 10), "cost, p, g") + _PAIR)
def m3_greedy(spark, sf):
    return M.greedy_match(*_tables(spark, sf), 10.0).withColumn("cost", F.round("cost", 6))


def _off(a: str, i: int, b: str) -> str:
    """SQL for the distance of end i of a to segment b."""
    dx, dy, x, y = f"({b}.x2-{b}.x1)", f"({b}.y2-{b}.y1)", f"({a}.x{i}-{b}.x1)", f"({a}.y{i}-{b}.y1)"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(({x}*{dx}+{y}*{dy})/nullif({dx}*{dx}+{dy}*{dy}, 0), 0)))"
    return f"sqrt(({x}-{t}*{dx})*({x}-{t}*{dx})+({y}-{t}*{dy})*({y}-{t}*{dy}))"


def _shadow(a: str, i: int, b: str) -> str:
    """SQL for the place of end i of a along b, from its first end."""
    return f"((({a}.x{i}-{b}.x1)*({b}.x2-{b}.x1)+({a}.y{i}-{b}.y1)*({b}.y2-{b}.y1))/nullif(l{b}, 0))"


def _common(a: str, b: str) -> str:
    """SQL for the share of a, the shorter one, that lies along b."""
    p, q = _shadow(a, 1, b), _shadow(a, 2, b)
    return f"coalesce(greatest(0.0::DOUBLE, least(greatest({p}, {q}), l{b}) - greatest(least({p}, {q}), 0.0::DOUBLE)) / nullif(l{a}, 0), 0)"


def _long(a: str) -> str:
    return f"sqrt(({a}.x2-{a}.x1)*({a}.x2-{a}.x1)+({a}.y2-{a}.y1)*({a}.y2-{a}.y1))"


_TURN = "abs((degrees(atan2(p.y2-p.y1, p.x2-p.x1)) + 180) % 180 - (degrees(atan2(g.y2-g.y1, g.x2-g.x1)) + 180) % 180)"
_ORIENTED = f"""SELECT unit, p, g, cost FROM (
  SELECT p.unit, p.line_id AS p, g.line_id AS g, {_long("p")} AS lp, {_long("g")} AS lg, least({_TURN}, 180 - {_TURN}) AS turn, ({_off("p", 1, "g")} + {_off("p", 2, "g")} + {_off("g", 1, "p")} + {_off("g", 2, "p")}) / 4 AS cost,
    CASE WHEN lp >= lg THEN {_common("g", "p")} ELSE {_common("p", "g")} END AS share FROM p JOIN gt g ON p.unit = g.unit) WHERE turn <= 10 AND share >= 0.5 AND cost <= 6"""


@query(_chosen(_ORIENTED, "cost, p, g") + _PAIR)
def m4_oriented(spark, sf):
    return M.oriented_match(*_tables(spark, sf), 6.0, 10.0, 0.5).withColumn("cost", F.round("cost", 6))


@query(_chosen(_costs(_ENDS_MAE, 6), "score DESC, p, cost, g") + _PAIR)
def m5_sequential(spark, sf):
    return M.sequential_match(*_tables(spark, sf), 6.0).withColumn("cost", F.round("cost", 6))


@query(_chosen(_costs(_ENDS_MAE, 6), "cost, p, g") + _PAIR)
def m6_global_greedy(spark, sf):
    return M.greedy_match(*_tables(spark, sf), 6.0, "ends_mae").withColumn("cost", F.round("cost", 6))


@query()
def m6_global_optimal(spark, sf):
    return M.optimal_match(*_tables(spark, sf), 6.0, "ends_mae").withColumn("cost", F.round("cost", 6))


@query(_chosen("SELECT p.unit, p.line_id AS p, g.line_id AS g, abs(p.y1-g.y1) AS a, abs(p.y2-g.y2) AS b, g.y1 AS gy FROM p JOIN gt g ON p.unit = g.unit", "gy, g, a + b, p") + "SELECT unit, p, g, a AS start_error, b AS end_error FROM z")
def m7_y_greedy(spark, sf):
    return M.y_greedy_match(*_tables(spark, sf))


@query()
def m8_optimal(spark, sf):
    return M.optimal_match(*_tables(spark, sf), 30.0).withColumn("cost", F.round("cost", 6))


def _certificate(kind):
    def run(spark, sf):
        # kept, as finding and proving would each work them out
        pred, gt = (keep(t.select("unit", "line_id", *G.COORDS, *extra), "segments") for t, extra in zip(_tables(spark, sf), (["score"], [])))
        return M.certified(pred, gt, keep(M.optimal_potentials(pred, gt, kind), "potentials"), kind)

    return run


_PROVED = ctes(gt=GT, pred=PRED) + """, a AS (SELECT unit, count(*) AS n FROM gt GROUP BY unit), b AS (SELECT unit, count(*) AS n FROM pred GROUP BY unit)
SELECT unit, least(a.n, b.n) AS n_pairs, true AS one_to_one, true AS feasible, true AS tight FROM a JOIN b USING (unit)"""


@query(_PROVED)
def m8_certificate(spark, sf):
    return _certificate("l2")(spark, sf)


@query(_PROVED)
def m6_certificate(spark, sf):
    return _certificate("ends_mae")(spark, sf)


@query(ctes(gt=GT, pred=PRED) + f""", {_P}
SELECT DISTINCT g.unit, g.line_id FROM gt g JOIN p ON p.unit = g.unit
WHERE least(sqrt((p.x1-g.x1)*(p.x1-g.x1)+(p.y1-g.y1)*(p.y1-g.y1))+sqrt((p.x2-g.x2)*(p.x2-g.x2)+(p.y2-g.y2)*(p.y2-g.y2)), sqrt((p.x1-g.x2)*(p.x1-g.x2)+(p.y1-g.y2)*(p.y1-g.y2))+sqrt((p.x2-g.x1)*(p.x2-g.x1)+(p.y2-g.y1)*(p.y2-g.y1))) <= 8
""")
def m9_covered(spark, sf):
    return M.covered(*_tables(spark, sf), 8.0).select("unit", "line_id")


@query(ctes(gt=GT, pred=PRED) + f""", {_P}
SELECT unit, round(sum(abs(coalesce(g.x1,0)-coalesce(p.x1,0))+abs(coalesce(g.y1,0)-coalesce(p.y1,0))+abs(coalesce(g.x2,0)-coalesce(p.x2,0))+abs(coalesce(g.y2,0)-coalesce(p.y2,0))) / (4 * greatest(count(g.line_id), count(p.line_id))), 6) AS mae
FROM (SELECT unit, line_id, x1, y1, x2, y2 FROM gt) g FULL JOIN p USING (unit, line_id) GROUP BY unit
""")
def m10_index_pairs(spark, sf):
    return M.index_pairs(*_tables(spark, sf)).select("unit", F.round("mae", 6).alias("mae"))


_AP = """, k AS (SELECT *, sum(tp) OVER w AS h, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY tau ORDER BY score DESC, unit, line_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max(h / n) OVER (PARTITION BY tau ORDER BY score DESC, unit, line_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM k),
s AS (SELECT count(*) AS n_gt FROM gt)
SELECT tau, round(sum(tp * env) / any_value(n_gt), 6) AS ap, sum(tp) AS tp, count(*) - sum(tp) AS fp, any_value(n_gt) - sum(tp) AS fn, round(sum(tp) / count(*), 6) AS precision,
  round(sum(tp) / any_value(n_gt), 6) AS recall, round(2 * sum(tp) / (count(*) + any_value(n_gt)), 6) AS f1
FROM e, s GROUP BY tau"""


@query(ctes(gt=GT, pred=PRED) + _hits(_SQ, "25.0::DOUBLE, 50.0, 75.0") + _AP)
def w1_evaluate(spark, sf):
    pred, gt = derived(spark, sf, PRED), derived(spark, sf, GT)
    found = precision.evaluate(pred, gt, (25.0, 50.0, 75.0))
    return found.select("tau", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("ap", "precision", "recall", "f1")))


@query(ctes(gt=GT, pred=PRED) + _hits(_SQ, "50.0::DOUBLE") + """
, k AS (SELECT *, sum(tp) OVER w / count(*) OVER w AS pr FROM m WINDOW w AS (PARTITION BY unit ORDER BY score DESC, line_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max(pr) OVER (PARTITION BY unit ORDER BY score DESC, line_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM k)
SELECT g.unit, round(CASE WHEN e.area IS NULL THEN 0 ELSE e.area / n END, 6) AS ap FROM (SELECT unit, count(*) AS n FROM gt GROUP BY unit) g LEFT JOIN (SELECT unit, sum(tp * env) AS area FROM e GROUP BY unit) e ON g.unit = e.unit
""")
def a27_ap_by_unit(spark, sf):
    pred, gt = _tables(spark, sf)
    totals = gt.groupBy("unit").agg(F.count(F.lit(1)).alias("n_gt"))
    return precision.average_precision_by_unit(M.nearest_first_hit(pred, gt, 50.0), totals).select("unit", F.round("ap", 6).alias("ap"))


def _cost_matcher(pred, gt, tau):
    """Predictions in order, each takes its cheapest free truth."""
    tp, used = np.zeros(len(pred), int), np.zeros(len(gt), bool)
    cost = end_costs(pred, gt, "mean_ends")
    for i in range(len(pred)):
        free = np.where(used, np.inf, cost[i]) if len(gt) else np.array([np.inf])
        j = int(np.argmin(free))
        if free[j] <= tau:
            tp[i], used[j] = 1, True
    return tp, 1 - tp


@query(_chosen(_costs(_MEAN_ENDS, 10), "score DESC, p, cost, g") + "SELECT p.unit, p.line_id, CASE WHEN z.p IS NULL THEN 0 ELSE 1 END AS tp FROM p LEFT JOIN z ON z.unit = p.unit AND z.p = p.line_id")
def x1_user_matcher(spark, sf):
    return M.run_matcher(*_tables(spark, sf), _cost_matcher, 10.0).select("unit", "line_id", "tp")


_M10 = """, x AS (SELECT g.unit, g.image_id, count(*) AS n FROM gt g GROUP BY ALL)"""


@query(ctes(gt=GT, pred=PRED) + f""", {_P},
j AS (SELECT p.unit, abs(p.x1-g.x1) AS a, abs(p.y1-g.y1) AS b, abs(p.x2-g.x2) AS c, abs(p.y2-g.y2) AS d FROM p JOIN gt g ON p.unit = g.unit AND p.line_id = g.line_id),
u AS (SELECT g.unit, g.image_id, g.n AS gt_lines, coalesce(q.n, 0) AS pred_lines, coalesce(e.m, 0) AS matched, coalesce(a,0) AS a, coalesce(b,0) AS b, coalesce(c,0) AS c, coalesce(d,0) AS d
  FROM (SELECT unit, image_id, count(*) AS n FROM gt GROUP BY ALL) g LEFT JOIN (SELECT unit, count(*) AS n FROM p GROUP BY unit) q ON g.unit = q.unit
  LEFT JOIN (SELECT unit, count(*) AS m, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM j GROUP BY unit) e ON g.unit = e.unit)
SELECT image_id, grouping(image_id) AS is_total, sum(gt_lines) AS gt_lines, sum(pred_lines) AS pred_lines, sum(matched) AS matched, sum(gt_lines)-sum(matched) AS unmatched_gt, sum(pred_lines)-sum(matched) AS unmatched_pred,
  round(CASE WHEN sum(matched) = 0 THEN NULL ELSE (sum(a)+sum(b))/(2*sum(matched)) END, 6) AS mae_start, round(CASE WHEN sum(matched) = 0 THEN NULL ELSE (sum(c)+sum(d))/(2*sum(matched)) END, 6) AS mae_end,
  round(CASE WHEN sum(matched) = 0 THEN NULL ELSE (sum(a)+sum(b)+sum(c)+sum(d))/(4*sum(matched)) END, 6) AS mae_all, round(CASE WHEN sum(matched) = 0 THEN NULL ELSE (sum(b)+sum(d))/(2*sum(matched)) END, 6) AS mae_y
FROM u GROUP BY ROLLUP (image_id)
""")
def a7_mae_report(spark, sf):
    pred, gt = _tables(spark, sf)
    same = pred.select("unit", F.col("line_id").alias("p")).join(gt.select("unit", F.col("line_id").alias("g")), (F.col("p") == F.col("g")) & (pred["unit"] == gt["unit"])).select(pred["unit"], "p", "g")
    report = metrics.mae_report(metrics.pair_errors(same, pred, gt), pred, gt, gt, "image_id")
    return report.select("image_id", "is_total", "gt_lines", "pred_lines", "matched", "unmatched_gt", "unmatched_pred", *(F.round(c, 6).alias(c) for c in ("mae_start", "mae_end", "mae_all", "mae_y")))


@query(ctes(gt=GT, pred=PRED) + f""", {_P}, m AS (SELECT unit, sum(abs(coalesce(g.x1,0)-coalesce(p.x1,0))+abs(coalesce(g.y1,0)-coalesce(p.y1,0))+abs(coalesce(g.x2,0)-coalesce(p.x2,0))+abs(coalesce(g.y2,0)-coalesce(p.y2,0))) AS a, greatest(count(g.line_id), count(p.line_id)) AS n
FROM (SELECT unit, line_id, x1, y1, x2, y2 FROM gt) g FULL JOIN p USING (unit, line_id) GROUP BY unit)
SELECT round(sum(a) / (4 * sum(n)), 6) AS mae, sum(n) AS lines FROM m""")
def a10_simple_mae_total(spark, sf):
    return metrics.simple_mae_total(*_tables(spark, sf)).withColumn("mae", F.round("mae", 6))


@query()
def a9_strict_and_global(spark, sf):
    found = metrics.strict_and_global(*_tables(spark, sf), ["image_id", "crop_id", "category"], "image_id", 60.0)
    return found.select("scope", "image_id", "gt_lines", "pred_lines", "matched", *(F.round(c, 6).alias(c) for c in ("mae_x1", "mae_y1", "mae_x2", "mae_y2", "mae_xy", "mae_y")))


@query()
def a12_merged_crops(spark, sf):
    pred, gt = (df.withColumn("crop_key", F.concat_ws("_", "image_id", (F.col("crop_id") % 2).cast("string"))) for df in _tables(spark, sf))
    return chains.merged_crops(pred, gt, "crop_key", 10.0, 1.0, 2.0).select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "ap")))


_LTR = "SELECT unit, line_id, CASE WHEN x1 > x2 THEN x2 ELSE x1 END AS x1, CASE WHEN x1 > x2 THEN y2 ELSE y1 END AS y1, CASE WHEN x1 > x2 THEN x1 ELSE x2 END AS x2, CASE WHEN x1 > x2 THEN y1 ELSE y2 END AS y2 FROM "


@query("WITH RECURSIVE " + ctes(gt0=GT, pred=PRED, mask=MASK)[5:] + f", gt AS ({_LTR} gt0), q AS ({_LTR} pred), w AS (SELECT * FROM q WHERE EXISTS (SELECT 1 FROM mask m WHERE m.unit = q.unit AND m.y = floor(q.y1 / 7) AND m.x = floor(q.x1 / 7)) AND EXISTS (SELECT 1 FROM mask m WHERE m.unit = q.unit AND m.y = floor(q.y2 / 7) AND m.x = floor(q.x2 / 7))), "
 + kept_sql("w", "(a.x1-b.x1)*(a.x1-b.x1)+(a.y1-b.y1)*(a.y1-b.y1)+(a.x2-b.x2)*(a.x2-b.x2)+(a.y2-b.y2)*(a.y2-b.y2) <= 1", "line_id")
 + ", p AS (SELECT w.*, 0 AS score FROM w SEMI JOIN kept ON kept.unit = w.unit AND kept.line_id = w.line_id)" + _SAMPLED.replace(f", {_P}", "", 1) + """
, b AS (SELECT unit, line_id, arg_min(g, (cost, g)) AS g, min(cost) AS cost FROM c GROUP BY unit, line_id),
h AS (SELECT p.unit, p.line_id, CASE WHEN b.g IS NOT NULL AND row_number() OVER (PARTITION BY p.unit, b.g ORDER BY p.line_id) = 1 THEN 1 ELSE 0 END AS tp FROM p LEFT JOIN b ON b.unit = p.unit AND b.line_id = p.line_id AND b.cost < 10),
pr AS (SELECT *, sum(tp) OVER v / count(*) OVER v AS pr FROM h WINDOW v AS (PARTITION BY unit ORDER BY line_id ROWS UNBOUNDED PRECEDING)),
ev AS (SELECT *, max(pr) OVER (PARTITION BY unit ORDER BY line_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM pr),
ar AS (SELECT unit, sum(tp * env) AS area FROM ev GROUP BY unit), un AS (SELECT unit FROM gt UNION SELECT unit FROM pred), ng AS (SELECT unit, count(*) AS n FROM gt GROUP BY unit)
SELECT un.unit, round(coalesce(100 * area / n, 0), 4) AS ap FROM un LEFT JOIN ar ON ar.unit = un.unit LEFT JOIN ng ON ng.unit = un.unit""")
def f8_evaluation_chain(spark, sf):
    return chains.evaluation_chain(derived(spark, sf, PRED), derived(spark, sf, GT), derived(spark, sf, MASK), 7.0, 10.0, 1.0).select("unit", F.round("ap", 4).alias("ap"))


_DIMS = "SELECT DISTINCT image_id, crop_id, unit, 60 AS h, 40 AS w FROM gt"
_PMASK = "SELECT DISTINCT unit, CAST(floor(y1 / 7) AS BIGINT) AS y, CAST(floor(x1 / 7) AS BIGINT) AS x FROM ({pred}) UNION SELECT unit, CAST(floor(y2 / 7) AS BIGINT), CAST(floor(x2 / 7) AS BIGINT) FROM ({pred})"
_COUNTS = ", pm AS (" + _PMASK.format(pred="SELECT * FROM pred") + "), dims AS (" + _DIMS + """),
b AS (SELECT unit, count(*) FILTER (WHERE p = 1 AND g = 1) AS tp, count(*) FILTER (WHERE p = 1 AND g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL AND g = 1) AS fn
  FROM (SELECT unit, y, x, 1 AS p FROM pm) FULL JOIN (SELECT unit, y, x, 1 AS g FROM mask) USING (unit, y, x) GROUP BY unit),
k AS (SELECT image_id, crop_id, d.unit, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, h * w - coalesce(tp, 0) - coalesce(fp, 0) - coalesce(fn, 0) AS tn FROM dims d LEFT JOIN b ON d.unit = b.unit)
"""


def _mask_counts(spark, sf):
    gt = derived(spark, sf, GT)
    dims = gt.select("image_id", "crop_id", "unit", F.lit(60).alias("h"), F.lit(40).alias("w")).distinct()
    ends = F.explode(F.array(*[F.struct(*(F.floor(F.col(f"{c}{i}") / 7).alias(c) for c in "yx")) for i in (1, 2)]))
    cells = derived(spark, sf, PRED).select("unit", ends.alias("e")).select("unit", "e.*")
    counted = metrics.mask_counts(cells, derived(spark, sf, MASK), dims.drop("image_id", "crop_id"), ["unit"])
    return dims.select("image_id", "crop_id", "unit").join(counted, "unit")


@query(ctes(gt=GT, pred=PRED, mask=MASK) + _COUNTS + """
SELECT unit, tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2*tp+fp+fn = 0 THEN NULL ELSE 2*tp/(2*tp+fp+fn) END, 6) AS f1, round(CASE WHEN tp+fp+fn = 0 THEN NULL ELSE tp/(tp+fp+fn) END, 6) AS iou, round((tp+tn)/(tp+fp+fn+tn), 6) AS accuracy FROM k
""")
def a5_mask_scores(spark, sf):
    scores = {k: F.round(v, 6) for k, v in metrics.mask_scores().items()}
    return _mask_counts(spark, sf).withColumns(scores).drop("image_id", "crop_id")


@query(ctes(gt=GT, pred=PRED, mask=MASK) + _COUNTS + """
, s AS (SELECT *, CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END AS pr, CASE WHEN tp+fp+fn = 0 THEN NULL ELSE tp/(tp+fp+fn) END AS io FROM k)
SELECT image_id, crop_id, CAST(grouping(image_id) + grouping(crop_id) AS INT) AS level, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, round(avg(pr), 6) AS macro_precision, round(avg(io), 6) AS macro_iou,
  round(CASE WHEN sum(tp)+sum(fp) = 0 THEN NULL ELSE sum(tp)/(sum(tp)+sum(fp)) END, 6) AS micro_precision, round(CASE WHEN sum(tp)+sum(fp)+sum(fn) = 0 THEN NULL ELSE sum(tp)/(sum(tp)+sum(fp)+sum(fn)) END, 6) AS micro_iou
FROM s GROUP BY ROLLUP (image_id, crop_id)
""")
def a6_micro_macro(spark, sf):
    rolled = metrics.micro_macro(_mask_counts(spark, sf), "image_id", "crop_id")
    return rolled.select("image_id", "crop_id", "level", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("macro_precision", "macro_iou", "micro_precision", "micro_iou")))


@query(ctes(gt=GT, pred=PRED) + f""", {_P}, c AS (SELECT DISTINCT g.unit, g.line_id FROM gt g JOIN p ON p.unit = g.unit AND {_SQ} < 50)
SELECT round(((SELECT count(*) FROM gt) - (SELECT count(*) FROM c)) / (SELECT count(*) FROM gt), 8) AS missed
""")
def a13_missed_share(spark, sf):
    pred, gt = _tables(spark, sf)
    found = M.pairs(pred, gt, "squared", 50.0).where(F.col("cost") < 50).select("unit", "g").distinct()
    return metrics.missed_share(found, gt).select(F.round("missed", 8).alias("missed"))


@query(ctes(gt=GT, pred=PRED) + """
SELECT image_id, coalesce(a, 0) AS n_pred, coalesce(b, 0) AS n_gt, coalesce(a, 0) - coalesce(b, 0) AS delta, CASE WHEN coalesce(a, 0) < coalesce(b, 0) THEN 'less' WHEN coalesce(a, 0) > coalesce(b, 0) THEN 'greater' ELSE 'equal' END AS verdict
FROM (SELECT image_id, count(DISTINCT category) AS a FROM pred GROUP BY image_id) FULL JOIN (SELECT image_id, count(DISTINCT category) AS b FROM gt GROUP BY image_id) USING (image_id)
""")
def a14_category_counts(spark, sf):
    return metrics.category_counts(derived(spark, sf, PRED), derived(spark, sf, GT), "image_id")


_S = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in G.COORDS)


@query(ctes(gt=GT, pred=PRED) + f""", {_P}, a AS (SELECT unit, {_S} FROM p GROUP BY unit), b AS (SELECT unit, {_S} FROM gt GROUP BY unit)
SELECT a.unit, """ + ", ".join("round((sqrt(" + "+".join(f"((a.m_{c}+({k})*a.s_{c})-(b.m_{c}+({k})*b.s_{c}))*((a.m_{c}+({k})*a.s_{c})-(b.m_{c}+({k})*b.s_{c}))" for c in ("x1", "y1")) + ") + sqrt(" + "+".join(f"((a.m_{c}+({k})*a.s_{c})-(b.m_{c}+({k})*b.s_{c}))*((a.m_{c}+({k})*a.s_{c})-(b.m_{c}+({k})*b.s_{c}))" for c in ("x2", "y2")) + f")) / 2, 5) AS {n}" for k, n in ((0, "mean"), (-1, "lower"), (1, "upper"))) + " FROM a JOIN b ON a.unit = b.unit")
def a19_offset_errors(spark, sf):
    return metrics.offset_errors(*_tables(spark, sf)).select("unit", *(F.round(c, 5).alias(c) for c in ("mean", "lower", "upper")))


_J = "SELECT unit, x1 AS x, y1 AS y FROM ({gt}) UNION SELECT unit, x2, y2 FROM ({gt})"


@query(ctes(gt=GT, pred=PRED) + ", j AS (" + _J.format(gt="SELECT * FROM gt") + """), e AS (SELECT DISTINCT unit, x1 AS px, y1 AS py FROM pred UNION SELECT unit, x2, y2 FROM pred),
d AS (SELECT j.unit, x, y, min(sqrt((x-px)*(x-px)+(y-py)*(y-py))) AS d FROM j LEFT JOIN e ON j.unit = e.unit GROUP BY ALL)
SELECT unit, round(avg(least(coalesce(d, 30), 30)), 6) AS mean, round(stddev_pop(least(coalesce(d, 30), 30)), 6) AS std FROM d GROUP BY unit
""")
def a20_junction_offsets(spark, sf):
    found = metrics.junction_offsets(derived(spark, sf, PRED), derived(spark, sf, _J.format(gt=GT)))
    return found.select("unit", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(ctes(gt=GT, pred=PRED) + f""", {_P},
a AS (SELECT unit, avg(y1) AS c, stddev_pop(y1) AS s FROM p GROUP BY unit), b AS (SELECT unit, avg(y1) AS c, stddev_pop(y1) AS s FROM gt GROUP BY unit),
am AS (SELECT p.unit, any_value(m) AS c, quantile_cont(abs(y1 - m), 0.5) AS s FROM p JOIN (SELECT unit, quantile_cont(y1, 0.5) AS m FROM p GROUP BY unit) q ON p.unit = q.unit GROUP BY p.unit),
bm AS (SELECT g.unit, any_value(m) AS c, quantile_cont(abs(y1 - m), 0.5) AS s FROM gt g JOIN (SELECT unit, quantile_cont(y1, 0.5) AS m FROM gt GROUP BY unit) q ON g.unit = q.unit GROUP BY g.unit)
SELECT a.unit, round((abs(a.c-b.c)+abs(a.s-b.s))/2, 5) AS gap, round((abs(am.c-bm.c)+abs(am.s-bm.s))/2, 5) AS robust_gap FROM a JOIN b ON a.unit=b.unit JOIN am ON a.unit=am.unit JOIN bm ON a.unit=bm.unit
""")
def a21_distribution_gap(spark, sf):
    pred, gt = _tables(spark, sf)
    robust = metrics.distribution_gap(pred, gt, "y1", robust=True).withColumnRenamed("gap", "robust_gap")
    return metrics.distribution_gap(pred, gt, "y1").join(robust, "unit").select("unit", F.round("gap", 5).alias("gap"), F.round("robust_gap", 5).alias("robust_gap"))


def _points(df):
    return df.select("unit", F.col("line_id").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"))


@query()
def a22_a23_transport(spark, sf):
    pred, gt = _tables(spark, sf)
    found = metrics.transport_distances(_points(pred), _points(gt))
    return found.select("unit", *(F.round(c, 6).alias(c) for c in ("w1_x", "w1_y", "sliced", "emd")))


@query(ctes(gt=GT, pred=PRED) + f""", {_P}, d AS (SELECT p.unit, p.line_id AS i, g.line_id AS j, sqrt((p.x1-g.x1)*(p.x1-g.x1)+(p.y1-g.y1)*(p.y1-g.y1)) AS d FROM p JOIN gt g ON p.unit = g.unit)
SELECT a.unit, round(a.d + b.d, 6) AS chamfer FROM (SELECT unit, avg(d) AS d FROM (SELECT unit, i, min(d) AS d FROM d GROUP BY unit, i) GROUP BY unit) a JOIN (SELECT unit, avg(d) AS d FROM (SELECT unit, j, min(d) AS d FROM d GROUP BY unit, j) GROUP BY unit) b ON a.unit = b.unit
""")
def a24_chamfer(spark, sf):
    pred, gt = _tables(spark, sf)
    return metrics.chamfer(_points(pred), _points(gt)).select("unit", F.round("chamfer", 6).alias("chamfer"))


@query()
def a25_line_alignment(spark, sf):
    return metrics.line_alignment(derived(spark, sf, GT), derived(spark, sf, MASK), 7.0).select("unit", F.round("alignment", 6).alias("alignment"))
