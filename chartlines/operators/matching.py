"""Matching predicted to true segments, unit by unit. Both sides have unit, line_id, x1, y1, x2, y2; predictions a score."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlines.functions.geometry import COORDS, angle, angle_difference, overlap, pair_cost, seg, symmetric_distance
from chartlines.operators import _numpy as N
from chartlines.operators.grid import large_units, middle, near_rows, near_segments, reach
from chartlines.operators.units import each_unit, spans, whole_units

Matcher = Callable[[np.ndarray, np.ndarray, float], tuple[np.ndarray, np.ndarray]]


def _sides(pred: DataFrame, gt: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    p = pred.select(*keys, F.col("line_id").alias("p"), "score", *(F.col(c).alias(f"p_{c}") for c in COORDS))
    return p, gt.select(*keys, F.col("line_id").alias("g"), *(F.col(c).alias(f"g_{c}") for c in COORDS))


def pairs(pred: DataFrame, gt: DataFrame, cost: str | Callable[[dict, dict], Column], limit: float | None = None, keys: tuple[str, ...] = ("unit",)) -> DataFrame:
    """All pairs of a unit with their cost, up to limit: keys, p (line_id of the prediction), score, g, cost.

    A cost named as in geometry.pair_cost and a limit let large units meet on a grid of
    midpoints; other costs meet all pairs.
    """
    p, g = _sides(pred, gt, keys)
    if isinstance(cost, str) and limit is not None:
        met = near_rows(p, g, middle("p_"), middle("g_"), reach(cost, limit), list(keys))
    else:
        met = p.join(g, list(keys))
    worth = pair_cost(cost, seg("p_"), seg("g_")) if isinstance(cost, str) else cost(seg("p_"), seg("g_"))
    met = met.withColumn("cost", worth)
    return (met if limit is None else met.where(F.col("cost") <= limit)).select(*keys, "p", "score", "g", "cost")


def nearest_truth(pred: DataFrame, gt: DataFrame, kind: str | Callable[[dict, dict], Column] = "squared", within: float | None = None) -> DataFrame:
    """pred with g, cost (the nearest truth of its unit, ties to the smaller line_id) and rival: the least cost at which a better scored prediction has the same nearest truth.

    Rows of pred that repeat count each, in any order among themselves. A unit without
    truth has null g and cost, and so have segments with a null coordinate. within:
    truths of a higher cost may be left out, which lets large units meet on a grid.
    The truths of other units come as one array each, looked through without making
    pairs.
    """
    cost = kind if callable(kind) else lambda a, b: pair_cost(kind, a, b)
    large = large_units(gt, ["unit"])
    truth = F.struct(F.col("line_id").alias("g"), *COORDS)
    lists = gt.join(large, "unit", "left_anti").groupBy("unit").agg(F.collect_list(truth).alias("_ts"))
    others = [F.col(c) for c in pred.columns if c != "unit"]
    numbered = pred.join(large, "unit", "left_semi").withColumn("_row", F.row_number().over(Window.partitionBy("unit").orderBy(F.col("line_id"), *others)))
    p = numbered.select("unit", "_row", *(F.col(c).alias(f"p_{c}") for c in COORDS))
    g = gt.join(large, "unit", "left_semi").select("unit", F.col("line_id").alias("g"), *(F.col(c).alias(f"g_{c}") for c in COORDS))
    met = p.join(g, "unit") if within is None or callable(kind) else near_rows(p, g, middle("p_"), middle("g_"), reach(kind, within), ["unit"])
    least = met.withColumn("cost", cost(seg("p_"), seg("g_"))).groupBy("unit", "_row").agg(F.min(F.when(F.col("cost").isNotNull(), F.struct("cost", "g"))).alias("_b"))
    crowded = numbered.join(least, ["unit", "_row"], "left").select(*pred.columns, "_b")
    if callable(kind):  # such as one that Python works out: no lambda can
        few = pred.join(large, "unit", "left_anti").withColumn("_row", F.row_number().over(Window.partitionBy("unit").orderBy(F.col("line_id"), *others)))
        pair = few.select("unit", "_row", *(F.col(c).alias(f"p_{c}") for c in COORDS)).join(gt.select("unit", F.col("line_id").alias("g"), *(F.col(c).alias(f"g_{c}") for c in COORDS)), "unit")
        # no filter on the cost: it would be worked out for the filter and once more for its value
        near = pair.withColumn("cost", cost(seg("p_"), seg("g_"))).groupBy("unit", "_row").agg(F.min(F.when(F.col("cost").isNotNull(), F.struct("cost", "g"))).alias("_b"))
        usual = few.join(near, ["unit", "_row"], "left").select(*pred.columns, "_b")
    else:
        # a truth that costs null is no element: array_min passes it by
        told = lambda t: F.struct(cost(seg(), {c: t[c] for c in COORDS}).alias("cost"), t["g"].alias("g"))
        looked = F.array_min(F.transform("_ts", lambda t: F.when(told(t)["cost"].isNotNull(), told(t))))
        usual = pred.join(large, "unit", "left_anti").join(lists, "unit", "left").withColumn("_b", looked).select(*pred.columns, "_b")
    best = usual.unionByName(crowded)
    above = Window.partitionBy("unit", "_b.g").orderBy(F.desc("score"), "line_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = best.withColumn("rival", F.min("_b.cost").over(above))
    return ranked.select(*pred.columns, F.col("_b.g").alias("g"), F.col("_b.cost").alias("cost"), "rival")


def hit(tau: Column | float) -> Column:
    """Of rows of nearest_truth: whether the truth lies under tau and no better scored prediction hit it."""
    return (F.col("cost") < tau) & (F.col("rival").isNull() | (F.col("rival") >= tau))


def nearest_first_hit(pred: DataFrame, gt: DataFrame, tau: float, kind: str | Callable[[dict, dict], Column] = "squared") -> DataFrame:
    """pred with tp: its nearest truth (ties to the smaller line_id) lies under tau and no better scored prediction hit it.

    A prediction whose nearest truth is taken is false even if another one is in
    reach. A unit without truth has only false predictions.
    """
    near = nearest_truth(pred, gt, kind, within=tau)
    return near.select(*pred.columns, F.coalesce(hit(tau), F.lit(False)).cast("int").alias("tp"))


def sampled_cost(a: dict, b: dict, step: float = 3.0, least: int = 5, most: int = 200) -> Column:
    """Smallest distance between any two of the points sampled along both segments, about `step` apart, `least` to `most` of each; null if a coordinate is."""

    @F.pandas_udf("double")
    def cost(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, u1: pd.Series, v1: pd.Series, u2: pd.Series, v2: pd.Series) -> pd.Series:
        rows = np.stack([c.to_numpy(float) for c in (x1, y1, x2, y2, u1, v1, u2, v2)], 1)
        out = np.full(len(rows), np.nan)
        good = ~np.isnan(rows).any(1)
        if good.any():
            out[good] = N.least_sampled_gaps(rows[good], step, least, most)
        return pd.Series(out).where(good, None)

    return cost(*(s[c] for s in (a, b) for c in COORDS))


def _matched(candidates: DataFrame, choose, order: list) -> DataFrame:
    """unit, p, g, cost of the pairs at the places that choose(arrays of one unit) returns; rows come in the given order."""
    return each_unit(candidates, order, choose).select("unit", "p", "g", "cost")


def _greedy(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Rows in order whose p and g are both still free."""
    used_p: set[int] = set()
    used_g: set[int] = set()
    kept = []
    for i, (p, g) in enumerate(zip(rows["p"].tolist(), rows["g"].tolist(), strict=True)):
        if p not in used_p and g not in used_g:
            used_p.add(p)
            used_g.add(g)
            kept.append(i)
    return np.array(kept, np.int64)


CHEAPEST = ["cost", "p", "g"]


def greedy_match(pred: DataFrame, gt: DataFrame, tau: float, kind: str = "mean_ends") -> DataFrame:
    """One-to-one pairs of each unit, cheapest first, up to tau."""
    return _matched(pairs(pred, gt, kind, tau), _greedy, CHEAPEST)


def oriented_match(pred: DataFrame, gt: DataFrame, dist: float = 5.0, degrees: float = 10.0, min_overlap: float = 0.5) -> DataFrame:
    """Greedy one-to-one pairs that pass gates on direction, symmetric distance and overlap."""
    p, g = _sides(pred, gt, ("unit",))
    a, b = seg("p_"), seg("g_")
    # the mean distance of four ends is up to dist, so that of each is up to four times as much
    met = near_segments(p, g, (F.col("p_y1"), F.col("p_x1")), b, 4 * dist, ["unit"])
    met = met.where((angle_difference(angle(a), angle(b)) <= degrees) & (overlap(a, b) >= min_overlap)).withColumn("cost", symmetric_distance(a, b)).where(F.col("cost") <= dist)
    return _matched(met.select("unit", "p", "g", "cost"), _greedy, CHEAPEST)


def sequential_match(pred: DataFrame, gt: DataFrame, tau: float, kind: str = "ends_mae") -> DataFrame:
    """Predictions by score take the cheapest truth still free, up to tau."""

    # best score first and then cheapest: the first free row of a prediction is its choice
    return _matched(pairs(pred, gt, kind, tau), _greedy, [F.desc("score"), "p", "cost", "g"])


def optimal_match(pred: DataFrame, gt: DataFrame, limit: float | None = None, kind: str = "l2", gate_first: bool = False) -> DataFrame:
    """Pairs of each unit with the least total cost; those above limit are dropped afterwards, or kept out beforehand with gate_first."""

    def choose(rows: dict[str, np.ndarray]) -> np.ndarray:
        (ps, i), (gs, j) = (np.unique(rows[c], return_inverse=True) for c in ("p", "g"))
        at = np.full((len(ps), len(gs)), -1)
        at[i, j] = np.arange(len(i))
        # pairs that were kept out, or whose cost is not known, cost more than any matching
        cost = rows["cost"][at]
        out = (at < 0) | np.isnan(cost)
        found = np.array([at[r, c] for r, c in N.optimal_pairs(np.where(out, 1e9, cost)) if not out[r, c]], np.int64)
        return found if limit is None else found[rows["cost"][found] <= limit]

    def choose_few(ps: list[int], gs: list[int], costs: list[float]) -> list[int]:
        row_of, col_of = ({k: i for i, k in enumerate(sorted(set(ids)))} for ids in (ps, gs))
        cost, at = [[1e9] * len(col_of) for _ in row_of], [[-1] * len(col_of) for _ in row_of]
        for i, (p, g, x) in enumerate(zip(ps, gs, costs)):
            r, c = row_of[p], col_of[g]
            cost[r][c], at[r][c] = (x, i) if x == x else (1e9, -1)
        found = [at[r][c] for r, c in N.optimal_few(cost)]
        return [i for i in found if i >= 0 and (limit is None or costs[i] <= limit)]

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        ps, gs, costs = (rows[c].tolist() for c in ("p", "g", "cost"))
        arrays, kept = {c: rows[c].to_numpy() for c in ("p", "g", "cost")}, []
        for a, b in spans(rows["unit"].to_numpy()):
            found = choose_few(ps[a:b], gs[a:b], costs[a:b]) if b - a <= N.FEW else choose({c: v[a:b] for c, v in arrays.items()}).tolist()
            kept += [a + i for i in found]
        return rows.iloc[kept]

    met = pairs(pred, gt, kind, limit if gate_first else None).select("unit", "p", "g", "cost")
    return whole_units(met, ["p", "g"], work, met.schema)


def optimal_potentials(pred: DataFrame, gt: DataFrame, kind: str = "l2") -> DataFrame:
    """unit, side (0 predictions, 1 truths), id, mate, potential: an optimal matching of each unit with both sides, and potentials that prove it (see certified).

    Segments are shuffled and not pairs: costs are worked out where the unit is. Pairs of
    unknown cost cost more than any other. Units with one side only are left out.
    """
    side = lambda df, n: df.where(F.col("unit").isNotNull()).select("unit", F.lit(n).alias("side"), "line_id", *COORDS)

    def run(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = int(np.searchsorted(rows["side"], 1))
        if n in (0, len(rows["side"])):
            return {c: rows["side"][:0] for c in ("unit", "side", "id", "mate", "potential")}
        lines = np.stack([rows[c] for c in COORDS], 1).astype(float)
        fresh = np.concatenate([[True], (rows["line_id"][1:] != rows["line_id"][:-1]) | (rows["side"][1:] != rows["side"][:-1])])
        ids, sides, lines = rows["line_id"][fresh], rows["side"][fresh], lines[fresh]
        n = int(np.searchsorted(sides, 1))
        cost = N.end_costs(lines[:n], lines[n:], kind)
        pairs, u, v = N.optimal_with_potentials(np.where(np.isnan(cost), 1e9, cost))
        mate = np.full(len(ids), None)
        for a, b in pairs:
            mate[a], mate[n + b] = int(ids[n + b]), int(ids[a])
        return {"unit": np.full(len(ids), rows["unit"][0]), "side": sides, "id": ids, "mate": mate, "potential": np.concatenate([u, v])}

    return each_unit(side(pred, 0).unionByName(side(gt, 1)), ["side", "line_id"], run, "unit long, side int, id long, mate long, potential double")


def certified(pred: DataFrame, gt: DataFrame, potentials: DataFrame, kind: str = "l2", slack: float = 1e-6) -> DataFrame:
    """unit, n_pairs, one_to_one, feasible, tight: whether potentials prove a unit's matching to be of least cost.

    feasible: no pair of the unit costs less than its two potentials, and those of the
    side with more rows are at most 0. Then no matching of all rows of the other side
    costs less than all potentials together; tight: this one costs just that. All steps
    are by unit alone, so pairs are never shuffled.
    """
    told = lambda n: F.map_from_entries(F.collect_list(F.when((F.col("side") == n) & F.col("id").isNotNull(), F.struct("id", F.struct("mate", "potential")))))
    known = potentials.groupBy("unit").agg(told(0).alias("_p"), told(1).alias("_g"))
    p, g = _sides(pred, gt, ("unit",))
    # a side's potentials come to its rows, before there are pairs
    held = lambda rows, n: rows.join(known.select("unit", f"_{n}"), "unit").withColumn("_own", F.try_element_at(f"_{n}", F.col(n))).where(F.col("_own").isNotNull()).select(*rows.columns, F.col("_own.mate").alias(f"{n}m"), F.col("_own.potential").alias(f"{n}u"))
    met = held(p, "p").join(held(g, "g"), "unit").withColumn("cost", pair_cost(kind, seg("p_"), seg("g_")))
    mine = (F.col("pm") == F.col("g")) & (F.col("gm") == F.col("p"))
    over = F.max(F.col("pu") + F.col("gu") - F.col("cost"))
    sums = met.groupBy("unit").agg(over.alias("over"), F.sum(F.when(mine, F.col("cost")).otherwise(0.0)).alias("spent"), F.count_if(mine).alias("n_pairs"))
    side = lambda n: [F.count_if(F.col("side") == n).alias(f"n{n}"), F.count_if((F.col("side") == n) & F.col("mate").isNotNull()).alias(f"m{n}"), F.coalesce(F.max(F.when(F.col("side") == n, F.col("potential"))), F.lit(0.0)).alias(f"top{n}")]
    own = potentials.groupBy("unit").agg(*side(0), *side(1), F.sum("potential").alias("bound"))
    both = sums.join(own, "unit")
    few = F.least("n0", "n1")
    signs = ((F.col("n0") <= F.col("n1")) | (F.col("top0") <= slack)) & ((F.col("n1") <= F.col("n0")) | (F.col("top1") <= slack))
    return both.select(
        "unit", "n_pairs", ((F.col("n_pairs") == few) & (F.col("m0") == few) & (F.col("m1") == few)).alias("one_to_one"),
        ((F.col("over") <= slack) & signs).alias("feasible"), (F.abs(F.col("spent") - F.col("bound")) <= slack * (1 + F.abs("bound"))).alias("tight"),
    )


def y_greedy_match(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Truths by their first y take the free prediction whose two y's are nearest; unit, p, g, start_error, end_error."""

    side = lambda df, n: df.select("unit", F.lit(n).alias("side"), "line_id", "y1", "y2")

    def run(rows: dict[str, np.ndarray]) -> dict[str, list]:
        p, g = rows["side"] == 0, np.flatnonzero(rows["side"] == 1)
        ids, first, second = rows["line_id"][p], rows["y1"][p], rows["y2"][p]
        used, out = np.zeros(len(ids), bool), []
        for k in g[np.lexsort((rows["line_id"][g], rows["y1"][g]))]:
            if used.all():
                break
            e1, e2 = np.abs(first - rows["y1"][k]), np.abs(second - rows["y2"][k])
            i = int(np.argmin(np.where(used, np.inf, e1 + e2)))
            used[i] = True
            out.append((int(rows["unit"][k]), int(ids[i]), int(rows["line_id"][k]), float(e1[i]), float(e2[i])))
        return {c: [o[i] for o in out] for i, c in enumerate(("unit", "p", "g", "start_error", "end_error"))}

    return each_unit(side(pred, 0).unionByName(side(gt, 1)), ["side", "line_id"], run, "unit long, p long, g long, start_error double, end_error double")


def covered(pred: DataFrame, gt: DataFrame, limit: float, kind: str = "l2_swap") -> DataFrame:
    """Truths with any prediction within limit; predictions may serve many."""
    return gt.join(pairs(pred, gt, kind, limit).select("unit", F.col("g").alias("line_id")).distinct(), ["unit", "line_id"], "left_semi")


def index_pairs(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """unit, mae: segments paired by line_id, a missing one counts as zeros; sum of differences over four times the larger count."""
    side = lambda df, p: df.select("unit", "line_id", *(F.col(c).alias(f"{p}_{c}") for c in COORDS), F.lit(1).alias(f"{p}_n"))
    both = side(gt, "g").join(side(pred, "p"), ["unit", "line_id"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    gap = sum((F.abs(zero(f"g_{c}") - zero(f"p_{c}")) for c in COORDS), F.lit(0.0))
    return both.groupBy("unit").agg((F.sum(gap) / (4 * F.greatest(F.count("g_n"), F.count("p_n")))).alias("mae"))


def run_matcher(pred: DataFrame, gt: DataFrame, matcher: Matcher, tau: float) -> DataFrame:
    """pred with tp from a user's matcher(pred lines, gt lines, tau) -> (tp, fp), called once for each unit; predictions come by score."""
    columns = pred.columns
    both = pred.withColumn("_side", F.lit(0)).unionByName(gt.withColumn("_side", F.lit(1)), allowMissingColumns=True)

    def run(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        lines = np.stack([rows[c] for c in COORDS], 1).astype(float)
        p = rows["_side"] == 0
        tp, _ = matcher(lines[p], lines[~p], tau) if p.any() else (np.zeros(0), None)
        return {c: rows[c][p] for c in columns} | {"tp": np.asarray(tp, int)}

    schema = ", ".join(f"`{n}` {t}" for n, t in pred.dtypes) + ", tp int"
    return each_unit(both, ["_side", F.desc("score"), "line_id"], run, schema)
