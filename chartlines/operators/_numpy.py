"""Small numpy helpers for what depends on order within one unit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from operator import add

import numpy as np

#: Up to so many items are worked through as plain numbers, which cost less than small arrays.
FEW = 48


def greedy_pairs(cost: np.ndarray, limit: float = np.inf) -> list[tuple[int, int]]:
    """One-to-one pairs, cheapest first, ties by row and column, up to limit."""
    rows, cols = np.nonzero(cost <= limit)
    out, used_r, used_c = [], np.zeros(cost.shape[0], bool), np.zeros(cost.shape[1], bool)
    for k in np.lexsort((cols, rows, cost[rows, cols])):
        r, c = int(rows[k]), int(cols[k])
        if not used_r[r] and not used_c[c]:
            used_r[r] = used_c[c] = True
            out.append((r, c))
    return out


def optimal_with_potentials(cost: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """One-to-one pairs of least total cost, all of the smaller side matched, and a potential for each row and column (shortest augmenting paths).

    No pair costs less than its two potentials together, potentials of the larger side
    are at most 0 and 0 where unmatched: so their sum bounds every matching from below.
    """
    if 0 in cost.shape:
        return [], np.zeros(cost.shape[0]), np.zeros(cost.shape[1])
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    owner, u, v = _paths_of_few(c.tolist()) if c.shape[1] <= FEW else _paths(c)
    pairs = [(int(r), j) for j, r in enumerate(owner) if r >= 0]
    return (sorted((j, r) for r, j in pairs), v, u) if flip else (sorted(pairs), u, v)


def optimal_few(cost: list[list[float]]) -> list[tuple[int, int]]:
    """optimal_pairs of a small matrix given as lists."""
    flip = len(cost) > len(cost[0])
    owner = _paths_of_few([list(c) for c in zip(*cost)] if flip else cost)[0]
    return sorted((j, r) if flip else (r, j) for j, r in enumerate(owner) if r >= 0)


def _paths(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each column (-1 for none) and the potentials of rows and columns, for no more rows than columns."""
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        best, prev, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        here, at, low = row, -1, 0.0
        while here >= 0:
            if at >= 0:
                seen[at] = True
            through = low + c[here] - u[here] - v
            better = ~seen & (through < best)
            best[better], prev[better] = through[better], at
            at = int(np.argmin(np.where(seen, np.inf, best)))
            low, here = best[at], int(owner[at])
        done = np.flatnonzero(seen)
        u[owner[done]] += low - best[done]
        v[done] -= low - best[done]
        u[row] += low
        while at >= 0:
            back = int(prev[at])
            owner[at] = owner[back] if back >= 0 else row
            at = back
    return owner, u, v


def _paths_of_few(c: list[list[float]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """As _paths, in the same steps on plain numbers, which cost less than arrays of a few."""
    n, m = len(c), len(c[0])
    u, v, owner = [0.0] * n, [0.0] * m, [-1] * m
    for row in range(n):
        best, prev, left = [np.inf] * m, [-1] * m, list(range(m))
        done: list[int] = []
        here, at, low = row, -1, 0.0
        while here >= 0:
            if at >= 0:
                left.remove(at)
                done.append(at)
            costs, own, nearest = c[here], u[here], np.inf
            came, at = at, left[0]
            for j in left:
                through = low + costs[j] - own - v[j]
                if through < best[j]:
                    best[j], prev[j] = through, came
                if best[j] < nearest:
                    nearest, at = best[j], j
            low, here = best[at], owner[at]
        for j in done:
            u[owner[j]] += low - best[j]
            v[j] -= low - best[j]
        u[row] += low
        while at >= 0:
            back = prev[at]
            owner[at] = owner[back] if back >= 0 else row
            at = back
    return owner, np.array(u), np.array(v)


def optimal_pairs(cost: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of least total cost, all of the smaller side matched."""
    return optimal_with_potentials(cost)[0]


def spread_ties(values: np.ndarray, eps: float) -> np.ndarray:
    """values of which equal ones are moved apart, in order, by 0, eps, -eps, 2 eps, -2 eps, ..."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
    place = np.arange(len(ranked)) - np.maximum.accumulate(np.where(head, np.arange(len(ranked)), 0))
    out = values.astype(float)
    out[order] = ranked + (place + 1) // 2 * np.where(place % 2, eps, -eps)
    return out


def runs(values: list, begin: int, end: int) -> list[tuple[int, int]]:
    """Begin and end of each stretch of equal values between two places."""
    cuts = [begin, *(i for i in range(begin + 1, end) if values[i] != values[i - 1]), end]
    return list(zip(cuts, cuts[1:]))


def spread_few_ties(values: list[float], eps: float) -> list[float]:
    """As spread_ties, for plain numbers."""
    if len(values) > FEW:
        return spread_ties(np.array(values, float), eps).tolist()
    seen: dict[float, int] = {}
    out = []
    for x in values:
        place = seen.get(x, 0)
        seen[x] = place + 1
        out.append(x + (place + 1) // 2 * (eps if place % 2 else -eps))
    return out


def take_nearest(starts: list[float] | np.ndarray, ends: list[float], most: int) -> list[tuple[int, bool, float]]:
    """For each end, in order: the place of the nearest start taken fewer than `most` times, the first on ties, True and the gap; where all are used up, the nearest of all and False. What is NaN is near nothing."""
    used, out = [0] * len(starts), []
    many = isinstance(starts, np.ndarray)
    count = np.zeros(len(starts), np.int64)
    for end in ends:
        if many:
            gap = np.abs(starts - end)
            gap[np.isnan(gap)] = np.inf
            free = np.where(count < most, gap, np.inf)
            j = int(np.argmin(free))
            j = j if np.isfinite(free[j]) else int(np.argmin(gap))
            out.append((j, bool(count[j] < most), float(abs(starts[j] - end))))
            count[j] += 1
            continue
        best, least, other, nearest = -1, np.inf, 0, np.inf
        for j, start in enumerate(starts):
            gap = abs(start - end)
            if gap < least and used[j] < most:
                best, least = j, gap
            if gap < nearest:
                other, nearest = j, gap
        j = best if best >= 0 else other
        out.append((j, used[j] < most, abs(starts[j] - end)))
        used[j] += 1
    return out


def take_free_points(points: list[tuple[float, float]] | np.ndarray, ends: list[tuple[float, float]], threshold: float) -> list[tuple[int, int]]:
    """Places of an end and of the nearest point within threshold still free, the first on ties; ends choose in order. What is NaN is near nothing."""
    limit, out = threshold * threshold, []
    if isinstance(points, np.ndarray):
        open_, n_open = np.ones(len(points), bool), len(points)
        for p, end in enumerate(ends):
            if not n_open:
                break
            gap = ((points - end) ** 2).sum(1)
            gap[~(gap <= limit) | ~open_] = np.inf
            j = int(np.argmin(gap))
            if open_[j] and gap[j] <= limit:
                open_[j] = False
                n_open -= 1
                out.append((p, j))
        return out
    left = list(range(len(points)))
    for p, (x, y) in enumerate(ends):
        best, least = -1, limit
        for j in left:
            dx, dy = points[j][0] - x, points[j][1] - y
            gap = dx * dx + dy * dy
            if gap < least or (best < 0 and gap == least):
                best, least = j, gap
        if best >= 0:
            left.remove(best)
            out.append((p, best))
            if not left:
                break
    return out


def end_costs(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """Cost matrix of segments (rows x1, y1, x2, y2); kinds as in functions.geometry.pair_cost."""
    return _costs(a.reshape(-1, 1, 2, 2), b.reshape(1, -1, 2, 2), kind)


def _costs(p: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    """Cost of segments whose last two axes are the end and its x, y."""
    turned = q[..., ::-1, :]
    dist = lambda x, y: np.sqrt(((x - y) ** 2).sum(-1)).sum(-1)
    l1 = lambda x, y: np.abs(x - y).sum((-2, -1))
    match kind:
        case "mean_ends":
            return np.minimum(dist(p, q), dist(p, turned)) / 2
        case "l2":
            return dist(p, q)
        case "l2_swap":
            return np.minimum(dist(p, q), dist(p, turned))
        case "l1":
            return l1(p, q)
        case "ends_mae":
            return np.minimum(l1(p, q), l1(p, turned)) / 4
        case "squared":
            return np.minimum(((p - q) ** 2).sum((-2, -1)), ((p - turned) ** 2).sum((-2, -1)))
        case "midpoint":
            return np.sqrt(((p.mean(-2) - q.mean(-2)) ** 2).sum(-1))
    raise ValueError(f"no such cost: {kind}")


def least_sampled_gaps(rows: np.ndarray, step: float, least: int, most: int) -> np.ndarray:
    """Smallest distance between the sample points of two segments, for each row of eight coordinates.

    The points of the second stand on a line, so the one nearest to a point of the first
    is the one nearest to its foot: one look for each point of the first.
    """
    x, y = (rows[:, [c, c + 4]] for c in (0, 1))
    dx, dy = (rows[:, [c + 2, c + 6]] - rows[:, [c, c + 4]] for c in (0, 1))
    size = np.hypot(dx, dy)
    points = np.where(size < 1e-9, 1, np.clip(np.ceil(size / step), least, most)).astype(np.int64)
    last, square = np.maximum(points - 1, 1), np.maximum(size[:, 1] ** 2, 1e-18)
    ends, out, a = np.cumsum(points[:, 0]), np.empty(len(rows)), 0
    while a < len(rows):
        # some rows whose points stay in the cache
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_POINTS, "right")))
        n = points[a:b, 0]
        first = np.cumsum(n) - n
        spread = lambda c: np.repeat(c[a:b], n)
        t = (np.arange(int(n.sum())) - np.repeat(first, n)) / spread(last[:, 0])
        ox, oy, far = spread(dx[:, 1]), spread(dy[:, 1]), spread(last[:, 1])
        rx, ry = spread(x[:, 0]) + spread(dx[:, 0]) * t - spread(x[:, 1]), spread(y[:, 0]) + spread(dy[:, 0]) * t - spread(y[:, 1])
        foot = (rx * ox + ry * oy) / spread(square)
        u = np.minimum(np.maximum(np.rint(foot * far), 0), spread(points[:, 1] - 1)) / far
        out[a:b] = np.minimum.reduceat((rx - ox * u) ** 2 + (ry - oy * u) ** 2, first)
        a = b
    return np.sqrt(out)


#: Points that least_sampled_gaps holds at a time.
BLOCK_POINTS = 1 << 14


def kept_of(units: np.ndarray, scores: np.ndarray, drops) -> np.ndarray:
    """Places of the rows kept, over many units at once: in each unit best score first, ties by place, a kept row taking out those later ones for which drops(kept, later) (arrays of places) holds. units: rows of a unit stand together."""
    begins = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]])[: len(units)])
    no = np.zeros(len(units), np.int64)
    no[begins[1:]] = 1
    order = np.lexsort((np.arange(len(units)), -scores, np.cumsum(no)))
    ends = np.append(begins[1:], len(units))
    later = np.repeat(ends, ends - begins) - np.arange(len(units)) - 1  # rows of the unit after each in order
    alive = np.ones(len(units), bool)
    before = np.concatenate([[0], np.cumsum(later)])
    a = 0
    while a < len(units):
        # some rows whose pairs fit a block, or a single one of a large unit
        b = max(a + 1, int(np.searchsorted(before, before[a] + PAIRS, "right")) - 1)
        n = later[a:b] if b > a + 1 or alive[order[a]] else later[a:a]
        first = np.repeat(np.arange(a, a + len(n)), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        open_ = alive[order[first]] & alive[order[second]]
        first, second = order[first[open_]], order[second[open_]]
        gone = drops(first, second)
        if len(n) == 1:
            alive[second[gone]] = False
        else:
            for i, j in zip(first[gone].tolist(), second[gone].tolist()):
                if alive[i]:
                    alive[j] = False
        a = b
    return np.flatnonzero(alive)


#: Pairs that kept_of looks at in one go.
PAIRS = 1 << 18


def nearer(lines: np.ndarray, limit: float, kind: str = "mean_ends"):
    """For kept_of: a later line not at limit or farther from a kept one."""
    ends = lines.reshape(-1, 2, 2)
    return lambda i, j: ~(_costs(ends[i], ends[j], kind) >= limit)


def collinear(lines: np.ndarray, angle: float, gap: float, share: float):
    """For kept_of: a later line nearly parallel to a kept one, close to it and covered by it for a share of its length."""
    ends = lines.reshape(-1, 2, 2)
    d = lines[:, 2:] - lines[:, :2]
    size = np.maximum(np.hypot(*d.T), 1e-9)
    turn = np.degrees(np.arctan2(d[:, 1], d[:, 0])) % 180

    def drops(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        unit = (d[i] / size[i, None])[:, None]
        rel = ends[j] - ends[i, :1]
        along, off = rel[:, :, 0] * unit[:, :, 0] + rel[:, :, 1] * unit[:, :, 1], np.abs(rel[:, :, 0] * unit[:, :, 1] - rel[:, :, 1] * unit[:, :, 0])
        cover = np.clip(np.minimum(along.max(1), size[i]) - np.maximum(along.min(1), 0), 0, None) / size[j]
        diff = np.abs(turn[j] - turn[i])
        return (np.minimum(diff, 180 - diff) < angle) & (off.max(1) < gap) & (cover >= share)

    return drops


def _off_axis(line: Sequence[float], other: Sequence[float]) -> float:
    """Largest squared distance of the ends of other from the straight line through both ends of line; plain numbers, as arrays of two points cost more than the sums."""
    x1, y1, x2, y2 = line
    dx, dy = x2 - x1, y2 - y1
    ends = [(other[0] - x1, other[1] - y1), (other[2] - x1, other[3] - y1)]
    if dx or dy:
        return max((x * dy - y * dx) ** 2 for x, y in ends) / max(dx * dx + dy * dy, 1e-9)
    return max(x * x + y * y for x, y in ends)


def clip_collinear(lines: np.ndarray, scores: np.ndarray, near: float, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Kept lines, best first, trimmed where they run along an earlier one; places of the kept lines and their coordinates.

    Two lines run together if the ends of one of them lie within `near` of the other's
    axis. The earlier one's shadow on a new line, widened by slack (a share of the new
    line's length) at both ends, takes away what it covers: all of it (the line is
    dropped), or one end (it is trimmed). A shadow inside the new line leaves it whole.
    """
    out: list[tuple[float, ...]] = []
    places = []
    rows = lines.tolist()
    for i in np.lexsort((np.arange(len(scores)), -scores)).tolist():
        x1, y1, x2, y2 = line = rows[i]
        dx, dy = x2 - x1, y2 - y1
        size = max(dx * dx + dy * dy, 1e-9)
        low, high = 0.0, 1.0
        for kept in out:
            if _off_axis(line, kept) > near**2 and _off_axis(kept, line) > near**2:
                continue
            a, b = (((kept[k] - x1) * dx + (kept[k + 1] - y1) * dy) / size for k in (0, 2))
            first, last = min(a, b) - slack, max(a, b) + slack
            if (low < first and last < high) or last < low or first > high:
                continue
            covers_start, covers_end = first <= low, high <= last
            low, high = last if covers_start else low, first if covers_end else high
            if low >= high:
                break
        if low < high:
            out.append((x1 + dx * low, y1 + dy * low, x1 + dx * high, y1 + dy * high))
            places.append(i)
    return np.array(places, np.int64), np.array(out).reshape(-1, 4)


def near_copies(lines: np.ndarray, eps: float) -> np.ndarray:
    """Places kept when each line within eps of an earlier kept one, by the norm of all four differences, is dropped."""
    kept: list[int] = []
    for i in range(len(lines)):
        if not kept or (((lines[kept] - lines[i]) ** 2).sum(1) > eps**2).all():
            kept.append(i)
    return np.array(kept, np.int64)


def quantile_distance(a: np.ndarray, b: np.ndarray) -> float:
    """1-D Wasserstein distance by interpolated quantiles on a common grid."""
    if not len(a) or not len(b):
        return float("nan")
    grid = np.linspace(0, 1, max(len(a), len(b)))
    at = lambda x: np.interp(grid, np.linspace(0, 1, len(x)), np.sort(x)) if len(x) > 1 else np.full(len(grid), x[0])
    return float(np.abs(at(a) - at(b)).mean())


@lru_cache
def _directions(n: int, seed: int) -> np.ndarray:
    turn = np.random.default_rng(seed).uniform(0, np.pi, n)
    return np.stack([np.cos(turn), np.sin(turn)])


def sliced_distance(a: np.ndarray, b: np.ndarray, directions: int = 128, seed: int = 0) -> float:
    """Mean of the 1-D distances of both sets' shadows on random directions."""
    if not len(a) or not len(b):
        return float("nan")
    grid = np.linspace(0, 1, max(len(a), len(b)))

    def shadows(x: np.ndarray) -> np.ndarray:
        s = np.sort(x @ _directions(directions, seed), axis=0)
        at = grid * (len(s) - 1)
        low = np.minimum(at.astype(int), max(len(s) - 2, 0))
        return s[low] + (at - low)[:, None] * (s[np.minimum(low + 1, len(s) - 1)] - s[low])

    return float(np.abs(shadows(a) - shadows(b)).mean())


def least_transport(cost: np.ndarray) -> float:
    """Least cost of moving as many units from each row as there are columns, so that each column takes as many as there are rows; by shortest augmenting paths."""
    n, m = cost.shape
    flow, left, room = np.zeros((n, m), np.int64), np.full(n, m), np.full(m, n)
    u, v = np.zeros(n), np.zeros(m)  # cost - u - v is never negative, and zero where units move
    for i in range(n):
        while left[i]:
            dist, source, done = cost[i] - u[i] - v, np.full(m, i), np.zeros(m, bool)
            reached, via = np.full(n, np.inf), np.full(n, -1)
            reached[i] = 0
            while True:
                j = int(np.argmin(np.where(done, np.inf, dist)))
                done[j] = True
                if room[j]:
                    break
                for s in np.flatnonzero((flow[:, j] > 0) & np.isinf(reached)):
                    reached[s], via[s] = dist[j], j
                    through = dist[j] + cost[s] - u[s] - v
                    better = ~done & (through < dist)
                    dist[better], source[better] = through[better], s
            steps, at = [], j
            while source[at] != i:
                steps.append((source[at], at, via[source[at]]))
                at = via[source[at]]
            moved = min(left[i], room[j], *(flow[s, back] for s, _, back in steps))
            flow[i, at] += moved
            for s, to, back in steps:
                flow[s, to] += moved
                flow[s, back] -= moved
            left[i] -= moved
            room[j] -= moved
            seen, end = np.isfinite(reached), dist[j]
            u[seen] += end - reached[seen]
            v[done] -= end - dist[done]
    return float((flow * cost).sum())


def _along(s: np.ndarray, n: int) -> np.ndarray:
    """Sorted values (last axis) at n even places, between them interpolated."""
    at = np.linspace(0, 1, n) * (s.shape[-1] - 1)
    low = np.minimum(at.astype(int), max(s.shape[-1] - 2, 0))
    return s[..., low] + (at - low) * (s[..., np.minimum(low + 1, s.shape[-1] - 1)] - s[..., low])


def quantile_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """quantile_distance of the last axes of a and b."""
    n = max(a.shape[-1], b.shape[-1])
    return np.abs(_along(np.sort(a), n) - _along(np.sort(b), n)).mean(-1)


def _sorted_first(s: np.ndarray) -> np.ndarray:
    """s sorted along its first axis, in place; few rows are exchanged as wholes, which costs less than sorting each column."""
    if len(s) > 12:
        s.sort(axis=0)
        return s
    for end in range(len(s) - 1, 0, -1):
        for i in range(end):
            s[i], s[i + 1] = np.minimum(s[i], s[i + 1]), np.maximum(s[i], s[i + 1])
    return s


def sliced_distances(a: np.ndarray, b: np.ndarray, directions: int = 128, seed: int = 0) -> np.ndarray:
    """sliced_distance of each of many units' points (unit, point, x and y)."""
    n = max(a.shape[1], b.shape[1])
    p, q = (_sorted_first((x.swapaxes(0, 1).reshape(-1, 2) @ _directions(directions, seed)).reshape(x.shape[1], -1)) for x in (a, b))

    def place(s: np.ndarray, t: float) -> np.ndarray:
        low = min(int(t * (len(s) - 1)), max(len(s) - 2, 0))
        share = t * (len(s) - 1) - low
        return s[low] + share * (s[low + 1] - s[low]) if share else s[low]

    total = sum(np.abs(place(p, t) - place(q, t)) for t in np.linspace(0, 1, n).tolist())
    return total.reshape(len(a), -1).mean(1) / n


def earth_movers_of_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """earth_movers of each of many units' points (unit, point, x and y), NaN where a coordinate is.

    As least_transport, in the same steps for all units side by side; those that are done are left out.
    """
    cost = np.sqrt(((a[:, :, None] - b[:, None]) ** 2).sum(3))
    out = np.full(len(cost), np.nan)
    known = np.flatnonzero(np.isfinite(cost).all((1, 2)))
    cost = cost[known]
    units, n, m = cost.shape
    flow, left, room = np.zeros((units, n, m), np.int64), np.full((units, n), m), np.full((units, m), n)
    u, v = np.zeros((units, n)), np.zeros((units, m))
    for i in range(n):
        while len(open_ := np.flatnonzero(left[:, i])):
            dist = cost[open_, i] - u[open_, i, None] - v[open_]
            source, done = np.full((len(open_), m), i), np.zeros((len(open_), m), bool)
            reached, via, end = np.full((len(open_), n), np.inf), np.full((len(open_), n), -1), np.zeros(len(open_), int)
            reached[:, i] = 0
            act = np.arange(len(open_))
            while len(act):
                j = np.where(done[act], np.inf, dist[act]).argmin(1)
                done[act, j], end[act] = True, j
                go = room[open_[act], j] == 0
                act, j = act[go], j[go]
                own, near = open_[act], dist[act, j]
                fresh = (flow[own, :, j] > 0) & np.isinf(reached[act])
                reached[act] = np.where(fresh, near[:, None], reached[act])
                via[act] = np.where(fresh, j[:, None], via[act])
                through = np.where(fresh[:, :, None], near[:, None, None] + cost[own] - u[own][:, :, None] - v[own][:, None], np.inf)
                by = through.argmin(1)
                best = np.take_along_axis(through, by[:, None], 1)[:, 0]
                better = ~done[act] & (best < dist[act])
                source[act], dist[act] = np.where(better, by, source[act]), np.where(better, best, dist[act])
            # what can be moved along the way back, and moving it
            all_, moved = np.arange(len(open_)), np.minimum(left[open_, i], room[open_, end])
            for turn in range(2):
                at, act = end.copy(), all_
                while len(act):
                    s = source[act, at[act]]
                    last = s == i
                    if turn:
                        flow[open_[act], s, at[act]] += moved[act]
                    act, s = act[~last], s[~last]
                    back = via[act, s]
                    if turn:
                        flow[open_[act], s, back] -= moved[act]
                    else:
                        moved[act] = np.minimum(moved[act], flow[open_[act], s, back])
                    at[act] = back
            left[open_, i] -= moved
            room[open_, end] -= moved
            far = dist[all_, end][:, None]
            u[open_] += np.where(np.isfinite(reached), far - reached, 0)
            v[open_] -= np.where(done, far - dist, 0)
    out[known] = (flow * cost).sum((1, 2)) / (n * m)
    return out


def earth_movers(a: np.ndarray, b: np.ndarray) -> float:
    """Exact 2-D earth mover's distance of uniform point sets; NaN if one is empty."""
    if not len(a) or not len(b):
        return float("nan")
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    if len(a) == len(b):
        return float(sum(cost[i, j] for i, j in optimal_pairs(cost)) / len(a))
    return least_transport(cost) / cost.size


def peaks(hist: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima (middle of a plateau, never at a border) of at least height, higher ones first claiming `distance` bins on each side."""
    found, i, n = [], 1, len(hist)
    while i < n - 1:
        if hist[i - 1] < hist[i]:
            j = i
            while j < n - 1 and hist[j + 1] == hist[i]:
                j += 1
            if j < n - 1 and hist[j + 1] < hist[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found = [p for p in found if hist[p] >= height]
    keep = dict.fromkeys(found, True)
    for p in sorted(found, key=lambda p: (hist[p], p), reverse=True):
        if keep[p]:
            for q in found:
                if q != p and abs(q - p) < distance:
                    keep[q] = False
    return np.array([p for p in found if keep[p]], np.int64)


def prominence(hist: np.ndarray, p: int) -> float:
    """How far a maximum stands above the higher of the two lowest points between it and something higher, or the border."""
    higher = np.flatnonzero(hist > hist[p])
    left = int(higher[higher < p][-1]) if (higher < p).any() else 0
    right = int(higher[higher > p][0]) if (higher > p).any() else len(hist) - 1
    return float(hist[p] - max(hist[left : p + 1].min(), hist[p : right + 1].min()))


def distance_sums(x: np.ndarray, n: np.ndarray, of: np.ndarray, y: np.ndarray | None = None, m: np.ndarray | None = None, by: np.ndarray | None = None, k: int = 1, block: int = 256) -> tuple[np.ndarray, np.ndarray | None]:
    """For each row of x the sum of its distances to the rows of y of each of k clusters (by), a row counting m times, and for each row of y those to the rows of x (n, of); without y those within x, whose rows are apart.

    Each pair is worked out once, for both its rows, in blocks that stay in the cache.
    """
    within = y is None
    if within:
        y, m, by = x, n, of
    middle = x.mean(0)  # squares lose least around it
    sides = []
    for p, weight, own in ((x, n, of), (y, m, by)):
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(k + 1)).tolist()
        some = [(c, a, min(a + block, e)) for c, (b, e) in enumerate(zip(cuts, cuts[1:])) for a in range(b, e, block)]
        sides.append((p[order] - middle, weight[order], order, some, np.zeros((len(p), k))))
    (x, n, order, rows, out), (y, m, back, columns, other) = sides
    ones = lambda p: np.ones((len(p), 1))
    square = lambda p: (p**2).sum(1)[:, None]
    left, right = np.hstack([-2 * x, square(x), ones(x)]), np.ascontiguousarray(np.hstack([y, ones(y), square(y)]).T)
    space = np.empty(block * block)
    for i, (c, a, b) in enumerate(rows):
        for d, e, f in columns[i:] if within else columns:
            gap = space[: (b - a) * (f - e)].reshape(b - a, f - e)
            np.matmul(left[a:b], right[:, e:f], out=gap)
            np.sqrt(np.abs(gap, out=gap), out=gap)
            if within and a == e:
                np.fill_diagonal(gap, 0)
                out[a:b, c] += gap @ m[e:f]
                continue
            out[a:b, d] += gap @ m[e:f]
            (out if within else other)[e:f, c] += n[a:b] @ gap
    found = np.empty_like(out)
    found[order] = out
    if within:
        return found, None
    partner = np.empty_like(other)
    partner[back] = other
    return found, partner


def merged_rows(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal rows of x, and the sum of n over all that equal it."""
    order = np.lexsort(x.T[::-1])
    fresh = np.concatenate([[True], (x[order[1:]] != x[order[:-1]]).any(1)])[: len(x)]
    return order[fresh], np.bincount(np.cumsum(fresh) - 1, n[order])


def silhouette(x: np.ndarray, n: np.ndarray, of: np.ndarray, block: int = 256) -> float:
    """Mean silhouette over all points, weighted by n; NaN with fewer than two clusters. Equal points must be in one cluster. It takes time with the square of the points; distances are worked out for `block` rows by as many at a time."""
    ids, own = np.unique(of, return_inverse=True)
    if len(ids) < 2:
        return float("nan")
    first, n = merged_rows(x, n)
    own, at = own[first], np.arange(len(first))
    sums, mass = distance_sums(x[first], n, own, k=len(ids), block=block)[0], np.bincount(own, n, len(ids))
    inside, outside = sums[at, own] / np.maximum(mass[own] - 1, 1e-12), sums / mass
    outside[at, own] = np.inf
    best = outside.min(1)
    value = np.where(mass[own] > 1, (best - inside) / np.maximum(np.maximum(best, inside), 1e-12), 0.0)
    return float((value * n).sum() / n.sum())


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first on ties, and its squared distance; `block` rows at a time."""
    of, least = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), block):
        gap = ((x[a : a + block, None] - centres) ** 2).sum(2)
        of[a : a + block], least[a : a + block] = gap.argmin(1), gap.min(1)
    return of, least


def _gap_to(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distance of each row to one point, column by column."""
    total = (x[:, 0] - centre[0]) ** 2
    for j in range(1, x.shape[1]):
        total += (x[:, j] - centre[j]) ** 2
    return total


def spread_seeds(x: np.ndarray, n: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: rows of x drawn one after another with a chance of weight times squared distance to the nearest one drawn so far; fewer if no row is apart."""
    rng = np.random.default_rng(seed)
    centres = x[[int(np.searchsorted(np.cumsum(n), rng.random() * n.sum()))]]
    gap = _gap_to(x, centres[0])
    while len(centres) < k and (gap * n).max() > 1e-18:
        mass = np.cumsum(gap * n)
        pick = x[min(int(np.searchsorted(mass, rng.random() * mass[-1])), len(x) - 1)]
        centres = np.vstack([centres, pick])
        np.minimum(gap, _gap_to(x, pick), out=gap)
    return centres


def settle(x: np.ndarray, n: np.ndarray, centres: np.ndarray, rounds: int, block: int = 1 << 13) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres after rounds of weighted k-means, the centre of each row, and the inertia; `block` rows at a time."""
    square, of = (x**2).sum(1), np.zeros(len(x), np.int32)
    for turn in range(rounds + 1):
        mass, moved, inertia = np.zeros(len(centres)), np.zeros(centres.shape), 0.0
        for a in range(0, len(x), block):
            some = slice(a, a + block)
            gap = np.maximum(square[some, None] - 2 * x[some] @ centres.T + (centres**2).sum(1), 0)
            own = of[some] = gap.argmin(1)
            inertia += float((gap.min(1) * n[some]).sum())
            mass += np.bincount(own, n[some], len(centres))
            for j in range(x.shape[1]):
                moved[:, j] += np.bincount(own, n[some] * x[some, j], len(centres))
        if turn == rounds:
            break
        fresh = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], centres)
        if np.allclose(fresh, centres, atol=1e-12, rtol=0):
            break
        centres = fresh
    return centres, of, inertia


def separate(x: np.ndarray, n: np.ndarray, k: int, rounds: int, tries: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """The k-means of least inertia from several seedings; centres in order of their values."""
    best = min((settle(x, n, spread_seeds(x, n, k, t), rounds) for t in range(tries)), key=lambda f: f[2])
    order = np.lexsort(np.round(best[0], 9).T[::-1])
    return best[0][order], np.argsort(order)[best[1]], best[2]


def separation(x: np.ndarray, n: np.ndarray, centres: np.ndarray, of: np.ndarray, block: int = 1 << 16) -> float:
    """Mean distance between two centres over the mean distance of a point to its own; 0 for one centre."""
    if len(centres) < 2:
        return 0.0
    off = sum(float((np.linalg.norm(x[a : a + block] - centres[of[a : a + block]], axis=1) * n[a : a + block]).sum()) for a in range(0, len(x), block))
    within = off / n.sum() + 1e-6
    gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)[np.triu_indices(len(centres), 1)]
    return float((gaps.mean() + 1e-6) / within)


def _meet(x: np.ndarray, y: np.ndarray, eps: float, block: int = 1 << 18) -> bool:
    """Whether any row of x lies within eps of one of y; those that face the other side first, then all, in blocks."""
    any_near = lambda a, b: bool((((a[:, None] - b[None]) ** 2).sum(2) <= eps**2).any())
    facing = [a[np.argsort(((a - b.mean(0)) ** 2).sum(1))[:16]] for a, b in ((x, y), (y, x))]
    step = max(1, block // len(y))
    return any_near(*facing) or any(any_near(x[a : a + step], y) for a in range(0, len(x), step))


def density_clusters(x: np.ndarray, n: np.ndarray, eps: float, least: float, block: int = 1 << 20) -> np.ndarray:
    """Cluster of each point (rows of x, standing for n each), -1 for none, numbered by their first core.

    Points of one cell of a grid lie within eps of one another: a cell that holds `least`
    or more has cores only, all cores of a cell are one cluster, and two cells are joined by the
    first pair of cores found within eps. Only points of cells that hold fewer are
    compared one by one, `block` pairs at a time; no list of neighbours is held.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    side = eps / np.sqrt(x.shape[1]) * (1 - 1e-9)
    some = lambda at: x[at].astype(float)
    cell = np.zeros(len(x), np.int32)
    for column in x.T:  # one column after another: rows as such sort slowly
        spot = np.floor(column / side)
        low = spot.min()
        span = int(spot.max() - low) + 1
        if span * (int(cell.max()) + 1) > 4 * len(x) + (1 << 16):  # few of many cells are taken
            kinds, place = np.unique(spot, return_inverse=True)
            cell = np.unique(cell.astype(np.int64) * len(kinds) + place, return_inverse=True)[1].astype(np.int32)
            continue
        code = cell.astype(np.int64) * span + (spot - low).astype(np.int64)
        cell = (np.cumsum(np.bincount(code) > 0) - 1).astype(np.int32)[code]
    spot = code = kinds = place = None
    order = np.argsort(cell, kind="stable").astype(np.int32 if len(x) < 1 << 31 else np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(cell))])
    spots = np.floor(x[order[starts[:-1]]] / side).astype(np.int64)
    members = lambda c: order[starts[c] : starts[c + 1]]
    number = {spot: i for i, spot in enumerate(map(tuple, spots.tolist()))}
    far = int(np.ceil(np.sqrt(x.shape[1])))
    steps = np.stack(np.meshgrid(*[np.arange(-far, far + 1)] * x.shape[1], indexing="ij"), -1).reshape(-1, x.shape[1])
    steps = steps[(np.maximum(np.abs(steps) - 1, 0) ** 2).sum(1) * side**2 <= eps**2]
    half = [s for s in map(tuple, steps.tolist()) if s > (0,) * x.shape[1]]

    def beside(c: int, moves) -> list[int]:
        spot = spots[c]
        return [number[s] for s in map(tuple, (spot + moves).tolist()) if s in number]

    def blocks(c: int, others: np.ndarray):
        own, size = members(c), max(1, block // max(len(others), 1))
        for a in range(0, len(own), size):
            yield own[a : a + size], ((some(own[a : a + size])[:, None] - some(others)[None]) ** 2).sum(2)

    held = np.bincount(cell, n, len(spots))
    core, sparse = (held >= least)[cell], np.flatnonzero(held < least).tolist()
    for c in sparse:
        others = np.concatenate([members(d) for d in beside(c, steps)])
        for own, gap in blocks(c, others):
            core[own] = ((gap <= eps**2) * n[others]).sum(1) >= least

    cores = [m[core[m]] for m in map(members, range(len(spots)))]
    top = list(range(len(spots)))

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    filled = [(c, tuple(spot)) for c, spot in enumerate(spots.tolist()) if len(cores[c])]
    for step in sorted(half, key=lambda s: sum(v * v for v in s)):  # near cells first: most others hang together by then
        for c, spot in filled:
            d = number.get(tuple(map(add, spot, step)))
            if d is not None and len(cores[d]) and root(c) != root(d) and _meet(some(cores[c]), some(cores[d]), eps):
                top[root(d)] = root(c)
    first: dict[int, int] = {}
    for c, own in enumerate(cores):
        if len(own):
            first[root(c)] = min(first.get(root(c), len(x)), int(own[0]))  # a cell's points stand in order
    number_of = {c: i for i, c in enumerate(sorted(first, key=first.get))}
    of = np.array([number_of.get(root(c), -1) for c in range(len(spots))], np.int32)[cell]
    of[~core] = -1
    for c in sparse:
        if core[members(c)].all():
            continue
        others = np.sort(np.concatenate([cores[d] for d in beside(c, steps)]))
        if not len(others):
            continue
        for own, gap in blocks(c, others):
            best = gap.argmin(1)  # the first of several
            near = ~core[own] & (gap[np.arange(len(own)), best] <= eps**2)
            of[own[near]] = of[others[best[near]]]
    return of


def smooth_cells(y1: int, x1: int, y2: int, x2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x, value of the anti-aliased cells between two cells: those of the box between them whose middle lies less than one cell off the line, and one less that distance."""
    dy, dx = abs(int(y2) - int(y1)), abs(int(x2) - int(x1))
    far, near = max(dy, dx), min(dy, dx)
    k = np.arange(far + 1)[:, None]
    j = (near * k) // max(far, 1) + np.arange(-1, 3)[None]
    length = max(np.hypot(far, near), 1.0)
    off = np.abs(far * j - near * k)
    inside = (j >= 0) & (j <= near) & (off < length)
    along, aside = np.broadcast_to(k, j.shape)[inside], j[inside]
    down, right = (along, aside) if dy > dx else (aside, along)
    return y1 + np.sign(y2 - y1) * down, x1 + np.sign(x2 - x1) * right, 1 - off[inside] / length


def smooth_lines(y1: np.ndarray, x1: np.ndarray, y2: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """line, y, x, value: the cells of smooth_cells for many lines at once, line telling whose they are, in no certain order."""
    y1, x1, y2, x2 = (np.asarray(c, np.int64) for c in (y1, x1, y2, x2))
    dy, dx = np.abs(y2 - y1), np.abs(x2 - x1)
    far, near = np.maximum(dy, dx), np.minimum(dy, dx)
    length = np.maximum(np.sqrt(far * far + near * near), 1.0)
    of = np.repeat(np.arange(len(far)), far + 1)
    k = np.arange(len(of)) - np.repeat(np.cumsum(far + 1) - far - 1, far + 1)
    run, rise, size = far[of], near[of], length[of]
    base, drop = rise * k // np.maximum(run, 1), rise * k
    found = []
    for step in range(-1, 3):
        j = base + step
        off = np.abs(run * j - drop)
        at = np.flatnonzero((j >= 0) & (j <= rise) & (off < size))
        found.append((of[at], k[at], j[at], 1 - off[at] / size[at]))
    line, along, aside, value = (np.concatenate(c) for c in zip(*found))
    steep = (dy > dx)[line]
    down, right = np.where(steep, along, aside), np.where(steep, aside, along)
    return line, y1[line] + np.sign(y2 - y1)[line] * down, x1[line] + np.sign(x2 - x1)[line] * right, value


def line_map(ends: tuple[np.ndarray, ...], size: int) -> np.ndarray:
    """The largest value of any of the lines (y1, x1, y2, x2) in each cell of a square map."""
    full = np.zeros(size * size)
    _, y, x, value = smooth_lines(*ends)
    np.maximum.at(full, y * size + x, value)
    return full.reshape(size, size)


def line_maps(of: np.ndarray, ends: tuple[np.ndarray, ...], size: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """map, y, x, value: the cells above 0 of the line_map of each of some maps, in order; of: the map (from 0) of each line. room: zeros for all maps, which are left as zeros."""
    line, y, x, value = smooth_lines(*ends)
    np.maximum.at(room, (of[line] * size + y) * size + x, value)
    at = np.flatnonzero(room != 0)  # places of truth values are found much faster
    value = room[at]
    room[at] = 0
    row = at // size
    map_ = row // size
    return map_, row - map_ * size, at - row * size, value


_HALVES: dict[int, np.ndarray] = {}


def halved(full: np.ndarray) -> np.ndarray:
    """A square map at half its size by cubic splines through its cells, mirrored at the edges; first and last cells stay first and last."""
    n = len(full)
    if n not in _HALVES:
        mirror = lambda i: np.abs((n - 1) - np.abs((n - 1) - np.abs(i)))
        through = np.zeros((n, n))
        for step, weight in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            np.add.at(through, (np.arange(n), mirror(np.arange(n) + step)), weight)
        m = n // 2
        at = np.arange(m) * (n - 1) / max(m - 1, 1)
        whole = np.minimum(np.floor(at).astype(int), n - 1)
        t = at - whole
        basis = np.zeros((m, n))
        for step, weight in ((-1, (1 - t) ** 3 / 6), (0, (4 - 6 * t**2 + 3 * t**3) / 6), (1, (1 + 3 * t + 3 * t**2 - 3 * t**3) / 6), (2, t**3 / 6)):
            np.add.at(basis, (np.arange(m), mirror(whole + step)), weight)
        # each row depends on its two neighbours only: elimination downwards, then upwards
        inverse = np.eye(n)
        for i in range(1, n):
            share = through[i, i - 1] / through[i - 1, i - 1]
            through[i] -= share * through[i - 1]
            inverse[i] -= share * inverse[i - 1]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                inverse[i] -= through[i, i + 1] * inverse[i + 1]
            inverse[i] /= through[i, i]
        _HALVES[n] = basis @ inverse
    return _HALVES[n] @ full @ _HALVES[n].T
