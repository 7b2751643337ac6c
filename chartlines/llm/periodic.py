"""Periodic runs of words: suffix trees of a stretch and of its reversal, constant-time LCE, Lyndon roots extended both ways.

Every maximal repetition of period q has a Lyndon word of length q in it, for the
order of words or for the reversed order, which is the longest Lyndon word that
starts where it does. It ends before the next smaller suffix. So each position
gives two candidates, and each is extended as far as the period holds: to the right
by the longest common extension (LCE) of two suffixes, to the left by that of two
reversed prefixes. An LCE is the depth of the lowest common ancestor of two leaves of
a suffix tree (Ukkonen), the least depth between them on the tree's Euler tour, which
tables of minima tell in constant time.

A run of length max(min_words, exponent * q) repeats GRAM words or more after q
words. What no repeated gram of the document covers lies in no run, so trees are
built for covered stretches only; most documents have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlines.llm.batches import mix, powers, seed, slices, word_hashes

MIN_WORDS, EXPONENT = 24, 3
SMALL = 16  # block of the tables of minima

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def suffix_tree(word: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's suffix tree of numbers of which the last is 0 and stands nowhere else: starts and ends of the edges into each node, and child by node * len(word) + first number."""
    n = len(word)
    start, end, link = [0], [0], [0]
    child: dict[int, int] = {}
    node = edge = length = remain = 0
    for i, c in enumerate(word):
        remain += 1
        fresh = 0
        while remain:
            if not length:
                edge = i
            key = node * n + word[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if fresh:
                    link[fresh], fresh = node, 0
            else:
                s = start[below]
                size = end[below] - s
                if length >= size:
                    node, edge, length = below, edge + size, length - size
                    continue
                after = word[s + length]
                if after == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                split = len(start)
                start += (s, i)
                end += (s + length, n)
                link += (0, 0)
                child[key] = split
                child[split * n + c] = split + 1
                start[below] = s + length
                child[split * n + after] = below
                if fresh:
                    link[fresh] = split
                fresh = split
            remain -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - remain + 1
    return start, end, child


class Minima:
    """Least value of any range in constant time: windows of powers of two up to SMALL, and of powers of two of blocks beyond."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // SMALL) * SMALL
        padded = np.full(n, np.iinfo(np.int32).max, np.int32)
        padded[: len(values)] = values
        self.near = self._windows(padded, SMALL.bit_length())
        blocks = padded.reshape(-1, SMALL)
        self.head = np.minimum.accumulate(blocks, 1).ravel()
        self.tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = blocks.min(1)
        self.far = self._windows(least, max(len(least), 1).bit_length())

    @staticmethod
    def _windows(values: np.ndarray, levels: int) -> list[np.ndarray]:
        out = [values]
        for k in range(levels - 1):
            step, last = 1 << k, out[-1]
            out.append(np.minimum(last, np.concatenate([last[step:], last[-1:].repeat(min(step, len(last)))])[: len(last)]))
        return out

    @staticmethod
    def _ask(windows: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least value from a to b, both included, of ranges that are not empty."""
        level = np.frexp(b - a + 1)[1] - 1
        out = np.empty(len(a), np.int32)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(windows[k][a[of]], windows[k][b[of] - (1 << int(k)) + 1])
        return out

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.minimum(a, b), np.maximum(a, b)
        p, q = a // SMALL, b // SMALL
        out = np.minimum(self.tail[a], self.head[b])
        same, between = p == q, q > p + 1
        if same.any():
            out[same] = self._ask(self.near, a[same], b[same])
        if between.any():
            out[between] = np.minimum(out[between], self._ask(self.far, p[between] + 1, q[between] - 1))
        return out


class Extensions:
    """Longest common extensions of the suffixes of a sequence, and the ranks of its suffixes."""

    def __init__(self, word: list[int], ranked: bool):
        self.n = len(word)
        start, end, child = suffix_tree(word)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        parents, self.children = (keys // self.n)[order], nodes[order].tolist()
        self.first = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        self.size = (np.array(end) - np.array(start)).tolist()
        tour, place = self._tour()
        self.minima, self.place = Minima(tour), place
        self.ranks = [np.argsort(np.argsort(place)), self._reversed_ranks()] if ranked else []

    def _tour(self) -> tuple[np.ndarray, np.ndarray]:
        """Depths along the Euler tour, children by their first word, and where each suffix's leaf stands in it."""
        first, children, size, n = self.first, self.children, self.size, self.n
        depth, tour, place, stack = [0] * len(size), [], [0] * n, [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            d, a, b = depth[v], first[v], first[v + 1]
            if a == b:
                place[n - d] = len(tour)
            tour.append(d)
            for c in reversed(children[a:b]):
                stack += (~v, c)
                depth[c] = d + size[c]
        return np.array(tour, np.int32), np.array(place, np.int64)

    def _reversed_ranks(self) -> np.ndarray:
        """Ranks of the suffixes if larger words come first; the end still comes before all."""
        first, children, size, n = self.first, self.children, self.size, self.n
        rank, stack, seen = [0] * n, [(0, 0)], 0
        while stack:
            v, d = stack.pop()
            a, b = first[v], first[v + 1]
            if a == b:
                rank[n - d] = seen
                seen += 1
                continue
            below = children[a:b]
            if size[below[0]] == 1 and first[below[0]] == first[below[0] + 1]:
                below = [*below[1:], below[0]]  # the leaf that the end alone leads to
            stack += [(c, d + size[c]) for c in below]
        return np.array(rank)

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common length of suffixes i and j, which differ."""
        return self.minima.least(self.place[i], self.place[j])


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each suffix but the last, which is the smallest, the next one that is smaller."""
    n = len(rank)
    out, stack = [0] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1] if stack else n
        stack.append(i)
    return np.array(out[:-1], np.int64)


def runs_of(ids: list[int], min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """start, length, period of the maximal runs of a sequence of positive numbers, none above its length; sorted."""
    n = len(ids)
    ahead, back = Extensions([*ids, 0], ranked=True), Extensions([*reversed(ids), 0], ranked=False)
    found = []
    i = np.arange(n)
    for rank in ahead.ranks:
        j = _next_smaller(rank.tolist())
        right = ahead.lce(i, j)
        # words before i and j: suffixes n - i and n - j of the reversal
        left = np.where(i > 0, back.lce(n - i, n - j), 0)
        q, length = j - i, left + (j - i) + right
        good = length >= np.maximum(min_words, exponent * q)
        found.append(np.stack([i - left, length, q], 1)[good])
    return np.unique(np.concatenate(found), axis=0).astype(np.int64)


def _ordered(runs: np.ndarray) -> np.ndarray:
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def gram_words(min_words: int, exponent: int) -> int:
    """Words that any run repeats after its period at the least: min over q of max(min_words, exponent * q) - q."""
    return min(max(min_words, exponent * q) - q for q in range(1, min_words + 1))


def _stretches(hashes: np.ndarray, starts: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (places in hashes) of what repeated grams of a text cover, if it is `least` long."""
    n = len(hashes)
    nothing = np.zeros(0, np.int64)
    if n < least:
        return nothing, nothing
    power, inverse = powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n])])
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(np.arange(n) + gram <= starts[1:][text_of])
    keys = mix((sums[at + gram] - sums[at]) * inverse[at]) ^ mix((text_of[at] + 1).astype(np.uint64) * seed(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return nothing, nothing
    again = np.zeros(n + 1, np.int64)
    hit = at[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
    again[hit] += 1
    np.subtract.at(again, hit + gram, 1)
    covered = np.cumsum(again)[:n] > 0
    head = np.zeros(n, bool)
    head[starts[:-1][starts[:-1] < n]] = True
    begin = covered.copy()
    begin[1:] &= ~covered[:-1] | head[1:]
    stop = covered.copy()
    stop[:-1] &= ~covered[1:] | head[1:]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return a[b - a >= least], b[b - a >= least]


def find_runs(documents: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs, collapsed of each row of documents.

    Words are those of [^\\x20\\x09-\\x0D]+ of the whole text. A run is a stretch of
    consecutive words of smallest period q and of max(min_words, exponent * q) words
    or more that no neighbouring word extends; exponent is 2 or more. runs has
    start (word number from 0), length and period of each, by start and then period;
    collapsed is the text without the words that a run repeats after its first q
    ones, the rest joined by one space. Null, empty and blank texts have no words, no
    runs and an empty collapsed text. Rows are worked on one by one: repeated rows and
    null ids give rows of their own, other columns are left out, no rows give none.
    A task holds the two trees of one stretch, some 500 bytes for each of its words.
    """
    gram = gram_words(min_words, exponent)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def one(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[list, bytes]:
        found = []
        for a, b in spans:
            number: dict[bytes, int] = {}
            runs = runs_of([number.setdefault(w, len(number) + 1) for w in words[a:b]], min_words, exponent)
            runs[:, 0] += a
            found.append(runs)
        if not found or not sum(map(len, found)):
            return [], b" ".join(words)
        runs = _ordered(np.concatenate(found))
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.subtract.at(gone, runs[:, 0] + runs[:, 1], 1)
        stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
        return runs.tolist(), b" ".join([words[i] for i in stay])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                hashes, starts = word_hashes(texts, lower=False)
                begins, ends = _stretches(hashes, starts, gram, min_words)
                of = np.searchsorted(starts, begins, "right") - 1
                spans: dict[int, list[tuple[int, int]]] = {}
                for t, x, y in zip(of.tolist(), (begins - starts[of]).tolist(), (ends - starts[of]).tolist()):
                    spans.setdefault(t, []).append((x, y))
                done = [one((text or "").encode().split(), spans.get(t, [])) for t, text in enumerate(texts.to_pylist())]
                lists = pa.array([[{"start": s, "length": m, "period": q} for s, m, q in runs] for runs, _ in done], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                collapsed = pa.array([c for _, c in done], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(starts)), lists, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
