"""Toxicity by a factorization machine over hashed terms.

A term is a word (letters and digits, A-Z lowered) or its first four or five
bytes, hashed to a bucket; a text has a term or not. The score is a sum of linear
weights plus all pairwise products of the terms' factors, so that two terms together
can weigh more (or less) than both alone. No term is left out beforehand: in rounds,
terms whose weight, or pairs whose factors, would lower the loss by more than chance
does get weights and factors, and the machine is fitted anew. Pairs are looked for
among all terms at once, whatever each does alone, as the leading directions of the
residuals' second moments between terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlines.llm.batches import joined, mix, prefix_hashes, seed, slices
from chartlines.llm.common import fitting, keep, learn_row

BUCKET_BITS = 22
#: Factors of a term; labelled rows of either label, and terms of all of them together, that the machine is fitted on at most.
FACTORS, SAMPLE_ROWS, SAMPLE_TERMS = 4, 6_000, 3_000_000
STEPS, ROUNDS = 120, 3
#: Deviations beyond chance at which a term gets a weight; directions of pairs must lie so far above those of shuffled residuals.
DEVIATIONS, ABOVE_NOISE = 3.0, 1.1
#: Terms of fewer texts are in no pair; a pair's direction is led by the terms that hold this much of it.
PAIR_TEXTS, LEAD = 8, 0.1
PREFIXES = (4, 5)


def _separators() -> np.ndarray:
    out = np.zeros(256, bool)
    out[:128] = True
    out[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return out


def term_buckets(column: pa.Array, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the terms of each text, with repetitions, and the text of each."""
    hashes, text_of = prefix_hashes(*joined(column), _separators(), PREFIXES)
    out = [(mix(h + seed(j + 1)) >> np.uint64(64 - bits)).astype(np.int64) for j, h in enumerate(hashes)]
    return np.concatenate(out), np.tile(text_of, len(out))


def _distinct(buckets: np.ndarray, text_of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((text_of << bits) | buckets)
    return keys & ((1 << bits) - 1), keys >> bits


def _sums(values: np.ndarray, at: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of values[at] (numbers, or rows of them, a column at a time to spare memory) for each of n groups."""
    if values.ndim == 1:
        return np.bincount(group, values[at], n)
    return np.stack([np.bincount(group, values[at, j], n) for j in range(values.shape[1])], 1)


@dataclass
class FactorizationMachine:
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def slots(self, bits: int = BUCKET_BITS) -> np.ndarray:
        """Place of each bucket among those with weights; -1 for the others."""
        out = np.full(1 << bits, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def raw(self, term: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic of n texts with distinct terms (places among buckets)."""
        sums = _sums(self.factors, term, text_of, n)
        return self.bias + _sums(self.weights - 0.5 * (self.factors**2).sum(1), term, text_of, n) + 0.5 * (sums**2).sum(1)

    def slopes(self, term: np.ndarray, text_of: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Slopes of the mean logistic loss in weights, factors and bias."""
        n, k = len(labels), len(self.weights)
        sums = _sums(self.factors, term, text_of, n)
        slope = (_logistic(self.raw(term, text_of, n)) - labels) / n
        alone = np.bincount(term, slope[text_of], k)
        return alone, _sums(slope[:, None] * sums, text_of, term, k) - alone[:, None] * self.factors, float(slope.sum())


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class PairMoments:
    """Second moments of residuals between centred and scaled terms, diagonal left out, as products with vectors; texts of many terms weigh less."""

    def __init__(self, term: np.ndarray, text_of: np.ndarray, n: int, k: int, shrink: float = 20.0):
        counts = np.bincount(term, minlength=k)
        self.ids = np.flatnonzero(counts >= PAIR_TEXTS)
        place = np.full(k, -1)
        place[self.ids] = np.arange(len(self.ids))
        hit = place[term] >= 0
        self.term, self.text_of, self.n, self.share = place[term[hit]], text_of[hit], n, counts[self.ids] / n
        self.scale = 1 / np.sqrt(self.share * (1 - self.share) + shrink / n)
        square = self.scale**2
        length = (square * self.share**2).sum() + np.bincount(self.text_of, (square * (1 - 2 * self.share))[self.term], n)
        self.weight = 1 / np.maximum(1, length / max(np.median(length), 1e-12))

    def times(self, residual: np.ndarray, q: np.ndarray) -> np.ndarray:
        r = residual * self.weight
        diagonal = (np.bincount(self.term, r[self.text_of], len(self.ids)) * (1 - 2 * self.share) + self.share**2 * r.sum()) * self.scale**2
        scaled = q * self.scale[:, None]
        along = r[:, None] * (_sums(scaled, self.term, self.text_of, self.n) - self.share @ scaled)
        back = _sums(along, self.text_of, self.term, len(self.ids)) - self.share[:, None] * along.sum(0)
        return (back * self.scale[:, None] - diagonal[:, None] * q) / self.n

    def leading(self, residual: np.ndarray, rng, most: int, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The `most` largest values and their directions."""
        q = np.linalg.qr(rng.normal(size=(len(self.ids), min(most + 2, len(self.ids)))))[0]
        for _ in range(turns):
            q = np.linalg.qr(self.times(residual, q))[0]
        small = q.T @ self.times(residual, q)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        return values[::-1][:most], (q @ turn)[:, ::-1][:, :most]


def descend(model: FactorizationMachine, term: np.ndarray, text_of: np.ndarray, labels: np.ndarray, steps: int = STEPS, l2: float = 2e-4) -> FactorizationMachine:
    """The machine after full-batch Adam on logistic loss with l2."""
    params = [model.weights.copy(), model.factors.copy(), np.array([model.bias])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        slopes = FactorizationMachine(model.buckets, params[0], params[1], params[2][0]).slopes(term, text_of, labels)
        for p, g, (m, v), rate, shrink in zip(params, slopes, moments, (0.1, 0.02, 0.1), (l2, l2, 0.0), strict=True):
            g = g + shrink * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return FactorizationMachine(model.buckets, params[0], params[1], float(params[2][0]))


def fit_machine(bucket: np.ndarray, text_of: np.ndarray, labels: np.ndarray, factors: int = FACTORS, rounds: int = ROUNDS) -> FactorizationMachine:
    """Machine for the buckets of each text (distinct in a text, in order of text)."""
    rng, n = np.random.default_rng(5), len(labels)
    seen = np.flatnonzero(np.bincount(bucket, minlength=1))
    place = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int64)
    place[seen] = np.arange(len(seen))
    term = place[bucket]
    base = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    model = FactorizationMachine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)), float(np.log(base / (1 - base))))
    if not len(seen) or base in (1e-4, 1 - 1e-4):
        return model
    k = len(seen)
    scale = 1 / np.sqrt((np.bincount(term, minlength=k) + 4) / n)
    limit = DEVIATIONS * np.sqrt(base * (1 - base) / n)
    pairs, raw = PairMoments(term, text_of, n, k), np.full(n, model.bias)
    weights, vectors, active = np.zeros(k), np.zeros((k, factors)), np.zeros(k, bool)
    chance = None
    for _ in range(rounds):
        residual = labels - _logistic(raw)
        fresh = np.abs(np.bincount(term, residual[text_of], k) * scale / n) > limit
        if len(pairs.ids) > 2 * factors:
            values, directions = pairs.leading(residual, rng, factors)
            size = float(np.sqrt((residual**2).mean()))
            if chance is None:  # what shuffled residuals give grows with their size
                chance = max(pairs.leading(rng.permutation(residual), rng, 1)[0][0] for _ in range(2)) / size
            lead = np.where((values > ABOVE_NOISE * chance * size) & (np.abs(directions) >= LEAD), directions, 0) * np.sqrt(np.maximum(values, 0))
            new = ~active[pairs.ids] & (lead != 0).any(1)
            vectors[pairs.ids[new]] = lead[new]
            fresh[pairs.ids[new]] = True
        if not (fresh & ~active).any():
            break
        active |= fresh
        place = np.cumsum(active) - 1
        hit = active[term]
        start = FactorizationMachine(seen[active], weights[active], vectors[active] + rng.normal(0, 0.01, (int(active.sum()), factors)), model.bias)
        model = descend(start, place[term[hit]], text_of[hit], labels)
        weights[active], vectors[active] = model.weights, model.factors
        raw = model.raw(place[term[hit]], text_of[hit], n)
    return model


def _terms_of(labelled: DataFrame) -> DataFrame:
    """label, draw, n, terms (distinct buckets, n of them) of rows with text, label and draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                found, text_of = _distinct(*term_buckets(batch.column(0).slice(a, b - a)), BUCKET_BITS)
                starts = np.searchsorted(text_of, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(starts)), lists], ["label", "draw", "n", "terms"])

    return labelled.select("text", "label", "draw").mapInArrow(run, "label int, draw long, n int, terms array<int>")


def train(documents: DataFrame, labels: DataFrame, learn_from=learn_row, sample_rows: int = SAMPLE_ROWS, sample_terms: int = SAMPLE_TERMS) -> FactorizationMachine:
    """Machine fitted on labels (doc_id, toxic) of the documents learn_from allows.

    Ids are drawn by hash before any text is looked at: sample_rows of either label at
    most, the rarer label so far more often; the bias is set right for that. Of them,
    in order of hash, those come to the driver, as whole sets of buckets, whose terms
    together stay within sample_terms; a text that doesn't fit is left out and the next one tried. Null labels and null texts teach nothing; of
    texts with one doc_id the smallest is taken; without rows of both labels every
    text gets the share of label 1, or 0.5 without labelled rows.
    """
    known = keep(labels.where(F.col("toxic").isNotNull() & learn_from(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).withColumn("draw", F.xxhash64("doc_id")), "labels")
    total = {int(r["label"] > 0): r["n"] for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where((F.col("label") > 0) == bool(g)).where(F.pmod("draw", F.lit(1 << 20)) < int(min(1.0, 0.95 * sample_rows / n) * (1 << 20))).orderBy("draw", "doc_id").limit(sample_rows) for g, n in sorted(total.items())]
    if not parts:
        return FactorizationMachine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), 0.0)
    ids = keep(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "drawn")
    # 2 * sample_rows ids at most
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text"))
    found = keep(_terms_of(rows), "terms")
    sizes = found.select("draw", "n").toArrow().sort_by("draw")
    chosen = sizes.filter(pa.array(fitting(sizes["n"].to_numpy(), sample_terms), pa.bool_())).select(["draw"])
    # 2 * sample_rows draws at most
    sample = found.join(F.broadcast(documents.sparkSession.createDataFrame(chosen)), "draw", "left_semi").select("label", "draw", "terms").toArrow().sort_by("draw")
    terms = sample["terms"].combine_chunks()
    bucket, lengths = terms.flatten().to_numpy().astype(np.int64), np.diff(terms.offsets.to_numpy())
    marks = (sample["label"].to_numpy() > 0).astype(float)
    model = fit_machine(bucket, np.repeat(np.arange(len(marks)), lengths), marks)
    if 0 < marks.sum() < len(marks):
        model.bias += float(np.log(total[1] / total[0]) - np.log(marks.sum() / (len(marks) - marks.sum())))
    return model


def score(documents: DataFrame, model: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted for each row, over its whole text.

    Null and empty texts, and texts without a known term, get the score of no terms.
    Only the text matters; equal texts get equal scores; an empty table gives no rows.
    """
    slots = model.slots()
    share = documents.sparkSession.sparkContext.broadcast((model, np.flatnonzero(slots >= 0), slots[slots >= 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, at, place = share.value
        slot = np.full(1 << BUCKET_BITS, -1, np.int32)
        slot[at] = place
        for batch in batches:
            for a, b in slices(batch.column(1)):
                buckets, text_of = term_buckets(batch.column(1).slice(a, b - a))
                found = slot[buckets]
                term, row_of = _distinct(found[found >= 0].astype(np.int64), text_of[found >= 0], BUCKET_BITS)
                raw = machine.raw(term, row_of, b - a) if len(at) else np.full(b - a, machine.bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_logistic(raw))], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
