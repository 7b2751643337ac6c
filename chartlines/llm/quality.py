"""Quality by positive-unlabelled learning: trusted positives against unlabelled web text, with a non-negative risk.

Every text is described by counts of kinds of bytes, words and lines, and by its
distinct words, hashed to buckets. The model is additive in bins of the numbers and
linear in the words, which together have length one. It minimises the non-negative
unbiased risk prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
so rows known to be bad are never needed. The class prior is estimated from the same
two samples by the smallest ratio of upper tails of a classifier, on the numbers
alone, that tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlines.llm.batches import joined, slices, word_hashes
from chartlines.llm.common import fitting, keep, learn_row

#: Trusted positives, and unlabelled rows, brought to the driver at most, as numbers and buckets; buckets of all of them together.
SAMPLE_ROWS, SAMPLE_TERMS = 6_000, 2_500_000
WORD_BITS = 13
BINS, STEPS = 12, 200
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,", "mark": b"!", "pipe": b"|", "sign": b"#$%&*@", "other": b"\"'()+-/:;<=>?[\\]^_`{}~", "line": b"\n", "space": b" \t"}
FEATURES = (*_KINDS, "high", "word_bytes", "distinct", "stutter", "line_words", "words")


def describe(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; all 0 for null and empty ones."""
    raw, starts = joined(column)
    n = len(starts) - 1
    size = np.diff(starts)
    out = np.zeros((n, len(FEATURES)), np.float32)
    if not len(raw):
        return out
    kind = np.full(256, len(_KINDS), np.uint8)
    for i, members in enumerate(_KINDS.values()):
        kind[list(members)] = i
    codes = kind[raw]
    full = size > 0
    heads = starts[:-1][full]
    for i in range(len(_KINDS) + 1):
        out[full, i] = np.add.reduceat((codes == i).astype(np.int32), heads) / size[full]
    hashes, first = word_hashes(column)
    words = np.diff(first)
    some = np.maximum(words, 1)
    lines = out[:, FEATURES.index("line")] * size
    out[:, -5] = np.where(words > 0, size / some, 0)
    text_of = np.repeat(np.arange(n), words)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    order = np.lexsort((hashes, text_of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    out[:, -4] = np.bincount(text_of[order], fresh, n) / some
    out[:, -3] = np.bincount(text_of, same, n) / some
    out[:, -2] = words / (lines + 1)
    out[:, -1] = np.log1p(words)
    return out


def word_buckets(column: pa.Array, bits: int = WORD_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text's words, and the text of each, in order of text."""
    hashes, first = word_hashes(column)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys = np.unique((text_of << bits) | (hashes >> np.uint64(64 - bits)).astype(np.int64))
    return keys & ((1 << bits) - 1), keys >> bits


@dataclass
class Texts:
    """Numbers of n texts and their distinct word buckets, in order of text."""

    x: np.ndarray
    bucket: np.ndarray
    text_of: np.ndarray

    def __post_init__(self) -> None:
        self.value = 1 / np.sqrt(np.maximum(np.bincount(self.text_of, minlength=len(self.x)), 1))[self.text_of]

    def words(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.text_of, weights[self.bucket] * self.value, len(self.x))

    def back(self, slope: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.bucket, slope[self.text_of] * self.value, size)


@dataclass
class BinnedModel:
    edges: np.ndarray
    weights: np.ndarray
    words: np.ndarray
    bias: float
    prior: float

    def places(self, x: np.ndarray) -> np.ndarray:
        """For each row and feature the place of its bin among all weights."""
        return np.stack([np.searchsorted(e, x[:, j]) + j * (self.edges.shape[1] + 1) for j, e in enumerate(self.edges)], 1)

    def raw(self, texts: Texts) -> np.ndarray:
        return self.bias + self.weights[self.places(texts.x)].sum(1) + texts.words(self.words)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _adam(grad, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray, least: float = 0.1) -> float:
    """Share of positives among the unlabelled: smallest ratio of upper tails of a score, where `least` of the positives lie above."""
    cuts = np.quantile(pos, np.linspace(0.02, 1 - least, 60)) if len(pos) else np.zeros(0)
    above = lambda s: np.array([(s >= c).mean() for c in cuts])
    ratios = above(unl) / np.maximum(above(pos), least)
    return float(np.clip(ratios.min() if len(ratios) else 0.5, 0.05, 0.98))


class Risk:
    """Risks of positives and unlabelled texts, and their slopes, in one vector of weights: bins, words (unless left out), bias."""

    def __init__(self, model: BinnedModel, pos: Texts, unl: Texts, words: bool):
        self.pos, self.unl, self.at_p, self.at_u = pos, unl, model.places(pos.x), model.places(unl.x)
        self.n_bins, self.n_words = len(model.weights), len(model.words) if words else 0
        self.size = self.n_bins + self.n_words + 1

    def margin(self, w: np.ndarray, positive: bool) -> np.ndarray:
        texts, at = (self.pos, self.at_p) if positive else (self.unl, self.at_u)
        return w[-1] + w[at].sum(1) + (texts.words(w[self.n_bins : -1]) if self.n_words else 0.0)

    def spread(self, slope: np.ndarray, positive: bool) -> np.ndarray:
        texts, at = (self.pos, self.at_p) if positive else (self.unl, self.at_u)
        bins = np.bincount(at.ravel(), np.repeat(slope, at.shape[1]), self.n_bins)
        return np.concatenate([bins, texts.back(slope, self.n_words) if self.n_words else np.zeros(0), [slope.sum()]])

    def told_apart(self, w: np.ndarray) -> np.ndarray:
        """Slopes of the plain risk of taking positives for unlabelled and the reverse."""
        n_p, n_u = len(self.pos.x), len(self.unl.x)
        return self.spread((_logistic(self.margin(w, True)) - 1) / n_p, True) + self.spread(_logistic(self.margin(w, False)) / n_u, False)

    def value(self, w: np.ndarray, prior: float) -> tuple[float, float]:
        """Risk on the positive side, and the part on the negative side, which must not be negative."""
        fp, fu = self.margin(w, True), self.margin(w, False)
        return prior * float(np.logaddexp(0, -fp).mean()), float(np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean())

    def slopes(self, w: np.ndarray, prior: float) -> np.ndarray:
        """Slopes of the non-negative risk: where the negative part is below 0, only that is pushed up again."""
        fp, fu = self.margin(w, True), self.margin(w, False)
        n_p, n_u = len(fp), len(fu)
        down = self.spread(_logistic(fu) / n_u, False) - prior * self.spread(_logistic(fp) / n_p, True)
        if np.logaddexp(0, fu).mean() < prior * np.logaddexp(0, fp).mean():
            return -down
        return prior * self.spread((_logistic(fp) - 1) / n_p, True) + down


def fit(pos: Texts, unl: Texts, bins: int = BINS, steps: int = STEPS, l2: float = 1e-3, bits: int = WORD_BITS) -> BinnedModel:
    both = np.concatenate([pos.x, unl.x])
    edges = np.stack([np.quantile(both[:, j], np.linspace(0, 1, bins + 1)[1:-1]) for j in range(both.shape[1])]) if len(both) else np.zeros((len(FEATURES), bins - 1))
    model = BinnedModel(edges, np.zeros(edges.shape[0] * bins), np.zeros(1 << bits), 0.0, 0.5)
    if not len(pos.x) or not len(unl.x):
        return model
    plain = Risk(model, pos, unl, words=False)
    told = _adam(lambda w: plain.told_apart(w) + l2 * w, plain.size, steps // 2)
    model.prior = estimate_prior(plain.margin(told, True), plain.margin(told, False))
    risk = Risk(model, pos, unl, words=True)
    w = _adam(lambda w: risk.slopes(w, model.prior) + l2 * w, risk.size, steps)
    return BinnedModel(edges, w[: risk.n_bins], w[risk.n_bins : -1], float(w[-1]), model.prior)


def _described(rows: DataFrame) -> DataFrame:
    """kind, draw, n, x, buckets (n of them) of rows with kind, draw and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.column(2).slice(a, b - a)
                x = describe(part)
                numbers = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                bucket, text_of = word_buckets(part)
                starts = np.searchsorted(text_of, np.arange(b - a + 1)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(starts), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(starts)), numbers, words], ["kind", "draw", "n", "x", "buckets"])

    return rows.select("kind", "draw", "text").mapInArrow(run, "kind int, draw long, n int, x array<float>, buckets array<int>")


def _texts(table: pa.Table) -> Texts:
    words = table["buckets"].combine_chunks()
    x = np.asarray(table["x"].combine_chunks().flatten().to_numpy(), np.float32).reshape(len(table), len(FEATURES))
    return Texts(x, words.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(table)), np.diff(words.offsets.to_numpy())))


def train(documents: DataFrame, labels: DataFrame, learn_from=learn_row, sample_rows: int = SAMPLE_ROWS, sample_terms: int = SAMPLE_TERMS) -> BinnedModel:
    """Model from rows of labels with quality 1 (trusted) and from documents without regard to labels (unlabelled).

    Both samples hold sample_rows ids at most, drawn by a hash of doc_id among those
    that learn_from allows, before any text is looked at. In order of hash, those rows
    come to the driver whose buckets together stay within sample_terms; one that doesn't
    fit is left out and the next one tried. Of texts with
    one doc_id the smallest is taken. Rows with quality 0 are used only as far as they
    are web text like any other. Null texts and labels teach nothing; without trusted
    or unlabelled rows every score is 0.5.
    """
    allowed = documents.where(learn_from(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", "text")
    trusted = labels.where((F.col("quality") == 1) & learn_from(F.col("doc_id"))).select("doc_id").distinct()

    def drawn(ids: DataFrame, salt: int) -> DataFrame:
        n = ids.count()
        draw = F.xxhash64("doc_id", F.lit(salt))
        share = min(1.0, 0.95 * sample_rows / max(n, 1))
        some = ids.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 20)) < int(share * (1 << 20))).distinct()
        return some.orderBy("draw", "doc_id").limit(sample_rows).withColumn("kind", F.lit(salt))

    wanted = keep(drawn(trusted, 1).unionByName(drawn(allowed.select("doc_id"), 2)), "drawn")
    # 2 * sample_rows ids at most
    rows = allowed.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "kind", "draw").agg(F.min("text").alias("text"))
    found = keep(_described(rows), "described")
    sizes = found.select("draw", "n").toArrow().sort_by("draw")
    chosen = sizes.filter(pa.array(fitting(sizes["n"].to_numpy(), sample_terms), pa.bool_())).select(["draw"])
    table = found.join(F.broadcast(documents.sparkSession.createDataFrame(chosen)), "draw", "left_semi").toArrow().sort_by([("kind", "ascending"), ("draw", "ascending")])
    kind = table["kind"].to_numpy()
    return fit(_texts(table.filter(pa.array(kind == 1))), _texts(table.filter(pa.array(kind == 2))))


def score(documents: DataFrame, model: BinnedModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted for each row, over its whole text.

    Null and empty texts are scored by their numbers, which are all 0; only the text
    matters; equal texts get equal scores; an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.column(1).slice(a, b - a)
                scores = _logistic(sent.value.raw(Texts(describe(part), *word_buckets(part))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores)], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
