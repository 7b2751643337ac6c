"""Approximate nearest neighbours: score-aware (anisotropic) quantisation, four-bit table scans, exact reranking.

The nearest vector to q in Euclidean distance has the largest q . x - |x|^2 / 2, so
the search is one for inner products. A vector is turned by a fixed random rotation,
which spreads what it holds over all components, and cut into pairs of components,
each coded by one of 16 codewords. Without it, vectors whose variance lies in few
components would be coded badly in a way that queries share, and the error to expect
would not hold. Codes and codewords minimise an error in which
the part parallel to the vector costs more than the part across, as it is the
parallel part that moves large inner products. Codes stay where they are: queries
are sent to all tasks in bounded blocks, a block a pass. A task adds up, for each
query, a table of inner products with all codewords over its codes, and measures on
the original vectors those rows that may still be among the query's k nearest: rows
whose score, raised by DEVIATIONS times the error to expect of their code, reaches
the k-th distance measured so far. How many that are follows from the data; no number
of candidates is fixed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartlines.llm.common import keep

#: Rows the codewords are fitted on at most; every row is coded and scanned.
SAMPLE_ROWS = 8_192
CODEWORDS, PAIR, SWEEPS, ROUNDS = 16, 2, 2, 6
#: Inner products of at least this share of the norms matter: the weight of parallel error follows from it.
SCORE_SHARE = 0.2
#: Rows scored at a time, queries sent at a time, and rows of the first block that are measured to begin with.
BLOCK_ROWS, BLOCK_QUERIES, RERANK = 8_192, 4_096, 300
#: A code's error in an inner product is, for a direction that has nothing to do with it, |q| * |what the code leaves| /
#: sqrt(dims) on average; rows up to so many times that are measured. From sqrt(dims) on no row can be missed: the exact setting.
DEVIATIONS = 4.0


@dataclass
class Codebook:
    centre: np.ndarray
    words: np.ndarray  # subspace, codeword, component
    parallel: float
    turn: np.ndarray  # rotation of the components

    def pad(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.words.shape[0] * PAIR))
        out[:, : x.shape[1]] = (x - self.centre) @ self.turn
        return out.reshape(len(x), -1, PAIR)

    def encode(self, x: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic error, one subspace after another."""
        parts = self.pad(x)
        codes = np.argmin(((parts[:, :, None] - self.words[None]) ** 2).sum(3), 2) if len(x) else np.zeros((0, len(self.words)), np.int64)
        flat = parts.reshape(len(x), -1)
        unit = (flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)).reshape(parts.shape)
        for _ in range(sweeps):
            along = ((parts - self.words[np.arange(len(self.words)), codes]) * unit).sum(2)
            total = along.sum(1)
            for j in range(len(self.words)):
                rest = parts[:, j, None] - self.words[j][None]
                mine = (rest * unit[:, j, None]).sum(2)
                cost = (rest**2).sum(2) + (self.parallel - 1) * ((total - along[:, j])[:, None] + mine) ** 2
                codes[:, j] = np.argmin(cost, 1)
                fresh = mine[np.arange(len(x)), codes[:, j]]
                total += fresh - along[:, j]
                along[:, j] = fresh
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codewords that minimise the anisotropic error of the coded rows, one subspace after another."""
        parts = self.pad(x)
        flat = parts.reshape(len(x), -1)
        unit = (flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)).reshape(parts.shape)
        along = ((parts - self.words[np.arange(len(self.words)), codes]) * unit).sum(2)
        for j in range(len(self.words)):
            others = along.sum(1) - along[:, j] + (parts[:, j] * unit[:, j]).sum(1)
            for c in range(CODEWORDS):
                mine = codes[:, j] == c
                if mine.any():
                    u = unit[mine, j]
                    left = mine.sum() * np.eye(PAIR) + (self.parallel - 1) * u.T @ u
                    self.words[j, c] = np.linalg.solve(left, parts[mine, j].sum(0) + (self.parallel - 1) * u.T @ others[mine])
            along[:, j] = ((parts[:, j] - self.words[j, codes[:, j]]) * unit[:, j]).sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of two codes, the inner product with both codewords."""
        each = np.einsum("qjd,jcd->qjc", self.pad(queries), self.words)
        if each.shape[1] % 2:
            each = np.concatenate([each, np.zeros((len(each), 1, CODEWORDS))], 1)
        return (each[:, 0::2, :, None] + each[:, 1::2, None, :]).reshape(len(each), each.shape[1] // 2, CODEWORDS**2)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], 1)
    return (codes[:, 0::2] * CODEWORDS + codes[:, 1::2]).astype(np.uint8)


def fit(sample: np.ndarray, dims: int, score_share: float = SCORE_SHARE, rounds: int = ROUNDS) -> Codebook:
    rng = np.random.default_rng(3)
    subspaces = -(-dims // PAIR)
    parallel = max(1.0, (dims - 1) * score_share**2 / (1 - score_share**2))
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    book = Codebook(sample.mean(0) if len(sample) else np.zeros(dims), np.zeros((subspaces, CODEWORDS, PAIR)), parallel, turn)
    if len(sample):
        parts = book.pad(sample)
        book.words = parts[rng.choice(len(sample), CODEWORDS, replace=len(sample) < CODEWORDS)].transpose(1, 0, 2).copy()
        for turn in range(rounds):
            weight, book.parallel = book.parallel, 1.0 if turn < rounds // 2 else book.parallel
            codes = book.encode(sample, 0 if book.parallel == 1.0 else SWEEPS)
            book.refit(sample, codes)
            book.parallel = weight
    return book


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part: a vec_id, and a finite vector without nulls that isn't zero, of the table's most usual length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("v"))
    rows = rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (lengths["d"] if lengths else 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), dims)


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest scores, ties to smaller ids."""
    if len(scores) > most:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:most]]


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances summed component by component, as Spark sums them, so that ties are the same."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += (x[:, j] - q[j]) * (x[:, j] - q[j])
    return np.sqrt(total)


class Scan:
    """The k nearest rows of each of a block of queries, over the rows shown so far."""

    def __init__(self, book: Codebook, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int, deviations: float):
        self.book, self.query_ids, self.queries, self.k, self.rerank = book, query_ids, queries, k, max(rerank, k + 1)
        self.far = np.sqrt(((queries - book.centre) ** 2).sum(1))
        self.slack = min(1.0, deviations / np.sqrt(max(queries.shape[1], 1)))
        self.near = np.full((len(queries), k), np.inf)
        self.ids = np.zeros((len(queries), k), query_ids.dtype)
        self.measured = 0

    def show(self, ids: np.ndarray, x: np.ndarray, packed: np.ndarray, half: np.ndarray, lost: np.ndarray) -> None:
        columns = [np.ascontiguousarray(packed[:, j]) for j in range(packed.shape[1])]
        for begin in range(0, len(self.queries), 256):
            for i, table in enumerate(self.book.tables(self.queries[begin : begin + 256]), begin):
                scores = -half
                for j, c in enumerate(columns):
                    scores = scores + table[j][c]
                self._look(i, scores, ids, x, half, lost)

    def _look(self, i: int, scores: np.ndarray, ids: np.ndarray, x: np.ndarray, half: np.ndarray, lost: np.ndarray) -> None:
        far, own = self.far[i], ids == self.query_ids[i]
        first = np.zeros(0, np.int64)
        if not np.isfinite(self.near[i, -1]):
            first = _best(np.where(own, -np.inf, scores), ids, self.rerank)
            self._take(i, first[~own[first]], ids, x)
        slack = 1e-9 * (far**2 + half + 1)  # of rounding
        may = (scores + self.slack * far * lost + slack >= (far**2 - self.near[i, -1] ** 2) / 2) & ~own
        may[first] = False
        self._take(i, np.flatnonzero(may), ids, x)

    def _take(self, i: int, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.measured += len(at)
        near = np.concatenate([self.near[i], _distances(x[at], self.queries[i])])
        all_ids = np.concatenate([self.ids[i], ids[at]])
        best = np.lexsort((all_ids, near))[: self.k]
        self.near[i], self.ids[i] = near[best], all_ids[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = np.isfinite(self.near)
        return np.repeat(self.query_ids, full.sum(1)), self.ids[full], self.near[full]


def nearest(vectors: DataFrame, is_query, k: int = 10, sample_rows: int = SAMPLE_ROWS, rerank: int = RERANK, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, deviations: float = DEVIATIONS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest to each query among all other rows, by Euclidean distance.

    is_query is a condition on vec_id. Vectors are embedding arrays; which take part
    is told at usable(). A row is no neighbour of a query with its own vec_id; rows
    repeating a vec_id count once, with the vector that comes first. Ties go to the
    smaller vec_id. With fewer candidates than k all are returned; an empty table
    gives no rows. The distance is exact, in double precision. Every query is held
    against every code; deviations says which rows are measured (see DEVIATIONS).
    """
    base = keep(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    n, dims = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_queries = base.where(is_query).count()
    share = min(1.0, 0.95 * sample_rows / max(n, 1))
    sample = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("vec_id").limit(sample_rows).toPandas()
    book = fit(np.array(sample["v"].to_list(), float).reshape(len(sample), dims or 1), dims or 1)
    kind = base.schema["vec_id"].dataType.simpleString()
    passes = max(1, -(-n_queries // block_queries))

    def code(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            codes = book.encode(x)
            packed = pack(codes)
            lost = np.sqrt(((book.pad(x) - book.words[np.arange(len(book.words)), codes]) ** 2).sum((1, 2)))
            half = ((x - book.centre) ** 2).sum(1) / 2
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, pa.array(half), pa.array(lost)], ["vec_id", "v", "code", "half", "lost"])

    coded = keep(base.select("vec_id", "v").mapInArrow(code, f"vec_id {kind}, v array<double>, code binary, half double, lost double"), "codes")
    context = base.sparkSession.sparkContext

    def scanned(turn: int) -> DataFrame:
        # block_queries rows, but for chance: dealt by hash
        block = base.where(is_query).where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(passes)) == turn).toArrow()
        sent = context.broadcast((book, block["vec_id"].to_numpy(), _matrix(block["v"].combine_chunks(), dims or 1)))

        def scan(batches):
            scanner = Scan(sent.value[0], sent.value[1], sent.value[2], k, rerank, deviations)
            for batch in batches:
                for a in range(0, batch.num_rows, block_rows):
                    part = batch.slice(a, block_rows)
                    packed = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    scanner.show(part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), dims), packed, *(part.column(c).to_numpy() for c in (3, 4)))
            query_id, vec_id, near = scanner.found()
            yield pa.RecordBatch.from_arrays([pa.array(query_id), pa.array(vec_id), pa.array(near)], ["query_id", "vec_id", "near"])

        met = coded.mapInArrow(scan, f"query_id {kind}, vec_id {kind}, near double")
        by_near = Window.partitionBy("query_id").orderBy("near", "vec_id")
        found = keep(met.withColumn("place", F.row_number().over(by_near)).where(F.col("place") <= k).select("query_id", "vec_id"), "candidates")
        sent.destroy()  # what it was needed for is written
        return found

    chosen = reduce(DataFrame.unionByName, [scanned(turn) for turn in range(passes)])
    distance = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    measured = chosen.join(base, "vec_id").join(base.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "vec_id", distance.alias("score"))
    by_distance = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return measured.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
