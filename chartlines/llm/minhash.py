"""Near-duplicates by fast similarity sketching, banding and exact verification.

The sketch of a set has SKETCH coordinates. In rounds, every shingle is hashed to
one coordinate and to a value; a coordinate keeps the smallest value of the first
round that reached it. After as many rounds as coordinates, round SKETCH + b
sends all shingles to coordinate b, so every coordinate is filled for certain.
Two sets agree in a coordinate with probability of their Jaccard similarity.

Documents with equal shingle sets are one class. Classes that agree in a whole
band of coordinates share a bucket. Twice, each bucket that still holds several
components gets a pivot, and members outside the pivot's component are compared
with it; the second time the pivot is the member with the fewest shingles of its
own, such as the text that the others were copied from. What no pivot has settled
is compared in pairs, but only across components and where the shingles that two
sets can share at all suffice. Every comparison is on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlines.llm.batches import mix, seed, shingle_hashes, slices, word_hashes
from chartlines.llm.common import keep, row_key
from chartlines.llm.components import connected_components

SHINGLE_WORDS = 5
MIN_SIMILARITY = 80  # per cent
#: 32 bands of 4 coordinates: a pair of similarity 0.8 shares no bucket with probability 5e-8.
SKETCH, BAND_ROWS = 128, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def distinct_shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and each text's first (one more entry for the end)."""
    values, text_of = shingle_hashes(*word_hashes(column), k)
    bounds = np.searchsorted(text_of, np.arange(len(column) + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(bounds, bounds[1:])]
    return (np.concatenate(parts) if parts else values), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def sketches(values: np.ndarray, starts: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Fast similarity sketches, one row of uint32 for each set; size is a power of two. Empty sets get all ones."""
    n = len(starts) - 1
    flat = np.full(n * size, _EMPTY)
    shift = np.uint64(64 - (size - 1).bit_length())
    set_of = np.repeat(np.arange(n), np.diff(starts))
    open_sets = np.flatnonzero(np.diff(starts) > 0)
    active, at = values, set_of
    for turn in range(2 * size):
        if not len(open_sets):
            break
        h = mix(active + seed(turn + 1))
        place = at * size + ((h >> shift).astype(np.int64) if turn < size else turn - size)
        fresh = flat[place] == _EMPTY
        np.minimum.at(flat, place[fresh], h[fresh] & np.uint64((1 << 56) - 1))
        still = (flat.reshape(n, size)[open_sets] == _EMPTY).any(axis=1)
        if not still.all():
            open_sets = open_sets[still]
            chosen = np.zeros(n, bool)
            chosen[open_sets] = True
            mask = chosen[at]
            active, at = active[mask], at[mask]
    return (mix(flat) >> np.uint64(32)).astype(np.uint32).reshape(n, size)


def _set_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 128-bit key for each set: two sums of mixed hashes and the size."""
    counts = np.diff(starts)
    out = np.zeros((len(counts), 2), np.uint64)
    full = counts > 0
    if full.any():
        for j, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[full, j] = mix(np.add.reduceat(mix(values ^ np.uint64(salt)), starts[:-1][full]) + counts[full].astype(np.uint64))
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _features(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, rid, n, cls, sketch of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                values, starts = distinct_shingles(batch.column(2).slice(a, b - a), k)
                n = pa.array(np.diff(starts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), n, _fixed(_set_keys(values, starts)), _fixed(sketches(values, starts))], ["doc_id", "rid", "n", "cls", "sketch"])

    source = documents.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, rid binary, n long, cls binary, sketch binary")


def _sets(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cls, shingles (distinct hashes) of the classes in wanted (rid, cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                values, starts = distinct_shingles(batch.column(1).slice(a, b - a), k)
                sets = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], ["cls", "shingles"])

    source = documents.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), "text")
    met = source.join(wanted.hint("shuffle_hash"), "rid").select("cls", "text")
    return met.mapInArrow(run, "cls binary, shingles array<long>").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of classes whose full sets are similar enough."""
    left, right = (sets.select(F.col("cls").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    return both.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")


def _reachable(n: str, most: str, pn: str, pmost: str, percent: int) -> Column:
    """Whether two sets of n and pn shingles, of which at most `most` and `pmost` can be shared, can be similar enough."""
    both = F.least(most, pmost, n, pn)
    return F.lit(100) * both >= percent * (F.col(n) + F.col(pn) - both)


def _open_members(marked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (bucket, cls, n, comp) of the buckets that hold several components, with most: how many shingles they can share.

    Shingles that no other class in these buckets has can't be shared, so a set of n
    of which `most` can be shared is only similar to sets of a size between
    percent * n and most / percent - n + most. Members whose bucket has no such size
    are left out, and then buckets of one component: in a large group of copies of
    one text, those with too many changes of their own go without being compared
    with the rest. Sizes are kept in bins of two per cent, some hundreds at most.
    """
    size_bin = lambda x: F.floor(F.log(F.greatest(x, F.lit(1.0))) / math.log(1.02)).cast("int")

    def several(rows: DataFrame) -> DataFrame:
        split = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.collect_set(size_bin(F.col("n").cast("double"))).alias("sizes")).where(F.col("lo") < F.col("hi")).select("bucket", "sizes")
        return rows.join(keep(split, "split"), "bucket")

    still = keep(several(marked), "open")
    universe = still.select("cls").distinct()
    shingles = sets.join(universe, "cls", "left_semi").select("cls", F.explode_outer("shingles").alias("sh"))
    own = shingles.groupBy("sh").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("cls")).where(F.col("c") == 1).groupBy("cls").agg(F.count(F.lit(1)).alias("own"))
    bounded = still.join(keep(own, "own"), "cls", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    least, largest = F.col("n") * (percent / 100), F.col("most") * (100 / percent) - F.col("n") + F.col("most")
    bins = bounded.withColumn("least", size_bin(least)).withColumn("largest", size_bin(largest)).withColumn("ok", largest >= least)
    fits = F.col("ok") & F.exists("sizes", lambda b: (b >= F.col("least")) & (b <= F.col("largest")))
    hopeful = keep(bins.where(fits).drop("least", "largest", "ok", "sizes"), "hopeful")
    return keep(several(hopeful).drop("sizes"), "open")


def _ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def near_duplicates(documents: DataFrame, k: int = SHINGLE_WORDS, percent: int = MIN_SIMILARITY) -> DataFrame:
    """doc_id, rid, n_shingles, component_id, kept for each row of documents.

    Words are those of [^\\x20\\x09-\\x0D]+ with A-Z lowered; a document's set holds
    its distinct k-word shingles, or all its words as one if they are fewer. Two
    documents are linked if 100 * |both| >= percent * |either|; component_id is the
    smallest doc_id that links reach, kept tells whether it is the row's own. Null,
    empty and blank texts have no shingles and stand alone. A null doc_id counts for
    no minimum; a component of such rows only has a null component_id and all are
    kept. Rows equal in doc_id and text share rid and result. Links are found with
    the probability given at SKETCH and verified on full sets.
    """
    rows = keep(_features(documents, k), "features")
    classes = keep(rows.where(F.col("n") > 0).groupBy("cls").agg(F.min("doc_id").alias("first"), F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), "classes")
    width = 4 * BAND_ROWS
    bands = F.array(*[F.xxhash64(F.substring("sketch", width * i + 1, width), F.lit(i)) for i in range(SKETCH // BAND_ROWS)])
    band_rows = classes.select("cls", "n", F.explode(bands).alias("bucket"))
    shared = keep(band_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("bucket"), "buckets")
    members = keep(band_rows.join(shared, "bucket"), "members")
    sets = keep(_sets(documents, classes.join(members.select("cls").distinct(), "cls", "left_semi").select("rid", "cls"), k), "sets")

    links, labels, tested = None, None, None
    for turn in ("random pivots", "central pivots", "all pairs"):
        marked = members if labels is None else members.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        marked = marked.withColumn("comp", F.col("cls") if labels is None else F.coalesce("comp", "cls"))
        if turn == "random pivots":
            marked = marked.withColumn("most", F.col("n"))
        else:
            marked = _open_members(marked, sets, percent)
            if marked.isEmpty():
                break
        if turn == "all pairs":
            # compared within the join, in the first of the buckets they share: only links come out of it
            whole = marked.join(classes.select("cls", bands.alias("bands")), "cls").join(sets, "cls")
            other = whole.select("bucket", *(F.col(c).alias(f"p_{c}") for c in ("cls", "n", "comp", "most", "bands", "shingles")))
            first = F.element_at(F.array_intersect("bands", "p_bands"), 1) == F.col("bucket")
            shared = F.size(F.array_intersect("shingles", "p_shingles")).cast("long")
            similar = F.lit(100) * shared >= percent * (F.col("n") + F.col("p_n") - shared)
            linked = whole.join(other, "bucket").where((F.col("comp") < F.col("p_comp")) & _reachable("n", "most", "p_n", "p_most", percent) & first & similar)
            links = links.union(keep(linked.select(*_ordered("cls", "p_cls")), "links"))
            labels = keep(connected_components(links), "components")
            break
        rank = F.col("most") / F.col("n") * -1 if turn == "central pivots" else F.lit(0.0)
        order = F.struct(rank.alias("rank"), F.xxhash64("cls").alias("draw"), "cls", "n", "comp", "most")
        pivots = keep(marked.groupBy("bucket").agg(F.min(order).alias("p")).select("bucket", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.comp").alias("pcomp"), F.col("p.most").alias("pmost")), "pivots")
        found = marked.join(pivots, "bucket").where((F.col("comp") != F.col("pcomp")) & _reachable("n", "most", "pn", "pmost", percent))
        pairs = found.select(*_ordered("cls", "pivot")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        good = keep(_verified(pairs, sets, percent), "links")
        links = good if links is None else links.union(good)
        labels = keep(connected_components(links), "components")

    grouped = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    heads = grouped.groupBy("comp").agg(F.min("first").alias("component"), F.sum("copies").alias("rows")).where(F.col("rows") > 1).drop("rows")
    named = keep(grouped.join(heads, "comp").select("cls", F.col("component"), F.lit(True).alias("grouped")), "named")
    out = rows.select("doc_id", "rid", "n", "cls").join(named, "cls", "left")
    component = F.when(F.col("grouped"), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "rid", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(documents: DataFrame, **how) -> DataFrame:
    """The rows of documents but those that near_duplicates does not keep: the smallest doc_id of each group stays."""
    gone = near_duplicates(documents, **how).where(~F.col("kept")).select(F.col("rid").alias("_rid")).distinct()
    return documents.join(gone.hint("shuffle_hash"), row_key(documents["doc_id"], documents["text"]) == gone["_rid"], "left_anti")
