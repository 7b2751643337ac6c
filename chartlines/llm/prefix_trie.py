"""Trie of conversation prefixes: a count-min sketch of prefix digests tells those that only one conversation has.

A prefix's digest is the exclusive or of hashes of its turns and their places, 128
bits, so a digest less its last turn is the parent's. All prefixes are counted in a
count-min sketch; where a prefix's estimate is one, no other conversation has it, nor
any longer one of the same conversation: that tail is a chain of nodes of one member,
made where it stands. Only prefixes that may be shared are shuffled and grouped by
digest. Sums over subtrees are sums over members: each node's worth lies with its
smallest member, which has all the prefixes above the node.

The sketch has ROWS rows of some CELLS_EACH cells a prefix, up to 2**MOST_BITS cells
a row (64 MB in all, as a cell is one bit once counted: more than one or not); with
still more prefixes it only proves fewer of them, and the exact grouping takes the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlines.llm.batches import mix, seed
from chartlines.llm.common import keep

ROWS, CELLS_EACH, LEAST_BITS, MOST_BITS = 2, 8, 16, 28
TILE_BITS = 16
#: Places of a conversation in one window; longer ones add what stands before.
SEGMENT = 4_096
#: Digests a task holds before it writes down their cells.
HELD = 1 << 22
NODE = ["a", "b", "depth"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), x, y, size: turns in order of turn (null first), role, text; x and y are hashes of role and text, size the text's code points.

    Null roles and texts are empty; rows without conv_id are left out; repeated rows
    are turns of their own. Conversations may be cut by range parts: a part's places
    begin with what earlier parts hold, told by a table of two rows a part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    marks = [F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(1), "text", "role").alias("y"), F.length("text").cast("long").alias("size")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", *marks)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            place, last, held = _places(ids, last, held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(len(ids), part))], ["conv_id", "x", "y", "size", "place", "part"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    parts = keep(dealt.mapInArrow(number, f"conv_id {kind}, x long, y long, size long, place long, part long"), "turns")
    edges = parts.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    edge = edges.select("part", F.explode(F.array("lo", "hi")).alias("conv_id")).distinct()
    counts = parts.join(F.broadcast(edge), ["part", "conv_id"], "left_semi").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.sum("n").over(earlier)).where(F.col("before").isNotNull()).select("conv_id", "part", "before")
    placed = parts.join(F.broadcast(before), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "x", "y", "size")


def _places(ids: np.ndarray, last, held: int) -> tuple[np.ndarray, object, int]:
    """Place of each row among those of its id, which stand together; `held` rows of the id `last` came before. Then the same for the next batch."""
    head = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))
    place = np.arange(len(ids)) - first + np.where(np.cumsum(head) == 0, held, 0)
    return place, ids[-1], int(place[-1]) + 1


def _along(rows: DataFrame, order: str, values: dict[str, tuple], backwards: bool = False) -> DataFrame:
    """rows with running values along each conversation, {name: (aggregate, column, how to put two together)}, taken by segments of SEGMENT places."""
    cut = rows.withColumn("_seg", F.floor(F.col(order) / SEGMENT))
    way = F.desc if backwards else F.asc
    window = Window.partitionBy("conv_id", "_seg").orderBy(way(order))
    own = cut.select("*", *(agg(c).over(window).alias(f"_{name}") for name, (agg, c, _) in values.items()))
    long = cut.where(F.col("_seg") > 0).select("conv_id").distinct()
    totals = cut.join(long, "conv_id", "left_semi").groupBy("conv_id", "_seg").agg(*(agg(c).alias(f"_t_{name}") for name, (agg, c, _) in values.items()))
    earlier = Window.partitionBy("conv_id").orderBy(way("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "_seg", *(agg(f"_t_{name}").over(earlier).alias(f"_b_{name}") for name, (agg, _, _) in values.items()))
    met = own.join(before, ["conv_id", "_seg"], "left")
    return met.select(*rows.columns, *(put(F.col(f"_{name}"), F.coalesce(f"_b_{name}", F.lit(0))).alias(name) for name, (_, _, put) in values.items()))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, total, depth, size, a, b, pa, pb: every prefix but the empty one, its digest and its parent's; turns have conv_id, total, place, x, y, size."""
    hashed = turns.select("conv_id", "total", (F.col("place") + 1).alias("depth"), "size", F.xxhash64("place", "x", "y").alias("h"), F.xxhash64("place", "y", "x", F.lit(1)).alias("g"))
    xor = lambda p, q: p.bitwiseXOR(q)
    run = _along(hashed, "depth", {"a": (F.bit_xor, "h", xor), "b": (F.bit_xor, "g", xor)})
    return run.select("conv_id", "total", "depth", "size", "a", "b", xor(F.col("a"), F.col("h")).alias("pa"), xor(F.col("b"), F.col("g")).alias("pb"))


def _cells(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    """A cell in each row of the sketch; the rows stand one after another."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    return [(mix(a + seed(r + 1) ^ b) >> np.uint64(64 - bits)).astype(np.int64) + (r << bits) for r in range(ROWS)]


def sketch(found: DataFrame, bits: int, least: int = 2) -> np.ndarray:
    """Count-min sketch of the digests a, b in found, a bit for each cell that counts least or more (1 or 2). Tasks count tiles of 2**TILE_BITS cells; the driver lays the tiles' bits out."""

    def write(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        cells = np.repeat(cells, np.minimum(counts, 2))
        tiles, first = np.unique(cells >> TILE_BITS, return_index=True)
        low = (cells & ((1 << TILE_BITS) - 1)).astype(np.uint16)
        parts = [low[x:y].tobytes() for x, y in zip(first, [*first[1:], len(low)])]
        yield pa.RecordBatch.from_arrays([pa.array(tiles), pa.array(parts, pa.binary())], ["tile", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held += _cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits)
            n += batch.num_rows
            if n >= HELD:
                yield from write(held)
                held, n = [], 0
        if n:
            yield from write(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, counts = None, np.zeros(1 << TILE_BITS, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if tile is not None and (counts >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([tile]), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], ["tile", "bits"])

        for batch in batches:
            for t, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t != tile:
                    yield from done()
                    tile, counts = t, np.zeros(1 << TILE_BITS, np.int64)
                np.add.at(counts, np.frombuffer(cells, np.uint16), 1)
        yield from done()

    counted = found.select("a", "b").mapInArrow(count, "tile long, cells binary")
    tiles = counted.repartition("tile").sortWithinPartitions("tile").mapInArrow(add, "tile long, bits binary").toArrow()
    flat = np.zeros((ROWS << bits) >> 3, np.uint8)
    for tile, packed in zip(tiles.column("tile").to_pylist(), tiles.column("bits").to_pylist()):
        at = tile << (TILE_BITS - 3)
        flat[at : at + len(packed)] = np.frombuffer(packed, np.uint8)
    return flat


def sketch_bits(n: int) -> int:
    """Width, as a power of two, of a row of a sketch of n digests."""
    return min(MOST_BITS, max(LEAST_BITS, int(CELLS_EACH * max(n, 1) - 1).bit_length()))


def held(flat: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether the cells of each digest are set in all rows of a sketch."""
    every = np.ones(len(a), bool)
    for cell in _cells(a, b, bits):
        every &= (flat[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return every


def screened(found: DataFrame, n: int) -> DataFrame:
    """found with state: 0 a prefix that may be shared, 1 the first of a conversation proved to be its own, 2 one that follows such a prefix."""
    bits = sketch_bits(n)
    sent = found.sparkSession.sparkContext.broadcast(sketch(found, bits))

    def own(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ~held(sent.value, a, b, bits)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, single = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, depth, a, b, pa_, pb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "depth", "a", "b", "pa", "pb"))
            head = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
            # a conversation's rows stand together and by depth: what was proved before holds on
            mine = own(a, b)
            if not head[0] and single:
                mine[0] = True
            first = np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))
            proved = np.maximum.accumulate(np.where(mine, np.arange(len(ids)), -1)) >= first
            above = np.concatenate([[single and not head[0]], proved[:-1] & ~head[1:]])
            above |= (depth > 1) & own(pa_, pb)
            state = np.where(above, 2, np.where(proved, 1, 0)).astype(np.int32)
            last, single = ids[-1], bool(proved[-1] or above[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state)], [*batch.schema.names, "state"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(look, f"{schema}, state int")


def _ends(rows: DataFrame) -> DataFrame:
    """a, b, depth, ends_sha256: of the conversations (conv_id) that end at each node, in ascending order, joined by commas.

    Ids are dealt and sorted by node and id, joined by the batch, and a node's pieces
    hashed in order as they come: no task holds a node's list.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in NODE], 1)
            ids = batch.column("conv_id").to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(ids)]
            pieces = [",".join(map(str, ids[x:y])) for x, y in zip(cuts, cuts[1:])]
            heads = batch.take(pa.array(cuts[:-1]))
            yield pa.RecordBatch.from_arrays([heads.column(c) for c in (*NODE, "conv_id")] + [pa.array(pieces, pa.string())], [*NODE, "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[], [], [], []]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(columns)], [*NODE, "ends_sha256"])
            done.clear()
            return batch

        for batch in batches:
            for a, b, depth, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "piece"))):
                if (a, b, depth) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (a, b, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            yield out()
        if node is not None:
            done.append((*node, state.hexdigest()))
        yield out()

    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = dealt.mapInArrow(join, f"a long, b long, depth long, first {kind}, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "a long, b long, depth long, ends_sha256 string")


def prefix_nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie.

    turns have conv_id, total, place, x, y (hashes of the turn), size; conversations
    conv_id and total, the number of turns, which may be none. A node is a distinct
    sequence of first turns, the root that of none; conv_id is its smallest member,
    parent_conv_id that of its parent (root: null). saved_tokens is the sum over its
    subtree of (n_convs - 1) * size of the last turn, ends_sha256 the SHA-256 of the
    ascending ids, joined by commas, of members that end there. No conversations give
    no nodes, not even a root.
    """
    found = keep(prefixes(turns), "prefixes")
    state = screened(found, found.count())
    open_rows = keep(state.where(F.col("state") < 2), "open")
    border = open_rows.where(F.col("state") == 1)
    zero = F.lit(0).cast("long")
    root = conversations.select("conv_id", "total", *(zero.alias(c) for c in ("depth", "size", "a", "b", "pa", "pb")))
    shared = open_rows.where(F.col("state") == 0).drop("state").unionByName(root)

    grouped = keep(shared.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"), F.min("pa").alias("pa"), F.min("pb").alias("pb")), "nodes")
    up = [F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth")]
    below = grouped.where(F.col("depth") > 0).select(*up).unionByName(border.select(*up)).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = keep(grouped.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")

    # a node's worth lies with its smallest member; what members are worth from a depth on adds up to the subtree's
    worth = nodes.where((F.col("n_convs") > 1) & (F.col("size") > 0)).select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("worth"))
    leaf = border.select("conv_id").union(nodes.where(F.col("n_children") == 0).select("conv_id")).distinct().withColumn("leaf", F.lit(1).cast("long"))
    of = worth.groupBy("conv_id").agg(F.lit(0).cast("long").alias("leaf")).union(leaf).groupBy("conv_id").agg(F.max("leaf").alias("leaf"))
    valued = shared.select("conv_id", *NODE).join(keep(of, "worthy"), "conv_id").join(worth, ["conv_id", "depth"], "left").withColumn("worth", F.coalesce("worth", F.lit(0)))
    from_here = _along(valued, "depth", {"rest": (F.sum, "worth", lambda p, q: p + q)}, backwards=True)
    sums = from_here.groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("rest").alias("saved_tokens"))
    ends = _ends(shared.where(F.col("depth") == F.col("total")))

    above = grouped.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("depth").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    asks = nodes.select("conv_id", *NODE, "pa", "pb", F.lit(False).alias("own"), F.lit(None).cast("long").alias("total"))
    asks = asks.unionByName(border.select("conv_id", *NODE, "pa", "pb", F.lit(True).alias("own"), "total")).withColumn("up", F.col("depth") - 1)
    named = keep(asks.join(above, ["pa", "pb", "up"], "left"), "parents")

    nothing, one = F.sha2(F.lit(""), 256), F.lit(1).cast("long")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    totals = nodes.drop("pa", "pb", "size", "conv_id").join(sums, NODE, "left").join(ends, NODE, "left")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    wide = named.where(~F.col("own")).join(totals, NODE).withColumn("parent_conv_id", parent).withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    wide = wide.withColumn("n_leaves", F.coalesce("n_leaves", zero)).withColumn("saved_tokens", F.coalesce("saved_tokens", zero))

    def chain(rows: DataFrame, parent: Column) -> DataFrame:
        last = F.col("depth") == F.col("total")
        return rows.select(
            "conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
            F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
        )

    return wide.select(*out).union(chain(named.where(F.col("own")), parent)).union(chain(state.where(F.col("state") == 2), F.col("conv_id")))
