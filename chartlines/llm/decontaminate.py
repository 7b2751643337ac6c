"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over items, exact weighted similarity.

A window is as long as a benchmark item (in words) and may start anywhere; it is cut
off at the ends of the document. Windows that can hold no item of their length are
ruled out first: what a window shares with an item weighs no more than its shingles
that stand in any item of that length, so these must weigh the least similarity
times the lightest such item. Every other window gets
FINGERPRINTS SimHashes of 64 bits (fewer for long items) and looks up, in a
multi-index of all items of its length, those that agree with it in one of the
BLOCKS blocks of a fingerprint up to radius // BLOCKS bits, which all within the
Hamming radius do.
Each pair found is verified on the shingles themselves, each weighing as many
characters as it has.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlines.llm.common import keep, let, lower_ascii, row_key, words

SHINGLE_WORDS = 5
MIN_SIMILARITY = 80  # per cent
#: 16-bit blocks with 2 errors each: 137 of 65,536 random values match. A bit of two texts of similarity 0.8 differs with
#: at most 0.26 for few shingles of very uneven weight (0.20 for even ones) and 0.185 from FEW on, so a block matches with
#: 0.17 or more (0.41): 48 blocks miss such a pair once in 7,000 at the very worst, 24 blocks of long items once in 300,000.
RADIUS, BLOCKS = 11, 4
FEW, FINGERPRINTS, FINGERPRINTS_LONG = 25, 12, 6
#: Starts of one text cut at a time.
STARTS = 64
#: Shingles of benchmark items that are broadcast at a time; a larger benchmark takes more passes over the documents.
BROADCAST_SHINGLES = 500_000


def _block_bits(blocks: int) -> list[tuple[int, int]]:
    """Shift and width of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(width: int, errors: int) -> list[int]:
    return [sum(1 << b for b in c) for e in range(errors + 1) for c in combinations(range(width), e)]


def shingles(ws: Column, k: Column) -> Column:
    """Distinct k-word shingles of an array of words."""
    at = F.sequence(F.lit(0), F.size(ws) - k)
    return F.when(F.size(ws) >= k, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(ws, i + 1, k), " ")))).otherwise(F.array().cast("array<string>"))


#: A bit in each of four lanes of 16 bits.
_LANES = 0x0001000100010001


def simhash(weighed: Column, total: Column, salt: Column) -> Column:
    """64-bit SimHash of an array of h, w (hash and weight of each shingle); total is the sum of weights.

    A bit is set where more than half of the weight votes for it. Up to 32,767 in all,
    four bits are added up at once in the lanes of a long.
    """
    long = lambda v: F.lit(v).cast("long")
    shift = lambda name, v, i: F.call_function(name, v, i)

    def lanes(i: Column) -> Column:
        votes = F.aggregate(weighed, long(0), lambda a, s: a + shift("shiftrightunsigned", F.xxhash64(s["h"], salt), i).bitwiseAND(long(_LANES)) * s["w"])
        over = votes + (16383 - F.floor(total / 2)) * long(_LANES)
        return shift("shiftleft", F.shiftrightunsigned(over, 14).bitwiseAND(long(_LANES)), i)

    def bit(i: Column) -> Column:
        votes = F.aggregate(weighed, long(0), lambda a, s: a + F.getbit(F.xxhash64(s["h"], salt), i) * s["w"])
        return F.when(2 * votes > total, shift("shiftleft", long(1), i)).otherwise(long(0))

    every = lambda part, n: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), long(0), lambda a, i: a.bitwiseOR(part(i)))
    return F.when(total < 32_768, every(lanes, 16)).otherwise(every(bit, 64))


def fingerprints(shingled: Column, n: Column) -> Column:
    """n SimHashes of an array of shingles, each of hashes of its own; a shingle weighs its number of characters."""
    weighed = F.transform(shingled, lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(s).cast("long").alias("w")))
    return let(F.struct(weighed.alias("each"), _weight(shingled).alias("total")), lambda v: F.transform(F.sequence(F.lit(1), n), lambda salt: simhash(v["each"], v["total"], salt)))


def index_items(benchmark: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """item_id, n_words, k, ws, sh (distinct shingles), weight, n_fps, fps of each item with words; an item of fewer words than k is one shingle."""
    split = benchmark.select("item_id", words(lower_ascii(F.col("text"))).alias("ws")).where(F.size("ws") > 0).distinct()
    sized = split.select("item_id", "ws", F.size("ws").alias("n_words"), F.least(F.size("ws"), F.lit(k)).alias("k"))
    cut = sized.withColumn("sh", shingles(F.col("ws"), F.col("k")))
    several = F.when(F.size("sh") == 1, 1).when(F.size("sh") < FEW, FINGERPRINTS).otherwise(FINGERPRINTS_LONG)
    return cut.withColumn("weight", _weight(F.col("sh"))).withColumn("n_fps", several).withColumn("fps", fingerprints(F.col("sh"), F.col("n_fps")))


def _weight(shingled: Column) -> Column:
    return F.aggregate(shingled, F.lit(0).cast("long"), lambda a, s: a + F.length(s))


def _windows(documents: DataFrame, items: DataFrame, k: int, min_similarity: int) -> DataFrame:
    """key, n_words, k, n_fps, first, last: runs of starts whose window can hold an item of n_words words; starts may lie before the text."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.size("hs") - k), lambda i: F.struct(_shingle_hash(F.col("hs"), i, k).alias("sh"), F.length(F.array_join(F.slice("ws", i + 1, k), " ")).alias("w"))))
    lightest = items.groupBy("n_words").agg(F.min("weight").alias("weight"), F.max("n_fps").alias("n_fps"))
    place = items.select("n_words", each.alias("s")).select("n_words", "s.sh", "s.w").distinct().join(lightest, "n_words")
    hashed = documents.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    # outer: for an inner explode the optimizer adds a filter on the array's size, which works all of it out twice
    sh = F.when(F.size("hs") >= k, F.transform(F.sequence(F.lit(0), F.size("hs") - k), lambda i: _shingle_hash(F.col("hs"), i, k)))
    at = hashed.select("key", sh.alias("shs")).select("key", F.posexplode_outer("shs").alias("p", "sh"))
    met = at.join(F.broadcast(place), "sh")
    # the shingle at p lies in windows that start from p - (n_words - k) to p: its weight comes in at the one and leaves after the other
    turns = F.array(F.struct((F.col("p") - F.col("n_words") + k).alias("t"), F.col("w").cast("long").alias("w")), F.struct((F.col("p") + 1).alias("t"), (-F.col("w")).cast("long").alias("w")))
    of = ["key", "n_words", "weight", "n_fps"]
    step = met.select(*of, F.explode(turns).alias("turn")).groupBy(*of, F.col("turn.t").alias("t")).agg(F.sum("turn.w").alias("w"))
    along = Window.partitionBy("key", "n_words").orderBy("t")
    held = step.withColumn("held", F.sum("w").over(along)).withColumn("next", F.lead("t").over(along))
    enough = held.where(F.col("next").isNotNull() & (100 * F.col("held") >= min_similarity * F.col("weight")))
    return enough.select("key", "n_words", F.lit(k).alias("k"), "n_fps", F.col("t").alias("first"), (F.col("next") - 1).alias("last"))


def _cut(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, key, n_words, n_fps, t, sh: the windows of runs with their distinct shingles; t is where the window would start, before the text if negative."""
    starts = runs.groupBy("key", "n_words", "k").agg(F.max("n_fps").alias("n_fps"), F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("starts"))
    # dealt by key at every size: the runs grow with the documents and fit no broadcast for good
    held = documents.join(starts.hint("shuffle_hash"), "key").select("doc_id", "key", words(lower_ascii(F.col("text"))).alias("ws"), "n_words", "k", "n_fps", "starts")
    some = F.transform(F.sequence(F.lit(1), F.size("starts"), F.lit(STARTS)), lambda i: F.slice("starts", i, STARTS))
    once = held.dropDuplicates(["key", "n_words"]).withColumn("some", F.explode_outer(some))

    def window(t: Column) -> Column:
        start, stop = F.greatest(t, F.lit(0)), F.least(t + F.col("n_words"), F.size("ws"))
        return F.struct(t.alias("t"), shingles(F.slice("ws", start + 1, stop - start), F.col("k")).alias("sh"))

    return once.select("doc_id", "key", "n_words", "n_fps", F.explode_outer(F.transform("some", window)).alias("w")).select("doc_id", "key", "n_words", "n_fps", "w.*")


def _shingle_hash(hs: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(hs, i + j) for j in range(k)])


def find_leaks(documents: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, min_similarity: int = MIN_SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, key, item_id, start, similarity, distance: the best window of each document for each item it holds.

    similarity is the weight of shared shingles over that of all shingles of window
    and item, at least min_similarity per cent; start is the window's first word
    (smallest of the best), distance that of the first fingerprint with a
    block that agrees. Windows start everywhere. key tells documents with one doc_id apart.
    Null, empty and blank texts hold nothing; items without words are in nothing;
    rows equal in doc_id and text are one document. Empty tables give no rows.
    """
    items = keep(index_items(benchmark, k).withColumn("item", row_key(F.col("item_id"), F.array_join("ws", " "))), "items")
    n, sizes = items.agg(F.sum(F.col("n_words") - F.col("k") + 1), F.collect_set("k")).first()  # sizes: k values at most
    passes = max(1, -(-(n or 0) // broadcast_shingles))
    keyed = documents.where(F.col("text").isNotNull()).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    texts = keyed.select("key", words(lower_ascii(F.col("text"))).alias("ws"))
    hashed = items.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    parts = [
        _windows(texts, hashed.where((F.col("k") == size) & (F.pmod(F.xxhash64("item"), F.lit(passes)) == turn)), size, min_similarity)
        for size in sorted(sizes or [k], reverse=True)
        for turn in range(passes)
    ]
    runs = keep(reduce(DataFrame.unionByName, parts), "runs")
    prints = keep(_cut(keyed, runs).withColumn("fps", fingerprints(F.col("sh"), F.col("n_fps"))), "windows")
    near = keep(_multi_index(prints, items, radius, blocks, passes == 1), "candidates")
    item = items.select("item", "item_id", F.col("sh").alias("item_sh"), F.col("weight").alias("item_weight"))
    shared = _weight(F.array_intersect("sh", "item_sh"))
    both = _weight(F.col("sh")) + F.col("item_weight") - F.col("shared")
    checked = near.join(prints.drop("fps", "n_fps"), ["key", "n_words", "t"]).join(F.broadcast(item) if passes == 1 else item, "item").withColumn("shared", shared).withColumn("all", both)
    good = checked.where(100 * F.col("shared") >= min_similarity * F.col("all")).withColumn("similarity", F.col("shared") / F.col("all"))
    placed = good.select("doc_id", "key", "item", "item_id", F.struct((-F.col("similarity")).alias("s"), F.greatest("t", F.lit(0)).alias("start"), "distance").alias("b"))
    best = placed.groupBy("doc_id", "key", "item", "item_id").agg(F.min("b").alias("b"))
    return best.select("doc_id", "key", "item_id", "b.start", (-F.col("b.s")).alias("similarity"), "b.distance")


def _multi_index(prints: DataFrame, items: DataFrame, radius: int, blocks: int, few: bool) -> DataFrame:
    """key, n_words, t, item, distance: the items of a window's length that agree with it in a block of a fingerprint, each once.

    Items stand in the index under every value of a block that differs from theirs in
    no more than radius // blocks bits; windows ask for their own values. All within
    radius in a fingerprint are found, and more; few: the items fit a broadcast.
    """
    errors, cut = radius // blocks, _block_bits(blocks)
    value = lambda fp, a, w: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
    flipped = lambda v, width: F.array(*[v.bitwiseXOR(F.lit(m).cast("long")) for m in _masks(width, errors)])
    around = F.transform("fps", lambda fp: F.array(*[flipped(value(fp, a, w), w) for a, w in cut]))
    index = items.select("item", "n_words", F.posexplode_outer(around).alias("f", "bs")).select("item", "n_words", "f", F.posexplode_outer("bs").alias("block", "vs")).select("item", "n_words", "f", "block", F.explode_outer("vs").alias("v"))
    asked = F.transform("fps", lambda fp: F.array(*[value(fp, a, w) for a, w in cut]))
    window = ["key", "n_words", "t"]
    own = prints.select(*window, "fps", F.posexplode_outer(asked).alias("f", "vs")).select(*window, "fps", "f", F.posexplode_outer("vs").alias("block", "v"))
    met = own.join(keep(index, "index"), ["n_words", "f", "block", "v"])
    theirs = items.select("item", F.col("fps").alias("item_fps"))
    pairs = met.join(F.broadcast(theirs) if few else theirs, "item").withColumn("apart", F.zip_with("fps", "item_fps", lambda a, b: a.bitwiseXOR(b)))
    # of all ways in which a pair meets only the first is kept: first fingerprint, first block within the errors
    bits = lambda x: [F.bit_count(value(x, a, w)) for a, w in cut]
    earlier = F.exists(F.slice("apart", 1, F.col("f")), lambda x: F.least(*bits(x)) <= errors)
    mine = F.get("apart", F.col("f"))
    first = reduce(lambda rest, ib: F.when(ib[1] <= errors, ib[0]).otherwise(rest), reversed(list(enumerate(bits(mine)))), F.lit(blocks))
    return pairs.where((F.col("block") == first) & ~earlier).select(*window, "item", F.bit_count(mine).alias("distance"))


def drop_leaks(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of documents that hold no benchmark item."""
    bad = find_leaks(documents, benchmark, **how).select(F.col("key").alias("_key")).distinct()
    return documents.join(bad.hint("shuffle_hash"), row_key(documents["doc_id"], documents["text"]) == bad["_key"], "left_anti")
