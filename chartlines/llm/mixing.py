"""Mixing sources to target weights: pivotal dependent rounding of fractional copy counts, as a distributed reduction tree.

Each source gets a target number of words. A document of the source is wanted
target / source size times; the whole part of that is sure, the fraction is a
probability. Of rows that repeat one document, as many as their fractions add up to
are sure as well, and only what is left over, less than one row, is left to chance. Fractions are rounded in pairs: a random amount of words moves from
one document of a pair to the other until one of them is taken for sure or not
at all, so that the expected words of the source stay as they are. What is left
of a block of documents is one fractional document, and these meet in the next
level of the tree, until one is left for each source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlines.llm.common import keep, let, word_count

#: Documents of a block, on average (dealt by hash), folded in one go.
BLOCK = 64
#: Up to so many sources the table of targets is broadcast; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 50_000
#: Rows of one repeated document that are written out by a task at a time.
REPEATS = 4_096
#: Fractions nearer to a whole number than this are whole.
WHOLE = 1e-9


def _running(rows: DataFrame, order: Column, tag: str, **sums: Column) -> DataFrame:
    """rows with, for each of sums, its sum over all rows before one in the order; summed part by part of a range partitioning, so no task holds all rows."""
    parts = keep(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), tag)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part at most
    heads = parts.groupBy("_part").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    offsets = heads.select("_part", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = parts.join(F.broadcast(offsets), "_part")
    return met.withColumns({name: F.col(f"_{name}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()}).drop("_part", *(f"_{name}" for name in sums))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, n_units, target from rows of source, source_size, n_units, one for each source.

    Sources in order of code points, null last, get the weights in turn. Targets
    share `share` times all words by weight; what would be above `cap` times a
    source's size is shared anew by weight until no target is above. The sources
    that stop at their cap are those of the smallest cap to weight: one pass in that
    order finds the level at which the others stand. The driver sees sums alone.
    """
    place = _running(sizes, F.col("source").asc_nulls_last(), "sources", place=F.lit(1))
    turns = F.array(*[F.lit(float(w)) for w in weights])
    ranked = place.select("source", "source_size", "n_units", F.element_at(turns, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"))
    most = F.lit(float(cap)) * F.col("source_size")
    words, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    at = _running(ranked.withColumn("most", most).withColumn("full", most / F.col("weight")), F.col("full"), "levels", capped=F.col("most"), heavier=F.col("weight"))
    # the level if all before this source stop at their caps
    level = (F.lit(float(share * (words or 0))) - F.col("capped")) / (F.lit(float(weight or 0)) - F.col("heavier"))
    found = at.withColumn("level", level).where(F.col("level") <= F.col("full")).agg(F.max("level")).first()[0]
    target = most if found is None else F.least(most, F.lit(found) * F.col("weight"))
    return ranked.select("source", "source_size", "n_units", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _item(x: Column, p: Column) -> Column:
    return F.struct(x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["mass"].alias("mass"), p.alias("p"))


def _pair(a: Column, b: Column, seed: int) -> Column:
    """Two items after a random transfer of words between them: at least one has p 0 or 1 then."""
    to_a = F.least((1 - a["p"]) * a["mass"], b["p"] * b["mass"])
    to_b = F.least(a["p"] * a["mass"], (1 - b["p"]) * b["mass"])

    def moved(d: Column) -> Column:
        up = _uniform(a["h"], b["h"], F.lit(seed)) * (d["to_a"] + d["to_b"]) < d["to_b"]
        words = F.when(up, d["to_a"]).otherwise(-d["to_b"])
        return F.array(_item(a, _snap(a["p"] + words / a["mass"])), _item(b, _snap(b["p"] - words / b["mass"])))

    return let(F.struct(to_a.alias("to_a"), to_b.alias("to_b")), moved)


def _snap(p: Column) -> Column:
    return F.when(p < WHOLE, 0.0).when(p > 1 - WHOLE, 1.0).otherwise(p)


def _open(x: Column) -> Column:
    return (x["p"] > 0) & (x["p"] < 1)


def _fold(items: Column, seed: int) -> Column:
    """All items of a block, with p 0 or 1 for all but one at most."""
    first = F.slice(items, 1, 1)

    def step(done: Column, x: Column) -> Column:
        # the fractional item, if there is one, is kept in front
        def put(both: Column) -> Column:
            swap = _open(F.element_at(both, 2))
            return F.concat(F.when(swap, F.reverse(both)).otherwise(both), F.slice(done, 2, F.size(done)))

        head = F.element_at(done, 1)
        return F.when(_open(head), let(_pair(head, x, seed), put)).otherwise(F.concat(F.array(x), done))

    return F.aggregate(F.slice(items, 2, F.size(items)), first, step)


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, n_rows, source_size, target, copies, extra for each distinct (doc_id, source, size).

    size is the number of words (null text: 0). Of the n_rows rows that agree in
    doc_id, source and size, each is taken `copies` times and `extra` of them once
    more. A source's words taken differ from its target by less than its largest
    document. Documents without words take part and take nothing; null doc_id and
    null source are values like others; an empty table gives an empty mix.
    Everything random comes from hashes of doc_id, source, size and seed, so reruns agree.
    """
    units = keep(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    targets = keep(source_targets(keep(sizes, "sizes"), weights, share, cap), "targets")
    n_sources, most_units = targets.agg(F.count(F.lit(1)), F.max("n_units")).first()
    side = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = units.join(side.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    counted = joined.withColumn("copies", F.floor(wanted + WHOLE).cast("int")).withColumn("part", F.col("n_rows") * _snap(wanted - F.col("copies")))
    sure = counted.withColumn("sure", F.floor(F.col("part") + WHOLE).cast("long"))
    planned = sure.withColumn("p", _snap(F.col("part") - F.col("sure"))).withColumn("mass", F.col("size").cast("double")).withColumn("h", F.xxhash64("doc_id", "source", "size", F.lit(seed)))
    open_ = (F.col("mass") > 0) & (F.col("p") > 0) & (F.col("p") < 1)
    whole_row = F.struct("h", "doc_id", "size", "mass", "p")
    left = planned.where(open_).select("source", F.ceil(F.col("n_units") / F.lit(block)).alias("blocks"), whole_row.alias("x"))
    settled: list[DataFrame] = []
    blocks, depth = -(-(most_units or 0) // block), 0
    while blocks:
        dealt = left.groupBy("source", "blocks", F.pmod(F.xxhash64("x.h", F.lit(depth)), F.col("blocks")).alias("b")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
        folded = keep(dealt.select("source", "blocks", F.explode_outer(_fold(F.col("xs"), seed + depth)).alias("x")), f"level{depth}")
        final = F.col("blocks") == 1
        up = F.when(_open(F.col("x")), _uniform(F.col("x.h"), F.lit(seed + 1)) < F.col("x.p")).otherwise(F.col("x.p") > 0)
        settled.append(folded.where((final | ~_open(F.col("x"))) & up).select("x.doc_id", "source", "x.size"))
        left = folded.where(~final & _open(F.col("x"))).withColumn("blocks", F.ceil(F.col("blocks") / F.lit(block)))
        blocks, depth = (0 if blocks == 1 else -(-blocks // block)), depth + 1
    # units that chance takes once more; of those without words it doesn't matter which
    chosen = reduce(DataFrame.unionByName, settled, planned.where(~open_ & (F.col("p") >= 1)).select("doc_id", "source", "size")).withColumn("up", F.lit(1))
    same = [F.col(f"u.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "size")]
    out = sure.alias("u").join(chosen.alias("t"), same, "left")
    return out.select(*(F.col(f"u.{c}") for c in ("doc_id", "source", "size", "n_rows", "source_size", "target", "copies")), (F.col("u.sure") + F.coalesce("t.up", F.lit(0))).alias("extra"))


def each_row(mix: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The rows of a mix, n_rows times each, with `taken`, the words taken from that row; a unit of many rows is spread over tasks."""
    steps = F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(repeats).cast("long"))
    many = mix.where(F.col("n_rows") > repeats).withColumn("begin", F.explode(steps)).repartition("doc_id", "source", "size", "begin")
    dealt = mix.where(F.col("n_rows") <= repeats).withColumn("begin", F.lit(0).cast("long")).unionByName(many)
    rows = dealt.withColumn("row", F.explode(F.sequence("begin", F.least(F.col("n_rows"), F.col("begin") + repeats) - 1)))
    times = F.col("copies") + (F.col("row") < F.col("extra")).cast("int")
    return rows.withColumn("taken", (times * F.col("size")).cast("long")).drop("begin", "row")


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The rows of documents as often as the mix takes them, with their own columns and copy_no (from 1); a column copy_no is replaced.

    Only where some rows of a repeated document are taken once more than others are
    its rows numbered, within each partition of the input and by sums over partitions.
    """
    source = documents.drop("copy_no")
    plan = keep(mix_sources(documents, **how).where((F.col("copies") > 0) | (F.col("extra") > 0)).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("n_rows").alias("_rows"), F.col("copies").alias("_copies"), F.col("extra").alias("_extra")), "mix")
    uneven = (F.col("_extra") > 0) & (F.col("_extra") < F.col("_rows"))

    def met(rows: DataFrame, side: DataFrame) -> DataFrame:
        on = [rows["doc_id"].eqNullSafe(side["_id"]), rows["source"].eqNullSafe(side["_source"]), word_count(rows["text"]).eqNullSafe(side["_size"])]
        return rows.join(side.hint("shuffle_hash"), on)

    taken = met(source, plan.where(~uneven)).withColumn("_times", F.col("_copies") + (F.col("_extra") > 0).cast("int"))
    if not plan.where(uneven).isEmpty():
        rows = keep(met(source.withColumn("_part", F.spark_partition_id()), plan.where(uneven)), "repeated")
        unit = ["_id", "_source", "_size"]
        parts = rows.groupBy(*unit, "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*unit).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = parts.select(*(F.col(c).alias(f"o{c}") for c in unit), F.col("_part").alias("o_part"), before.alias("_before"))
        numbered = rows.withColumn("_no", F.row_number().over(Window.partitionBy(*unit, "_part").orderBy(F.xxhash64("text"))))
        placed = numbered.join(offsets, [F.col(c).eqNullSafe(F.col(f"o{c}")) for c in (*unit, "_part")])
        taken = taken.unionByName(placed.withColumn("_times", F.col("_copies") + (F.col("_no") + F.col("_before") <= F.col("_extra")).cast("int")).select(taken.columns))
    repeated = taken.where(F.col("_times") > 0)
    return repeated.select(*(F.col(c) for c in source.columns), F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy_no"))
