"""Line dedup by winnowing: delete runs of whole lines that stand earlier in the corpus.

A window is a shortest stretch of non-blank lines that holds at least min_words
words. Of each window the line with the smallest hash is chosen; windows that overlap
mostly choose the same line, so few of many short lines are. Only chosen lines are
written down, as fingerprints. Equal runs that are long enough choose the same lines,
whatever stands around them, so a fingerprint that stands at one place only settles
all windows that chose it. Where a fingerprint stands at several places, it is
extended to the left and right, line by line, to the windows that chose it, and the
extended runs are compared; those that stand earlier are deleted. Runs longer than
a window are deleted as the windows that they are made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlines.llm.common import keep, let, words

#: Words that a repeated run must hold to be deleted.
MIN_WORDS = 8


def _reach(ns: Column, first: Column, step: int, min_words: int) -> Column:
    """How many lines from line `first` on, in the direction of step, hold min_words words; 0 if all of them don't."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("k"))

    def more(a: Column, j: Column) -> Column:
        held = F.coalesce(F.get(ns, first + step * j), F.lit(0))
        return F.when(a["sum"] >= min_words, a).otherwise(F.struct((a["sum"] + held).alias("sum"), (j + 1).alias("k")))

    # a line that is long enough is its own window, both ways
    far = F.aggregate(F.sequence(F.lit(1), F.lit(min_words - 1)), F.struct(F.get(ns, first).alias("sum"), F.lit(1).alias("k")), more, lambda a: F.when(a["sum"] >= min_words, a["k"]).otherwise(0))
    return F.when(F.get(ns, first) >= min_words, 1).otherwise(far)


def fingerprints(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The chosen lines of each document: doc_id, rid, at, fp, and windows, the windows that chose it: start, stop (line numbers), left, right (keys of the lines before and after it).

    Arrays are read by index only: a slice in a lambda would copy the whole array for each line.
    """
    counted = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), F.least(F.size(words(x)), F.lit(min_words)).alias("n"), x.alias("line")))
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("rid"), F.filter(counted, lambda s: s["n"] > 0).alias("s"))
    hashed = rows.select("doc_id", "rid", F.col("s.at").alias("at"), F.col("s.n").alias("n"), F.transform("s.line", lambda x: F.xxhash64(x)).alias("h"), F.transform("s.line", lambda x: F.xxhash64(x, F.lit(1))).alias("g"))
    along = F.sequence(F.lit(0), F.size("n") - 1)

    def span(first: Column, last: Column) -> Column:
        least = F.array_min(F.transform(F.sequence(first, last), lambda j: F.struct(F.get("h", j).alias("h"), j.alias("j"))))
        return F.struct(first.alias("first"), last.alias("last"), least["j"].alias("chosen"))

    def both(n: Column, i: Column) -> Column:
        ahead = let(_reach(F.col("n"), i, 1, min_words), lambda k: F.when(k > 0, span(i, i + k - 1)))
        back = let(_reach(F.col("n"), i, -1, min_words), lambda k: F.when(k > 1, span(i - k + 1, i)))
        return F.when(n >= min_words, F.array(F.struct(i.alias("first"), i.alias("last"), i.alias("chosen")))).otherwise(F.array(ahead, back))

    spanned = hashed.select("*", F.transform("n", both).alias("spans")).select("*", along.alias("along"))

    def keys(first: Column, last: Column) -> Column:
        """Key of a stretch of lines, empty if last < first."""
        near = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
        return F.aggregate(near, start, lambda x, j: F.struct(F.xxhash64(x["a"], F.get("h", j)).alias("a"), F.xxhash64(x["b"], F.get("g", j)).alias("b")))

    def chosen(i: Column) -> Column:
        # windows that may have chosen line i begin or end within min_words - 1 lines of it
        near = F.sequence(F.greatest(i - (min_words - 1), F.lit(0)), F.least(i + (min_words - 1), F.size("n") - 1))
        mine = F.array_distinct(F.filter(F.flatten(F.transform(near, lambda j: F.get("spans", j))), lambda w: w["chosen"] == i))
        window = lambda w: F.struct(F.get("at", w["first"]).alias("start"), F.get("at", w["last"]).alias("stop"), keys(w["first"], i - 1).alias("left"), keys(i + 1, w["last"]).alias("right"))
        return F.struct(F.get("at", i).alias("at"), F.struct(F.get("h", i).alias("h"), F.get("g", i).alias("g")).alias("fp"), F.transform(mine, window).alias("windows"))

    # outer: for an inner explode the optimizer adds a filter on the array's size, which works all of it out twice
    found = spanned.select("doc_id", "rid", F.explode_outer(F.filter(F.when(F.size("n") > 0, F.transform("along", chosen)), lambda c: F.size(c["windows"]) > 0)).alias("c")).where(F.col("c").isNotNull())
    return found.select("doc_id", "rid", "c.at", "c.fp", "c.windows")


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs that stand earlier, in order of doc_id, text hash and line: doc_id, rid, start, stop."""
    found = keep(fingerprints(documents, min_words), "fingerprints")
    place = F.struct("doc_id", "rid", "at")
    # kept, so that both sides of the joins are plain exchanges whose hot keys can be split
    shared = keep(found.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where(F.col("lo") < F.col("hi")).select("fp"), "shared")
    extended = keep(found.join(shared, "fp", "left_semi").select("doc_id", "rid", "fp", F.explode("windows").alias("w")).select("doc_id", "rid", "fp", "w.*"), "extended")
    here, run = F.struct("doc_id", "rid", "start"), ["fp", "left", "right"]
    first = keep(extended.groupBy(*run).agg(F.min(here).alias("lo"), F.max(here).alias("hi")).where(F.col("lo") < F.col("hi")).select(*run, "lo"), "first")
    return extended.join(first, run).where(here > F.col("lo")).select("doc_id", "rid", "start", "stop")


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents with text without its repeated runs, and n_lines (non-blank lines before), n_removed; columns of those names are replaced.

    A non-blank line is removed if it lies in a run of non-blank lines of
    min_words words or more that equals a run starting earlier: in a document
    with a smaller doc_id (null first, then by a hash of the text), or further up
    in the same one. Blank lines inside such a run go with it; others stay. The
    first occurrence stays whole unless it overlaps its own repetition. Null
    texts stay null; rows equal in doc_id and text are one document and keep the same.
    """
    source = documents.drop("n_lines", "n_removed")
    runs = repeated_runs(source, min_words)
    gone = runs.select("doc_id", "rid", F.explode(F.sequence("start", "stop")).alias("at")).groupBy("doc_id", "rid").agg(F.collect_set("at").alias("_gone")).select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid"), "_gone")
    on = source["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(source["text"]) == gone["_rid"])
    joined = source.join(gone.hint("shuffle_hash"), on, "left")
    solid = lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.struct(
            F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")).alias("text"),
            F.size(F.filter(lines, solid)).alias("n_lines"),
            F.when(F.col("_gone").isNull(), 0).otherwise(F.size(F.filter("_gone", lambda i: solid(F.get(lines, i))))).alias("n_removed"),
        )

    done = joined.withColumn("_done", F.when(F.col("text").isNotNull(), let(F.split("text", "\n"), rest)))
    text, total, removed = F.col("_done.text"), F.coalesce("_done.n_lines", F.lit(0)), F.coalesce("_done.n_removed", F.lit(0))
    return done.select(*(text.alias("text") if c == "text" else F.col(c) for c in source.columns), total.alias("n_lines"), removed.alias("n_removed"))
