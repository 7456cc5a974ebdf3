"""Mixing sources to target weights by hash thresholds.

Each document has a fixed random number, a hash. The documents of a source below
a threshold are in the mix. Thresholds come from histograms: words by source and
hash bucket are summed, the bucket in which a source's budget runs out is found,
and only the documents in that bucket are looked at again with finer buckets,
until one hash is left. Nothing is sorted, and no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rolecall.session import materialize

#: Weights by the rank of the source, again and again, and how often at most a
#: document is taken.
WEIGHTS, MOST_TIMES = (5, 2, 1), 3

WORD = r"[^\x20\x09-\x0D]+"

#: Bits of the hash, and of a histogram's buckets.
HASH_BITS, BUCKET_BITS = 60, 10


def ranked(frame: DataFrame, key: str, label: str) -> DataFrame:
    """``frame`` with ``rank``, from 0 by ascending ``key``, nulls last: sorted
    in ranges, and the sizes of the ranges added up."""
    low = (1 << 33) - 1  # the position within its range is in the lower 33 bits
    placed = materialize(
        frame.repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last())
        .withColumn("place", F.monotonically_increasing_id())
        .withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit(low))}), label)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = placed.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(bases, "range").withColumn("rank", F.col("base") + F.col("place")).drop("range", "place", "base")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target): the sum of all sizes shared by weight, no
    more than ``most_times`` a source's size, what is over shared again by weight."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = materialize(ranked(sizes, "source", "sources").withColumn("weight", weight), "weighted")
    cap = F.col("source_size") * most_times
    row = weighted.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    share, full = (row.size / row.weight if row.weight else 0.0), -1
    while True:
        over = F.col("weight") * F.lit(share) >= cap
        state = weighted.agg(F.count_if(over).alias("full"), F.sum(F.when(over, cap)).alias("taken"),
                             F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if state.full == full or not state.weight:
            break
        full, share = state.full, (row.size - (state.taken or 0)) / state.weight
    return weighted.select("source", "source_size",
                           F.least(cap.cast("double"), F.col("weight") * F.lit(share)).alias("target"))


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents with a hash below it fit the budget of
    their source as nearly as whole documents can."""
    state = materialize(budgets.where("budget > 0").select(
        "source", "budget", F.lit(0).cast("bigint").alias("path")), "budgets")
    for level in range(1, HASH_BITS // BUCKET_BITS + 1):
        shift = HASH_BITS - level * BUCKET_BITS
        inside = sized.alias("d").join(state.alias("s"), _same_source("d", "s") & (
            F.shiftright("d.hash", shift + BUCKET_BITS) == F.col("s.path")))
        sums = inside.groupBy(F.col("s.source").alias("source"), F.col("s.budget").alias("budget"),
                              F.shiftright("d.hash", shift).alias("path")).agg(
            F.sum("d.size").alias("words"), F.min("d.hash").alias("low"), F.max("d.hash").alias("high"))
        upto = Window.partitionBy("source").orderBy("path")
        cut = (sums.withColumn("upto", F.sum("words").over(upto)).where("upto >= budget")
               .withColumn("nth", F.row_number().over(upto)).where("nth = 1"))
        state = materialize(cut.select("source", "path", "words", "low", "high",
                                       (F.col("budget") - F.col("upto") + F.col("words")).alias("budget")), "cut")
        if state.where("low < high").isEmpty():
            break
    # The document at the boundary is in if that comes nearer to the budget.
    return state.select("source", (F.col("low") + F.when(F.col("budget") * 2 >= F.col("words"), 1).otherwise(0)
                                   ).alias("threshold"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    ``documents`` holds (doc_id, text, source); other columns are ignored,
    whatever their names. ``size`` counts the words of the text, none if null.
    Sources weigh ``weights`` by their rank in code point order, a null source
    last, and share the sum of all sizes. A source that should give more than it
    has gives each document so many whole times, and those below a hash threshold
    once more. The hash is of doc_id and text: the same input gives the same mix
    in any order, and rows equal in both go together. An empty table gives no
    rows, and texts without words give 0 everywhere. Columns to ``keep`` come last.
    """
    mask = (1 << HASH_BITS) - 1
    sized = materialize(documents.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("doc_id", "text").bitwiseAND(F.lit(mask)).alias("hash"), *keep), "sized")
    asked = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_times)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    asked = materialize(asked.withColumn("times", whole.cast("bigint")).withColumn(
        "budget", F.col("target") - F.col("times") * F.col("source_size")), "targets")
    limits = _thresholds(sized, asked)
    plan = materialize(asked.alias("a").join(limits.alias("t"), _same_source("a", "t"), "left").select(
        "a.source", "a.source_size", "a.target", "a.times", F.coalesce("t.threshold", F.lit(0)).alias("threshold")), "plan")
    return sized.alias("d").join(plan.alias("p"), _same_source("d", "p")).select(
        "d.doc_id", "d.size", "p.source_size", "p.target",
        (F.col("d.size") * (F.col("p.times") + (F.col("d.hash") < F.col("p.threshold")).cast("bigint"))).alias("taken"),
        *[F.col(f"d.{c}") for c in keep])
