"""Spelling variants of a vocabulary, grouped by what most people write.

Words one edit apart are found with pivotal grams. The bigrams of a word are ordered,
rare ones first. Its prefix is its first three places in that order (and all others of
the third one's gram); its pivots are two disjoint grams of the prefix, those that few
words hold, picked by dynamic programming. One edit spoils one of two disjoint grams at
most. So of two near words, the one whose prefix ends first has a pivot that stands in
the prefix of the other, shifted by one place at most. And since the one edit lies in
front of that gram or behind it, what is on the other side of it is the same. Pivots
meet prefixes in one join, by gram, place, length and the side that has to be equal;
what meets is verified.

There are no more bigrams than pairs of letters, so their frequencies are a table of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rolecall.session import Scratch, materialize

#: Runs of Latin letters, the letters of a bigram, and how many of them one edit can spoil.
RUN, GRAM, SPOILED = r"[A-Za-zÀ-ÿ]+", 2, 1

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A form occurs so many times as often as its variant. Least length and occurrences of a word.
RATIO, LEAST_LENGTH, LEAST_TIMES = 10, 7, 2

#: Words with one gram, place, length and side that meet in one task; more are dealt to blocks.
BLOCK = 2000


def runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` once per run of letters, with ``run``: lower-cased in A to
    Z only. A null text has none."""
    lowered = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    return documents.withColumn("run", F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0)))).drop(text)


def vocabulary(runs_: DataFrame, word: str = "run", least_length: int = LEAST_LENGTH,
               least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): distinct words that are long and frequent enough, and how often each occurs."""
    return (runs_.select(F.col(word).alias("word")).where(F.char_length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times))


def _grams(word: str) -> Column:
    """The bigrams of a word, by place."""
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - (GRAM - 1)), lambda i: F.substring(F.col(word), i, F.lit(GRAM)))


def _pivots(places: list[int], weights: list[int], need: int) -> list[int]:
    """``need`` of the places, any two of them ``GRAM`` apart at least, with the least
    sum of weights. ``places`` ascend and hold enough that are disjoint."""
    # best[i][j]: least weight of j disjoint grams among the first i places, and the last of them.
    best = [[(0, -1)] + [(float("inf"), -1)] * need]
    for i, place in enumerate(places):
        before = i
        while before and places[before - 1] > place - GRAM:
            before -= 1
        row = [(0, -1)]
        for j in range(1, need + 1):
            row.append(min(best[i][j], (best[before][j - 1][0] + weights[i], i), key=lambda b: b[0]))
        best.append(row)
    chosen, i = [], len(places)
    for j in range(need, 0, -1):
        last = best[i][j][1]
        chosen.append(places[last])
        i = last
        while i and places[i - 1] > places[last] - GRAM:
            i -= 1
    return chosen[::-1]


def _parity(word: str) -> int:
    """Which letters (in 64 classes) occur an odd number of times. One edit changes two at most."""
    odd = 0
    for letter in word:
        odd ^= 1 << (ord(letter) & 63)
    return odd - (1 << 64) if odd >> 63 else odd


def _signatures(grams: list[str], counts: list[int]):
    """Of each word the places of its prefix, as (gram, place, pivot, last): ``gram`` and
    ``last``, that of the prefix's end, by their number in the order."""
    order = {g: i for i, g in enumerate(grams)}
    need = SPOILED + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            owner, gram, place, pivot, last = [], [], [], [], []
            for row, word in enumerate(words):
                numbers = [order[word[i:i + GRAM]] for i in range(len(word) - GRAM + 1)]
                end = sorted(numbers)[min(GRAM * SPOILED, len(numbers) - 1)]
                prefix = [i for i, g in enumerate(numbers) if g <= end]
                chosen = set(_pivots(prefix, [counts[numbers[i]] for i in prefix], need))
                for i in prefix:
                    owner.append(row)
                    gram.append(numbers[i])
                    place.append(i)
                    pivot.append(i in chosen)
                    last.append(end)
            odd = pa.array([_parity(w) for w in words], pa.int64())
            took = pa.array(owner, pa.int64())
            yield pa.record_batch(
                [batch.column("word").take(took), batch.column("n").take(took), odd.take(took), pa.array(gram, pa.int32()),
                 pa.array(place, pa.int32()), pa.array(pivot, pa.bool_()), pa.array(last, pa.int32())],
                names=["word", "n", "odd", "gram", "place", "pivot", "last"])
    return run


#: What one edit can do to the place of a gram and the length of its word, and whether the
#: letters in front of the gram stay as they are, or those behind it.
_SHIFTS = [(0, 0, True), (0, 0, False), (0, 1, True), (0, -1, True), (1, 1, False), (-1, -1, False)]


def _key(place: Column, size: Column, front: Column) -> Column:
    """A hash of a word's gram, place, length, and the side of the gram that has to be equal."""
    side = F.when(front, F.substring(F.col("word"), F.lit(1), F.col("place"))).otherwise(
        F.substring(F.col("word"), F.col("place") + (GRAM + 1), F.char_length("word")))
    return F.xxhash64("gram", place, size, front, side)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(x, n_x, y, n_y): each pair of different words, once each way, that one inserted,
    deleted or replaced code point tells apart. ``words``: (word, n), of four code
    points at least, distinct. ``block`` doesn't change the result."""
    with Scratch(words.sparkSession) as scratch:
        held = scratch.table(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
        # As many rows as there are pairs of letters.
        counted = held.select(F.explode(_grams("word")).alias("gram")).groupBy("gram").agg(
            F.count("*").alias("times")).orderBy("times", "gram").toArrow()
        order, times = counted.column("gram").to_pylist(), counted.column("times").to_pylist()
        signed = scratch.table(held.mapInArrow(
            _signatures(order, times),
            "word string, n bigint, odd bigint, gram int, place int, pivot boolean, last int"), "signed")
        size = F.char_length("word")
        prefixes = signed.withColumn("front", F.explode(F.array(F.lit(True), F.lit(False)))).select(
            _key(F.col("place"), size, F.col("front")).alias("key"), F.col("word").alias("y"), F.col("n").alias("n_y"),
            F.col("odd").alias("odd_y"), F.col("last").alias("last_y"))
        shifts = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s"), F.lit(f).alias("f")) for p, s, f in _SHIFTS]))
        pivots = signed.where("pivot").withColumn("shift", shifts).select(
            _key(F.col("place") + F.col("shift.p"), size + F.col("shift.s"), F.col("shift.f")).alias("key"),
            F.col("word").alias("x"), F.col("n").alias("n_x"), F.col("odd").alias("odd_x"), F.col("last").alias("last_x"))
        # Where many words have the same key, these are dealt to blocks, and who asks for them asks each block.
        crowded = scratch.table(prefixes.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > block).select(
            "key", F.ceil(F.col("m") / block).alias("blocks")), "crowded")
        blocks = F.coalesce("blocks", F.lit(1).cast("bigint"))
        dealt = prefixes.join(crowded, "key", "left").withColumn("block", F.pmod(F.xxhash64("y"), blocks)).drop("blocks")
        asked = pivots.join(crowded, "key", "left").withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).drop("blocks")
        # Where both prefixes end with the same gram, both words ask.
        met = asked.join(dealt, ["key", "block"]).where(
            (F.col("last_x") <= F.col("last_y")) & (F.bit_count(F.col("odd_x").bitwiseXOR(F.col("odd_y"))) <= 2 * SPOILED)
            & (F.levenshtein("x", "y", 1) == 1))
        low = F.col("x") < F.col("y")
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
                           F.when(low, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"),
                           F.when(low, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b")).distinct()
        both = F.explode(F.array(*[F.struct(F.col(p).alias("x"), F.col(f"n_{p}").alias("n_x"), F.col(q).alias("y"),
                                            F.col(f"n_{q}").alias("n_y")) for p, q in (("a", "b"), ("b", "a"))]))
        return materialize(pairs.select(both.alias("p")).select("p.*"), "near")


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``words`` (word, n).

    Two words are near if one inserted, deleted or replaced code point tells them apart.
    A word's form is its near word with the largest ``n`` (ties: the first in code point
    order) if that is at least ``ratio`` times its own, else null; its root is where the
    forms lead from it, or itself. Words are distinct, not null and of four code points
    at least; ``n`` is positive. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError(f"the ratio must be 2 at least, got {ratio}")
    held = materialize(words.select("word", F.col("n").cast("bigint").alias("n")), "vocabulary")
    best = near_words(held, block).groupBy("x").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_y")).alias("n"), F.col("y").alias("word"))).alias("best"))
    kept = -F.col("best.n") >= F.lit(ratio) * F.col("n")
    formed = materialize(held.join(best, F.col("word") == F.col("x"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(kept, F.col("best.word")).alias("form"), F.when(kept, -F.col("best.n")).alias("form_n")), "forms")
    # Each round doubles the way followed. It ends: n grows by the ratio with every step.
    ways = materialize(formed.where("form is not null").select("word", F.col("form").alias("to")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("at"), F.col("to").alias("next"))
        longer = ways.join(ahead, F.col("to") == F.col("at"), "left")
        if longer.where("next is not null").isEmpty():
            break
        ways = materialize(longer.select("word", F.coalesce("next", "to").alias("to")), "ways")
    roots = ways.select(F.col("word").alias("from"), F.col("to").alias("root"))
    return formed.join(roots, F.col("word") == F.col("from"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
