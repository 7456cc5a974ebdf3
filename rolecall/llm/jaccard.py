"""Similarity join of documents on their sets of word shingles, exact.

The overlap counts of all pairs are the product of the document by shingle
incidence matrix with its transpose. It is computed in blocks (hash partitions
of the shingles) and only where a pair can still reach the threshold:

* In any fixed order of shingles, two sets with a Jaccard of 3/4 share one of
  the first n - ceil(3n/4) + 1 shingles of each. Only those rows of the matrix
  are multiplied. Frequent shingles come last in the order, so a line that many
  documents hold makes no pairs by itself.
* Sizes differ by a factor of 4/3 at most, and the sets in no more than a
  seventh of both sizes. A parity bitmap of each set bounds that difference from
  below, so most other pairs fall before any set is read.
* What is left is counted on the whole sets.

Large groups of near copies would still make all their pairs. So in a few rounds
each document is compared with one pivot of its group and linked ones are merged;
after that, pairs are made only between documents that are not in one component.
That gives the components. Who needs the join itself, every link, asks for
:func:`all_links`, which leaves out no pair for what is connected already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from rolecall.llm.graph import components
from rolecall.llm.words import mix, shingle_sets
from rolecall.llm.worker import lean, only
from rolecall.session import Scratch, arrow_rows, materialize

#: Words of a shingle, and the least similarity.
WORDS, THRESHOLD = 5, Fraction(3, 4)

#: Texts, and pairs of sets, that a task hands to Python at a time.
ROWS = 1000

#: Documents of a task whose shingles are counted together.
COUNTED = 10_000

#: Shingles seen so often, counting only what repeats within :data:`COUNTED` documents, are
#: put last in the order; so many at most, the most frequent ones. Neither
#: changes the result, only how many pairs are looked at.
FREQUENT, MOST_FREQUENT = 24, 1 << 18

#: Longs of the parity bitmap that pairs are joined by.
BITMAP_LONGS = 8

#: Rounds in which each document meets one pivot, before pairs are made.
PIVOT_ROUNDS = 3

#: Shingles before its own that each entry of a class brings to the join of pairs. A pair
#: that has one of these in common is made there, so it isn't made again.
EARLIER = 8

#: Classes of a shingle that :func:`all_links` compares in one task; more are dealt
#: to blocks, and each two blocks meet by themselves.
BLOCK = 1000

#: Document ids that may be sent to all executors to pick their texts; beyond
#: it, texts are picked by a shuffled join.
MOST_SENT = 2_000_000


def _signature(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _parity(shingles: np.ndarray, bits: int) -> np.ndarray:
    """How often each of so many hash classes (a power of two) occurs, modulo 2."""
    odd = np.bincount((mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def _parity_bits(n: int) -> int:
    """Classes for a set of ``n``: enough that sets without much in common differ."""
    return max(256, 1 << max(0, n - 1).bit_length())


def _difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of how many shingles only one of two sets holds. The larger
    bitmap is folded to the classes of the smaller one."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _describe(size: int):
    """One row per document (no ``shingle``), and per :data:`COUNTED` documents of a task
    the shingles that repeat among them (no ``sig``)."""
    def repeats(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held)
        held.clear()
        values, times = _repeated(every)
        nothing = pa.nulls(len(values), pa.int64())
        return pa.record_batch(
            [nothing] * (3 + BITMAP_LONGS) + [pa.array(values.view(np.int64)), pa.array(times),
                                              pa.nulls(len(nothing), pa.binary())], names=_DESCRIBED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, held, seen = 0, [], set()
        for batch in batches:
            counted += batch.num_rows
            if counted > COUNTED:
                if held:
                    yield repeats(held)
                counted = batch.num_rows
                seen.clear()
            sigs, sizes, bits, parities = [], [], [], []
            for shingles in shingle_sets(batch.column("text"), size):
                sig = _signature(shingles) if len(shingles) else None
                sigs.append(sig)
                sizes.append(len(shingles))
                bits.append(_parity(shingles, 64 * BITMAP_LONGS).view(np.int64))
                parities.append(_parity(shingles, _parity_bits(len(shingles))).tobytes())
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    held.append(shingles)
            rows = len(sigs)
            nothing = pa.nulls(rows, pa.int64())
            columns = np.array(bits, np.int64).reshape(rows, BITMAP_LONGS).T
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()),
                 *[pa.array(c) for c in columns], nothing, nothing, pa.array(parities, pa.binary())], names=_DESCRIBED)
        if held:
            yield repeats(held)
    return run


def _repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur more than once, ascending, and how often each. Sorts ``values``
    in place, as a copy would hold all shingles of a batch again."""
    values.sort()
    same = values[1:] == values[:-1]
    starts = np.flatnonzero(same & np.concatenate([np.ones(1, bool), ~same[:-1]])[:len(same)])
    found = values[starts]
    return found, np.searchsorted(values, found, side="right") - starts


_BITS = [f"bits{i}" for i in range(BITMAP_LONGS)]
_DESCRIBED = ["doc_id", "sig", "n", *_BITS, "shingle", "times", "parity"]


def _first_shingles(size: int, frequent: np.ndarray, times: np.ndarray, threshold: Fraction):
    """(shingle, sig, frequent): the part of each set that a similar one has to share in.
    ``frequent`` is sorted. Copies among :data:`COUNTED` documents of a task give their rows once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, done = 0, set()
        for batch in batches:
            counted += batch.num_rows
            if counted > COUNTED:
                counted = batch.num_rows
                done.clear()
            shown, owners, often = [], [], []
            for shingles in shingle_sets(batch.column("text"), size):
                n = len(shingles)
                if not n or (sig := _signature(shingles)) in done:
                    continue
                done.add(sig)
                least = -(-threshold.numerator * n // threshold.denominator)
                rank = np.zeros(n, np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
                    rank = np.where(frequent[at] == shingles, times[at], 0)
                first = np.argsort(rank, kind="stable")[:n - least + 1]
                shown.append(shingles[first])
                often.append(rank[first] > 0)
                owners.append(np.full(len(first), sig, np.int64))
            if shown:
                yield pa.record_batch(
                    [pa.array(np.concatenate(shown).view(np.int64)), pa.array(np.concatenate(owners)),
                     pa.array(np.concatenate(often))], names=["shingle", "sig", "frequent"])
    return run


def _sets(size: int):
    """The sets of the classes asked for; a doc_id that repeats may come with
    other texts, which are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("sig").to_pylist()
            found = [(sig, s.tobytes()) for sig, s in zip(asked, shingle_sets(batch.column("text"), size))
                     if len(s) and _signature(s) == sig]
            yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()),
                                   pa.array([f[1] for f in found], pa.binary())], names=["sig", "shingles"])
    return run


def _possible(threshold: Fraction):
    """Keeps the pairs that their parities leave possible."""
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("n_x", "n_y", "parity_x", "parity_y"))
            for row, (nx, ny, a, b) in enumerate(zip(*columns)):
                if nx * p <= ny * q and ny * p <= nx * q and _difference(
                        np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)) * (q + p) <= (nx + ny) * (q - p):
                    keep.append(row)
            yield batch.select(["x", "y"]).take(pa.array(keep, pa.int64()))
    return run


def _linked(threshold: Fraction):
    """Keeps the pairs whose sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row, (a, b) in enumerate(zip(batch.column("set_x"), batch.column("set_y"))):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if threshold.denominator * common >= threshold.numerator * (len(x) + len(y) - common):
                    keep.append(row)
            yield batch.select(["x", "y"]).take(pa.array(keep, pa.int64()))
    return run


def _similar_size(x: str, y: str, threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (nx * p <= ny * q) & (ny * p <= nx * q)


def _reachable(x: str, y: str, threshold: Fraction):
    """Whether sizes and bitmaps allow the threshold. A similarity of p/q leaves
    a difference of (q - p) / (q + p) of both sizes at most."""
    p, q = threshold.numerator, threshold.denominator
    differ = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in _BITS), F.lit(0))
    return _similar_size(x, y, threshold) & (
        differ * (q + p) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (q - p))


@dataclass
class JaccardJoin:
    """Classes of equal shingle sets, and what links them.

    ``members``: (doc_id, n, sig), one row per document row, ``sig`` null where
    the set is empty. ``links``: (x, y) pairs of classes found similar, enough
    of them to connect every component.
    """

    members: DataFrame
    links: DataFrame

    def documents(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every document row; a
        document without words is its own component."""
        found = components(self.links)
        classes = (self.members.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
                   .join(found, F.col("sig") == F.col("node"), "left")
                   .select("sig", "least", F.coalesce("component", "sig").alias("component")))
        least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
        named = classes.join(least, "component").select("sig", "component_id")
        # Documents without words would be one hot key of the join.
        some = self.members.where("sig is not null").join(named, "sig").select("doc_id", "n", "component_id")
        none = self.members.where("sig is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _prepared(documents: DataFrame, words: int, threshold: Fraction, held: Scratch):
    """Members, the entries of the first shingles, bitmaps, and what keeps the pairs
    that are similar enough."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{c} {'binary' if c == 'parity' else 'bigint'}" for c in _DESCRIBED)
    described = materialize(texts.mapInArrow(lean(only(_describe(words))), schema), "described")
    members = described.where("shingle is null").select("doc_id", "n", "sig")
    classes = members.where("sig is not null").groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))

    common = (described.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
              .where(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "shingle").limit(MOST_FREQUENT)).toArrow()
    frequent = common.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    frequent, times = frequent[order], common.column("times").to_numpy()[order]

    shown = texts.mapInArrow(lean(only(_first_shingles(words, frequent, times, threshold))),
                             "shingle bigint, sig bigint, frequent boolean")
    # A class with many shingles that others show, too, is in the middle of its group.
    middle = F.sum("times").over(Window.partitionBy("sig"))
    entries = held.table(_shared(shown).join(classes.drop("doc_id"), "sig").withColumn("degree", middle), "entries")
    shapes = described.where("sig is not null").select("sig", "n", "parity")
    bits = described.where("sig is not null").groupBy("sig").agg(*[F.min(b).alias(b) for b in _BITS])

    def verified(pairs: DataFrame) -> DataFrame:
        with Scratch(documents.sparkSession) as scratch:
            possible = _left_possible(pairs, shapes, threshold, scratch)
            return _verified(possible, classes, texts, words, threshold, scratch)

    return members, entries, bits, verified


def jaccard_join(documents: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD) -> JaccardJoin:
    """Links between the documents whose shingle sets have a Jaccard similarity
    of ``threshold`` or more. ``documents`` holds (doc_id long, text string);
    other columns are ignored, whatever their names.

    Null and empty texts have empty sets and no links. A text of fewer than
    ``words`` words has one shingle, all of it. Equal texts, and equal sets, are
    one class. Repeated doc_ids give a row each; a null doc_id takes part, and
    is the component id only where all ids of its component are null. An empty
    table gives empty results. Shingles and sets are told apart by 64-bit
    hashes.
    """
    with arrow_rows(documents.sparkSession, ROWS):
        held = Scratch(documents.sparkSession)
        members, entries, bits, verified = _prepared(documents, words, threshold, held)
        links, left = verified(_pivot_pairs(entries.withColumn("component", F.col("sig")), F.col("degree"), threshold)), entries
        for number in range(1, PIVOT_ROUNDS + 1):
            after = Scratch(documents.sparkSession)
            left = after.table(_open(left, components(links)), "open")
            held.clear()
            held = after
            if number < PIVOT_ROUNDS:
                pairs = _pivot_pairs(left, F.xxhash64("sig", F.lit(number)), threshold)
            else:
                pairs = _all_pairs(left, bits, threshold).distinct()
            links = links.unionByName(verified(pairs))
        held.clear()
    return JaccardJoin(members, links)


def all_links(documents: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(x, y), x < y: every pair of different classes with a similarity of
    ``threshold`` or more, as many as there are. Rows of one class have equal sets.
    ``documents`` is as for :func:`jaccard_join`; ``block`` doesn't change the result."""
    with arrow_rows(documents.sparkSession, ROWS), Scratch(documents.sparkSession) as held:
        _, entries, bits, verified = _prepared(documents, words, threshold, held)
        return verified(_block_pairs(entries, bits, threshold, block))


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, n_links) of every class of ``members``, given :func:`all_links`."""
    ends = links.select(F.col("x").alias("sig")).unionAll(links.select("y")).groupBy("sig").agg(F.count("*").alias("n"))
    return members.where("sig is not null").select("sig").distinct().join(ends, "sig", "left").select(
        "sig", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"))


def _shared(shown: DataFrame) -> DataFrame:
    """(shingle, sig, times): the shingles that may be shown by more than one class, each
    with its classes once. Shingles shown by the same classes make the same pairs, so one
    row stands for all of them, ``times`` many, under a hash of what they have in common;
    should two hashes be equal, classes meet that needn't, and none is lost.

    Rare shingles have few rows each, so windows tell. Frequent ones, of which
    one may be in any share of the documents, are only combined before and after
    the shuffle on both columns.
    """
    of_shingle = Window.partitionBy("shingle")
    rare = (shown.where(~F.col("frequent"))
            .withColumns({"low": F.min("sig").over(of_shingle), "high": F.max("sig").over(of_shingle)})
            .where("low != high").select("shingle", "sig", "low", "high").distinct()
            .withColumns({"holders": F.count("*").over(of_shingle),
                          "each": F.bit_xor(F.xxhash64("sig")).over(of_shingle)}))
    together = F.xxhash64("low", "high", "holders", "each").alias("shingle")
    return (rare.groupBy(together, "sig").agg(F.count("*").alias("times"))
            .unionByName(shown.where("frequent").select("shingle", "sig").distinct().withColumn(
                "times", F.lit(1).cast("bigint"))))


def _pivot_pairs(entries: DataFrame, rank, threshold: Fraction) -> DataFrame:
    """For each class the one pivot it shares most with and isn't connected to.
    The pivot of a shingle is its class of highest rank, by bands of similar size."""
    ratio = float(threshold.denominator) / threshold.numerator
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(ratio))).cast("int")
    banded = entries.select("shingle", "sig", "n", "component", "times", band.alias("band"), rank.alias("rank"))
    pivots = banded.groupBy("shingle", "band").agg(F.max(F.struct("rank", "sig", "n", "component")).alias("pivot"))
    met = banded.withColumn("own", F.struct("sig", "n")).join(pivots, ["shingle", "band"]).where(
        (F.col("component") != F.col("pivot.component")) & _similar_size("own", "pivot", threshold))
    shared = met.groupBy("sig", F.col("pivot.sig").alias("pivot")).agg(F.sum("times").alias("times"))
    best = shared.groupBy("sig").agg(F.max(F.struct("times", "pivot")).alias("best"))
    return best.select(F.least("sig", "best.pivot").alias("x"), F.greatest("sig", "best.pivot").alias("y")).distinct()


def _open(entries: DataFrame, merged: DataFrame) -> DataFrame:
    """The entries whose shingle is in more than one component, with the component."""
    placed = entries.drop("component", "degree").join(merged, F.col("sig") == F.col("node"), "left").drop("node").withColumn(
        "component", F.coalesce("component", "sig"))
    several = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low != high").select("shingle")
    return placed.join(several, "shingle", "left_semi")


def _all_pairs(entries: DataFrame, bits: DataFrame, threshold: Fraction) -> DataFrame:
    """All pairs that share a shingle, may reach the threshold and are not connected.
    Similar classes share many; such a pair is made at the first shingle they share, and
    again only where more than :data:`EARLIER` shingles of one lie between two of those."""
    before = Window.partitionBy("sig").orderBy("shingle").rowsBetween(-EARLIER, -1)
    wide = entries.select("shingle", "sig", "n", "component", F.collect_list("shingle").over(before).alias("earlier")).join(
        bits, "sig")
    x, y = wide.alias("x"), wide.alias("y")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.sig") < F.col("y.sig"))
                 & (F.col("x.component") != F.col("y.component")) & _reachable("x", "y", threshold)
                 & ~F.arrays_overlap("x.earlier", "y.earlier"))
    return met.select(F.col("x.sig").alias("x"), F.col("y.sig").alias("y"))


def _block_pairs(entries: DataFrame, bits: DataFrame, threshold: Fraction, block: int) -> DataFrame:
    """All pairs that share a shingle and may reach the threshold. Classes of a
    shingle are dealt to blocks; each two of them, and each by itself, are one key."""
    blocks = entries.groupBy("shingle").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = entries.select("shingle", "sig", "n").join(blocks, "shingle").withColumn(
        "block", F.pmod(F.xxhash64("sig"), F.col("blocks"))).join(bits, "sig")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    wide = dealt.withColumn("other", other).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    x, y = wide.alias("x"), wide.alias("y")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.low") == F.col("y.low"))
                 & (F.col("x.high") == F.col("y.high")) & (F.col("x.sig") < F.col("y.sig"))
                 & ((F.col("x.block") != F.col("y.block")) | (F.col("x.low") == F.col("x.high")))
                 & _reachable("x", "y", threshold))
    return met.select(F.col("x.sig").alias("x"), F.col("y.sig").alias("y")).distinct()


def _left_possible(pairs: DataFrame, parities: DataFrame, threshold: Fraction, scratch: Scratch) -> DataFrame:
    pairs = scratch.table(pairs, "met")
    needed = pairs.select(F.col("x").alias("sig")).union(pairs.select("y")).distinct()
    shapes = scratch.table(parities.join(needed, "sig", "left_semi").dropDuplicates(["sig"]), "shapes")
    both = (pairs.join(shapes.toDF("x", "n_x", "parity_x"), "x").join(shapes.toDF("y", "n_y", "parity_y"), "y")
            .select("x", "y", "n_x", "n_y", "parity_x", "parity_y"))
    return both.mapInArrow(lean(only(_possible(threshold))), "x bigint, y bigint")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, threshold: Fraction,
              scratch: Scratch) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    pairs = scratch.table(pairs, "pairs")
    needed = pairs.select(F.col("x").alias("sig")).union(pairs.select("y")).distinct()
    owners = scratch.table(classes.join(needed, "sig", "left_semi").select("sig", "doc_id"), "owners")
    if owners.count() <= MOST_SENT:
        owners = F.broadcast(owners)
    held = texts.alias("t").join(owners.alias("o"), F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")))
    sets = scratch.table(held.select("sig", "text").mapInArrow(lean(only(_sets(words))), "sig bigint, shingles binary"), "sets")
    both = (pairs.join(sets.toDF("y", "set_y"), "y").join(sets.toDF("x", "set_x"), "x")
            .select("x", "y", "set_x", "set_y"))
    return materialize(both.mapInArrow(lean(only(_linked(threshold))), "x bigint, y bigint"), "links")
