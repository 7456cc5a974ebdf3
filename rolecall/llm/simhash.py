"""Near duplicates by SimHash, found with multi-index hashing.

A fingerprint of 64 bits is cut into segments. If two fingerprints differ in no
more than ``radius`` bits, they differ in no more than ``radius // segments`` bits
of some segment. So each fingerprint is a resident of the bucket of every of its
segments, and a visitor of the buckets whose segment lies in the small Hamming ball
around its own. Those that meet in a bucket are compared in full.

Only different fingerprints meet, in one shuffle by bucket. A bucket with many
residents would have the square of them in links, so what leaves it is a forest that
connects what is linked in it: no more edges than fingerprints. Buckets beyond
:data:`BLOCK` fingerprints are dealt to blocks, and each two blocks meet in a task of
their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rolecall.llm.graph import components
from rolecall.llm.tokens import ragged
from rolecall.session import Scratch, materialize

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints may differ.
WORDS, SEED, RADIUS = 3, 42, 3

#: Segments of a fingerprint. Two of 32 bits keep buckets small for any number of
#: documents; with a radius of 3 the balls hold the segment and what is one bit off.
SEGMENTS = 2

#: Fingerprints of a bucket that are compared in one task.
BLOCK = 4096

#: Shingles whose bits are counted together, and comparisons made at a time.
SLICE, PAIRS = 1 << 16, 1 << 21

#: Comparisons of a bucket that is compared together with others.
FEW = 1 << 12

_BITS = 64


def text_fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text. A word is a run of bytes other than space and
    the controls 9 to 13; A to Z count as a to z."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    size = min(words, len(parts))
    starts, ends = starts[:len(parts) - size + 1], ends[size - 1:]
    above = np.zeros(_BITS, np.int64)
    digest = xxhash.xxh64_digest
    for first in range(0, len(starts), SLICE):
        cuts = zip(starts[first:first + SLICE].tolist(), ends[first:first + SLICE].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in cuts]), np.uint8).reshape(-1, 8)
        bits = np.unpackbits(hashes, axis=1)
        even = len(bits) // 255 * 255  # as many as a byte can count
        above += bits[:even].reshape(-1, 255, _BITS).sum(1, np.uint8).sum(0, np.int64) + bits[even:].sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * above > len(starts)).tobytes(), "big")


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            known: dict[bytes, int] = {b"": 0}
            found = np.zeros(len(texts), np.uint64)
            for row, value in enumerate(texts):
                text = value.as_py() or b""
                if text not in known:
                    known[text] = text_fingerprint(text, words, seed)
                found[row] = known[text]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
    return run


def fingerprints(documents: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id long, fp long) of every row of ``documents`` (doc_id, text): the bits that
    are set in over half the hashes of the text's shingles, repeats included. Null
    texts and those without words have 0."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_fingerprints(words, seed), "doc_id bigint, fp bigint")


def as_hex(fp: str) -> Column:
    """A fingerprint as 16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment, as even as can be."""
    cuts = [i * _BITS // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _long(bits) -> Column:
    """A long with these bits set."""
    value = sum(1 << b for b in bits)
    return F.lit(value - (1 << _BITS) if value >> (_BITS - 1) else value).cast("bigint")


def _entries(distinct: DataFrame, radius: int, segments: int) -> DataFrame:
    """(segment, value, resident, fp): the buckets each fingerprint lives in and visits."""
    places = []
    for number, (low, bits) in enumerate(_segments(segments)):
        for off in range(radius // segments + 1):
            places += [F.struct(F.lit(number).alias("segment"), F.lit(low).alias("low"), _long(range(bits)).alias("whole"),
                                _long(flipped).alias("flipped"), F.lit(off).alias("off"))
                       for flipped in combinations(range(bits), off)]
    own = F.expr("shiftrightunsigned(fp, place.low)").bitwiseAND(F.col("place.whole"))
    flipped = F.col("place.flipped")
    # Of two values one bit apart, the one that lacks the bit visits the other.
    return distinct.select("fp", F.explode(F.array(*places)).alias("place")).where(
        (F.col("place.off") != 1) | (own.bitwiseAND(flipped) == 0)).select(
        "place.segment", own.bitwiseXOR(flipped).alias("value"), (F.col("place.off") == 0).alias("resident"), "fp")


def _forest(low: np.ndarray, high: np.ndarray) -> list[int]:
    """Positions of edges that connect what all the edges connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for position, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
        if (a := root(a)) != (b := root(b)):
            parent[max(a, b)] = min(a, b)
            kept.append(position)
    return kept


def _within(residents: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links of residents with residents and others, compared a strip at a time."""
    ends = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = max(1, PAIRS // len(residents))
    for first in range(0, len(others), rows):
        strip = others[first:first + rows]
        a, b = np.nonzero(np.bitwise_count(strip[:, None] ^ residents[None, :]) <= radius)
        low, high = strip[a].view(np.int64), residents[b].view(np.int64)
        apart = low != high
        ends = _joined(ends, (low[apart], high[apart]))
    return ends


def _joined(ends, more):
    """A forest of both sets of edges."""
    low, high = (np.concatenate(both) for both in zip(ends, more))
    kept = _forest(low, high)
    return low[kept], high[kept]


def _links(radius: int):
    """Walks rows sorted by bucket; a bucket may go on in the next batch."""
    names = ("segment", "value", "low", "high")

    def linked(rows: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps, sizes = rows["fp"].view(np.uint64), np.diff(cuts)
        lives = np.concatenate([[0], np.cumsum(rows["resident"])])
        lives = lives[cuts[1:]] - lives[cuts[:-1]]
        pairs = sizes * lives
        ends = [np.zeros(0, np.int64)] * 2
        # Buckets of a few rows are compared together, so many that the strip stays bounded.
        some = np.flatnonzero((sizes > 1) & (lives > 0) & (pairs <= FEW))
        upto = np.cumsum(pairs[some])
        for first in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            here = some[(upto > first) & (upto <= first + PAIRS)]
            nth = ragged(np.zeros(len(here), np.int64), pairs[here])
            start, size = np.repeat(cuts[here], pairs[here]), np.repeat(sizes[here], pairs[here])
            low, high = fps[start + nth // size], fps[start + nth % size]
            near = (np.bitwise_count(low ^ high) <= radius) & (low != high)
            ends = _joined(ends, (low[near].view(np.int64), high[near].view(np.int64)))
        for k in np.flatnonzero(pairs > FEW):
            fps_here = fps[cuts[k]:cuts[k + 1]]
            ends = _joined(ends, _within(fps_here[:lives[k]], fps_here, radius))
        yield pa.record_batch([pa.array(ends[0]), pa.array(ends[1])], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*names, "resident", "fp")}
            change = np.zeros(batch.num_rows, bool)
            for name in names:
                change[1:] |= rows[name][1:] != rows[name][:-1]
            cuts = np.flatnonzero(change)
            if open_rows and any(open_rows[-1][n][-1] != rows[n][0] for n in names):
                cuts = np.concatenate([[0], cuts])
            if not len(cuts):
                open_rows.append(rows)
                continue
            last = int(cuts[-1])
            parts = [*open_rows, {c: v[:last] for c, v in rows.items()}]
            before = sum(len(p["fp"]) for p in open_rows)
            whole = {c: np.concatenate([p[c] for p in parts]) for c in rows}
            yield from linked(whole, np.unique(np.concatenate([[0], cuts + before])))
            open_rows = [{c: v[last:] for c, v in rows.items()}]
        if open_rows:
            whole = {c: np.concatenate([p[c] for p in open_rows]) for c in open_rows[0]}
            yield from linked(whole, np.array([0, len(whole["fp"])]))
    return run


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """(x, y): links between the different fingerprints of ``distinct`` (fp long), enough of
    them to connect all that differ in no more than ``radius`` bits."""
    with Scratch(distinct.sparkSession) as scratch:
        places = _entries(distinct, radius, segments)
        sizes = places.groupBy("segment", "value").agg(F.count("*").alias("rows"), F.count_if("resident").alias("lives"))
        # Seldom any; where there are, the planner sends them or shuffles them by their measured size.
        hot = scratch.table(sizes.where((F.col("rows") > block) & (F.col("lives") > 0)).select(
            "segment", "value", F.ceil(F.col("rows") / block).alias("blocks")), "hot")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        dealt = places.join(hot, ["segment", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
        met = dealt.withColumn("own", own).withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
            "segment", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "resident", "fp")
        ordered = met.repartition("segment", "value", "low", "high").sortWithinPartitions(
            "segment", "value", "low", "high", F.desc("resident"))
        return materialize(ordered.mapInArrow(_links(radius), "x bigint, y bigint"), "links")


def near_duplicates(documents: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS,
                    segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """(doc_id long, fp long, component_id long), one row per row of ``documents``.

    ``documents`` holds (doc_id, text); other columns are ignored, whatever their names.
    Documents whose fingerprints differ in no more than ``radius`` bits are linked; the
    component is named by its smallest doc_id. Null and empty texts, and those without
    words, have the fingerprint 0 and are linked like any other. Repeated rows and ids
    give a row each; a null doc_id takes part, and is the component id only where all
    ids of its component are null. An empty table gives no rows. ``segments`` and
    ``block`` don't change the result.
    """
    if not 0 <= radius < _BITS or segments < 1 or block < 1:
        raise ValueError("the radius must be 0 to 63 bits, segments and block positive")
    prints = materialize(fingerprints(documents, words, seed), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fp"), radius, segments, block))
    placed = classes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(placed.join(ids, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
