"""Fingerprints of texts from closed syncmers.

Of all runs of ``K`` code points, those count whose smallest inner run of ``S``
code points (by hash) stands at either end. Whether a run counts depends on the
run alone, so an edit changes only the anchors that it touches, and what two
texts share has the same anchors in both, wherever it stands.

A fingerprint is the anchors in order, each with its distance to the one before
and a 32-bit hash, in base64. Two are compared by position: the nth anchor with a
hash in one goes with the nth in the other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecall.llm.words import mix

#: Code points of an anchor and of the inner runs; one anchor in (K - S + 1) / 2
#: code points or so.
K, S = 32, 9

_U64 = np.uint64
_STEP = _U64(0x9E3779B97F4A7C15)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(units: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` units, from those of runs of powers of two."""
    n = len(units) - size + 1
    total = np.zeros(n, _U64)
    power, span, at = mix(units.astype(_U64) + _U64(1)), 1, 0
    while True:
        if size & span:
            total = mix(total * _STEP + power[at:at + n])
            at += span
        if span * 2 > size:
            return total
        power = mix(power[:-span] * _STEP + power[span:])
        span *= 2


def _window_min(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` neighbours."""
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers of a text. A text
    shorter than ``k`` is one anchor, an empty one has none."""
    units = _code_points(text)
    if len(units) < k:
        if not len(units):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        return np.zeros(1, np.int64), (_runs(units, len(units)) >> _U64(32)).astype(np.uint32)
    inner = _runs(units, s)
    inside = k - s + 1
    least = _window_min(inner, inside)
    at = np.flatnonzero((inner[:len(least)] == least) | (inner[inside - 1:] == least))
    if not len(at):
        at = np.zeros(1, np.int64)
    return at, (_runs(units, k)[at] >> _U64(32)).astype(np.uint32)


def fingerprint(text: str, k: int = K, s: int = S) -> str:
    at, hashes = anchors(text, k, s)
    pairs = np.stack([np.diff(at, prepend=0).astype("<u4"), hashes.astype("<u4")], 1)
    return base64.b64encode(pairs.tobytes()).decode()


def unpack(printed: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a fingerprint."""
    pairs = np.frombuffer(base64.b64decode(printed), "<u4").reshape(-1, 2)
    return np.cumsum(pairs[:, 0], dtype=np.int64), pairs[:, 1]


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Each hash with how often it came before, as one number."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    nth = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
    numbered = np.empty(len(hashes), _U64)
    numbered[order] = (ranked.astype(_U64) << _U64(32)) | nth.astype(_U64)
    return numbered


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """Positions of the anchors that go together, by position in ``a``."""
    at_a, hash_a = unpack(a)
    at_b, hash_b = unpack(b)
    if not len(at_a) or not len(at_b):
        return []
    _, i, j = np.intersect1d(_numbered(hash_a), _numbered(hash_b), assume_unique=True, return_indices=True)
    order = np.argsort(i)
    return list(zip(at_a[i[order]].tolist(), at_b[j[order]].tolist()))


def likeness(a: str, b: str) -> float:
    """Share of the anchors of the longer fingerprint that the other has, too: 1
    for equal ones, also for two empty ones; 0 if one is empty."""
    if a == b:
        return 1.0
    hash_a, hash_b = unpack(a)[1], unpack(b)[1]
    if not len(hash_a) or not len(hash_b):
        return 0.0
    common = np.intersect1d(_numbered(hash_a), _numbered(hash_b), assume_unique=True)
    return len(common) / max(len(hash_a), len(hash_b))


def fingerprints(documents: DataFrame, column: str = "text", k: int = K, s: int = S) -> DataFrame:
    """``documents`` with ``fingerprint`` of the whole texts; null counts as empty."""
    @F.pandas_udf("string")
    def run(texts):
        return texts.fillna("").map(lambda t: fingerprint(t, k, s))

    return documents.withColumn("fingerprint", run(F.col(column).cast("string")))


#: Rows of a part of the ordered documents, at about.
PART_ROWS = 8192

EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _followed(documents: DataFrame, parts: int) -> DataFrame:
    """(part, ghost, doc_id, mark, text): the documents by descending doc_id in
    parts, each part with a copy (the ghost) of the first document of the next
    one behind it, and the last part with that of the first part."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark").asc()]
    keys = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
                            ).withColumn("mark", F.xxhash64("text"))
    # Where parts begin; one id per part goes to the driver.
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(keys.approxQuantile("doc_id", shares, 0.1 / parts)), reverse=True) if shares else []
    bounds = [int(b) for b in bounds]
    # Bounds descend; a document belongs behind all that are not below it.
    edges = -np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part_of(ids):
        found = np.searchsorted(edges, -ids.fillna(0).astype("int64").to_numpy(), side="right")
        return ids.isna().mul(0).add(found).where(ids.notna(), len(edges)).astype("int32")

    placed = keys.withColumn("part", part_of("doc_id"))
    firsts = {r.part: r.first for r in placed.groupBy("part").agg(
        F.min(F.struct((-F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("key"), "mark")).alias("first")).collect()}
    used = sorted(firsts)
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the first part follows the last one
    if not firsts:
        return placed.select("part", F.lit(False).alias("ghost"), "doc_id", "mark", "text")
    heads = documents.sparkSession.createDataFrame(
        [(p, f.key, f.mark, before[p]) for p, f in firsts.items()], "part int, key bigint, mark bigint, to int")
    key = -F.coalesce("doc_id", F.lit(-(1 << 62)))
    copies = (placed.withColumn("key", key).join(F.broadcast(heads), ["part", "key", "mark"])
              .select(F.col("to").alias("part"), F.lit(True).alias("ghost"), "doc_id", "mark", "text")
              .dropDuplicates(["part"]))
    return placed.select("part", F.lit(False).alias("ghost"), "doc_id", "mark", "text").unionByName(copies)


def compare_edits(documents: DataFrame, k: int = K, s: int = S, part_rows: int = PART_ROWS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how near it is
    to that and to the next document's: columns :data:`EDITED`.

    ``documents`` holds (doc_id long, text string); other columns are ignored,
    whatever their names. The edited text has the last floor(n / 2) of n code
    points replaced by as many of the first ones of the next document (or all it
    has). The next is by descending doc_id, then by a hash of the text, null ids
    last; after the last comes the first, so a single document follows itself.
    Null texts are empty. An empty table gives no rows.
    """
    rows = documents.count()
    parts = max(1, -(-rows // part_rows))
    followed = _followed(documents, parts)
    dealt = followed.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions(
        "part", "ghost", F.col("doc_id").desc_nulls_last(), "mark")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], None
        for part, ghost, doc_id, text in rows_of(batches):
            text = text or ""
            printed = fingerprint(text, k, s)
            if held is not None and held[0] == part:
                _, own_id, own, own_print = held
                half = len(own) // 2
                edited = own[:len(own) - half] + text[:half]
                edited_print = fingerprint(edited, k, s)
                out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            own_print, edited_print, likeness(own_print, edited_print), likeness(own_print, printed)))
            held = None if ghost else (part, doc_id, text, printed)
            if len(out) == 512:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [field.split()[0] for field in EDITED.split(", ")]
    return dealt.mapInArrow(run, EDITED)
