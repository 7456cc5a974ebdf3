"""Exact search for the highest inner products, by descending length.

Vectors are turned to integers, sorted by length and rotated so that the first
components hold most of it (the axes are those of the SVD of the whole table).
A query meets the vectors in blocks, longest first. By Cauchy and Schwarz no
score is above the product of the lengths, so a query is done where that falls
below its k-th best score so far. Within a block, the product of the first
components plus the product of the lengths of the rest bounds each score; only
those that can still enter are computed, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecall.session import materialize

SCALE = 256

#: Vectors of a block, and bytes of queries that all tasks hold at a time.
BLOCK, QUERY_BYTES = 4096, 16 << 20

#: Share of the components that bounds look at first.
FIRST_SHARE = 0.25

#: Scores are exact in doubles as long as no product of lengths reaches this.
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm2): floor(scale * x) of each component; vectors that are
    null, have no id or hold null or non-finite components are left out. A component
    that no long holds is an error."""
    x = F.col(vector).cast("array<double>")
    whole = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    values = F.transform("x", lambda c: F.when(F.abs(c * scale) < float(1 << 63), F.floor(c * scale)).otherwise(
        F.raise_error(F.lit("a component is beyond 64 bits")).cast("bigint")))
    return whole.select("vec_id", values.alias("v")).withColumn("norm2", F.aggregate(
        "v", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zeros behind the shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _axes(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of the table, strongest first: tasks add up
    products of components, the driver gets width * width numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = _matrix(batch.column("v"), width).astype(float)
            total += rows.T @ rows
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "x"])

    sums = vectors.select("v").mapInArrow(run, "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    found = sums.toPandas()
    gram = np.zeros((width, width))
    gram[found["i"], found["j"]] = found["x"]
    return np.linalg.eigh(gram)[1][:, ::-1] if width else gram


class _Queries:
    """Queries held by a task, with the best candidates found so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, axes: np.ndarray, first: int, k: int, floor: np.ndarray):
        self.ids, self.rows, self.k, self.first, self.axes = ids, rows, k, first, axes
        self.turned = rows @ axes
        self.rest = np.sqrt((self.turned[:, first:] ** 2).sum(1))
        self.length = np.sqrt((rows.astype(float) ** 2).sum(1))
        self.floor = floor.astype(float)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), ascending

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> bool:
        """Takes in a block; false if neither it nor a shorter one can matter."""
        lengths = np.sqrt((rows.astype(float) ** 2).sum(1))
        longest = lengths.max(initial=0)
        open_ = np.flatnonzero(self.length * longest * (1 + 1e-9) + 1e-6 >= self.floor)
        if not len(open_):
            return False
        turned = rows @ self.axes
        rest = np.sqrt((turned[:, self.first:] ** 2).sum(1))
        for low in range(0, len(open_), 512):
            some = open_[low:low + 512]
            bound = self.turned[some, :self.first] @ turned[:, :self.first].T + np.outer(self.rest[some], rest)
            slack = 1e-6 + 1e-9 * self.length[some] * longest
            hit = bound >= (self.floor[some] - slack)[:, None]
            if hit.mean() > 0.2:
                scores = self._scores(self.rows[some], rows)
                for at, q in enumerate(some):
                    self._enter(q, scores[at], ids)
            else:
                for at in np.flatnonzero(hit.any(1)):
                    mine = np.flatnonzero(hit[at])
                    self._enter(some[at], self._scores(self.rows[some[at]][None], rows[mine])[0], ids[mine])
        return True

    @staticmethod
    def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0) * (b.astype(float) ** 2).sum(1).max(initial=0))
        if most < _EXACT:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        exact = a.astype(object) @ b.astype(object).T
        if max(abs(exact.max(initial=0)), abs(exact.min(initial=0))) >= 1 << 63:
            raise OverflowError("an inner product is beyond 64 bits")
        return exact.astype(np.int64)

    def _enter(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        able = np.flatnonzero((scores >= self.floor[q]) & (ids != self.ids[q]))
        if not len(able):
            return
        if len(able) > self.k:
            able = able[np.lexsort((ids[able], -scores[able]))[:self.k]]
        merged = sorted(self.best[q] + [(-int(scores[i]), int(ids[i])) for i in able])[:self.k]
        self.best[q] = merged
        if len(merged) == self.k:
            self.floor[q] = max(self.floor[q], -merged[-1][0])

    def results(self) -> pa.RecordBatch:
        found = [(int(self.ids[q]), v, -s) for q, best in enumerate(self.best) for s, v in best]
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))],
                               names=["query_id", "vec_id", "score"])


FOUND = "query_id bigint, vec_id bigint, score bigint"


def search(vectors: DataFrame, queries, k: int, vector: str = "embedding", scale: int = SCALE,
           query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest integer
    inner product for each row that the condition ``queries`` (on vec_id) picks;
    all, if there are fewer. Equal scores go to the smaller vec_id.

    ``vectors`` holds (vec_id long, a list of numbers); other columns are
    ignored. Rows that :func:`quantised` leaves out take no part. A shorter list
    counts as zeros beyond its end, an empty one scores 0. Candidates are all rows
    with another vec_id than the query's. Rows that repeat a vec_id count as
    often as they come; as queries, once for each different vector. An empty
    table gives no rows. Products are exact; one that no long holds is an error.

    Queries go to all tasks ``query_bytes`` at a time, a fixed bound, and every
    such batch meets all blocks in one job.
    """
    spark = vectors.sparkSession
    # Sorted by length over the whole table; a task holds a range of lengths.
    table = materialize(quantised(vectors, vector, scale).withColumn("width", F.size("v"))
                        .repartitionByRange(F.desc("norm2"), "vec_id")
                        .sortWithinPartitions(F.desc("norm2"), "vec_id"), "vectors")
    shape = table.agg(F.max("width").alias("width"), F.max("norm2").alias("norm2")).first()
    if shape.width is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = shape.width
    first = max(1, round(width * FIRST_SHARE))
    axes = _axes(table, width)
    # The longest block gives every query a first floor.
    longest = table.orderBy(F.desc("norm2"), "vec_id").limit(BLOCK).select("vec_id", "v").toArrow()
    longest_ids, longest_rows = longest.column("vec_id").to_numpy(), _matrix(longest.column("v"), width)

    asked = table.where(queries).select("vec_id", "v").distinct()
    each = max(1, query_bytes // (8 * max(1, width)))
    n = asked.count()
    batches_of_queries = -(-n // each)
    asked = materialize(asked.withColumn("batch", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, batches_of_queries)))),
                        "queries")
    parts = []
    for number in range(batches_of_queries):
        held = asked.where(F.col("batch") == number).select("vec_id", "v").toArrow()
        ids, rows = held.column("vec_id").to_numpy(), _matrix(held.column("v"), width)
        seed = _Queries(ids, rows, axes, first, k, np.full(len(ids), -np.inf))
        seed.meet(longest_ids, longest_rows)
        sent = spark.sparkContext.broadcast((ids, rows, axes, first, seed.floor))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, rows, axes, first, floor = sent.value
            mine = _Queries(ids, rows, axes, first, k, floor)
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(low, BLOCK)
                    if not mine.meet(part.column("vec_id").to_numpy(), _matrix(part.column("v"), len(axes))):
                        break
            yield mine.results()

        parts.append(materialize(table.select("vec_id", "v").mapInArrow(run, FOUND), "found"))
        sent.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    entry = F.struct((-F.col("score")).alias("minus"), "vec_id")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.minus")).alias("score"))
