"""Packing of documents into sequences of equal length: bounded-space best fit.

Every task packs the documents of its part of the input as they come, with no
shuffle. It holds a fixed number of open sequences. A piece goes where it leaves
the least room; a bitset of the free sizes finds that place in a few operations.
If nothing fits and no more may be open, the fullest one is closed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rolecall.llm.tokens import encoder, encoder_key
from rolecall.llm.worker import lean, only

#: Tokens of a sequence, and sequences a task holds open.
LENGTH, OPEN = 2048, 1024


class BestFit:
    """Places pieces online. Bins are numbered from 0 in the order they open."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN):
        self.length, self.most = length, open_bins
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.sizes = 0  # bit f is set while some open bin has f free
        self.open = self.bins = 0

    def _take(self, free: int) -> int:
        bin_ = self.free[free].pop()
        if not self.free[free]:
            self.sizes &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to ``length`` tokens."""
        fitting = self.sizes >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.length, self.bins
            self.bins += 1
        left = free - size
        if left:
            if self.open == self.most:
                # The fullest closes, which may be the one just used.
                fullest = (self.sizes & -self.sizes).bit_length() - 1
                if left <= fullest:
                    return bin_, self.length - free
                self._take(fullest)
            self.free[left].append(bin_)
            self.sizes |= 1 << left
            self.open += 1
        return bin_, self.length - free


PACKED = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
          "sequence_id bigint, offset bigint")


def pack(documents: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH, open_bins: int = OPEN,
         with_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes: a row per piece, as :data:`PACKED`,
    and with ``with_ids`` the ids themselves (little-endian, 32 bits unsigned).

    ``documents`` holds (doc_id long, text string); other columns are ignored,
    whatever their names. A document is its ids and ``end_id``; null and empty
    texts are ``end_id`` alone. Only documents longer than a sequence are cut.
    Repeated and null doc_ids are packed like any others. An empty table gives
    no rows. A sequence number holds the number of the task in its upper bits,
    so a task that runs again gives the same numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        fit, encode = BestFit(length, open_bins), encoder(vocabulary)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, values, offsets in encode.encode(batch.column("text")):
                rows = []
                for k in range(len(offsets) - 1):
                    whole = np.append(values[offsets[k]:offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), length)):
                        data = whole[start:start + length].tobytes()
                        bin_, offset = fit.place(len(data) // 4)
                        rows.append((doc_ids[first + k], piece, start, len(data) // 4, zlib.crc32(data),
                                     base + bin_, offset, data))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows))[:len(kinds)], kinds)], names=names)

    kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5 + [pa.binary()] * with_ids
    schema = PACKED + ", ids binary" * with_ids
    names = [field.split()[0] for field in schema.split(", ")]
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lean(only(run, encoder_key(vocabulary))), schema)
