"""Token ids in files of independent zstandard frames with a seek table.

A file holds one frame per document (its ids, little-endian, 32 bits unsigned),
then a frame with the document ids, then a skippable frame with the compressed
size, the size and a checksum of each frame (the seekable format of zstandard).
Any zstandard reader can read a file whole; one that knows the table fetches and
decompresses only the frames of the documents it is asked for.

Files are written by tasks under names of their own. A manifest, written by
Spark, names those that count, so a task that is lost and run again does no harm.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rolecall.llm.tokens import encoder
from rolecall.session import materialize, scratch_path

# Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
FOOTER, FOOTER_SIZE = "<IBI", 9
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])

LEVEL = 3

#: Documents of a file that one task reads back together.
DOCUMENTS_A_TASK = 8192

#: What a document without an id has in the id frame.
NO_ID = np.iinfo(np.int64).min


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes a file frame by frame."""

    def __init__(self, path: str):
        system, inner = open_path(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(inner, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int] = []

    def _frame(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), _checksum(data)))

    def document(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._frame(ids.astype("<u4").tobytes())
        self.ids.append(NO_ID if doc_id is None else doc_id)

    def close(self) -> None:
        self._frame(np.array(self.ids, "<i8").tobytes())
        table = np.array(self.table, ENTRY).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + FOOTER_SIZE))
        self.out.write(table)
        self.out.write(struct.pack(FOOTER, len(self.table), WITH_CHECKSUMS, SEEKABLE_MAGIC))
        self.out.close()


class FrameReader:
    """Reads frames of a file by number, or documents by id."""

    def __init__(self, path: str):
        system, inner = open_path(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        frames, flags, magic = struct.unpack(FOOTER, self._at(size - FOOTER_SIZE, FOOTER_SIZE))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        length = frames * ENTRY.itemsize
        self.table = np.frombuffer(self._at(size - FOOTER_SIZE - length, length), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()
        self.ids = np.frombuffer(self._frame(frames - 1), "<i8")

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(int(start))
        return self.file.read(int(size))

    def _frame(self, number: int, packed: bytes | None = None) -> bytes:
        entry = self.table[number]
        packed = self._at(self.starts[number], entry["packed"]) if packed is None else packed
        data = self.unpacker.decompress(packed, max_output_size=int(entry["size"]))
        if len(data) != entry["size"] or _checksum(data) != entry["checksum"]:
            raise ValueError(f"frame {number} is damaged")
        return data

    @property
    def lengths(self) -> np.ndarray:
        """Tokens of each document, from the table alone."""
        return self.table["size"][:-1].astype(np.int64) // 4

    def documents(self, first: int, end: int) -> Iterator[np.ndarray]:
        """The ids of documents by number; neighbours are fetched a few MB at a time."""
        while first < end:
            stop = int(np.searchsorted(self.starts, self.starts[first] + (4 << 20), side="right")) - 1
            stop = min(max(stop, first + 1), end)
            low = self.starts[first]
            block = self._at(low, self.starts[stop] - low)
            for k in range(first, stop):
                yield np.frombuffer(self._frame(k, block[self.starts[k] - low:self.starts[k + 1] - low]), "<u4")
            first = stop

    def find_all(self, doc_ids: Iterable[int | None]) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of every document here that has one of the ids asked for, in file
        order; documents may share an id, and ``None`` asks for those without one. No
        others are decompressed."""
        asked = np.array([NO_ID if i is None else i for i in doc_ids], np.int64)
        for k in np.flatnonzero(np.isin(self.ids, asked)).tolist():
            doc_id = int(self.ids[k])
            yield None if doc_id == NO_ID else doc_id, next(self.documents(k, k + 1))

    def find(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        """The documents asked for that are here, by id. An id that several documents share
        is an error; :meth:`find_all` gives each of them."""
        found = {}
        for doc_id, ids in self.find_all(doc_ids):
            if doc_id in found:
                raise ValueError(f"several documents have the id {doc_id}")
            found[doc_id] = ids
        return found

    def close(self) -> None:
        self.file.close()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, as tasks need it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = system.makeQualified(place).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


MANIFEST = "part int, path string, documents bigint, tokens bigint, bytes bigint"


def write_tokens(documents: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encodes all texts and writes them in ascending doc_id order; returns the
    manifest: (part, path, documents, tokens, bytes), parts in order.

    ``documents`` holds (doc_id long, text string); other columns are ignored,
    whatever their names. Null and empty texts are documents of ``end_id`` alone.
    Repeated doc_ids stay, in the order of a hash of their texts; rows without a
    doc_id come last. An empty table gives no files.
    """
    spark = documents.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "tokens"))
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ordered = (documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .repartitionByRange(*keys).sortWithinPartitions(*keys))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        writer, tokens, encode = None, 0, encoder(vocabulary)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, values, offsets in encode.encode(batch.column("text")):
                writer = writer or FrameWriter(path)
                for k in range(len(offsets) - 1):
                    whole = np.append(values[offsets[k]:offsets[k + 1]], np.uint32(end_id))
                    writer.document(ids[first + k], whole)
                    tokens += len(whole)
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([part], pa.int32()), [path], [len(writer.ids)], [tokens],
                                   [sum(t[0] for t in writer.table)]],
                                  names=["part", "path", "documents", "tokens", "bytes"])

    return materialize(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents of the files, ids as
    little-endian bytes. Every frame is checked against its checksum."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    slices = placed.withColumn("first", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("documents") - 1, F.lit(DOCUMENTS_A_TASK).cast("bigint"))))
    slices = slices.select("path", "base", "first").repartition("path", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = FrameReader(row["path"])
                lengths, first = reader.lengths, row["first"]
                end = min(first + DOCUMENTS_A_TASK, len(lengths))
                starts = row["base"] + np.cumsum(lengths) - lengths
                found = reader.documents(first, end)
                for low in range(first, end, 512):
                    high = min(low + 512, end)
                    known = reader.ids[low:high]
                    yield pa.record_batch(
                        [pa.array(known, mask=known == NO_ID), pa.array(starts[low:high]), pa.array(lengths[low:high]),
                         pa.array([next(found).tobytes() for _ in range(low, high)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
                reader.close()

    return slices.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
