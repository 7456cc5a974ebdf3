"""Remembered postings as a log: what each batch added and forgot, and now and then a base.

A batch appends its new postings and the companies whose sets ran out; nothing stored is
read to write that. Every :attr:`SeenLog.compact_every` batches what is remembered by then
is written as a base, and readers start from the last one. Which files hold the state
before a batch follows from its number alone, so a batch that is repeated after a failure
reads what it read before and writes over what it left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecall import schemas
from rolecall.operators.dedup import KEYS, batch_changes, seen_after
from rolecall.sources.postings import read_store

LAPSED = "company_key string, _expiry timestamp"


@dataclass(frozen=True)
class SeenLog:
    """The log in a shared folder. Batches are numbered from 0 without gaps."""

    folder: str
    compact_every: int = 16

    def __post_init__(self) -> None:
        if self.compact_every < 1:
            raise ValueError(f"compact_every must be positive, got {self.compact_every}")

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _read(self, spark: SparkSession, kind: str, batches: range, schema) -> DataFrame:
        if not batches:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[self._path(kind, b) for b in batches])

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """(company_key, content_hash, seen_at): what is remembered when a batch begins."""
        start = batch - batch % self.compact_every
        if start and start == batch:
            return read_store(spark, self._path("base", start), schemas.SEEN)
        base = (read_store(spark, self._path("base", start), schemas.SEEN) if start
                else spark.createDataFrame([], schemas.SEEN))
        since = range(start, batch)
        added = self._read(spark, "added", since, schemas.SEEN).withColumnRenamed("seen_at", "ts")
        return seen_after(base, added, self._read(spark, "lapsed", since, LAPSED))

    def append(self, rows: DataFrame, batch: int, ttl_seconds: int) -> DataFrame:
        """The new postings among ``rows`` (company_key, content_hash, ts, id); remembers them."""
        spark = rows.sparkSession
        news, lapsed = batch_changes(rows, ttl_seconds, self.before(spark, batch))
        news.select(*KEYS, F.col("ts").alias("seen_at")).write.mode("overwrite").parquet(self._path("added", batch))
        lapsed.write.mode("overwrite").parquet(self._path("lapsed", batch))
        if (batch + 1) % self.compact_every == 0:
            start = batch + 1 - self.compact_every
            base = (read_store(spark, self._path("base", start), schemas.SEEN) if start
                    else spark.createDataFrame([], schemas.SEEN))
            since = range(start, batch + 1)
            added = self._read(spark, "added", since, schemas.SEEN).withColumnRenamed("seen_at", "ts")
            seen_after(base, added, self._read(spark, "lapsed", since, LAPSED)).write.mode("overwrite").parquet(
                self._path("base", batch + 1))
        return news
