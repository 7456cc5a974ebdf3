"""A store of postings in versions, each of which is there whole or not at all.

A merge writes the partitions it changes to a folder of its own, then a table that says
which folder holds each partition, and gives that table its number by one rename::

    data/commit_id=<id>/name=../year=../month=../day=../*.parquet
    months/commit_id=<id>/name=../year=../month=../*.parquet
    prepared/<id>      tables that have no number yet
    versions/<number>  tables that have

A merge of many days with few rows each writes a folder per month, with the day as a column,
and of days as before only those it changes: the table says for each day which commit has it.

Until the rename, readers see the version before; a merge that dies leaves folders that no
version names. Of two merges that want one number one gets it, and the other merges again
with what it finds then. Folders that a version names are never written again, so a reader
of a version isn't disturbed by later ones.
"""

from __future__ import annotations

import functools
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from rolecall.session import materialize, shared_files
from rolecall.sources.postings import STORE_PARTITIONS, folders_for, in_partitions, partitions_last, store_exists
from rolecall.sources.sinks import first_of_url, upsert_postings

COMMIT = "commit_id"
KEYS = list(STORE_PARTITIONS)

#: Where the folders of commits are, by the number of partition columns that are folders.
PLACES = {len(KEYS): "data", len(KEYS) - 1: "months"}

#: Key of the metadata that a table of folders keeps the columns of the store under.
COLUMNS = "columns"


class VersionedStore:
    """Postings with partition columns, below ``path``.

    ``merge`` keeps what is stored and adds the first of each new url of a partition, as
    ``write_postings`` does. A null and an empty partition value are the same one. Columns
    that stored rows or new ones lack are null there. A batch without rows makes a version
    like the one before. A column named ``commit_id`` is refused.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def versions(self, spark: SparkSession) -> list[int]:
        """The numbers of all versions that are kept, oldest first."""
        return sorted(int(f.getPath().getName()) for f in self._listed(spark, "versions"))

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named. One that isn't there is an error."""
        known = self.versions(spark)
        if not known or (version is not None and version not in known):
            raise ValueError(f"no version {'' if version is None else version} of a store in {self.path}")
        return self._rows(self._folders(spark, known[-1] if version is None else version))

    def merge(self, postings: DataFrame) -> int:
        """Adds postings; returns the number of the version that has them."""
        if COMMIT in postings.columns:
            raise ValueError(f"postings must not have a column {COMMIT}")
        spark = postings.sparkSession
        named = postings.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in STORE_PARTITIONS})
        # Used for the rows and for the partitions, and again if another merge comes first.
        new = materialize(first_of_url(named), "new-postings")
        touched = new.select(*STORE_PARTITIONS).distinct()
        while True:
            known = self.versions(spark)
            folders = self._folders(spark, known[-1]) if known else None
            number = known[-1] + 1 if known else 1
            if self._publish(spark, self._write(new, touched, folders), number):
                return number

    def vacuum(self, spark: SparkSession, keep: int, idle_seconds: float = 86400) -> None:
        """Deletes all versions but the latest ``keep``, and folders that none of those names.

        Folders that were touched within ``idle_seconds`` stay: a merge may be at work on
        them. Readers of a version that goes will fail.
        """
        if keep < 1:
            raise ValueError("at least one version has to stay")
        known = self.versions(spark)
        files, _ = shared_files(spark, self.path)
        for number in known[:-keep]:
            files.delete(shared_files(spark, self._version(number))[1], True)
        named = {r[COMMIT] for number in known[-keep:]
                 for r in self._folders(spark, number).select(COMMIT).distinct().toLocalIterator()}
        before = (time.time() - idle_seconds) * 1000
        for place in (*PLACES.values(), "prepared"):
            for status in self._listed(spark, place):
                commit = status.getPath().getName().removeprefix(f"{COMMIT}=")
                if commit not in named and status.getModificationTime() <= before:
                    files.delete(status.getPath(), True)

    def _version(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}"

    def _listed(self, spark: SparkSession, place: str) -> list:
        files, folder = shared_files(spark, f"{self.path}/{place}")
        return list(files.listStatus(folder)) if files.exists(folder) else []

    def _folders(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.parquet(self._version(number))

    def _rows(self, folders: DataFrame, touched: DataFrame | None = None) -> DataFrame:
        """The rows that a table of folders names; only those of the partitions ``touched``.
        The table has a row per partition; it prunes the folders that are read."""
        columns = T.StructType.fromJson(folders.schema[COMMIT].metadata[COLUMNS])
        if touched is not None:
            folders = in_partitions(folders, touched, KEYS, "left_semi")
        spark, columns = folders.sparkSession, columns.add(COMMIT, "string")
        # One by one, as partitions are not pruned through a union.
        found = [in_partitions(spark.read.schema(columns).parquet(place), folders, [COMMIT, *KEYS], "left_semi")
                 for place in (f"{self.path}/{p}" for p in PLACES.values()) if store_exists(spark, place)]
        return functools.reduce(DataFrame.unionByName, [partitions_last(rows.drop(COMMIT)) for rows in found])

    def _write(self, new: DataFrame, touched: DataFrame, folders: DataFrame | None) -> str:
        """Writes the partitions at hand, and the table of folders with them in it."""
        commit, within = uuid.uuid4().hex, folders_for(new)
        if folders is not None:
            new = upsert_postings(self._rows(folders, touched), new, within=STORE_PARTITIONS)
        (new.hint("rebalance", *map(F.col, within)).write.partitionBy(*within)
         .parquet(f"{self.path}/{PLACES[len(within)]}/{COMMIT}={commit}"))
        held = touched.withColumn(COMMIT, F.lit(commit))
        if folders is not None:
            held = in_partitions(folders, touched, KEYS, "left_anti").unionByName(held)
        # Stored columns may be null in folders written before they came.
        columns = T.StructType([T.StructField(f.name, f.dataType) for f in new.schema])
        described = F.col(COMMIT).alias(COMMIT, metadata={COLUMNS: columns.jsonValue()})
        held.select(*STORE_PARTITIONS, described).write.parquet(f"{self.path}/prepared/{commit}")
        return commit

    def _publish(self, spark: SparkSession, commit: str, number: int) -> bool:
        """Gives a prepared table its number, unless another has it."""
        files, target = shared_files(spark, self._version(number))
        _, source = shared_files(spark, f"{self.path}/prepared/{commit}")
        files.mkdirs(target.getParent())
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(
            files.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        replace_nothing = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(source), files.makeQualified(target), replace_nothing)
        except Py4JJavaError:
            # Whoever has the number, a lost table would be an error of its own.
            if files.exists(target) and files.exists(source):
                return False
            raise
        return True
