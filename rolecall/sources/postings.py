"""Reading stored postings: day files as text, and the Parquet store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from rolecall import schemas
from rolecall.functions.text import parse_tags
from rolecall.session import shared_files

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "encoding": "UTF-8"}

STORE_PARTITIONS = ("name", "year", "month", "day")

#: A store gets a folder per day, unless its first postings are of more days than this, with
#: fewer postings each: a file costs as much as thousands of rows, so those get one per month.
MANY_FOLDERS, FEW_ROWS = 256, 1000


def read_postings(spark: SparkSession, root: str, skip_unreadable: bool = False) -> DataFrame:
    """All day files below ``root``: any path with ``_jobs_`` in the name of a
    CSV file (or of a folder Spark wrote for one), none with ``summary`` in it.

    Values come back typed, whatever earlier rewrites made of them. A file that
    cannot be read is an error; with ``skip_unreadable`` its rows are left out,
    and Spark logs its name.
    """
    raw = (spark.read.schema(schemas.CSV_POSTINGS).options(**CSV_OPTIONS)
           .option("recursiveFileLookup", "true")
           .option("ignoreCorruptFiles", str(skip_unreadable).lower())
           .option("pathGlobFilter", "*.csv").csv(root))
    # Constant file columns are pruned before any file is opened.
    below = F.substring_index(F.col("_metadata.file_path"), root.rstrip("/"), -1)
    day_files = raw.where(below.rlike(r"_jobs_[^/]*\.csv(/|$)") & ~below.contains("summary"))
    return typed_postings(day_files)


def typed_postings(raw: DataFrame) -> DataFrame:
    """Text columns of a day file as posting columns."""
    def text(name):
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    return raw.select(
        text("title"), "company", "location", text("url"),
        F.lit("").alias("description"), "source",
        F.col("posted_date").try_cast("date").alias("posted_date"),
        F.col("posted_time").try_cast("double").try_cast("bigint").alias("posted_time"),
        F.col("scraped_at").try_cast("timestamp").alias("scraped_at"),
        "category", parse_tags("tags").alias("tags"),
        F.col("classification_confidence").try_cast("double").alias("classification_confidence"))


def read_store(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table. One that cannot be read is an error.

    Partition values are text ("01"), not the numbers Spark would take them for.
    """
    if schema is None:
        found = spark.read.parquet(path).schema
        schema = T.StructType([
            T.StructField(f.name, T.StringType()) if f.name in STORE_PARTITIONS else f for f in found])
    return partitions_last(spark.read.schema(schema).parquet(path))


def partitions_last(rows: DataFrame) -> DataFrame:
    """With the partition columns at the end, where Spark puts those that are folders."""
    keys = [c for c in STORE_PARTITIONS if c in rows.columns]
    ordered = [c for c in rows.columns if c not in keys] + keys
    return rows if ordered == rows.columns else rows.select(*ordered)


def folders_for(rows: DataFrame) -> tuple[str, ...]:
    """The partition columns that are folders in a store that begins with ``rows``; what is
    left of them is a column of its files."""
    days = rows.groupBy(*STORE_PARTITIONS).agg(F.count("*").alias("rows"))
    count, total = days.agg(F.count("*"), F.sum("rows")).first()
    return STORE_PARTITIONS[:-1] if count > MANY_FOLDERS and total < FEW_ROWS * count else STORE_PARTITIONS


def store_folders(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The partition columns that are folders in the store that is there."""
    files, place = shared_files(spark, path)
    found: tuple[str, ...] = ()
    while below := next((f for f in files.listStatus(place) if f.isDirectory() and "=" in f.getPath().getName()), None):
        place = below.getPath()
        found += (place.getName().split("=")[0],)
    return found or STORE_PARTITIONS


def store_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is there. Whatever else is wrong with it is an error."""
    files, place = shared_files(spark, path)
    return files.exists(place)


def read_existing(spark: SparkSession, path: str, touched: DataFrame,
                  partitions: tuple[str, ...] = STORE_PARTITIONS) -> DataFrame:
    """The stored rows of the partitions that ``touched`` names; null is a partition, too,
    and an empty value is stored as null."""
    keys = [c for c in partitions if c in touched.columns]
    # A few searches times a few days, so this side is checked to stay small by
    # the planner's own threshold; it also prunes the partitions to read.
    return in_partitions(read_store(spark, path), touched.select(*keys).distinct(), keys, "left_semi")


def in_partitions(rows: DataFrame, named: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` whose partition is, or isn't, in ``named``, by plain equality with null as
    empty text: Spark prunes partitions by that, not by null-safe equality, and only where
    the other side has a comparison, which here is true of every row."""
    def told(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    other = named.select(*[told(c).alias(f"_{c}") for c in keys]).where(F.col(f"_{keys[0]}") >= "")
    return rows.join(other, [told(c) == F.col(f"_{c}") for c in keys], how)


def read_postings_stream(spark: SparkSession, path: str, schema,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """Postings as they arrive in a folder of Parquet files."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)
