"""Writing postings and summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from rolecall import schemas
from rolecall.functions.text import date_parts, iso_timestamp, join_tags
from rolecall.operators.ordering import keep_first
from rolecall.operators.summary import category_summary, tag_summary
from rolecall.session import materialize, shared_files
from rolecall.sources.postings import (
    CSV_OPTIONS, STORE_PARTITIONS, folders_for, read_existing, store_exists, store_folders)


def append_union(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; a column one side lacks is null there."""
    return existing.unionByName(new, allowMissingColumns=True)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without the named columns; names the frame lacks are no error."""
    return df.drop(*columns)


def upsert_postings(existing: DataFrame, new: DataFrame, key: str = "url",
                    within: tuple[str, ...] = (), order_by: tuple[str, ...] = ()) -> DataFrame:
    """Both sets of rows, the first of each key kept: stored rows win over new
    ones, and among new ones the order decides, then the whole row, so that a
    rerun keeps the same one. Without the key column, all rows.
    """
    both = append_union(existing.withColumn("_batch", F.lit(0)), new.withColumn("_batch", F.lit(1)))
    if key not in both.columns:
        return both.drop("_batch")
    order = [c for c in order_by if c in both.columns]
    return keep_first(both, [*within, key], ["_batch", *order, _whole_row(both)]).drop("_batch")


def _whole_row(df: DataFrame):
    return F.xxhash64(*[df[c] for c in sorted(df.columns)])


def with_partitions(postings: DataFrame, name=None, ts: str = "scraped_at") -> DataFrame:
    """Adds the store's partition columns: search, year, month and day."""
    named = postings if name is None else postings.withColumn("name", F.lit(name))
    return named.withColumns(date_parts(ts))


def write_postings(postings: DataFrame, path: str) -> None:
    """Merges postings (with partition columns) into the Parquet store.

    Only the folders at hand are read and rewritten; the first write decides whether
    they are of days or of months (``folders_for``). The write goes to a
    staging folder first, so reading the same partitions is safe, and writing
    the same postings again changes nothing.
    """
    spark = postings.sparkSession
    order = _arrival(postings)
    # Used twice below, so made once; its true size then lets the planner
    # broadcast the partitions at hand and prune the store by them.
    new = materialize(first_of_url(postings), "new-postings")
    if store_exists(spark, path):
        folders = store_folders(spark, path)
        new = upsert_postings(read_existing(spark, path, new, folders), new, within=STORE_PARTITIONS,
                              order_by=tuple(order))
    else:
        folders = folders_for(new)
    # What is no folder is stored as folders are: as text, and an empty one as null.
    new = new.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in STORE_PARTITIONS if c not in folders})
    # One task per small partition, several for a hot one: few files either way.
    balanced = new.hint("rebalance", *map(F.col, folders))
    (balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*folders).parquet(path))


def first_of_url(postings: DataFrame) -> DataFrame:
    """The first posting of each url of a partition, as they arrive."""
    return keep_first(postings, [*STORE_PARTITIONS, "url"], [*_arrival(postings), _whole_row(postings)])


def added_postings(postings: DataFrame, path: str) -> DataFrame:
    """The rows that :func:`write_postings` would add to the store as it is."""
    spark = postings.sparkSession
    keys = [*STORE_PARTITIONS, "url"]
    new = first_of_url(postings)
    if not store_exists(spark, path):
        return new
    new = materialize(new, "new-postings")
    stored = read_existing(spark, path, new).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}").cast(new.schema[k].dataType)) for k in keys]
    return new.join(stored, same, "left_anti")


def _arrival(postings: DataFrame) -> list[str]:
    """Columns that order postings."""
    named = [c for c in ("seq", "scraped_at", "title", "company", "location") if c in postings.columns]
    return named or ["url"]


def to_output_rows(postings: DataFrame, keep_description: bool = False) -> DataFrame:
    """Postings as a day file shows them: tags joined, times as ISO text."""
    rows = postings.withColumns({"tags": join_tags("tags"), "scraped_at": iso_timestamp("scraped_at")})
    columns = schemas.POSTINGS.fieldNames() if keep_description else schemas.OUTPUT_COLUMNS
    return rows.select(*columns)


def day_file(root: str, name: str, day: datetime) -> str:
    return f"{root.rstrip('/')}/{name}/{day:%Y}/{day:%m}/{name}_jobs_{day:%Y%m%d}.csv"


def write_postings_csv(postings: DataFrame, root: str, name: str, day: datetime) -> str:
    """Merges postings into one search's CSV of a day, description dropped.

    What the day's file holds wins, and the first of each url stays. The merged
    file is written aside and then takes the old one's place; a write that was
    lost in between is picked up by the next.
    """
    path = day_file(root, name, day)
    spark = postings.sparkSession
    aside = f"{path}.new"
    files, place = shared_files(spark, path)
    _, beside = shared_files(spark, aside)
    _, written = shared_files(spark, f"{aside}/_SUCCESS")
    if files.exists(written) and not files.exists(place):
        files.rename(beside, place)
    rows = to_output_rows(postings)
    new = rows.select([F.col(c).cast("string") for c in rows.columns])
    stored = spark.createDataFrame([], new.schema)
    if files.exists(place):
        stored = spark.read.schema(schemas.CSV_POSTINGS).options(**CSV_OPTIONS).csv(path).select(*new.columns)
    _write_csv(upsert_postings(stored, new, order_by=tuple(_arrival(new))), aside)
    files.delete(place, True)
    if not files.rename(beside, place):
        raise OSError(f"cannot rename {aside} to {path}")
    return path


def _write_csv(df: DataFrame, path: str) -> None:
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    df.write.mode("overwrite").options(**options).csv(path)


def write_category_summary(summary: DataFrame, path: str) -> None:
    """A handful of rows, so one file."""
    _write_csv(summary.coalesce(1), path)


def write_tag_summary(summary: DataFrame, path: str) -> None:
    """One row per tag, so one file; an empty summary still has its header."""
    _write_csv(summary.coalesce(1), path)


def write_summaries(jobs: DataFrame, folder: str, prefix: str = "", seq: str | None = None) -> None:
    """Category and tag shares as two files."""
    _write_both(category_summary(jobs), tag_summary(jobs, seq=seq), folder, prefix)


def _write_both(categories: DataFrame, tags: DataFrame, folder: str, prefix: str) -> None:
    start = f"{folder.rstrip('/')}/{prefix + '_' if prefix else ''}"
    write_category_summary(categories, f"{start}categories_summary.csv")
    write_tag_summary(tags, f"{start}tags_summary.csv")


def write_monthly_and_total(batch: DataFrame, root: str, name: str, day: datetime,
                            history: DataFrame | None = None, seq: str | None = None) -> None:
    """The summary of a batch in its month's folder, and the total one.

    The total covers ``history`` where given, else the batch once more.
    """
    root = root.rstrip("/")
    monthly, total = f"{root}/summary/{day:%Y}/{day:%m}", f"{root}/summary"
    if history is not None:
        write_summaries(batch, monthly, name, seq)
        write_summaries(history, total, f"{name}_total", seq)
        return
    # Counted once, written to both places; one file keeps the order.
    categories = materialize(category_summary(batch).coalesce(1), "categories")
    tags = materialize(tag_summary(batch, seq=seq).coalesce(1), "tags")
    _write_both(categories, tags, monthly, name)
    _write_both(categories, tags, total, f"{name}_total")
