"""Joins whose keys may be skewed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolecall.functions import text

#: Copies of the small side in a salted join.
SALTS = 16

#: Rows up to which the planner may broadcast a side that it takes for small.
BROADCAST_ROWS = 100_000


def by_rows(side: DataFrame, rows: int, copies: int = 1) -> DataFrame:
    """A side of a join for which the planner has the size of its files only. Many short
    rows make small files and large broadcasts, which pass through the driver, so beyond
    ``BROADCAST_ROWS`` copies it is shuffled."""
    return side.hint("merge") if rows * copies > BROADCAST_ROWS else side


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str,
                spread_by: list[str], salts: int = SALTS, rows: int | None = None) -> DataFrame:
    """Join where one key of ``big`` may hold a third of its rows.

    The rows of a key are spread over ``salts`` groups and ``small``, which has
    few rows per key, is copied to each. Spark still broadcasts ``small`` where
    its measured size allows, and where ``rows``, if told, are few.
    """
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if rows is not None:
        copies = by_rows(copies, rows, salts)
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def with_keys(postings: DataFrame, company: str = "company", description: str = "description",
              empty_description: str = "collapse") -> DataFrame:
    """Adds ``company_key`` and ``content_hash``.

    Postings of a company without description are one and the same content
    (``collapse``), or told apart by their url (``by_url``).
    """
    if empty_description not in ("collapse", "by_url"):
        raise ValueError(f"unknown empty_description {empty_description!r}")
    content = F.col(description)
    if empty_description == "by_url":
        content = F.coalesce(text.non_empty(text.strip(content)), F.col("url"))
    return postings.withColumns({
        "company_key": text.company_key(company),
        "content_hash": text.content_hash(content),
    })


def enrich_description(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Cards with the description of their url; empty without a detail page.
    ``details`` holds one row per url."""
    side = details.select("url", F.col("description").alias("_detail"))
    return (cards.drop("description").join(side, "url", "left")
            .withColumn("description", F.coalesce("_detail", F.lit("")))
            .drop("_detail"))


def seen_before(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings whose company and content are remembered."""
    return _semi(postings, seen, "left_semi")


def new_only(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings whose company and content are not remembered."""
    return _semi(postings, seen, "left_anti")


def _semi(postings: DataFrame, seen: DataFrame, how: str) -> DataFrame:
    # One key can hold many postings; adaptive execution splits those of a hot
    # key, because a semi join repeats nothing of the remembered side.
    keys = seen.select("company_key", "content_hash")
    return postings.join(keys, ["company_key", "content_hash"], how)


def store_seen(seen: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Writes remembered postings as a table in buckets of company and content. What is
    joined with it on these is dealt to the same buckets, and the table stays where it is."""
    (seen.write.mode("overwrite").option("path", path).bucketBy(buckets, "company_key", "content_hash")
     .sortBy("company_key", "content_hash").saveAsTable(name))
    return seen.sparkSession.table(name)


def zero_fill_categories(counts: DataFrame, categories: list[str]) -> DataFrame:
    """Every category with its count; unlisted ones are left out."""
    spark = counts.sparkSession
    listed = spark.createDataFrame(list(enumerate(categories)), "category_ord int, category string")
    # At most one row per listed category survives, so this side is tiny.
    found = counts.where(F.col("category").isin(categories)).groupBy("category").agg(
        F.sum("job_count").alias("job_count"))
    return (listed.join(F.broadcast(found), "category", "left")
            .withColumn("job_count", F.coalesce("job_count", F.lit(0)).cast("bigint")))
