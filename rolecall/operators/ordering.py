"""First rows, pages and prefixes of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rolecall.operators.joins import salted_join


def keep_first(df: DataFrame, key: list[str], order_by: list) -> DataFrame:
    """The first row of each key; null keys form one group.

    Spark picks the first row of each key within every task before the shuffle
    (window group limit), so copies of a hot key never meet in one task.
    """
    first = Window.partitionBy(*key).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def newest_first(postings: DataFrame, age: str = "posted_time", tie: str = "url") -> DataFrame:
    """Least age first; unknown ages last."""
    return postings.orderBy(F.asc_nulls_last(age), tie)


def page(postings: DataFrame, start: int, size: int = 10, order_by: list | None = None) -> DataFrame:
    """``size`` rows from ``start`` on, in the order given."""
    ordered = postings.orderBy(*order_by) if order_by else newest_first(postings)
    return ordered.offset(start).limit(size)


def pages_until_empty(cards: DataFrame, run: str, page: str, valid: Column, first: int = 0) -> DataFrame:
    """The valid cards of each run, page by page from ``first`` on until a page has none.

    A page that is missing has none either; cards without a run or page are in none. Where a run ends is a matter of its pages
    alone: a page with valid cards whose next page has none may be the last, and the
    first of those is. Joins and aggregates by run and page; no run is sorted or numbered.
    """
    good = cards.where(F.coalesce(valid, F.lit(False)))
    pages = good.groupBy(run, page).agg(F.lit(1).alias("_one")).select(run, F.col(page).cast("bigint").alias("_page"))
    starts = pages.groupBy(run).agg(F.lit(first - 1).cast("bigint").alias("_page"))
    known = pages.where(F.col("_page") >= first).unionByName(starts)
    following = known.select(run, (F.col("_page") - 1).alias("_page"))
    ends = known.join(following, [run, "_page"], "left_anti").groupBy(run).agg(F.min("_page").alias("_last"))
    joined = salted_join(good, ends, [run], "inner", spread_by=[page])
    return joined.where(F.col(page).between(F.lit(first), F.col("_last"))).drop("_last")


def take_while(rows: DataFrame, run: str, seq: str, stop: Column,
               short_runs: bool = False) -> DataFrame:
    """Rows of each run before its first row for which ``stop`` holds.

    The place of that row is an aggregate, so a long run is not brought
    together; rows are then compared with it. Where runs are known to be short,
    as the cards of one page are, a window spares the second look at the rows.
    """
    marked = rows.withColumn("_stop", F.coalesce(stop, F.lit(False)))
    if short_runs:
        so_far = Window.partitionBy(run).orderBy(seq).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return (marked.withColumn("_stops", F.count_if("_stop").over(so_far))
                .where("_stops = 0").drop("_stop", "_stops"))
    ends = (marked.groupBy(run).agg(F.min(F.when(F.col("_stop"), F.col(seq))).alias("_end"))
            .where(F.col("_end").isNotNull()))
    joined = salted_join(marked, ends, [run], "left", spread_by=[seq])
    return (joined.where(F.col("_end").isNull() | (F.col(seq) < F.col("_end")))
            .drop("_stop", "_end"))
