"""Searches that run at times of their own.

A search with an interval of n seconds runs at every multiple of n, counted from the
epoch, and sees what has arrived since its run before. A posting so belongs to one run of
each search that it matches, and which one follows from its time alone: no state is kept
for that, and runs of all searches are one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolecall.operators.matching import match_specs
from rolecall.sources.specs import SearchSpec, enabled

MICROS = 1_000_000


def due_at(ts: str | Column, interval: Column) -> Column:
    """When a search of that interval, in seconds, next runs after a time."""
    width = interval.cast("bigint") * MICROS
    return F.timestamp_micros((F.floor(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / width) + 1) * width)


def due_matches(postings: DataFrame, specs: list[SearchSpec], ts: str = "ts", **match_options) -> DataFrame:
    """The matches of all enabled searches, each with ``due_at``, the run that finds it.
    A posting without a time is found by none. Without searches there are no rows."""
    specs = enabled(specs)
    matches = match_specs(postings, specs, **match_options).where(F.col(ts).isNotNull())
    interval = F.lit(None).cast("bigint")
    for spec in specs:
        interval = F.when(F.col("spec") == spec.name, spec.interval).otherwise(interval)
    return matches.withColumn("due_at", due_at(F.col(ts).cast("timestamp"), interval))


def found_by_run(matches: DataFrame) -> DataFrame:
    """(name, due_at, found): what each run of each search found, from :func:`due_matches`."""
    return matches.groupBy(F.col("spec").alias("name"), "due_at").agg(F.count("*").alias("found"))


def watched(matches: DataFrame, specs: list[SearchSpec], late_seconds: int = 0) -> DataFrame:
    """Matches of a stream with a watermark on their runs: :func:`found_by_run` in append
    mode then gives a run once postings ``late_seconds`` after its time have arrived. The
    time of a run is ahead of its postings by an interval at most, hence the longest one."""
    longest = max((spec.interval for spec in enabled(specs)), default=0)
    return matches.withWatermark("due_at", f"{longest + late_seconds} seconds")
