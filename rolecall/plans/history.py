"""Summaries over everything stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolecall.functions.classification import classify
from rolecall.functions.taxonomy import DEFAULT_TAXONOMY, Taxonomy
from rolecall.operators.summary import category_summary, tag_summary
from rolecall.sources.postings import read_postings


def reclassified(stored: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY,
                 title_only: bool = False) -> DataFrame:
    """Stored postings, classified again. Day files hold no description, so
    there the title alone decides; ``title_only`` does the same for a store
    that has it."""
    return classify(stored, taxonomy=taxonomy, title_only=title_only)


def history_summary(spark: SparkSession, root: str,
                    taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> tuple[DataFrame, DataFrame]:
    """Category and tag summary over all day files below ``root``."""
    jobs = reclassified(read_postings(spark, root), taxonomy)
    return category_summary(jobs, categories=taxonomy.categories), tag_summary(jobs)
