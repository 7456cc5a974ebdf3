"""The search cycle as one lazy plan: pages to classified postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolecall.functions.classification import classify
from rolecall.functions.taxonomy import DEFAULT_TAXONOMY, Taxonomy
from rolecall.operators.dedup import dedup_exact, dedup_with_expiry
from rolecall.operators.joins import enrich_description, with_keys
from rolecall.operators.matching import limit_per_spec, match_specs
from rolecall.sources.extract import details, extract_cards, link_cards, list_cards
from rolecall.sources.specs import DEFAULT_TTL_SECONDS, SearchSpec, enabled


def search(postings: DataFrame, specs: list[SearchSpec], order_by: list[str],
           taxonomy: Taxonomy = DEFAULT_TAXONOMY, **match_options) -> DataFrame:
    """Each search's first postings, classified. ``name`` is the search.

    Postings are classified after the limit, when few are left.
    """
    specs = enabled(specs)
    matches = match_specs(postings, specs, **match_options)
    chosen = limit_per_spec(matches, order_by, specs)
    return classify(chosen.withColumn("name", F.col("spec")).drop("spec", "max_results"),
                    taxonomy=taxonomy)


def list_postings(list_pages: DataFrame, detail_pages: DataFrame,
                  scraped_at: Column | None = None) -> DataFrame:
    """Postings of list pages, with the descriptions of their detail pages."""
    cards = list_cards(extract_cards(list_pages, "list"), scraped_at)
    return enrich_description(cards, details(detail_pages, "list"))


def link_postings(link_pages: DataFrame, as_of, scraped_at: Column | None = None) -> DataFrame:
    """Postings of the run date from link pages; they hold no description."""
    return link_cards(extract_cards(link_pages, "link"), as_of, scraped_at=scraped_at)


def remember(postings: DataFrame, order_by: list[str], ttl_seconds: int | None = DEFAULT_TTL_SECONDS,
             ts: str = "scraped_at", id: str = "id", empty_description: str = "collapse") -> DataFrame:
    """Postings not seen before, ahead of any search: with a clock per company,
    or, without ``ttl_seconds``, for good."""
    keyed = with_keys(postings, empty_description=empty_description)
    if ttl_seconds is None:
        return dedup_exact(keyed, order_by)
    return dedup_with_expiry(keyed, ttl_seconds, ts, id)


def with_id(postings: DataFrame, keys: tuple[str, ...] = ("page_id", "seq")) -> DataFrame:
    """Adds a sortable ``id`` from the place a posting was found at."""
    return postings.withColumn("id", F.concat_ws(
        "-", *[F.lpad(F.col(k).cast("string"), 19, "0") for k in keys]))
