"""Schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(text: str) -> T.StructType:
    """A schema from ``name type [not null], ...``; needs no running session."""
    fields = (part.split(" ", 2) for part in text.split(", "))
    return T.StructType([
        T.StructField(name, _TYPES[kind], nullable=not rest) for name, kind, *rest in fields])


POSTINGS = _struct(
    "title string not null, company string, location string, url string not null, "
    "description string, source string, posted_date date, posted_time bigint, "
    "scraped_at timestamp, category string, tags array<string>, "
    "classification_confidence double"
)

#: Column order of a stored day file; ``description`` is never stored there.
OUTPUT_COLUMNS = [f.name for f in POSTINGS.fields if f.name != "description"]

#: A day file as text. Values are cast with ``try_cast`` after reading, because
#: earlier rewrites may have turned whole numbers into floating ones.
CSV_POSTINGS = T.StructType([T.StructField(name, T.StringType()) for name in OUTPUT_COLUMNS])

PAGES = _struct("page_id bigint, url string, html string")

SEARCH_SPECS = _struct(
    "name string, type string, interval int, enabled boolean, message string, "
    "keywords array<string>, location string, job_type string, workplace_type string, "
    "experience_level string, last_time_posted bigint, excluded_companies array<string>, "
    "max_results int, ttl_seconds bigint"
)

CATEGORY_KEYWORDS = _struct(
    "category string, category_ord int, field string, kw_ord int, keyword string, weight int"
)
TAG_KEYWORDS = _struct("tag_group string, tag string, kw_ord int, keyword string")

#: Remembered postings. The clock of a company is its latest ``seen_at``.
SEEN = _struct("company_key string, content_hash string, seen_at timestamp")

RUNS = _struct("name string, run_id bigint, found bigint")
