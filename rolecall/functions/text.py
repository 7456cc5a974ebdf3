"""Scalar columns over posting fields. Everything here is a plain Spark
expression, so it stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Every character Unicode counts as white space (``trim`` alone knows only the space).
WHITESPACE = "".join(filter(str.isspace, map(chr, range(0x3001))))

#: The unit seconds of "N units ago".
UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def non_empty(c: Column | str) -> Column:
    """The value, or null when it is the empty text."""
    return F.nullif(_col(c), F.lit(""))


def normalize_text(c: Column | str) -> Column:
    """Lower case without surrounding white space; null counts as empty."""
    return strip(F.lower(text_or_empty(c)))


def company_key(c: Column | str) -> Column:
    return F.concat(F.lit("job:company:"), F.replace(normalize_text(c), F.lit(" "), F.lit("_")))


def content_hash(c: Column | str) -> Column:
    # Never null, and told so: a join would else test the hash for null, and
    # for that make it a second time.
    return F.coalesce(F.sha2(normalize_text(c), 256), F.lit(""))


def strip_query(c: Column | str) -> Column:
    return F.substring_index(_col(c), "?", 1)


def absolute_url(c: Column | str, base: str) -> Column:
    c = _col(c)
    return (F.when(c.startswith("/"), F.concat(F.lit(base), c))
            .when(~c.startswith("http"), F.concat(F.lit(base + "/"), c))
            .otherwise(c))


def age_seconds(c: Column | str) -> Column:
    """Seconds in "30 minutes ago"; null for anything else."""
    pattern = r"(?U)(\d+)\s+(minute|hour|day)s?\s+ago"
    lowered = F.lower(_col(c))
    unit = F.regexp_extract(lowered, pattern, 2)
    seconds = F.lit(None).cast("bigint")
    for name, value in UNIT_SECONDS.items():
        seconds = F.when(unit == name, F.lit(value).cast("bigint")).otherwise(seconds)
    return F.try_multiply(F.regexp_extract(lowered, pattern, 1).try_cast("bigint"), seconds)


def parse_posted_date(c: Column | str) -> Column:
    """Date of "Posted on Nov 4, 2025" or "November 4, 2025"; null otherwise."""
    text = strip(F.replace(_col(c), F.lit("Posted on "), F.lit("")))
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    text = F.when(text.rlike(r"^\p{L}+ \d{1,2}, \d{4}$"), text)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("MMM d, yyyy")),
        F.try_to_timestamp(text, F.lit("MMMM d, yyyy")),
    ).cast("date")


def is_on(day: Column | str, as_of) -> Column:
    """Whether a date is the run date, which is always passed in."""
    return _col(day) == F.lit(as_of).cast("date")


def split_record(c: Column | str, separator: str = "·") -> Column:
    """The stripped first three parts as a struct, or null with fewer parts."""
    parts = F.split(_col(c), separator)
    return F.when(F.size(parts) >= 3, F.struct(
        strip(F.get(parts, F.lit(0))).alias("company"),
        strip(F.get(parts, F.lit(1))).alias("location"),
        strip(F.get(parts, F.lit(2))).alias("posted"),
    ))


def first_line(c: Column | str) -> Column:
    return strip(F.substring_index(_col(c), "\n", 1))


def title_fallback(headings: list[Column], link_text: Column, company: Column) -> Column:
    """First non-empty heading, else first line of the link text, else the company."""
    return F.coalesce(
        *[non_empty(strip(h)) for h in headings],
        non_empty(first_line(strip(link_text))),
        company,
    )


def card_defaults(title: Column, company: Column, location: Column) -> dict[str, Column]:
    """Values for what a card does not show."""
    return {
        "title": F.coalesce(title, F.lit("Unknown")),
        "company": F.coalesce(company, F.lit("Unknown")),
        "location": F.coalesce(location, F.lit("Not specified")),
    }


def label(title="title", company="company", location="location") -> Column:
    return F.format_string("%s at %s (%s)", _col(title), _col(company), _col(location))


def join_tags(tags: Column | str = "tags") -> Column:
    return F.coalesce(F.concat_ws(",", _col(tags)), F.lit(""))


def parse_tags(c: Column | str) -> Column:
    """Comma text to an array without empty entries."""
    return F.filter(F.transform(F.split(text_or_empty(c), ","), strip), lambda t: t != "")


def iso_timestamp(c: Column | str) -> Column:
    """ISO text, with the fraction only when there is one."""
    c = _col(c)
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
                  ).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def date_parts(ts: Column | str) -> dict[str, Column]:
    ts = _col(ts)
    return {"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"),
            "day": F.date_format(ts, "yyyyMMdd")}


def search_expression(keywords: Column, excluded: Column) -> Column:
    """``(k1 AND k2) NOT(c1 OR c2)``; the keywords alone when nothing is excluded."""
    wanted = F.array_join(F.coalesce(keywords, F.array()), " AND ")
    unwanted = F.array_join(F.coalesce(excluded, F.array()), " OR ")
    return (F.when(unwanted == "", wanted)
            .when(wanted == "", F.concat(F.lit("NOT("), unwanted, F.lit(")")))
            .otherwise(F.concat(F.lit("("), wanted, F.lit(") NOT("), unwanted, F.lit(")"))))


def percentage(count: Column, total: Column, digits: int = 2) -> Column:
    """Share in percent, rounded half to even; 0.0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(count / total * 100, digits))
