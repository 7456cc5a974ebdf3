"""Keyword matching: exact substring tests without word boundaries.

Keywords may be a Python list, which becomes one ``contains`` per keyword in
the plan, or an array column, which becomes a higher-order function.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, functions as F

from rolecall.functions.text import text_or_empty

Keywords = list[str] | tuple[str, ...] | Column


def checked_keywords(keywords) -> list[str]:
    keywords = list(keywords)
    if any(not k for k in keywords):
        raise ValueError("an empty keyword cannot be matched")
    return keywords


def _lowered(keywords: Keywords, case_sensitive: bool) -> list[str] | Column:
    if isinstance(keywords, Column):
        keywords = F.coalesce(keywords, F.array().cast("array<string>"))
        return keywords if case_sensitive else F.transform(keywords, F.lower)
    keywords = checked_keywords(keywords)
    return keywords if case_sensitive else [k.lower() for k in keywords]


def _with_text(text, case_sensitive: bool, body: Callable[[Column], Column]) -> Column:
    """``body`` of the text in the case it is compared in.

    The lower-cased text enters as the only element of an array, so that it is
    made once per row and not once per keyword.
    """
    text = text_or_empty(text)
    if case_sensitive:
        return body(text)
    return F.get(F.transform(F.array(F.lower(text)), body), F.lit(0))


def match_all(keywords: Keywords, text, case_sensitive: bool = False) -> Column:
    """All keywords occur. No keywords: true. A repeated keyword: never true."""
    keywords = _lowered(keywords, case_sensitive)
    if isinstance(keywords, Column):
        return _with_text(text, case_sensitive, lambda t: (
            F.when(F.size(keywords) == 0, True).when(t == "", False)
            .otherwise((F.size(F.array_distinct(keywords)) == F.size(keywords))
                       & F.forall(keywords, lambda k: F.contains(t, k)))))
    if not keywords:
        return F.lit(True)
    if len(set(keywords)) < len(keywords):
        return F.lit(False)
    return _with_text(text, case_sensitive,
                      lambda t: reduce(and_, [t.contains(k) for k in keywords]))


def match_any(keywords: Keywords, text, case_sensitive: bool = False) -> Column:
    """Some keyword occurs. No keywords: true."""
    keywords = _lowered(keywords, case_sensitive)
    if isinstance(keywords, Column):
        return _with_text(text, case_sensitive, lambda t: (
            F.when(F.size(keywords) == 0, True).when(t == "", False)
            .otherwise(F.exists(keywords, lambda k: F.contains(t, k)))))
    if not keywords:
        return F.lit(True)
    return _with_text(text, case_sensitive,
                      lambda t: reduce(or_, [t.contains(k) for k in dict.fromkeys(keywords)]))


def match_score(keywords: Keywords, text, case_sensitive: bool = False) -> Column:
    """Distinct keywords found over the length of the list."""
    keywords = _lowered(keywords, case_sensitive)
    if isinstance(keywords, Column):
        return _with_text(text, case_sensitive, lambda t: (
            F.when(F.size(keywords) == 0, 1.0).when(t == "", 0.0)
            .otherwise(F.size(F.filter(F.array_distinct(keywords), lambda k: F.contains(t, k)))
                       / F.size(keywords))))
    if not keywords:
        return F.lit(1.0)
    return _with_text(text, case_sensitive, lambda t: reduce(
        add, [t.contains(k).cast("int") for k in dict.fromkeys(keywords)]) / F.lit(len(keywords)))


def _can_overlap_itself(keyword: str) -> bool:
    return any(keyword.startswith(keyword[i:]) for i in range(1, len(keyword)))


def occurrences(text: Column, keyword: str) -> Column:
    """Overlapping occurrences of one keyword. Only a keyword that ends as it
    begins can overlap itself and needs the look-ahead."""
    if _can_overlap_itself(keyword):
        quoted = "".join("\\" + ch if not ch.isalnum() and ord(ch) < 128 else ch for ch in keyword)
        return F.regexp_count(text, F.lit(f"(?={quoted})")).cast("bigint")
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(keyword), F.lit("")))
    return (removed / len(keyword.encode())).cast("bigint")


def matched_keywords(keywords: list[str], text, case_sensitive: bool = False) -> Column:
    """Map of each keyword found to its number of (overlapping) occurrences."""
    keywords = _lowered(keywords, case_sensitive)
    if not keywords:
        return F.create_map().cast("map<string,bigint>")

    def counts(t: Column) -> Column:
        each = F.array(*[F.struct(F.lit(k).alias("keyword"), occurrences(t, k).alias("n"))
                         for k in dict.fromkeys(keywords)])
        return F.map_from_entries(F.filter(each, lambda e: e["n"] > 0))

    return _with_text(text, case_sensitive, counts)


def missing_keywords(keywords: Keywords, text, case_sensitive: bool = False) -> Column:
    """The required keywords that do not occur."""
    keywords = _lowered(keywords, case_sensitive)
    required = keywords if isinstance(keywords, Column) else F.array(
        *map(F.lit, keywords)).cast("array<string>")
    return _with_text(text, case_sensitive, lambda t: F.filter(
        F.array_distinct(required), lambda k: ~F.contains(t, k)))


def accept_posting(description, keywords: Keywords) -> Column:
    """A posting without description is rejected, even without keywords."""
    return (text_or_empty(description) != "") & match_all(keywords, description)
