"""Verdicts on urls: rules by host and path, and what redirects to what.

A rule decides the urls it fits. All others take the decision of the urls that
are the same page: redirects and canonical links tie urls together, and within
such a component an allowed url wins over a blocked one. A page without either
is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rolecall.llm.graph import components
from rolecall.session import materialize

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and its subdomains, where the path starts so."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, place: str) -> Rule:
        host, slash, path = place.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def place(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z
    in lower case; empty without it."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; a later one of two
    equally long ones loses. Null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: -len(r.place))
    chosen = None
    for rule in ordered:
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.place).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return found if chosen is None else chosen


# The tags and attributes of HTML that name another url of a page.
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


BASE = r"""(?i)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    start = F.expr("cast(array() as array<string>)")

    def step(acc: Column, part: Column) -> Column:
        # What precedes the first slash is no segment and stays.
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(part == "..", up).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    kept = F.array_join(F.aggregate(parts, start, step), "/")
    return F.when(path.rlike(r"/\.\.?$"), F.concat(kept, F.lit("/"))).otherwise(kept)


def resolved(target: Column, base: Column) -> Column:
    """The url that ``target`` names on a page at ``base``, as RFC 3986 has it; null for
    schemes without ``://`` and where ``base`` has none."""
    root = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1)
    place = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    path, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.when(place.contains("/"), F.regexp_extract(place, r"^(.*/)", 1)).otherwise("/")
    found = (F.when(target.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), target))
             .when(path == "", F.concat(root, place, F.when(target.startswith("?"), rest).otherwise(
                 F.regexp_extract(base, r"(\?[^#]*)", 1))))
             .otherwise(F.concat(root, _without_dots(F.when(path.startswith("/"), path).otherwise(
                 F.concat(folder, path))), rest)))
    return F.when(target.rlike(SCHEME), F.when(target.rlike(SCHEME + "//"), target)).when(root != "", found)


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of all redirects and canonical links in ``pages`` (url, html).
    Relative targets start from the page's first base href, else from its url."""
    html = F.col("html").cast("string")
    def every(mark: str, pattern: str) -> Column:
        # Pages that don't hold the word are not searched.
        return F.when(F.lower(html).contains(mark), F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).otherwise(
            F.expr("cast(array() as array<string>)"))
    def plain(column: Column) -> Column:
        return F.replace(column, F.lit("&amp;"), F.lit("&"))
    stated = F.when(F.lower(html).contains("<base"), plain(F.regexp_extract(html, BASE, 1))).otherwise("")
    both = pages.select(F.col("url").cast("string").alias("url"), stated.alias("stated"), F.explode(F.concat(
        every("canonical", CANONICAL), every("refresh", REFRESH))).alias("to"))
    both = both.where("url is not null and to != ''").withColumn("to", plain(F.col("to")))
    base = F.when(F.col("stated") == "", F.col("url")).otherwise(
        F.coalesce(resolved(F.col("stated"), F.col("url")), F.col("url")))
    target = resolved(F.col("to"), F.col("base"))
    return both.withColumn("base", base).select("url", target.alias("target")).where(
        "target is not null and target != url").distinct()


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` rows as (page_id, url, host, path, rule, verdict, alias_of).

    ``pages`` holds (page_id, url, html); other columns are ignored, whatever
    their names. ``redirects`` (url, target) adds edges that pages do not hold,
    such as those of HTTP. ``rule`` is the longest that fits the url, else null.
    Without one the verdict is that of the url's component: ``allow`` if a rule
    allows one of its urls, else ``block`` if a rule blocks one, else ``allow``.
    Targets count though no page has their url. ``alias_of`` is the smallest url of the component, null if it has
    no other. A null url has an empty host and path and no aliases; repeated
    pages are judged alike; an empty table gives no rows.
    """
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("url").cast("string"), F.col("target").cast("string")))
    members = components(edges).select(F.col("node").alias("url"), "component")
    decided = members.withColumn("found", best_rule(host_of(F.col("url")), path_of(F.col("url")), rules))
    verdicts = decided.groupBy("component").agg(
        F.when(F.count_if(F.col("found.verdict") == ALLOW) > 0, ALLOW)
        .when(F.count_if(F.col("found.verdict") == BLOCK) > 0, BLOCK).alias("shared"))
    shared = materialize(members.join(verdicts, "component"), "shared")
    # A url may be that of any share of the pages; only its own few rows are on the other side.
    judged = (urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
              .withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
              .join(shared, "url", "left"))
    return judged.select(
        "page_id", "url", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "shared", F.lit(ALLOW)).alias("verdict"),
        F.col("component").alias("alias_of"))
