"""Matching every posting against every search in one pass over the postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rolecall.functions.scan import KeywordScan, constant
from rolecall.functions.text import text_or_empty
from rolecall.sources.specs import SOURCES, SearchSpec, check_types, enabled

FACETS = ("location", "job_type", "workplace_type", "experience_level")

#: First-stage groups of a search when its first results are picked.
LIMIT_SALTS = 64


SPEC_CONSTANT = (
    "array<struct<spec:string,source:string,checks:boolean,possible:boolean,needed:array<int>,"
    "within:bigint,excluded:array<string>,max_results:int,location:string,job_type:string,"
    "workplace_type:string,experience_level:string>>")


def _constant_spec(spec: SearchSpec, scan: KeywordScan) -> dict:
    """One search as a constant of the plan. ``needed`` holds keyword positions;
    ``possible`` is false where a keyword is listed twice."""
    source, checks = SOURCES[spec.type]
    lowered = [k.lower() for k in spec.keywords] if checks else []
    return {
        "spec": spec.name, "source": source, "checks": checks,
        "possible": len(set(lowered)) == len(lowered),
        "needed": scan.positions(dict.fromkeys(lowered)),
        "within": spec.last_time_posted,
        "excluded": [c.lower() for c in spec.excluded_companies],
        "max_results": spec.max_results,
        **{name: getattr(spec, name) for name in FACETS},
    }


def match_specs(postings: DataFrame, specs: list[SearchSpec], *, description: str = "description",
                company: str = "company", age: str = "posted_time", source: str | None = None,
                missing_facets: str = "error", engine: str | None = None) -> DataFrame:
    """Adds one row per (posting, enabled search it satisfies): ``spec`` and
    ``max_results``.

    The searches are literals of the plan and each posting is scanned once for
    the keywords of all of them, so nothing is joined or shuffled. ``source``
    names the column that tells the sites apart; without it every search sees
    every posting. A facet that a search asks for but the frame lacks was
    answered by the site; pass ``missing_facets="ignore"`` to say so.
    """
    specs = enabled(check_types(list(specs)))
    if not specs:
        return postings.withColumns({"spec": F.lit(None).cast("string"),
                                     "max_results": F.lit(None).cast("int")}).where("false")
    checked = [s for s in specs if SOURCES[s.type][1]]
    scan = KeywordScan(dict.fromkeys(k.lower() for s in checked for k in s.keywords), engine)
    facets = [f for f in FACETS if any(getattr(s, f) is not None for s in specs)]
    absent = [f for f in facets if f not in postings.columns]
    if absent and missing_facets != "ignore":
        raise ValueError(f"postings have no column {absent}, which a search asks for")
    facets = [f for f in facets if f in postings.columns]
    if any(s.last_time_posted is not None for s in specs) and age not in postings.columns:
        raise ValueError(f"postings have no column {age!r}, which a search asks for")

    wanted = constant([_constant_spec(s, scan) for s in specs], SPEC_CONSTANT)
    scanned = (postings
               .withColumn("_lower", F.lower(text_or_empty(description)))
               .withColumn("_found", scan.found("_lower")))
    # The posting enters as a single value, so that its parts are computed once
    # and not again for each search.
    row = F.array(F.struct(
        F.col("_found").alias("found"),
        (F.col("_lower") != "").alias("described"),
        F.lower(text_or_empty(company)).alias("company"),
        (F.col(age).cast("bigint") if age in postings.columns else F.lit(None).cast("bigint")).alias("age"),
        (F.col(source) if source else F.lit(None).cast("string")).alias("source"),
        *[F.col(f).alias(f) for f in facets],
    ))

    def accepted(posting: Column):
        def test(spec: Column) -> Column:
            keywords = ~spec["checks"] | (
                posting["described"] & spec["possible"]
                & (F.size(F.array_except(spec["needed"], posting["found"])) == 0))
            ok = keywords & ~F.array_contains(spec["excluded"], posting["company"])
            ok = ok & (spec["within"].isNull() | F.coalesce(posting["age"] <= spec["within"], F.lit(False)))
            if source:
                ok = ok & (spec["source"] == posting["source"])
            for name in facets:
                ok = ok & (spec[name].isNull() | F.coalesce(spec[name] == posting[name], F.lit(False)))
            return ok
        return test

    hits = F.flatten(F.transform(row, lambda posting: F.transform(
        F.filter(wanted, accepted(posting)),
        lambda spec: F.struct(spec["spec"].alias("spec"), spec["max_results"].alias("max_results")))))
    # Outer, so that no filter on the scan result is inferred and run twice.
    return (scanned.withColumn("_hit", F.explode_outer(hits))
            .where(F.col("_hit").isNotNull())
            .withColumns({"spec": F.col("_hit.spec"), "max_results": F.col("_hit.max_results")})
            .drop("_lower", "_found", "_hit"))


def spec_filters(postings: DataFrame, spec: SearchSpec, age: str = "posted_time",
                 company: str = "company") -> DataFrame:
    """The postings that pass what one search asks beside its keywords: recency,
    facets and excluded companies. What it does not ask lets everything pass."""
    kept = postings
    if spec.last_time_posted is not None:
        kept = kept.where(F.col(age) <= spec.last_time_posted)
    for name in FACETS:
        if getattr(spec, name) is not None:
            kept = kept.where(F.col(name) == getattr(spec, name))
    if spec.excluded_companies:
        excluded = [c.lower() for c in spec.excluded_companies]
        kept = kept.where(~F.lower(text_or_empty(company)).isin(excluded))
    return kept


def limit_per_spec(matches: DataFrame, order_by: list[str], specs: list[SearchSpec] | None = None,
                   salts: int = LIMIT_SALTS) -> DataFrame:
    """The first ``max_results`` rows of each search in the given order.

    A search may match a third of all rows, so its first rows are picked within
    salted groups and then among the survivors. The literal bound lets Spark cut
    each group before the shuffle as well.
    """
    order = [F.col(c) for c in order_by]
    ranked = matches.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    for group in (["spec", "_salt"], ["spec"]):
        ranked = ranked.withColumn("_rank", F.row_number().over(
            Window.partitionBy(*group).orderBy(*order)))
        if specs:
            ranked = ranked.where(F.col("_rank") <= max(s.max_results for s in specs))
        ranked = ranked.where(F.col("_rank") <= F.col("max_results"))
    return ranked.drop("_salt", "_rank")
