"""The functions for SQL. Spark inlines their bodies into the plan, so what a body needs
several times is named by a lambda over an array of one: it is computed once."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from rolecall.functions.classification import DEFAULT_CONFIDENCE, FULL_SCORE, KeywordTables
from rolecall.functions.scan import longest_length, sql_text
from rolecall.functions.taxonomy import DEFAULT_TAXONOMY, Taxonomy
from rolecall.functions.text import WHITESPACE

_STRIPPED = f"btrim(lower(coalesce({{0}}, '')), {sql_text(WHITESPACE)})"
_KEYWORDS = "transform(coalesce(keywords, cast(array() as array<string>)), k -> lower(k))"
_TEXT = "lower(coalesce(text, ''))"

#: Name, parameters, type and body.
FUNCTIONS = (
    ("company_key", "company STRING", "STRING",
     f"concat('job:company:', replace({_STRIPPED.format('company')}, ' ', '_'))"),
    ("content_hash", "text STRING", "STRING", f"sha2({_STRIPPED.format('text')}, 256)"),
    ("match_all", "keywords ARRAY<STRING>, text STRING", "BOOLEAN",
     f"CASE WHEN size(coalesce(keywords, array())) = 0 THEN true WHEN coalesce(text, '') = '' THEN false "
     f"ELSE size(array_distinct({_KEYWORDS})) = size(keywords) "
     f"AND forall({_KEYWORDS}, k -> contains({_TEXT}, k)) END"),
    ("match_any", "keywords ARRAY<STRING>, text STRING", "BOOLEAN",
     f"CASE WHEN size(coalesce(keywords, array())) = 0 THEN true WHEN coalesce(text, '') = '' THEN false "
     f"ELSE exists({_KEYWORDS}, k -> contains({_TEXT}, k)) END"),
    ("match_score", "keywords ARRAY<STRING>, text STRING", "DOUBLE",
     f"CASE WHEN size(coalesce(keywords, array())) = 0 THEN 1.0D WHEN coalesce(text, '') = '' THEN 0.0D "
     f"ELSE size(filter(array_distinct({_KEYWORDS}), k -> contains({_TEXT}, k))) / size(keywords) END"),
    ("percentage", "n BIGINT, total BIGINT", "DOUBLE",
     "CASE WHEN total = 0 THEN 0.0D ELSE bround(n / total * 100, 2) END"),
)


def _classification(taxonomy: Taxonomy) -> tuple[KeywordTables, tuple]:
    """Classification as functions: positions to scores, scores to the result, and all of
    it in one, in which each text is scanned once. Equal calls in one SELECT share that."""
    tables = KeywordTables(taxonomy)
    if tables.regex:
        raise ValueError("classify the table instead: SQL functions take plain keywords only")
    ids, names = "ARRAY<INT>", taxonomy.categories

    def total(found: str, category: str, field: str) -> str:
        weights = f"from_json({sql_text(str(tables.weights(category, field)))}, 'array<int>')"
        return f"aggregate({found}, 0, (total, i) -> total + get({weights}, i))"

    def scores(in_title: str, in_description: str) -> str:
        return "array(" + ", ".join(f"{total(in_title, n, 'title')} + {total(in_description, n, 'description')}"
                                    for n in names) + ")"

    def tags(found: str) -> str:
        table = f"from_json({sql_text(json.dumps(tables.tags()))}, 'array<array<string>>')"
        return f"array_sort(array_distinct(flatten(transform({found}, i -> get({table}, i)))))"

    def category(of: str) -> str:
        chosen = " ".join(f"WHEN {of}[{i}] = array_max({of}) THEN {sql_text(n)}" for i, n in enumerate(names))
        return f"CASE WHEN array_max({of}) < 1 THEN {sql_text(taxonomy.default_category)} {chosen} END"

    def confidence(of: str) -> str:
        return (f"CASE WHEN array_max({of}) < 1 THEN {DEFAULT_CONFIDENCE}D "
                f"ELSE least(array_max({of}) / {FULL_SCORE}D, 1.0D) END")

    reach = max(longest_length(tables.plain) - 1, 0)
    title, description = "lower(coalesce(title, ''))", "lower(coalesce(description, ''))"
    seam = f"concat(right({title}, {reach}), ' ', left({description}, {reach}))"
    found = (f"array(named_struct('t', keywords_in({title}), 'd', keywords_in({description}), "
             f"'s', keywords_in({seam})))")
    scored = (f"transform({found}, f -> named_struct('scores', {scores('f.t', 'f.d')}, "
              f"'tags', {tags('concat(f.t, f.d, f.s)')}))")
    result = "STRUCT<category: STRING, tags: ARRAY<STRING>, confidence: DOUBLE>"
    return tables, (
        ("keyword_scores", f"in_title {ids}, in_description {ids}", ids, scores("in_title", "in_description")),
        ("tags_of_keywords", f"found {ids}", "ARRAY<STRING>", tags("found")),
        ("best_category", f"scores {ids}", "STRING", category("scores")),
        ("best_confidence", f"scores {ids}", "DOUBLE", confidence("scores")),
        ("classify", "title STRING, description STRING", result,
         f"transform({scored}, f -> named_struct('category', {category('f.scores')}, 'tags', f.tags, "
         f"'confidence', {confidence('f.scores')}))[0]"),
        ("extract_tags", "title STRING, description STRING", "ARRAY<STRING>", "classify(title, description).tags"),
    )


def register_functions(spark: SparkSession, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> list[str]:
    """Makes the functions known to SQL for this session; returns their names."""
    tables, classification = _classification(taxonomy)
    tables.scan.register(spark, "keywords_in")
    for name, parameters, result, body in FUNCTIONS + classification:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) "
                  f"RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS + classification]
