"""Category, confidence and tags of a posting, from keyword tables.

The texts are scanned once for all keywords; scores and tags are looked up from
the positions found, with tables that are literals of the plan. No join, no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolecall.functions.scan import KeywordScan, constant, longest_length
from rolecall.functions.taxonomy import DEFAULT_TAXONOMY, Taxonomy
from rolecall.functions.text import strip, text_or_empty

DEFAULT_CONFIDENCE = 0.3
FULL_SCORE = 10.0


def is_regex(keyword: str) -> bool:
    r"""A keyword that starts with ``\b`` is a regular expression."""
    return keyword.startswith(r"\b")


def _regex_found(text: Column, keyword: str) -> Column:
    return text.rlike("(?iuU)" + keyword)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Entries of the list found in a lower-cased text; repeats count again."""
    hits = F.lit(0)
    for keyword in keywords:
        found = (_regex_found(text, keyword) if is_regex(keyword)
                 else text.contains(keyword.lower()))
        hits = hits + found.cast("int")
    return hits


class KeywordTables:
    """A taxonomy as lookups by keyword position.

    Plain keywords come first and are scanned for; regular expressions follow
    and are tested one by one.
    """

    def __init__(self, taxonomy: Taxonomy, engine: str | None = None):
        listed = [row[2] for row in taxonomy.category_rows + taxonomy.tag_rows]
        self.taxonomy = taxonomy
        self.plain = list(dict.fromkeys(k.lower() for k in listed if not is_regex(k)))
        self.regex = list(dict.fromkeys(k for k in listed if is_regex(k)))
        self.scan = KeywordScan(self.plain, engine)
        self._index = {k: i for i, k in enumerate(self.plain + self.regex)}

    def _position(self, keyword: str) -> int:
        return self._index[keyword if is_regex(keyword) else keyword.lower()]

    def weights(self, category: str, field: str) -> list[int]:
        table = [0] * len(self._index)
        for name, of, keyword, weight in self.taxonomy.category_rows:
            if (name, of) == (category, field):
                table[self._position(keyword)] += weight
        return table

    def tags(self) -> list[list[str]]:
        table: list[list[str]] = [[] for _ in self._index]
        for _, tag, keyword in self.taxonomy.tag_rows:
            table[self._position(keyword)].append(tag)
        return table

    def regex_found(self, text: Column) -> Column:
        hits = [F.when(_regex_found(text, k), F.lit(self._index[k])) for k in self.regex]
        return F.array_except(F.array(*hits), F.array(F.lit(None).cast("int")))


def _score(found: str, weights: list[int]) -> Column:
    table = constant(weights, "array<int>")
    return F.aggregate(found, F.lit(0), lambda total, i: total + F.get(table, i))


def _tag_names(found: str, tags: list[list[str]]) -> Column:
    table = constant(tags, "array<array<string>>")
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda i: F.get(table, i)))))
    return F.when(F.size(found) > 0, names).otherwise(F.array().cast("array<string>"))


def best_score(scores: list[Column]) -> Column:
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def best_category(names: list[str], scores: list[Column], default: str) -> Column:
    """Highest score; ties go to the earlier category. Never null, and Spark can tell: of
    a value that may be null, joins and filters infer a test that would scan the texts again."""
    best = best_score(scores)
    chosen = F.when(best < 1, F.lit(default))
    for name, score in zip(names[:-1], scores):
        chosen = chosen.when(score == best, F.lit(name))
    return chosen.otherwise(F.lit(names[-1]))


def confidence(best: Column) -> Column:
    return F.when(best < 1, F.lit(DEFAULT_CONFIDENCE)).otherwise(
        F.least(best / FULL_SCORE, F.lit(1.0)))


def with_keywords_found(df: DataFrame, tables: KeywordTables, title: str,
                        description: str) -> DataFrame:
    """Adds ``_in_title``, ``_in_description`` and ``_in_both``, the positions of
    the keywords in each text and in ``title + ' ' + description``.

    A keyword lies in the joined text if it lies in one of the two or across
    the seam, so the long text is scanned only once. A column the frame lacks
    counts as empty.
    """
    def lowered(name):
        return F.lower(text_or_empty(name)) if name in df.columns else F.lit("")

    reach = max(longest_length(tables.plain) - 1, 0)
    texts = df.withColumns({"_lt": lowered(title), "_ld": lowered(description)})
    found = texts.withColumn("_seam", F.concat(
        F.right("_lt", F.lit(reach)), F.lit(" "), F.left("_ld", F.lit(reach)))).withColumns({
        "_in_title": tables.scan.found("_lt"),
        "_in_description": tables.scan.found("_ld"),
        "_in_seam": tables.scan.found("_seam"),
    })
    if tables.regex:
        both = strip(F.concat("_lt", F.lit(" "), "_ld"))
        found = found.withColumns({
            "_in_title": F.concat("_in_title", tables.regex_found(strip("_lt"))),
            "_in_description": F.concat("_in_description", tables.regex_found(strip("_ld"))),
            "_in_seam": F.concat("_in_seam", tables.regex_found(both)),
        })
        # A pattern counts for the tags only where it matches the joined text.
        plain = len(tables.plain)
        spread = F.concat("_in_title", "_in_description")
        found = found.withColumn("_in_both", F.concat(
            "_in_seam", F.filter(spread, lambda i: i < plain)))
    else:
        found = found.withColumn("_in_both", F.concat("_in_title", "_in_description", "_in_seam"))
    return found.drop("_lt", "_ld", "_seam", "_in_seam")


def classify(df: DataFrame, title: str = "title", description: str = "description",
             taxonomy: Taxonomy = DEFAULT_TAXONOMY, title_only: bool = False,
             engine: str | None = None) -> DataFrame:
    """Adds (or overwrites) category, tags and classification_confidence."""
    tables = KeywordTables(taxonomy, engine)
    names = taxonomy.categories
    found = with_keywords_found(df, tables, title, "" if title_only else description)
    scored = found.withColumn("_scores", F.array(*[
        _score("_in_title", tables.weights(name, "title"))
        + _score("_in_description", tables.weights(name, "description"))
        for name in names]))
    scores = [F.get("_scores", F.lit(i)) for i in range(len(names))]
    return scored.withColumns({
        "category": best_category(names, scores, taxonomy.default_category),
        "tags": _tag_names("_in_both", tables.tags()),
        "classification_confidence": confidence(best_score(scores)),
    }).drop("_in_title", "_in_description", "_in_both", "_scores")


def extract_tags(df: DataFrame, title: str = "title", description: str = "description",
                 taxonomy: Taxonomy = DEFAULT_TAXONOMY, engine: str | None = None) -> DataFrame:
    """Adds the tags alone."""
    return classify(df.drop("category", "classification_confidence"), title, description,
                    taxonomy, engine=engine).drop("category", "classification_confidence")


def classify_if_needed(df: DataFrame, **kwargs) -> DataFrame:
    return df if "category" in df.columns else classify(df, **kwargs)
