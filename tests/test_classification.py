import random
import re

import pytest
from pyspark.sql import functions as F

from rolecall.functions import taxonomy as tx
from rolecall.functions.classification import classify, classify_if_needed, extract_tags
from rolecall.functions.taxonomy import DEFAULT_TAXONOMY, Taxonomy


def slow_classify(title, description, taxonomy=DEFAULT_TAXONOMY):
    """The rules, row by row."""
    title, description = title or "", description or ""
    t, d = title.lower().strip(), description.lower().strip()
    both = f"{title} {description}".lower().strip()

    def found(keyword, text):
        if keyword.startswith("\\b"):
            return re.search(keyword, text, re.I) is not None
        return keyword.lower() in text

    scores = dict.fromkeys(taxonomy.categories, 0)
    for category, field, keyword, weight in taxonomy.category_rows:
        scores[category] += weight * found(keyword, t if field == "title" else d)
    best = max(scores, key=scores.get)
    tags = sorted({tag for _, tag, k in taxonomy.tag_rows if found(k, both)})
    if scores[best] < 1:
        return taxonomy.default_category, tags, 0.3
    return best, tags, min(scores[best] / 10.0, 1.0)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "title string, description string")
    return [(r.title, r.description, r.category, r.tags, r.classification_confidence)
            for r in classify(df, **options).collect()]


@pytest.mark.parametrize("title, description, expected", [
    ("Frontend", "", ("Frontend", 0.6)),           # listed twice
    ("x", "y", ("Fullstack", 0.3)),                # nothing found
    ("x", "an api", ("Backend", 0.1)),             # less sure than nothing found
    ("Web Developer", "", ("Frontend", 0.3)),      # tie goes to the earlier category
    ("frontend devops sre", "css html", ("Frontend", 0.8)),
    ("machine learning ai engineer nlp engineer", "llm", ("AI", 1.0)),
    (None, None, ("Fullstack", 0.3)),
])
def test_stated_cases(spark, title, description, expected):
    (_, _, category, _, confidence), = run(spark, [(title, description)])
    assert (category, confidence) == expected


def test_tags_match_inside_words_and_across_the_seam(spark):
    (*_, tags, _), = run(spark, [("google", "artsy")])
    assert tags == ["Go", "TypeScript"]
    (*_, tags, _), = run(spark, [("We use Spring", "Boot and Ruby on Rails")])
    assert tags == ["Rails", "Ruby", "Spring Boot"]
    (*_, tags, _), = run(spark, [("x", "c# .net laravel dynamodb")])
    assert tags == [".NET", "AWS", "C#", "DynamoDB", "Laravel", "PHP"]


WORDS = [row[2] for row in DEFAULT_TAXONOMY.category_rows + DEFAULT_TAXONOMY.tag_rows] + [
    "and", "the", "Größe", "\n", "\t", "  ", "Σ", "boot", "spring", "learning", "machine"]


@pytest.mark.parametrize("engine", ["contains", "trie"])
def test_random_texts_agree_with_the_rules(spark, engine):
    rng = random.Random(11)

    def words(n):
        return " ".join(rng.choice(WORDS).title() if rng.random() < 0.3 else rng.choice(WORDS)
                        for _ in range(rng.randint(0, n)))

    rows = [(words(3), words(12)) for _ in range(150)] + [(None, words(5)), (words(2), None)]
    for title, description, *got in run(spark, rows, engine=engine):
        assert tuple(got) == slow_classify(title, description), (title, description)


def test_custom_taxonomy_with_patterns(spark):
    taxonomy = Taxonomy.from_text(
        r"""
One | title | \bgo\b, lang
Two | title | go
Two | description | \bgo\b, rust
""", r"""
g | Go | \bgo\b
g | Seam | \bend start\b, n l
""", default_category="None")
    rows = [("go", ""), ("golang", "x"), ("GO!", "go rust"), ("the end", "start now"),
            ("x", "cargo"), ("in", "lane"), ("ago", "go-to")]
    for title, description, *got in run(spark, rows, taxonomy=taxonomy):
        assert tuple(got) == slow_classify(title, description, taxonomy), (title, description)


def test_taxonomy_tables_round_trip(spark):
    categories, tags = tx.category_keywords(spark), tx.tag_keywords(spark)
    assert (categories.count(), tags.count()) == (109, 148)
    assert [r.category for r in tx.all_categories(categories).collect()] == [
        "Frontend", "Backend", "Fullstack", "DevOps", "AI"]
    assert {r.tag_group: len(r.tags) for r in tx.all_tags(tags).collect()} == {
        "languages": 13, "cloud": 5, "frameworks": 14, "ai_tools": 10, "databases": 7,
        "devops_tools": 12, "other": 10}
    assert [r.tag for r in tx.flat_tags(tags).collect()] == DEFAULT_TAXONOMY.flat_tags
    assert len(DEFAULT_TAXONOMY.flat_tags) == 71
    again = Taxonomy.from_frames(categories, tags)
    assert again.categories == DEFAULT_TAXONOMY.categories
    assert sorted(again.category_rows) == sorted(DEFAULT_TAXONOMY.category_rows)
    assert sorted(again.tag_rows) == sorted(DEFAULT_TAXONOMY.tag_rows)


@pytest.mark.parametrize("keyword", ["", " go", "go "])
def test_taxonomy_rejects_empty_and_padded_keywords(keyword):
    with pytest.raises(ValueError):
        Taxonomy((("A", "title", keyword, 3),), ())


def test_missing_columns_and_existing_category(spark):
    df = spark.createDataFrame([("devops", "old")], "title string, category string")
    assert classify(df).first().category == "DevOps"
    assert classify_if_needed(df).first().category == "old"
    assert classify_if_needed(df.drop("category")).first().category == "DevOps"


def test_title_only(spark):
    rows = [("devops", "frontend css html dom browser ui/ux user interface")]
    assert run(spark, rows)[0][2] == "Frontend"
    assert run(spark, rows, title_only=True)[0][2] == "DevOps"


def test_extract_tags_alone(spark):
    df = spark.createDataFrame([("x", "kafka")], "title string, description string")
    got = extract_tags(df)
    assert got.columns == ["title", "description", "tags"] and got.first().tags == ["Kafka"]


def test_row_order_does_not_matter(spark):
    rows = [(f"t{i} python", "api " * (i % 3)) for i in range(30)]
    forwards = sorted(map(str, run(spark, rows)))
    assert forwards == sorted(map(str, run(spark, rows[::-1])))
