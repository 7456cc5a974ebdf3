from pyspark.sql import functions as F

import pytest

from rolecall.functions import matching, text
from rolecall.functions.classification import classify
from rolecall.functions.sql import register_functions
from rolecall.functions.taxonomy import Taxonomy
from rolecall.plans import catalogue

ROWS = [(["Python", "docker"], " We use PYTHON and Docker ", "Acme  Inc ", 1, 800), ([], "", None, 0, 0),
        (["a", "A"], "a", "B", 1, 3), (["x"], "", "\tC\n", 5, 5), (["zq", "é"], "É", "", 3, 800)]


def test_sql_functions_agree_with_columns(spark):
    register_functions(spark)
    df = spark.createDataFrame(ROWS, "keywords array<string>, t string, c string, n bigint, total bigint")
    df.createOrReplaceTempView("rows")
    keywords = F.col("keywords")
    expected = df.select(
        matching.match_all(keywords, F.col("t")), matching.match_any(keywords, F.col("t")),
        matching.match_score(keywords, F.col("t")), text.company_key("c"), text.content_hash("t"),
        text.percentage(F.col("n"), F.col("total")))
    got = spark.sql("SELECT match_all(keywords, t), match_any(keywords, t), match_score(keywords, t), "
                    "company_key(c), content_hash(t), percentage(n, total) FROM rows")
    assert list(map(tuple, got.collect())) == list(map(tuple, expected.collect()))
    assert "PythonUDF" not in got._jdf.queryExecution().executedPlan().toString()


def test_classification_in_sql(spark, sf_dir):
    assert "classify" in register_functions(spark)
    docs = catalogue.documents(spark, sf_dir).select("id", "title", "description").union(
        spark.createDataFrame([(-1, "Web Developer, Spring", "Boot and C#, .NET on AWS"), (-2, None, None)],
                              "id bigint, title string, description string"))
    docs.createOrReplaceTempView("docs")
    got = spark.sql("SELECT id, classify(title, description) AS c FROM docs")
    tags = spark.sql("SELECT id, extract_tags(title, description) AS t FROM docs")
    expected = classify(docs).select("id", "category", "tags", "classification_confidence")
    assert sorted((r.id, r.c.category, r.c.tags, r.c.confidence) for r in got.collect()) == sorted(
        map(tuple, expected.collect()))
    assert sorted(map(tuple, tags.collect())) == sorted(map(tuple, expected.select("id", "tags").collect()))
    with pytest.raises(ValueError):
        register_functions(spark, Taxonomy((("A", "title", r"\bgo\b", 3),), ()))


def test_classify_in_sql_scans_each_text_once(spark):
    """Title, description and the seam, whatever fields of the result are made of them."""
    register_functions(spark)
    spark.createDataFrame([("a", "b")], "title string, description string").createOrReplaceTempView("texts")
    for call in ("classify(title, description)", "extract_tags(title, description)"):
        plan = spark.sql(f"SELECT {call} AS c FROM texts")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract_all(") == 3
