from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rolecall.functions import text


def values(spark, rows, expression, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_normalize_strips_all_unicode_space(spark):
    rows = ["  \tA b \n", " X　", None, "", "\x1cq\x1f"]
    assert values(spark, rows, text.normalize_text("v")) == ["a b", "x", "", "", "q"]


def test_keys_agree_with_hashlib(spark):
    import hashlib
    rows = ["  Größe Σ \n", "", "Plain"]
    assert values(spark, rows, text.content_hash("v")) == [
        hashlib.sha256(r.lower().strip().encode()).hexdigest() for r in rows]
    assert values(spark, [" Acme  Corp "], text.company_key("v")) == ["job:company:acme__corp"]


def test_strip_query_keeps_fragment(spark):
    assert values(spark, ["https://a/b?x=1&y", "https://a/b#c", ""], text.strip_query("v")) == [
        "https://a/b", "https://a/b#c", ""]


def test_absolute_url(spark):
    assert values(spark, ["/x", "x", "https://b/x"], text.absolute_url("v", "https://a")) == [
        "https://a/x", "https://a/x", "https://b/x"]


@pytest.mark.parametrize("shown, seconds", [
    ("1 hour ago", 3600), ("30 minutes ago", 1800), ("2 days ago", 172800), ("3 weeks ago", None),
    ("", None), (None, None), ("Reposted 2  Days ago!", 172800), ("1 minute", None),
    ("99999999999999999999 days ago", None)])
def test_age_seconds(spark, shown, seconds):
    assert values(spark, [shown], text.age_seconds("v")) == [seconds]


def test_parse_posted_date(spark):
    rows = ["Posted on Nov 4, 2025", "Nov 04, 2025", "November 4, 2025", "bad", "Nov 4 2025",
            "Feb 30, 2025", "nov  4,  2025", "Nov 4, 20255", None, ""]
    day = date(2025, 11, 4)
    assert values(spark, rows, text.parse_posted_date("v")) == [
        day, day, day, None, None, None, day, None, None, None]


def test_is_on_takes_the_run_date(spark):
    assert values(spark, [date(2025, 11, 4), date(2025, 11, 3)],
                  text.is_on("v", date(2025, 11, 4)), "v date") == [True, False]


def test_split_record(spark):
    rows = ["Acme · Remote · Posted on Nov 4, 2025", "a·b", "a · b · c · d", ""]
    got = values(spark, rows, text.split_record("v"))
    assert [tuple(r) if r else None for r in got] == [
        ("Acme", "Remote", "Posted on Nov 4, 2025"), None, ("a", "b", "c"), None]


def test_title_fallback(spark):
    df = spark.createDataFrame([(None, "T", "x\ny", "c"), (" ", None, " first \nsecond", "c"),
                                (None, None, " ", "c"), (" H ", "T", "x", "c")],
                               "h1 string, h2 string, t string, c string")
    got = df.select(text.title_fallback([F.col("h1"), F.col("h2")], F.col("t"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["T", "first", "c", "H"]


def test_percentage_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0, 0), (1, 800), (1, 3), (3, 800)], "n bigint, t bigint")
    got = [r[0] for r in df.select(text.percentage(F.col("n"), F.col("t"))).collect()]
    assert got == [0.0, 0.12, 33.33, 0.38]
    pairs = [(n, t) for t in range(1, 120) for n in range(t + 1)]
    df = spark.createDataFrame(pairs, "n bigint, t bigint")
    got = df.select("n", "t", text.percentage(F.col("n"), F.col("t")).alias("p")).collect()
    assert all(r.p == round(r.n / r.t * 100, 2) for r in got)


def test_tags_text_round_trip(spark):
    assert values(spark, ["a, b,,c ", "", None], text.parse_tags("v")) == [["a", "b", "c"], [], []]
    assert values(spark, [["a", "b"], [], None], text.join_tags("v"), "v array<string>") == ["a,b", "", ""]


def test_iso_timestamp_like_isoformat(spark):
    rows = [datetime(2025, 1, 2, 3, 4, 5), datetime(2025, 1, 2, 3, 4, 5, 60)]
    assert values(spark, rows, text.iso_timestamp("v"), "v timestamp") == [r.isoformat() for r in rows]


def test_search_expression(spark):
    df = spark.createDataFrame([(["a", "b"], ["X", "Y"]), (["a", "b"], []), ([], ["X"]), ([], None)],
                               "k array<string>, x array<string>")
    got = [r[0] for r in df.select(text.search_expression(F.col("k"), F.col("x"))).collect()]
    assert got == ["(a AND b) NOT(X OR Y)", "a AND b", "NOT(X)", ""]


def test_label_and_date_parts(spark):
    df = spark.createDataFrame([("Dev", "Acme", "Remote", datetime(2025, 3, 4))],
                               "title string, company string, location string, ts timestamp")
    assert df.select(text.label()).first()[0] == "Dev at Acme (Remote)"
    assert tuple(df.select(*text.date_parts("ts").values()).first()) == ("2025", "03", "20250304")
