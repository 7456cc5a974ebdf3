import random

import pytest
from pyspark.sql import functions as F

from rolecall.functions import matching as m
from rolecall.functions.classification import KeywordTables
from rolecall.functions.scan import COMMON, FEW, KeywordScan, parted, rare_letter_pattern
from rolecall.functions.taxonomy import DEFAULT_TAXONOMY
from rolecall.operators.matching import limit_per_spec, match_specs, spec_filters
from rolecall.sources.specs import SearchSpec


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression).first()[0]


STATED = "We need Python developer with Docker and Kubernetes experience"


@pytest.mark.parametrize("keywords, text, cased, expected", [
    (["python", "docker", "kubernetes"], STATED, False, True),
    (["python", "docker"], "Python developer with Docker experience", False, True),
    (["python", "java"], STATED, False, False),
    (["python"], STATED, True, False),
    ([], "", False, True), ([], "x", False, True),
    (["a"], "", False, False), (["a"], None, False, False),
    (["a", "A"], "a", False, False),
    (["a", "A"], "aA", True, True),
    (["java"], "javascript", False, True),
    (["c++"], "C++ rocks", False, True),
])
def test_match_all(spark, keywords, text, cased, expected):
    as_column = F.array(*map(F.lit, keywords)).cast("array<string>")
    assert one(spark, m.match_all(keywords, F.col("t"), cased), text) is expected
    assert one(spark, m.match_all(as_column, F.col("t"), cased), text) is expected


@pytest.mark.parametrize("keywords, text, expected", [
    (["zq", "docker"], STATED, True), (["zq"], STATED, False), ([], "", True), (["zq"], "", False)])
def test_match_any(spark, keywords, text, expected):
    as_column = F.array(*map(F.lit, keywords)).cast("array<string>")
    assert one(spark, m.match_any(keywords, F.col("t")), text) is expected
    assert one(spark, m.match_any(as_column, F.col("t")), text) is expected


@pytest.mark.parametrize("keywords, text, expected", [
    (["python", "docker", "kubernetes", "aws"], "Python and Docker experience required", 0.5),
    ([], "", 1.0), (["a"], "", 0.0), (["a", "A"], "a", 0.5), (["a", "b", "c"], "ab", 2 / 3)])
def test_match_score(spark, keywords, text, expected):
    as_column = F.array(*map(F.lit, keywords)).cast("array<string>")
    assert one(spark, m.match_score(keywords, F.col("t")), text) == expected
    assert one(spark, m.match_score(as_column, F.col("t")), text) == expected


def test_matched_keywords(spark):
    stated = "Python and Docker are great. I love Python!"
    assert one(spark, m.matched_keywords(["python", "docker", "go"], F.col("t")), stated) == {
        "python": 2, "docker": 1}
    assert one(spark, m.matched_keywords(["aa", "c++", "é"], F.col("t")), "aaa c++ C++ é") == {
        "aa": 2, "c++": 2, "é": 1}
    assert one(spark, m.matched_keywords([], F.col("t")), "x") == {}
    assert one(spark, m.matched_keywords(["a"], F.col("t")), "") == {}


def test_overlaps_are_counted_like_a_slow_scan(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab.+ ") for _ in range(60)) for _ in range(40)]
    keywords = ["a", "ab", "aba", "bb", "a.a", "++", " a ", "b+b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", m.matched_keywords(keywords, F.col("t")).alias("n")).collect():
        slow = {k: sum(row.t.startswith(k, i) for i in range(len(row.t))) for k in keywords}
        assert row.n == {k: n for k, n in slow.items() if n}


def test_missing_keywords_and_empty_keyword(spark):
    assert one(spark, m.missing_keywords(["A", "b", "b"], F.col("t")), "xa") == ["b"]
    with pytest.raises(ValueError):
        m.match_all(["a", ""], F.col("t"))


def test_accept_posting_tests_the_description_first(spark):
    assert one(spark, m.accept_posting(F.col("t"), []), "") is False
    assert one(spark, m.accept_posting(F.col("t"), []), "x") is True
    assert one(spark, m.accept_posting(F.col("t"), ["python"]), STATED) is True


@pytest.mark.parametrize("engine", ["contains", "trie"])
def test_scan_engines_agree_with_python(spark, engine):
    rng = random.Random(3)
    keywords = sorted({"".join(rng.choice("abc '\\é") for _ in range(rng.randint(1, 4))) for _ in range(40)})
    texts = ["".join(rng.choice("abc '\\é") for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None]
    scan = KeywordScan(keywords, engine)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", scan.found("t").alias("found")).collect():
        assert row.found == [i for i, k in enumerate(keywords) if k in (row.t or "")]


POSTINGS = [
    # id, company, location, description, posted_time, source
    (1, "Acme", "Remote", "Python and docker", 100, "linkedin"),
    (2, "Beta", "Berlin", "python only", 5000, "linkedin"),
    (3, "acme", "Remote", "", 10, "startups"),
    (4, "Gamma", None, "docker PYTHON go", None, "linkedin"),
    (5, None, "Remote", "nothing here", 50, "linkedin"),
]
SCHEMA = "id int, company string, location string, description string, posted_time bigint, source string"


def found(spark, specs, **options):
    df = match_specs(spark.createDataFrame(POSTINGS, SCHEMA), specs, **options)
    got = {}
    for row in df.collect():
        got.setdefault(row.spec, set()).add(row.id)
    return got


def test_match_specs(spark):
    specs = [
        SearchSpec("both", "linkedin", keywords=("Python", "Docker")),
        SearchSpec("any", "linkedin"),
        SearchSpec("twice", "linkedin", keywords=("python", "PYTHON")),
        SearchSpec("recent", "linkedin", last_time_posted=100),
        SearchSpec("remote", "linkedin", location="Remote"),
        SearchSpec("not acme", "linkedin", excluded_companies=("ACME",)),
        SearchSpec("off", "linkedin", enabled=False),
        SearchSpec("links", "startups", keywords="python"),
    ]
    everywhere = found(spark, specs)
    assert everywhere == {
        "both": {1, 4}, "any": {1, 2, 4, 5}, "recent": {1, 5}, "remote": {1, 5},
        "not acme": {2, 4, 5}, "links": {1, 2, 3, 4, 5}}
    assert found(spark, specs, engine="trie") == everywhere
    by_source = found(spark, specs, source="source")
    assert by_source["links"] == {3} and by_source["any"] == {1, 2, 4, 5}


def test_many_searches_share_one_scan(spark):
    words = ["python", "docker", "go", "nothing", "only", "here"] + [f"w{i}" for i in range(60)]
    specs = [SearchSpec(f"s{i}", "linkedin", keywords=(words[i], words[(i * 7) % len(words)])
                        if i % len(words) != (i * 7) % len(words) else (words[i],))
             for i in range(len(words))]
    got = found(spark, specs)
    for spec in specs:
        slow = {r[0] for r in POSTINGS if r[3] and all(k in r[3].lower() for k in spec.keywords)}
        assert got.get(spec.name, set()) == slow


def test_each_search_finds_its_own(spark):
    specs = [SearchSpec(f"s{i}", "linkedin", keywords=(k,)) for i, k in enumerate(["python", "docker", "go", "x"])]
    assert found(spark, specs) == {"s0": {1, 2, 4}, "s1": {1, 4}, "s2": {4}}


def test_facets_must_exist_or_be_answered_by_the_site(spark):
    spec = [SearchSpec("full", "linkedin", job_type="F")]
    with pytest.raises(ValueError):
        found(spark, spec)
    assert found(spark, spec, missing_facets="ignore") == {"full": {1, 2, 4, 5}}


def test_no_searches_match_nothing(spark):
    assert found(spark, []) == {}


def test_spec_filters(spark):
    df = spark.createDataFrame(POSTINGS, SCHEMA)
    kept = spec_filters(df, SearchSpec("s", "linkedin", last_time_posted=100, location="Remote",
                                       excluded_companies=("ACME",)))
    assert [r.id for r in kept.collect()] == [5]
    assert spec_filters(df, SearchSpec("s", "linkedin")).count() == 5


def test_limit_per_spec_is_exact_on_a_hot_search(spark):
    rows = [("hot", i, 7) for i in range(500)] + [("cold", i, 3) for i in range(2)]
    specs = [SearchSpec("hot", "linkedin", max_results=7), SearchSpec("cold", "linkedin", max_results=3)]
    df = spark.createDataFrame(rows, "spec string, seq int, max_results int").repartition(8)
    for given in (specs, None):
        got = limit_per_spec(df, ["seq"], given).collect()
        assert sorted((r.spec, r.seq) for r in got) == [("cold", 0), ("cold", 1)] + [
            ("hot", i) for i in range(7)]


@pytest.mark.parametrize("letters, count", [("abk", 40), ("ab k.", 90), ("kqxe", 150), ("abcdefgk -.\U0001f600\u00e7", 120)])
def test_scan_finds_what_is_contained(spark, letters, count):
    rng = random.Random(count)
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    keywords, texts = list({word(5) for _ in range(count)}), [word(40) for _ in range(80)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(KeywordScan(keywords).found("t").alias("found"))
    assert [r.found for r in df.collect()] == [[i for i, k in enumerate(keywords) if t and k in t] for t in texts]


def test_a_scan_stops_at_rare_letters_only():
    """Nearly each place of a text has one of the letters that keywords start with."""
    tables = KeywordTables(DEFAULT_TAXONOMY)
    parts = parted(tables.plain)
    stops = rare_letter_pattern(parts.values()).split("]")[0]
    assert not set(COMMON) & set(stops) and len(tables.plain) - len(parts) <= FEW
