import random
from collections import Counter

from pyspark.sql import functions as F

from rolecall.functions.taxonomy import DEFAULT_TAXONOMY
from rolecall.operators import joins, ordering, summary

JOBS = "name string, year string, month string, category string, tags array<string>, seq bigint"


def jobs(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of all rows is one search's one month.
        name, month = ("hot", "01") if i % 3 == 0 else (rng.choice("ab"), rng.choice(["01", "02"]))
        rows.append((name, "2025", month, rng.choice(["AI", "Backend", "Backend", "Unknown", None]),
                     rng.sample(["Go", "Rust", "Zig", "Go"], rng.randint(0, 4)), i))
    return rows, spark.createDataFrame(rows, JOBS).repartition(5)


def test_category_summary(spark):
    rows, df = jobs(spark)
    got = [tuple(r) for r in summary.category_summary(df).collect()]
    counts = Counter(r[3] for r in rows)
    listed = sorted(DEFAULT_TAXONOMY.categories, key=lambda c: -counts[c])
    assert got == [(c, counts[c], round(counts[c] / 300 * 100, 2), 300) for c in listed]


def test_empty_input_has_no_summary(spark):
    _, df = jobs(spark)
    assert summary.category_summary(df.where("false")).count() == 0
    assert summary.tag_summary(df.where("false")).count() == 0
    assert summary.total_jobs(df.where("false")).first()[0] == 0


def test_tag_summary_ties_by_first_seen(spark):
    rows = [("a", "2025", "01", "AI", ["Zig", "Go"], 5), ("a", "2025", "01", "AI", ["Rust", "Zig", "Rust"], 9),
            ("a", "2025", "01", "AI", [], 1), ("a", "2025", "01", "AI", ["Go"], 2)]
    df = spark.createDataFrame(rows, JOBS)
    got = [tuple(r) for r in summary.tag_summary(df, seq="seq").collect()]
    assert got == [("Go", 2, 50.0, 4), ("Zig", 2, 50.0, 4), ("Rust", 2, 50.0, 4)]
    assert [r.tag for r in summary.tag_summary(df).collect()] == ["Go", "Rust", "Zig"]
    by_text = df.withColumn("seq", F.lpad(F.col("seq").cast("string"), 3, "0"))
    assert [r.tag for r in summary.tag_summary(by_text, seq="seq").collect()] == ["Go", "Zig", "Rust"]
    as_text = df.withColumn("tags", F.concat_ws(", ", "tags"))
    assert [tuple(r) for r in summary.tag_summary(as_text, seq="seq").collect()] == got
    assert [r.tag for r in summary.top_tags(df, 2, seq="seq").collect()] == ["Go", "Zig"]


def test_rollups_divide_by_the_jobs_of_their_level(spark):
    rows, df = jobs(spark)
    keys = {"all": lambda r: (None, None, None), "name": lambda r: (r[0], None, None),
            "year": lambda r: (r[0], r[1], None), "month": lambda r: r[:3]}
    totals = Counter((g, *k(r)) for r in rows for g, k in keys.items())
    tags = Counter((g, *k(r), t) for r in rows for g, k in keys.items() for t in r[4])
    got = {tuple(r)[:5]: tuple(r)[5:] for r in summary.rollup_tag_summary(df).collect()}
    assert got == {k: (n, round(n / totals[k[:4]] * 100, 2), totals[k[:4]]) for k, n in tags.items()}
    cats = Counter((g, *k(r), r[3]) for r in rows for g, k in keys.items())
    got = {tuple(r)[:5]: tuple(r)[5:] for r in summary.rollup_category_summary(df).collect()}
    assert got == {(*level, c): (cats[(*level, c)], round(cats[(*level, c)] / n * 100, 2), n)
                   for level, n in totals.items() for c in DEFAULT_TAXONOMY.categories}


def test_zero_fill_and_totals(spark):
    counts = spark.createDataFrame([("AI", 3), ("Odd", 9)], "category string, job_count bigint")
    got = {r.category: r.job_count for r in joins.zero_fill_categories(counts, ["Backend", "AI"]).collect()}
    assert got == {"Backend": 0, "AI": 3}


def test_run_totals(spark):
    runs = spark.createDataFrame([("a", 1, 3), ("a", 1, 2), ("a", 4, 0), ("b", 2, 7)],
                                 "name string, run_id bigint, found bigint")
    got = {(r["name"], r.run_id): (r.found, r.searches, r.total_found) for r in summary.run_totals(runs).collect()}
    assert got == {("a", 1): (5, 1, 5), ("a", 4): (0, 2, 5), ("b", 2): (7, 1, 7)}


def test_keep_first_groups_null_keys(spark):
    df = spark.createDataFrame([("u", 2), ("u", 1), (None, 4), (None, 3)], "url string, seq int")
    got = ordering.keep_first(df, ["url"], ["seq"]).collect()
    assert sorted(r.seq for r in got) == [1, 3]


def test_take_while_both_ways(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), i, rng.random() < 0.02) for i in range(400)]
    rows.append(("never", 1, False))
    df = spark.createDataFrame(rows, "run string, seq int, stop boolean").repartition(6)
    ends = {}
    for run, seq, stop in rows:
        if stop:
            ends.setdefault(run, seq)
    expected = sorted((r, s) for r, s, _ in rows if s < ends.get(r, 10**9))
    for short in (False, True):
        got = ordering.take_while(df, "run", "seq", F.col("stop"), short).collect()
        assert sorted((r.run, r.seq) for r in got) == expected


def test_newest_first_and_page(spark):
    df = spark.createDataFrame([("u3", None), ("u2", 5), ("u1", 5), ("u0", 9)], "url string, posted_time bigint")
    assert [r.url for r in ordering.newest_first(df).collect()] == ["u1", "u2", "u0", "u3"]
    assert [r.url for r in ordering.page(df, 1, 2).collect()] == ["u2", "u0"]


def test_counts_of_parts_add_up(spark):
    """Summaries of merged counts are those of all jobs, however these are parted."""
    _, df = jobs(spark)
    parts = [summary.summary_counts(df.where(F.pmod("seq", F.lit(7)) == k)) for k in range(7)]
    parts.append(summary.summary_counts(df.where("false")))
    counts = parts[0]
    for part in parts[1:]:
        counts = summary.merge_counts(counts.unionByName(part))

    def rows(frame):
        return sorted(map(str, frame.collect()))

    assert rows(summary.category_summary_of_counts(counts)) == rows(summary.rollup_category_summary(df))
    assert rows(summary.tag_summary_of_counts(counts)) == rows(summary.rollup_tag_summary(df))
    assert summary.category_summary_of_counts(parts[-1]).count() == 0
