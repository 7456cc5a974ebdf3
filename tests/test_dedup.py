import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rolecall import schemas
from rolecall.operators import dedup, joins

START = datetime(2024, 1, 1)
SCHEMA = "company_key string, content_hash string, ts timestamp, id bigint"


def at(seconds):
    return START + timedelta(seconds=seconds)


def slow_fold(rows, ttl, live=None):
    """One arrival after the other; returns the ids that were new."""
    live = {company: dict(contents) for company, contents in (live or {}).items()}
    new = []
    for company, content, ts, id in sorted(rows, key=lambda r: (r[2], r[3])):
        contents = live.setdefault(company, {})
        if contents and ts >= max(contents.values()) + timedelta(seconds=ttl):
            contents.clear()
        if content not in contents:
            contents[content] = ts
            new.append(id)
    return sorted(new)


ARRIVALS = [
    ("x", "A", at(0), 1), ("x", "A", at(4), 2), ("x", "A", at(8), 3),
    ("y", "A", at(0), 4), ("y", "B", at(3), 5), ("y", "A", at(7), 6), ("y", "A", at(8), 7),
]


def folded(spark, rows, ttl, way, seen=None):
    df = spark.createDataFrame(rows, SCHEMA)
    if way == "companies":
        news = dedup.fold_companies(df, ttl)
    elif way == "slices":
        news, _ = dedup.fold_slices(df, ttl, seen)
    else:
        news = dedup.dedup_with_expiry(df, ttl, hot_rows=way)
    return sorted(r.id for r in news.collect())


@pytest.mark.parametrize("way", ["companies", "slices", 1_000_000, 3])
def test_stated_arrivals(spark, way):
    assert slow_fold(ARRIVALS, 5) == [1, 3, 4, 5, 7]
    assert folded(spark, ARRIVALS, 5, way) == [1, 3, 4, 5, 7]


def random_arrivals(seed, n=160, span=70):
    rng = random.Random(seed)
    companies = ["hot"] * 6 + ["a", "b", "c"]
    contents = ["A"] * 4 + list("BCDEFGH")
    moment, rows = 0, []
    for id in range(n):
        # Bursts and gaps, on and between whole seconds, with ties.
        moment += rng.choice([0, 0, 0.25, 1, 2, 5, 9]) * span / 70
        rows.append((rng.choice(companies), rng.choice(contents), at(moment), id))
    return rows


@pytest.mark.parametrize("ttl", [7, 19, 40, 90])
def test_walk_agrees_with_the_slow_fold(spark, ttl):
    rows = random_arrivals(ttl)
    assert folded(spark, rows, ttl, "companies") == slow_fold(rows, ttl)


@pytest.mark.parametrize("ttl, way", [(35, "slices"), (60, "slices"), (45, 30)])
def test_slices_agree_with_the_slow_fold(spark, ttl, way):
    rows = random_arrivals(ttl, 70)
    assert folded(spark, rows, ttl, way) == slow_fold(rows, ttl)


def test_store_carries_over(spark):
    """Two halves, the second with the store of the first, equal the whole."""
    rows = sorted(random_arrivals(9, 60), key=lambda r: (r[2], r[3]))
    first, second = rows[:30], rows[30:]
    news, store = dedup.fold_slices(spark.createDataFrame(first, SCHEMA), 50)
    later, _ = dedup.fold_slices(spark.createDataFrame(second, SCHEMA), 50, store)
    got = sorted(r.id for r in news.unionByName(later).collect())
    assert got == slow_fold(rows, 50)


@pytest.mark.parametrize("seed", range(3))
def test_store_carries_over_any_split(spark, seed):
    """Arrivals split anywhere, also within a slice: every part with the store of
    those before it."""
    rows = sorted(random_arrivals(seed, 40, 60), key=lambda r: (r[2], r[3]))
    cuts = [0, *sorted(random.Random(seed).sample(range(1, len(rows)), 3)), len(rows)]
    got, store = [], None
    for a, b in zip(cuts, cuts[1:]):
        news, store = dedup.fold_slices(spark.createDataFrame(rows[a:b], SCHEMA), 50, store)
        got += [r.id for r in news.collect()]
    assert sorted(got) == slow_fold(rows, 50)


def test_set_that_runs_out_after_the_last_arrival_is_kept(spark):
    first = [("x", "A", at(-20), 0), ("y", "B", at(5), 1)]
    _, store = dedup.fold_slices(spark.createDataFrame(first, SCHEMA), 50)
    news, _ = dedup.fold_slices(spark.createDataFrame([("x", "A", at(20), 2)], SCHEMA), 50, store)
    assert news.count() == 0


def test_sets_of_quiet_companies_are_freed(spark):
    rows = [("quiet", "A", at(0), 0)] + [("x", "A", at(i * 10), i) for i in range(1, 5)]
    news, store = dedup.fold_slices(spark.createDataFrame(rows, SCHEMA), 7)
    assert sorted(r.id for r in news.collect()) == slow_fold(rows, 7)
    assert [r.company_key for r in store.collect()] == ["x"]


def test_many_slices_rewrite_the_store(spark):
    rows = [("x", "AB"[i % 2], at(i * 3), i) for i in range(8)]
    before, dedup.APPENDS = dedup.APPENDS, 2
    try:
        assert folded(spark, rows, 7, "slices") == slow_fold(rows, 7)
    finally:
        dedup.APPENDS = before


def test_no_arrivals(spark):
    assert folded(spark, [], 5, "slices") == []
    assert folded(spark, [], 5, 10) == []


@pytest.mark.parametrize("ttl", [0, -1])
def test_ttl_must_be_positive(spark, ttl):
    df = spark.createDataFrame(ARRIVALS, SCHEMA)
    for call in (dedup.dedup_with_expiry, dedup.fold_slices):
        with pytest.raises(ValueError):
            call(df, ttl)


def seen_frame(spark, rows):
    return spark.createDataFrame(rows, schemas.SEEN)


def test_mark_live_reset_and_stats(spark):
    seen = seen_frame(spark, [("x", "A", at(0)), ("x", "B", at(5)), ("y", "A", at(0))])
    marked = dedup.mark_seen(seen, spark.createDataFrame([("y", "A", at(9), 1), ("z", "Q", at(2), 2)], SCHEMA), "ts")
    # The driver shows times in its own zone, so they are compared as numbers.
    got = {(r[0], r[1]): r[2] for r in marked.select(
        "company_key", "content_hash", F.unix_seconds("seen_at")).collect()}
    zero = int(START.replace(tzinfo=timezone.utc).timestamp())
    assert {k: v - zero for k, v in got.items()} == {
        ("x", "A"): 0, ("x", "B"): 5, ("y", "A"): 9, ("z", "Q"): 2}
    # The clock is the company's: A of x lives on because B came later.
    live = {(r.company_key, r.content_hash) for r in dedup.live_set(seen, 6, at(10)).collect()}
    assert live == {("x", "A"), ("x", "B")}
    assert tuple(dedup.seen_store_stats(seen).first()) == (2, 3)
    empty, dropped = dedup.reset_seen(seen)
    assert empty.count() == 0 and dropped.first()[0] == 2
    assert tuple(dedup.seen_store_stats(empty).first()) == (0, 0)


def test_seen_before_and_new_only(spark):
    postings = spark.createDataFrame(
        [(1, "Acme ", "Text"), (2, "acme", " TEXT"), (3, "acme", "other"), (4, "b", "text")],
        "id int, company string, description string")
    keyed = joins.with_keys(postings)
    seen = keyed.where("id = 1").select("company_key", "content_hash")
    assert [r.id for r in joins.seen_before(keyed, seen).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in joins.new_only(keyed, seen).orderBy("id").collect()] == [3, 4]
    assert sorted(r.id for r in dedup.dedup_exact(keyed, ["id"]).collect()) == [1, 3, 4]


def test_empty_descriptions_collapse_or_not(spark):
    postings = spark.createDataFrame(
        [(1, "a", "", "u1"), (2, "a", None, "u2"), (3, "a", " ", "u1"), (4, "b", "", "u1")],
        "id int, company string, description string, url string")
    collapsed = dedup.dedup_exact(joins.with_keys(postings), ["id"])
    assert sorted(r.id for r in collapsed.collect()) == [1, 4]
    apart = dedup.dedup_exact(joins.with_keys(postings, empty_description="by_url"), ["id"])
    assert sorted(r.id for r in apart.collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        joins.with_keys(postings, empty_description="?")


def test_salted_join_keeps_every_row(spark):
    big = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2)], "k string, i int")
    small = spark.createDataFrame([("hot", "h"), ("cold", "c"), ("other", "o")], "k string, v string")
    left = joins.salted_join(big, small, ["k"], "left", ["i"])
    assert left.count() == 302 and left.where("v = 'h'").count() == 300
    assert joins.salted_join(big, small.select("k"), ["k"], "left_anti", ["i"]).count() == 1


def test_postings_are_made_once(spark):
    """A function that makes postings ran for the keys and again for the rows returned."""
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(ARRIVALS, SCHEMA).mapInArrow(make, SCHEMA)
    assert sorted(r.id for r in dedup.dedup_with_expiry(rows, 5).collect()) == [1, 3, 4, 5, 7]
    assert made.value == len(ARRIVALS)
