"""The log of remembered postings against one arrival after the other."""

import os

import pytest

from rolecall import schemas
from rolecall.operators import dedup
from rolecall.streaming.seen_log import SeenLog
from test_dedup import SCHEMA, at, random_arrivals, slow_fold


def test_batches_meet_what_the_log_holds(spark, tmp_path):
    rows = sorted(random_arrivals(4, 50, 60), key=lambda r: (r[2], r[3]))
    log, got = SeenLog(str(tmp_path / "log"), 2), []
    parts = [rows[i:i + 10] for i in range(0, 50, 10)]
    for batch, part in enumerate(parts):
        got += [r.id for r in log.append(spark.createDataFrame(part, SCHEMA), batch, 50).collect()]
    assert sorted(got) == slow_fold(rows, 50)
    # A batch that is repeated reads and leaves what it did before.
    again = log.append(spark.createDataFrame(parts[3], SCHEMA), 3, 50)
    assert {r.id for r in again.collect()} == {r.id for r in spark.createDataFrame(parts[3], SCHEMA).collect()} & set(got)
    assert sorted(os.listdir(tmp_path / "log" / "base")) == ["batch=2", "batch=4"]


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    log = SeenLog(str(tmp_path / "log"), 100)
    log.append(spark.createDataFrame([(f"c{i}", "A", at(0), i) for i in range(500)], SCHEMA), 0, 5000)
    log.append(spark.createDataFrame([("c1", "A", at(1), 500), ("c2", "B", at(1), 501)], SCHEMA), 1, 5000)
    assert spark.read.parquet(str(tmp_path / "log" / "added" / "batch=1")).count() == 1
    assert log.before(spark, 2).count() == 501


def test_bases_are_spaced(tmp_path):
    with pytest.raises(ValueError):
        SeenLog(str(tmp_path), 0)


@pytest.mark.parametrize("hot_rows", [1_000_000, 9])
def test_changes_are_those_of_slices(spark, hot_rows):
    """Random arrivals of many ttls in two batches, the last of which has a late row; companies that stay away lapse, too."""
    rows = sorted(random_arrivals(9, 60, 60), key=lambda r: (r[2], r[3]))
    parts = [rows[:20] + [("quiet", "A", rows[15][2], 900)], rows[20:] + [("late", "A", rows[3][2], 901)]]
    stores = [spark.createDataFrame([], schemas.SEEN)] * 2
    for part in parts:
        df, after = spark.createDataFrame(part, SCHEMA), []
        walked = dedup.batch_changes(df, 600, stores[0], hot_rows)
        sliced = dedup.fold_changes(df, 600, stores[1])
        assert sorted(map(tuple, walked[0].collect())) == sorted(map(tuple, sliced[0].collect())) != []
        stores = [dedup.materialize(dedup.seen_after(store, *changes), "store") for store, changes in zip(stores, (walked, sliced))]
        assert sorted(map(str, stores[0].collect())) == sorted(map(str, stores[1].collect()))
    none = dedup.batch_changes(spark.createDataFrame([], SCHEMA), 20, stores[0])
    assert [df.count() for df in none] == [0, 0]


def test_a_long_batch_takes_no_step_per_ttl(spark, tmp_path, monkeypatch):
    """A batch that spans hundreds of ttls was a job or more for each of them."""
    monkeypatch.setattr(dedup, "dedup_slice", None)
    rows = [("c", "A", at(100 * i), i) for i in range(300)]
    news = SeenLog(str(tmp_path / "log")).append(spark.createDataFrame(rows, SCHEMA), 0, 10)
    assert news.count() == 300
