"""A store in versions: merges that die, meet, and what readers see meanwhile."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolecall.sources import postings as readers
from rolecall.sources import sinks
from rolecall.sources.versions import COMMIT, VersionedStore
from test_store import posting

LATER = {"scraped_at": datetime(2025, 12, 1)}


def day(spark, *changes, name="s"):
    return sinks.with_partitions(posting(spark, *changes), name)


def shown(df):
    return sorted((r.url, r.title, r.month) for r in df.collect())


def test_versions_stay_as_they_were(spark, tmp_path):
    store = VersionedStore(str(tmp_path / "store"))
    assert store.versions(spark) == []
    assert store.merge(day(spark, {}, {"url": "u2", **LATER})) == 1
    assert store.merge(day(spark, {"title": "Again"}, {"url": "u3", "title": "New"})) == 2
    first = [("u1", "Go Dev", "11"), ("u2", "Go Dev", "12")]
    assert shown(store.read(spark, 1)) == first
    assert shown(store.read(spark)) == sorted([*first, ("u3", "New", "11")])
    # The month that wasn't touched is not written again.
    assert len([d for d, _, files in os.walk(tmp_path / "store" / "data") if "month=12" in d and "day=" in d]) == 1
    for version in (0, 3):
        with pytest.raises(ValueError):
            store.read(spark, version)
    with pytest.raises(ValueError):
        VersionedStore(str(tmp_path / "none")).read(spark)


def test_a_merge_that_dies_shows_nothing(spark, tmp_path):
    store = VersionedStore(str(tmp_path / "store"))
    store.merge(day(spark))
    reader = store.read(spark)

    class Dying(VersionedStore):
        def _publish(self, *given):
            raise OSError("lost")

    with pytest.raises(OSError):
        Dying(store.path).merge(day(spark, {"url": "u2"}))
    assert store.versions(spark) == [1] and shown(store.read(spark)) == [("u1", "Go Dev", "11")]
    store.merge(day(spark, {"url": "u3"}))
    assert [u for u, *_ in shown(store.read(spark))] == ["u1", "u3"]
    assert shown(reader) == [("u1", "Go Dev", "11")]


def test_two_merges_at_once_both_count(spark, tmp_path):
    store = VersionedStore(str(tmp_path / "store"))

    class Overtaken(VersionedStore):
        tries = 0

        def _write(self, *given):
            commit = super()._write(*given)
            self.tries += 1
            if self.tries == 1:
                store.merge(day(spark, {"title": "First"}, {"url": "u2"}))
            return commit

    late = Overtaken(store.path)
    assert late.merge(day(spark, {"title": "Second"}, {"url": "u3"})) == 2 and late.tries == 2
    assert [(u, t) for u, t, _ in shown(store.read(spark))] == [("u1", "First"), ("u2", "Go Dev"), ("u3", "Go Dev")]


def test_columns_that_come_later_nulls_and_empty_batches(spark, tmp_path):
    store = VersionedStore(str(tmp_path / "store"))
    store.merge(day(spark).where("false"))
    assert store.read(spark).count() == 0
    store.merge(day(spark, {}).drop("tags"))
    nameless = day(spark, {"url": "u2"}, {"url": "u2"}, {"url": "u3", "scraped_at": None}, name=None).withColumn(
        "name", F.lit(None).cast("string")).withColumn("note", F.lit("n"))
    store.merge(nameless)
    store.merge(day(spark, {"url": "u2", "title": "Again"}, {"url": "u4"}, name=""))
    rows = {r.url: r for r in store.read(spark).collect()}
    assert sorted(rows) == ["u1", "u2", "u3", "u4"] and store.read(spark).count() == 4
    assert rows["u1"].tags is None and rows["u2"].tags == ["Go", "Rust"]
    assert (rows["u1"].note, rows["u2"].note, rows["u2"].title, rows["u2"].name) == (None, "n", "Go Dev", None)
    assert (rows["u3"].day, rows["u4"].note) == (None, None)
    assert store.merge(day(spark).where("false")) == 5 and store.read(spark).count() == 4
    with pytest.raises(ValueError):
        store.merge(day(spark).withColumn(COMMIT, F.lit("x")))


def test_vacuum_leaves_what_versions_name(spark, tmp_path):
    store = VersionedStore(str(tmp_path / "store"))
    for url in ("u1", "u2", "u3"):
        store.merge(day(spark, {"url": url}, {"url": f"{url}-later", **LATER} if url == "u1" else {"url": url}))
    store.vacuum(spark, 2, idle_seconds=3600)
    assert store.versions(spark) == [2, 3] and len(os.listdir(tmp_path / "store" / "data")) == 3
    store.vacuum(spark, 1, idle_seconds=-1)
    # The first commit still holds December.
    assert len(os.listdir(tmp_path / "store" / "data")) == 2
    assert [u for u, *_ in shown(store.read(spark))] == ["u1", "u1-later", "u2", "u3"]
    with pytest.raises(ValueError):
        store.vacuum(spark, 0)


def test_stored_rows_of_a_null_partition_stay(spark, tmp_path):
    path = str(tmp_path / "plain")
    for url in ("u1", "u2"):
        sinks.write_postings(day(spark, {"url": url}).withColumn("name", F.lit(None).cast("string")), path)
    sinks.write_postings(day(spark, {"url": "u3"}, name=""), path)
    assert sorted(r.url for r in readers.read_store(spark, path).collect()) == ["u1", "u2", "u3"]


def test_only_folders_of_the_version_are_read(spark, tmp_path):
    store, path = VersionedStore(str(tmp_path / "store")), str(tmp_path / "plain")
    for url in ("u1", "u2"):
        store.merge(day(spark, {"url": url}, {"url": url, **LATER}))
        sinks.write_postings(day(spark, {"url": url}, {"url": url, **LATER}), path)
    at_hand = spark.createDataFrame([("s", "2025", "11", "20251104")], "name string, year string, month string, day string")
    for rows, files in ((store.read(spark), 4), (readers.read_existing(spark, path, at_hand), 2)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "dynamicpruning" in plan
        assert rows.count() == files


def many_days(spark, count):
    """A posting a day."""
    days = day(spark).drop(*sinks.STORE_PARTITIONS).withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return sinks.with_partitions(days.withColumns({
        "url": F.concat(F.lit("u"), "id"), "scraped_at": F.timestamp_seconds(F.lit(1735689600) + F.col("id") * 86400)}).drop("id"), "s")


def folders(path):
    return [d for d, _, files in os.walk(path) if any(f.endswith(".parquet") for f in files)]


def test_many_days_of_few_rows_are_few_folders(spark, tmp_path):
    store, rows = VersionedStore(str(tmp_path / "store")), many_days(spark, 300)
    assert store.merge(rows) == 1 and len(folders(tmp_path / "store" / "months")) == 10
    store.merge(rows.limit(0))
    # A day more and a day again, by day; then all days again.
    store.merge(day(spark, {"url": "late", **LATER}, {"url": "late", "scraped_at": datetime(2025, 3, 1), "title": "New"}, {"url": "u59", "scraped_at": datetime(2025, 3, 1)}))
    assert len(folders(tmp_path / "store" / "data")) == 2
    for again in (False, True):
        if again:
            store.merge(rows.withColumns({"title": F.lit("Again"), "note": F.lit("n")}))
        got = {(r.url, r.day): r.title for r in store.read(spark).collect()}
        assert store.read(spark).count() == len(got) == 302 and "Again" not in got.values()
        assert (got["late", "20250301"], got["u59", "20250301"]) == ("New", "Go Dev") and ("late", "20251201") in got
        assert store.read(spark, 1).count() == 300 and store.read(spark).columns[-4:] == list(sinks.STORE_PARTITIONS)
    store.vacuum(spark, 1, idle_seconds=-1)
    assert store.read(spark).count() == 302 and len(os.listdir(tmp_path / "store" / "months")) == 1
