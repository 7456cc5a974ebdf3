from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rolecall import schemas
from rolecall.plans.history import history_summary, reclassified
from rolecall.sources import postings as readers
from rolecall.sources import sinks
from rolecall.sources.specs import (
    SOURCES, SearchSpec, by_name, enabled, read_specs, register_search_type, specs_frame, specs_from_config)


def posting(spark, *changes):
    base = {"title": "Go Dev", "company": "Acme", "location": "Remote", "url": "u1", "description": "d",
            "source": "linkedin", "posted_date": date(2025, 11, 2), "posted_time": 3600,
            "scraped_at": datetime(2025, 11, 4, 5, 6, 7), "category": "Backend", "tags": ["Go", "Rust"],
            "classification_confidence": 0.3}
    rows = [tuple({**base, **change}[n] for n in schemas.POSTINGS.fieldNames()) for change in changes or ({},)]
    return spark.createDataFrame(rows, schemas.POSTINGS)


def test_upsert_keeps_the_first_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "url string, v int")
    new = spark.createDataFrame([("b", 2, "n"), ("c", 3, "n"), ("c", 2, "m")], "url string, v int, extra string")
    merged = sinks.upsert_postings(old, new, order_by=("v",))
    rows = {r.url: (r.v, r.extra) for r in merged.collect()}
    assert rows == {"a": (1, None), "b": (1, None), "c": (2, "m")}
    again = sinks.upsert_postings(merged, new, order_by=("v",))
    assert {r.url: (r.v, r.extra) for r in again.collect()} == rows
    assert sinks.upsert_postings(old.where("false"), new.where("false")).count() == 0
    assert sinks.upsert_postings(old.drop("url"), new.drop("url")).count() == 5


def test_store_merges_within_its_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    write = lambda df: sinks.write_postings(sinks.with_partitions(df, "s"), path)
    write(posting(spark, {}, {"url": "u2"}, {"url": "u2", "title": "Later", "scraped_at": datetime(2025, 11, 4, 9)}))
    write(posting(spark, {"title": "Again"}, {"url": "u3", "scraped_at": datetime(2025, 12, 1)}))
    write(posting(spark, {"title": "Again"}))
    got = readers.read_store(spark, path)
    assert sorted((r.url, r.title, r.month, r.day) for r in got.collect()) == [
        ("u1", "Go Dev", "11", "20251104"), ("u2", "Go Dev", "11", "20251104"), ("u3", "Go Dev", "12", "20251201")]


def test_unreadable_store_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_store(spark, str(tmp_path / "none")).count()


def test_a_folder_that_is_no_store_is_not_overwritten(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        sinks.write_postings(sinks.with_partitions(posting(spark), "s"), str(tmp_path / "store"))
    assert (tmp_path / "store" / "part.parquet").read_text() == "no parquet"
    assert not readers.store_exists(spark, str(tmp_path / "none"))


def test_a_hot_day_is_merged_whole(spark, tmp_path):
    """Most postings are of one day, half of them copies of one url."""
    path = str(tmp_path / "store")
    rows = posting(spark).select([c for c in schemas.POSTINGS.fieldNames() if c != "url"])
    many = rows.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(399)))).withColumn(
        "url", F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.concat(F.lit("u"), "id"))).withColumn(
        "scraped_at", F.when(F.col("id") < 390, F.col("scraped_at")).otherwise(F.lit(datetime(2025, 12, 1)))).drop("id")
    for _ in range(2):
        sinks.write_postings(sinks.with_partitions(many, "s"), path)
    got = readers.read_store(spark, path)
    assert got.count() == 200 + 2 and got.where("url = 'same'").count() == 2


def test_many_days_of_few_rows_are_few_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    days = posting(spark).withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(299)))).withColumns({
        "url": F.concat(F.lit("u"), "id"), "scraped_at": F.timestamp_seconds(F.lit(1735689600) + F.col("id") * 86400)}).drop("id")
    write = lambda df: sinks.write_postings(sinks.with_partitions(df, "s"), path)
    write(days)
    assert len([d for d in (tmp_path / "store").rglob("month=*/") if list(d.glob("*.parquet"))]) == 10
    write(posting(spark, {"url": "u0", "title": "Again", "scraped_at": datetime(2025, 1, 1)},
                  {"url": "u0", "title": "New", "scraped_at": datetime(2025, 1, 2)}, {"url": "late", "scraped_at": datetime(2025, 12, 1)}))
    write(days.withColumn("title", F.lit("Again")))
    rows = readers.read_store(spark, path)
    got = {(r.url, r.month, r.day): r.title for r in rows.collect()}
    assert rows.count() == len(got) == 302 and rows.columns[-4:] == list(readers.STORE_PARTITIONS)
    assert "Again" not in got.values() and got["u0", "01", "20250102"] == "New" and ("late", "12", "20251201") in got
    at_hand = sinks.with_partitions(posting(spark, {"scraped_at": datetime(2025, 1, 2)}), "s")
    assert sorted(r.url for r in readers.read_existing(spark, path, at_hand).collect()) == ["u0", "u1"]


def test_day_file_round_trip(spark, tmp_path):
    root = str(tmp_path / "output")
    df = posting(spark, {"title": 'A "quoted", two\nline title'}, {"url": "u2", "tags": [], "posted_time": None})
    path = sinks.write_postings_csv(df, root, "s", datetime(2025, 11, 4))
    assert path.endswith("/s/2025/11/s_jobs_20251104.csv")
    back = {r.url: r.asDict() for r in readers.read_postings(spark, root).collect()}
    assert back["u1"]["title"] == 'A "quoted", two\nline title' and back["u1"]["description"] == ""
    assert back["u1"]["tags"] == ["Go", "Rust"] and back["u1"]["posted_time"] == 3600
    assert back["u1"]["posted_date"] == date(2025, 11, 2) and back["u2"]["tags"] == []
    assert back["u2"]["posted_time"] is None


def test_day_file_is_merged(spark, tmp_path):
    root, day = str(tmp_path / "output"), datetime(2025, 11, 4)
    sinks.write_postings_csv(posting(spark, {}, {"url": "u2"}), root, "s", day)
    path = sinks.write_postings_csv(posting(spark, {"title": "Again"}, {"url": "u3"}, {"url": "u3"}), root, "s", day)
    got = sorted((r.url, r.title, r.tags) for r in readers.read_postings(spark, root).collect())
    assert got == [(u, "Go Dev", ["Go", "Rust"]) for u in ("u1", "u2", "u3")]
    # A write lost between the removal of the old file and the rename.
    (tmp_path / path).rename(f"{path}.new")
    assert readers.read_postings(spark, root).count() == 0
    sinks.write_postings_csv(posting(spark, {"url": "u4"}), root, "s", day)
    assert sorted(r.url for r in readers.read_postings(spark, root).collect()) == ["u1", "u2", "u3", "u4"]


HEADER = ",".join(schemas.OUTPUT_COLUMNS)


def test_reads_day_files_others_wrote(spark, tmp_path):
    folder = tmp_path / "output" / "s" / "2025" / "11"
    folder.mkdir(parents=True)
    (folder / "s_jobs_20251104.csv").write_text(
        f'{HEADER}\n"Dev, ""x""",Acme,R,u1,linkedin,2025-11-02,3600.0,2025-11-04T05:06:07.5,AI,"Go,Rust",0.3\n'
        f",Acme,R,u2,linkedin,,,2025-11-04T05:06:07,AI,,0.3\n")
    (folder / "s_jobs_summary.csv").write_text("category\nAI\n")
    (folder / "other.csv").write_text("x\n1\n")
    below = tmp_path / "output" / "summary"
    below.mkdir()
    (below / "s_jobs_20251104.csv").write_text(f"{HEADER}\nNo,,,,,,,,,,\n")
    got = {r.url: r for r in readers.read_postings(spark, str(tmp_path / "output")).collect()}
    assert set(got) == {"u1", "u2"}
    assert got["u1"].title == 'Dev, "x"' and got["u1"].posted_time == 3600 and got["u1"].tags == ["Go", "Rust"]
    assert got["u2"].title == "" and got["u2"].posted_time is None
    assert reclassified(readers.read_postings(spark, str(tmp_path / "output"))).count() == 2


def read_csv(path):
    import csv
    import glob
    rows = []
    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(part, newline="") as f:
            rows += list(csv.reader(f))
    return rows


def test_summaries_monthly_total_and_history(spark, tmp_path):
    root, day = str(tmp_path / "output"), datetime(2025, 11, 4)
    df = posting(spark, {"title": "devops"}, {"url": "u2", "title": "frontend", "category": "AI", "tags": []})
    sinks.write_postings_csv(df, root, "s", day)
    sinks.write_monthly_and_total(df, root, "s", day, history=df.union(df))
    monthly = read_csv(f"{root}/summary/2025/11/s_categories_summary.csv")
    assert monthly[0] == ["category", "job_count", "percentage", "total_jobs"]
    assert monthly[1:3] == [["Backend", "1", "50.0", "2"], ["AI", "1", "50.0", "2"]]
    assert read_csv(f"{root}/summary/s_total_tags_summary.csv")[1:] == [
        ["Go", "2", "50.0", "4"], ["Rust", "2", "50.0", "4"]]
    sinks.write_monthly_and_total(df, root, "t", day)
    for place in ("summary/2025/11/t", "summary/t_total"):
        assert read_csv(f"{root}/{place}_categories_summary.csv") == monthly
        assert read_csv(f"{root}/{place}_tags_summary.csv")[0] == ["tag", "job_count", "percentage", "total_jobs"]
    categories, tags = history_summary(spark, root)
    assert {r.category: r.job_count for r in categories.collect() if r.job_count} == {"DevOps": 1, "Frontend": 1}
    assert tags.collect() == []


def test_empty_tag_summary_has_a_header(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    sinks.write_tag_summary(spark.createDataFrame([], "tag string, job_count bigint"), path)
    assert read_csv(path) == [["tag", "job_count"]]
    sinks.write_summaries(posting(spark), str(tmp_path / "plain"))
    assert (tmp_path / "plain" / "categories_summary.csv").exists()


CONFIG = {"workers": [
    {"name": "li", "type": "LinkedIn", "interval": 90, "message": "m", "config": {
        "source": "linkedin", "keywords": ["python", "aws"], "location": "Remote", "job_type": "F",
        "last_time_posted": 86400, "excluded_companies": ["A"]}},
    {"name": "st", "type": "startups", "config": {"keywords": "python"}},
    {"name": "off", "type": "linkedin", "enabled": False, "config": None},
]}


def test_specs_from_config(spark, tmp_path):
    specs = specs_from_config(CONFIG)
    assert [s.name for s in enabled(specs)] == ["li", "st"]
    li, st = by_name(specs, "li"), by_name(specs, "st")
    assert (li.type, li.interval, li.keywords, li.max_results, li.ttl_seconds) == (
        "linkedin", 90, ("python", "aws"), 100, 432000)
    assert (st.keywords, st.interval, st.last_time_posted) == (("python",), 60, None)
    assert by_name(specs, "nope") is None
    path = str(tmp_path / "specs")
    specs_frame(spark, specs).write.json(path)
    assert sorted(read_specs(spark, path), key=lambda s: s.name) == sorted(specs, key=lambda s: s.name)


@pytest.mark.parametrize("bad", [
    {"name": "", "type": "linkedin"}, {"name": "a", "type": ""}, {"name": "a", "type": "job"},
    {"name": "a", "type": "linkedin", "interval": 0},
    {"name": "a", "type": "linkedin", "config": {"keywords": ["x", ""]}},
    {"name": "a", "type": "linkedin", "config": {"ttl_seconds": 0}}])
def test_bad_specs_are_refused(bad):
    with pytest.raises(ValueError):
        specs_from_config({"workers": [bad]})


def test_output_columns_and_drop(spark):
    rows = sinks.to_output_rows(posting(spark))
    assert rows.columns == schemas.OUTPUT_COLUMNS
    assert rows.first().tags == "Go,Rust" and rows.first().scraped_at == "2025-11-04T05:06:07"
    assert "description" in sinks.to_output_rows(posting(spark), keep_description=True).columns
    assert sinks.drop_columns(rows, ["url", "nope"]).columns == [c for c in rows.columns if c != "url"]
    assert sinks.append_union(rows.select("url"), rows.select("title")).columns == ["url", "title"]
    assert rows.select(F.count("*")).first()[0] == 1


def test_register_search_type():
    register_search_type("Board", "board", checks_keywords=False)
    try:
        assert specs_from_config({"workers": [{"name": "b", "type": "BOARD"}]})[0].type == "board"
    finally:
        del SOURCES["board"]
