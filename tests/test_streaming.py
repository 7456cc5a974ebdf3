from datetime import datetime, timedelta

import pytest

from rolecall.operators import dedup, joins
from rolecall.plans import search
from rolecall.sources.postings import read_postings_stream, read_store
from rolecall.sources.specs import SearchSpec
from rolecall.streaming.dedup import dedup_stream
from rolecall.streaming.search import SearchJob, SearchProgress, run_search_stream

from test_dedup import SCHEMA, random_arrivals, slow_fold

START = datetime(2024, 1, 1)


def files_in_order(spark, rows, schema, path, parts):
    """One file per part of the rows, in the order of time."""
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return read_postings_stream(spark, path, spark.createDataFrame([], schema).schema, 1)


def test_stateful_stream_equals_batch(spark, tmp_path):
    rows = sorted(random_arrivals(4, 90), key=lambda r: (r[2], r[3]))
    stream = files_in_order(spark, rows, SCHEMA, str(tmp_path / "in"), 3)
    query = (dedup_stream(stream, 30).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
             .start(str(tmp_path / "out")))
    query.awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == slow_fold(rows, 30)
    with pytest.raises(ValueError):
        dedup_stream(stream, 0)


def test_late_rows_are_judged_when_they_arrive(spark, tmp_path):
    """The last two files are older than the first two: B is new, C is known."""
    rows = [("x", "A", START + timedelta(hours=5), 1), ("x", "C", START + timedelta(hours=9), 2),
            ("x", "B", START, 3)]
    rows.append(("x", "C", START, 4))
    stream = files_in_order(spark, rows, SCHEMA, str(tmp_path / "in"), 4)
    query = (dedup_stream(stream, 86400).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
             .start(str(tmp_path / "out")))
    query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


POSTINGS = ("id bigint, title string, company string, location string, url string, description string, "
            "scraped_at timestamp")


def arrivals():
    rows = []
    for i in range(24):
        company, text = ("Acme", "Beta")[i % 2], ("Python and Docker", "python", "Go")[i % 3]
        rows.append((i, f"Dev {i % 5}", company, "Remote", f"u{i % 20}", text, START + timedelta(days=i)))
    return rows


SPECS = [SearchSpec("py", "linkedin", keywords=("python",)),
         SearchSpec("all", "linkedin", max_results=3)]


def test_search_stream_and_its_reruns(spark, tmp_path):
    job = SearchJob(SPECS, str(tmp_path / "job"), ttl_seconds=5 * 86400)
    stream = files_in_order(spark, arrivals(), POSTINGS, str(tmp_path / "in"), 2)
    progress = SearchProgress(job)
    spark.streams.addListener(progress)
    run_search_stream(stream, job, str(tmp_path / "cp")).awaitTermination()

    # What a batch over everything finds new is what the stream found new.
    keyed = joins.with_keys(spark.createDataFrame(arrivals(), POSTINGS))
    fresh = dedup.dedup_with_expiry(keyed, 5 * 86400, ts="scraped_at")
    batch = search.search(fresh, SPECS[:1], ["scraped_at", "id"]).dropDuplicates(["url"])
    stored = read_store(spark, job.store)
    assert {r.url for r in stored.where("name = 'py'").collect()} == {r.url for r in batch.collect()}
    per_run = {(r["name"], r.run_id): (r.found, r.total_found) for r in job.runs(spark).collect()}
    assert per_run["all", 0][0] == 3 and per_run["all", 1] == (3, 6)
    # What was observed while the batches were written is what the runs add up.
    assert {k: progress.found(*k) for k in per_run} == {k: v[0] for k, v in per_run.items()}
    assert progress.found("all") == 6 and progress.found("py") == per_run["py", 1][1]

    everything = job.summary(spark, "category").where("grain = 'all'").first()
    assert everything.total_jobs == stored.count()
    tags = {r.tag: r.job_count for r in job.batch_summary(spark, "tag", 0).where("grain = 'name' and name = 'py'").collect()}
    assert tags["Python"] == per_run["py", 0][0]

    before = sorted(map(str, stored.collect()))
    job.process_batch(spark.createDataFrame(arrivals()[12:], POSTINGS), 1)
    assert sorted(map(str, read_store(spark, job.store).collect())) == before
    assert {(r["name"], r.run_id): r.found for r in job.runs(spark).collect()} == {
        k: v[0] for k, v in per_run.items()}
    spark.streams.removeListener(progress)
    assert progress.postings == 24 and progress.runs == 2


def test_totals_of_counts_are_a_recount(spark, tmp_path):
    """After each batch, and after one that is repeated, counts say what the store holds."""
    job = SearchJob([SearchSpec("py", "linkedin", keywords=("python",)), SearchSpec("all", "linkedin")], str(tmp_path))
    rows = arrivals()
    # Stored urls come again in later batches, on other days and on the same one.
    batches = [rows[:10], rows[10:], [(100 + r[0], "Again", "Gamma", *r[3:]) for r in rows[5:15]]]
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, POSTINGS)
        for _ in range(1 + (number == 1)):
            job.process_batch(df, number)
        for kind in ("category", "tag"):
            assert sorted(map(str, job.totals(spark, kind, number).collect())) == sorted(
                map(str, job.summary(spark, kind).collect()))


def test_state_is_called_a_few_times_per_company_and_batch(spark):
    """Every row asked the state and most wrote to it; now a set is read and added to at once."""
    import pandas as pd
    from rolecall.streaming.dedup import SeenPostings

    class State:
        def __init__(self, calls):
            self.calls, self.held = calls, None

        def __getattr__(self, name):
            def call(value=None):
                self.calls.append(name)
                if name in ("update", "put"):
                    self.held = value
                elif name == "appendList":
                    self.held = (self.held or []) + value
                elif name == "get":
                    return iter(self.held or []) if isinstance(self.held, list) or self.listed else self.held
            return call

    class Handle:
        def __init__(self):
            self.calls = []

        def _state(self, *_, listed=False):
            state = State(self.calls)
            state.listed = listed
            return state

        getValueState = getMapState = _state

        def getListState(self, *_):
            return self._state(listed=True)

        def registerTimer(self, _):
            self.calls.append("registerTimer")

        deleteTimer = registerTimer

    def rows(days, contents):
        return iter([pd.DataFrame({"company_key": "c", "content_hash": contents, "arrived_ms": 0, "id": range(len(days)),
                                   "ts": pd.to_datetime([START + timedelta(days=d) for d in days])})])

    handle, processor = Handle(), SeenPostings(5 * 86_400_000, 7 * 86_400_000)
    processor.init(handle)
    fresh = lambda days, contents: list(next(iter(processor.handleInputRows(("c",), rows(days, contents), None)))["id"])
    many = [f"t{i}" for i in range(500)]
    assert len(fresh([0] * 500, many)) == 500 and len(handle.calls) <= 10
    assert fresh([1, 4, 4], ["t3", "new", "new"]) == [1]
    # Renewed on day 4, so t3 is known on day 8; on day 9 the set is gone, and what comes then is remembered.
    assert fresh([8, 9, 9], ["t3", "t3", "new"]) == [1, 2]
    assert fresh([10, 10], ["t3", "t4"]) == [1]
