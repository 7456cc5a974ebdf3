import random
from collections import Counter
from datetime import datetime, timedelta

from rolecall.sources.specs import SearchSpec
from rolecall.streaming import clocks

START = datetime(2024, 1, 1)
POSTINGS = "id bigint, company string, description string, ts timestamp"
SPECS = [SearchSpec("minute", "linkedin", interval=60), SearchSpec("slow", "linkedin", interval=150, keywords=("go",)),
         SearchSpec("off", "linkedin", interval=1, enabled=False)]


def postings(n, seed):
    rng = random.Random(seed)
    # A third of all arrive within one second; runs begin at full minutes, too.
    times = [30 if i % 3 == 0 else rng.choice([rng.randrange(900), 60 * rng.randrange(15)]) for i in range(n)]
    return [(i, "Acme", rng.choice(["Go", "go and rust", "rust", None]), START + timedelta(seconds=t))
            for i, t in enumerate(sorted(times))]


def slow_runs(rows):
    """Each search at each of its times, over what has come since the time before."""
    found = Counter()
    for name, interval, word in (("minute", 60, ""), ("slow", 150, "go")):
        for k in range(1, 1000 // interval + 2):
            low, high = START + timedelta(seconds=interval * (k - 1)), START + timedelta(seconds=interval * k)
            # Postings without a description match no search.
            n = sum(low <= r[3] < high and bool(r[2]) and word in r[2].lower() for r in rows)
            if n:
                found[name, high] = n
    return dict(found)


def test_runs_of_a_table(spark):
    rows = postings(300, 1)
    df = spark.createDataFrame([*rows, (-1, "Acme", "go", None)], POSTINGS).repartition(5)
    runs = clocks.found_by_run(clocks.due_matches(df, SPECS)).collect()
    assert {(r.name, r.due_at): r.found for r in runs} == slow_runs(rows) and len(runs) == len(slow_runs(rows))
    assert clocks.found_by_run(clocks.due_matches(df.where("false"), SPECS)).count() == 0
    assert clocks.found_by_run(clocks.due_matches(df, SPECS[2:])).count() == 0


def test_runs_of_a_stream(spark, tmp_path):
    """A run comes out once its time has passed for sure, with all it found."""
    rows = postings(200, 2)
    for low in range(0, 200, 50):
        spark.createDataFrame(rows[low:low + 50], POSTINGS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POSTINGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    matches = clocks.watched(clocks.due_matches(stream, SPECS), SPECS)
    query = (clocks.found_by_run(matches).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    whole = slow_runs(rows)
    sure = max(due for _, due in whole) - timedelta(seconds=150)
    runs = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.name, r.due_at): r.found for r in runs} == {k: n for k, n in whole.items() if k[1] <= sure}
