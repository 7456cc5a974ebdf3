"""The search cycle on a stream of postings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from rolecall import schemas
from rolecall.functions.taxonomy import DEFAULT_TAXONOMY, Taxonomy
from rolecall.operators.dedup import KEYS
from rolecall.operators.joins import with_keys
from rolecall.operators.summary import (
    category_summary_of_counts, merge_counts, rollup_category_summary, rollup_tag_summary, run_totals,
    summary_counts, tag_summary_of_counts)
from rolecall.plans.search import search
from rolecall.sources.postings import read_store
from rolecall.session import shared_files
from rolecall.sources.sinks import added_postings, with_partitions, write_postings
from rolecall.sources.specs import DEFAULT_TTL_SECONDS, SearchSpec, enabled
from rolecall.streaming.seen_log import SeenLog


@dataclass
class SearchJob:
    """What one batch of arriving postings goes through, and where its results
    are kept. All folders are shared ones.

    Each step can be repeated: what a batch remembers is a part of a log by its
    number, the store is merged by url, and the runs are written per batch.
    ``found`` holds what each batch found by search, as observed while it was written.
    """

    specs: list[SearchSpec]
    folder: str
    ttl_seconds: int = DEFAULT_TTL_SECONDS
    ts: str = "scraped_at"
    id: str = "id"
    taxonomy: Taxonomy = DEFAULT_TAXONOMY
    empty_description: str = "collapse"
    match_options: dict = field(default_factory=dict)
    compact_every: int = 16
    found: dict[int, dict[str, int]] = field(default_factory=dict)

    @property
    def store(self) -> str:
        return f"{self.folder}/postings"

    @property
    def seen(self) -> SeenLog:
        return SeenLog(f"{self.folder}/seen", self.compact_every)

    def new_postings(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The new ones of a batch; remembers them for the next."""
        keyed = with_keys(batch, empty_description=self.empty_description)
        rows = keyed.select(*KEYS, F.col(self.ts).cast("timestamp").alias("ts"),
                            F.col(self.id).alias("id"))
        news = self.seen.append(rows, batch_id, self.ttl_seconds)
        return keyed.join(news.select(F.col("id").alias(self.id)), self.id, "left_semi")

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Dedup, match, limit, classify, store, summarise; and note what was found."""
        spark = batch.sparkSession
        # Read once, though keys and postings are both needed; a lost part is
        # read again from the source.
        batch = batch.persist()
        try:
            found = search(self.new_postings(batch, batch_id), self.specs, [self.ts, self.id],
                           self.taxonomy, **self.match_options)
            path = f"{self.folder}/found/batch={batch_id}"
            observed = Observation(f"found-{batch_id}")
            names = [spec.name for spec in enabled(self.specs)]
            counts = [F.count_if(F.col("name") == name).alias(f"s{i}") for i, name in enumerate(names)]
            watched = found.observe(observed, *counts) if counts else found
            watched.drop(*KEYS).write.mode("overwrite").parquet(path)
            self.found[batch_id] = {name: observed.get[f"s{i}"] for i, name in enumerate(names)} if counts else {}
        finally:
            batch.unpersist()
        stored = read_store(spark, path)
        runs = stored.groupBy("name").agg(F.count("*").alias("found")).select(
            "name", F.lit(batch_id).cast("bigint").alias("run_id"), "found")
        runs.write.mode("overwrite").parquet(f"{self.folder}/runs/batch={batch_id}")
        dated = with_partitions(stored, ts=self.ts)
        self._count(dated, batch_id)
        write_postings(dated, self.store)
        for kind, summary in self._summaries(dated).items():
            summary.write.mode("overwrite").parquet(f"{self.folder}/{kind}_summary/batch={batch_id}")

    def _counts_path(self, batch_id: int) -> str:
        return f"{self.folder}/counts/batch={batch_id}"

    def _count(self, dated: DataFrame, batch_id: int) -> None:
        """Counts of what the store will hold: those before, and what the batch adds.
        They are written before the store, and once: when a batch is repeated, the
        store may hold its postings already."""
        spark, path = dated.sparkSession, self._counts_path(batch_id)
        files, done = shared_files(spark, f"{path}/_SUCCESS")
        if files.exists(done):
            return
        counts = summary_counts(added_postings(dated, self.store))
        if batch_id:
            counts = counts.unionByName(read_store(spark, self._counts_path(batch_id - 1)))
        merge_counts(counts).write.mode("overwrite").parquet(path)

    def totals(self, spark: SparkSession, kind: str, batch_id: int) -> DataFrame:
        """Category or tag shares of everything stored up to a batch, by search and
        month, from counts alone."""
        counts = read_store(spark, self._counts_path(batch_id))
        if kind == "tag":
            return tag_summary_of_counts(counts)
        return category_summary_of_counts(counts, categories=self.taxonomy.categories)

    def _summaries(self, dated: DataFrame) -> dict[str, DataFrame]:
        return {
            "category": rollup_category_summary(dated, categories=self.taxonomy.categories),
            "tag": rollup_tag_summary(dated),
        }

    def batch_summary(self, spark: SparkSession, kind: str, batch_id: int) -> DataFrame:
        """Category or tag shares of what one batch found, by search and month."""
        return read_store(spark, f"{self.folder}/{kind}_summary/batch={batch_id}")

    def summary(self, spark: SparkSession, kind: str) -> DataFrame:
        """Category or tag shares of everything stored, by search and month."""
        return self._summaries(read_store(spark, self.store))[kind]

    def runs(self, spark: SparkSession) -> DataFrame:
        """What each run of each search found, and the totals so far."""
        return run_totals(spark.read.schema(schemas.RUNS).parquet(f"{self.folder}/runs"))


def run_search_stream(postings: DataFrame, job: SearchJob, checkpoint: str,
                      interval: int | None = None) -> StreamingQuery:
    """Repeats the search every ``interval`` seconds on what has arrived; without
    an interval, once over all there is."""
    writer = postings.writeStream.foreachBatch(job.process_batch).option(
        "checkpointLocation", checkpoint)
    trigger = {"processingTime": f"{interval} seconds"} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


class SearchProgress(StreamingQueryListener):
    """Counts runs, the postings that came in, and those that each search of a job
    found, in all and by run, while a stream is running."""

    def __init__(self, job: SearchJob | None = None) -> None:
        self.job = job
        self.runs = 0
        self.postings = 0

    def found(self, name: str, run: int | None = None) -> int:
        """What a search found in a run, or in all of them so far."""
        runs = self.job.found if self.job else {}
        return sum(by_name.get(name, 0) for batch, by_name in list(runs.items()) if run in (None, batch))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.runs += 1
        self.postings += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
