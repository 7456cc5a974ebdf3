"""Expiring dedup on a stream, with the state of each company in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolecall.session import ROCKSDB, STATE_STORE


#: How long the state of a company without arrivals is kept, in seconds of running time.
KEPT_SECONDS = 7 * 86400


class SeenPostings(StatefulProcessor):
    """The live set and clock of one company."""

    def __init__(self, ttl_millis: int, kept_millis: int):
        self.ttl, self.kept = ttl_millis, kept_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        content = T.StructType([T.StructField("content_hash", T.StringType())])
        moment = T.StructType([T.StructField("at", T.LongType())])
        self.live = handle.getListState("contents", content)
        self.expiry = handle.getValueState("expiry", moment)
        self.timer = handle.getValueState("timer", moment)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrivals = pd.concat(list(rows)).sort_values(["ts", "id"])
        times = [ts.value // 1_000_000 for ts in arrivals["ts"]]
        stored = self.expiry.get()
        before = expiry = stored[0] if stored else None
        # A call of the state costs more than a row, so the set is read and added to at once.
        lapsed = before is not None and times[0] >= before
        live = {content for content, in self.live.get()} if before is not None and not lapsed else set()
        new, added = [], []
        for content, at in zip(arrivals["content_hash"], times):
            if expiry is not None and at >= expiry:
                live, added, lapsed = set(), [], True
            new.append(content not in live)
            if new[-1]:
                live.add(content)
                added.append((content,))
                # A row that is late does not turn the clock back.
                expiry = max(expiry or 0, at + self.ttl)
        if lapsed and before is not None:
            self.live.put(added)
        elif added:
            self.live.appendList(added)
        if expiry != before:
            self.expiry.update((expiry,))
        if timer := self.timer.get():
            self.handle.deleteTimer(timer[0])
        quiet = int(arrivals["arrived_ms"].max()) + self.kept
        self.handle.registerTimer(quiet)
        self.timer.update((quiet,))
        yield arrivals[new][["company_key", "content_hash", "ts", "id"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Frees the state of a company that has been quiet for long enough."""
        self.live.clear()
        self.expiry.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedup_stream(postings: DataFrame, ttl_seconds: int, ts: str = "ts", id: str = "id",
                 kept_seconds: int = KEPT_SECONDS) -> DataFrame:
    """(company_key, content_hash, ts, id) of the new postings of a stream.

    Postings are judged as they arrive, those of one trigger in the order (ts, id).
    None is dropped as late: a late one meets the set as it then is. A company
    without arrivals for ``kept_seconds`` (at least the ttl) of running time is
    forgotten; a replay that pauses longer starts it anew. State is kept
    by company, off heap; what a company's task handles at once is bounded
    by its live set and the files per trigger. For streams in which one company may fill whole
    triggers, :func:`rolecall.streaming.search.run_search_stream` keeps its state
    in tables instead and has no such task.
    """
    if ttl_seconds <= 0:
        raise ValueError(f"ttl_seconds must be positive, got {ttl_seconds}")
    # The only state store that can hold maps and timers; set for this session.
    postings.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    # The watermark follows the arrival, so it is behind every row of a trigger: it
    # moves timers and drops nothing. Processing-time timers would need triggers
    # without end, which a run over what is available must not have.
    keyed = postings.select("company_key", "content_hash", F.col(ts).cast("timestamp").alias("ts"),
                            F.col(id).alias("id"), F.current_timestamp().alias("arrived"),
                            F.unix_millis(F.current_timestamp()).alias("arrived_ms")).withWatermark(
        "arrived", "1 minute")
    schema = T.StructType([
        T.StructField("company_key", T.StringType()), T.StructField("content_hash", T.StringType()),
        T.StructField("ts", T.TimestampType()), T.StructField("id", keyed.schema["id"].dataType)])
    return keyed.groupBy("company_key").transformWithStateInPandas(
        statefulProcessor=SeenPostings(ttl_seconds * 1000, max(ttl_seconds, kept_seconds) * 1000),
        outputStructType=schema, outputMode="Append", timeMode="EventTime")
