"""Seen-before logic: exact, and with a clock per company.

A posting is new unless its content is in the live set of its company. A new
posting joins the set and restarts the clock of the whole company; a duplicate
does not. When ``ttl`` has passed since the last new posting, the set is gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rolecall import schemas
from rolecall.operators.joins import salted_join
from rolecall.operators.ordering import keep_first
from rolecall.session import materialize, scratch_path

KEYS = ["company_key", "content_hash"]

#: Companies with more postings than this are folded slice by slice.
HOT_ROWS = 1_000_000


def dedup_exact(postings: DataFrame, order_by: list[str]) -> DataFrame:
    """The first posting of each company and content."""
    return keep_first(postings, KEYS, order_by)


def seen_store_stats(seen: DataFrame) -> DataFrame:
    """Number of companies and of remembered postings.

    Grouped twice, because distinct counts in one go would send all pairs of a
    hot company to one task.
    """
    pairs = seen.groupBy(*KEYS).agg(F.lit(1).alias("one"))
    companies = pairs.groupBy("company_key").agg(F.count("*").alias("n"))
    return companies.agg(F.count("*").alias("total_companies"),
                         F.coalesce(F.sum("n"), F.lit(0)).alias("total_cached_jobs"))


def mark_seen(seen: DataFrame, postings: DataFrame, ts: str) -> DataFrame:
    """Remembers postings without asking whether they are known: latest time per
    company and content."""
    added = postings.select(*KEYS, F.col(ts).cast("timestamp").alias("seen_at"))
    return (seen.select(*KEYS, "seen_at").unionByName(added)
            .groupBy(*KEYS).agg(F.max("seen_at").alias("seen_at")))


def live_set(seen: DataFrame, ttl_seconds: int, at) -> DataFrame:
    """What is still remembered at a time: the sets of companies whose clock has
    not run out."""
    clocks = _clocks(seen, ttl_seconds).where(F.col("_expiry") > F.lit(at).cast("timestamp"))
    return salted_join(seen, clocks.drop("_expiry"), ["company_key"], "inner",
                       spread_by=["content_hash"])


def reset_seen(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty store, and the number of companies dropped."""
    dropped = seen_store_stats(seen).select("total_companies")
    return seen.sparkSession.createDataFrame([], schemas.SEEN), dropped


def _checked_ttl(ttl_seconds: int) -> int:
    if ttl_seconds <= 0:
        raise ValueError(f"ttl_seconds must be positive, got {ttl_seconds}")
    return ttl_seconds


def _required(name: str, kind: str | None = None) -> Column:
    """The column, which may not be null."""
    value = F.col(name).cast(kind) if kind else F.col(name)
    return F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.lit(f"expiring dedup needs a value in {name!r} of every posting")))


def _clocks(seen: DataFrame, ttl_seconds: int) -> DataFrame:
    """When the set of each company runs out."""
    return seen.groupBy("company_key").agg(
        (F.max("seen_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("_expiry"))


def dedup_slice(rows: DataFrame, seen: DataFrame, ttl_seconds: int,
                last) -> tuple[DataFrame, DataFrame]:
    """New postings of rows that span less than ``ttl_seconds``, the latest of
    them at ``last``, and the companies whose sets ran out by then, with the time.
    ``rows`` holds (company_key, content_hash, ts, id).

    Within such a slice a set can run out at most once, because a new posting
    moves the clock beyond the slice. So everything follows from aggregates:

    * What is not in the store is new, at its first arrival.
    * If such an arrival comes before the set of its company runs out, it renews
      the set, and the rest of the company's postings are duplicates.
    * Otherwise the set has lapsed: of each content, the first arrival after
      that is new, and the store forgets what the set held before.

    A set is forgotten only if it ran out by ``last``: what arrives after these
    rows, in the same slice or not, may still meet one that runs out later.

    Aggregates combine before the shuffle, so a hot company is never one task's
    work.
    """
    _checked_ttl(ttl_seconds)
    arrival = F.min(F.struct("ts", "id")).alias("new")
    firsts = rows.groupBy(*KEYS).agg(arrival)
    unknown = materialize(
        firsts.join(seen.select(*KEYS), KEYS, "left_anti").select(*KEYS, "new.ts", "new.id"),
        "unknown")
    renewals = unknown.groupBy("company_key").agg(F.min("ts").alias("_renewed"))
    lapsed = (_clocks(seen, ttl_seconds).where(F.col("_expiry") <= F.lit(last))
              .join(renewals, "company_key", "left")
              .where(F.col("_renewed").isNull() | (F.col("_renewed") >= F.col("_expiry")))
              .select("company_key", "_expiry"))
    lapsed = materialize(lapsed, "lapsed")
    if lapsed.isEmpty():
        return unknown, lapsed
    late = materialize(
        salted_join(rows, lapsed, ["company_key"], "inner", spread_by=["id"])
        .where(F.col("ts") >= F.col("_expiry"))
        .groupBy(*KEYS).agg(arrival).select(*KEYS, "new.ts", "new.id"), "late")
    spread = ["content_hash"]
    unlapsed = salted_join(unknown, lapsed.select("company_key"), ["company_key"], "left_anti", spread)
    return unlapsed.unionByName(late), lapsed


def seen_after(seen: DataFrame, news: DataFrame, lapsed: DataFrame) -> DataFrame:
    """The store once ``news`` are remembered and ``lapsed`` (company_key, _expiry) sets are
    forgotten, also of companies that did not come back: nothing lapsed is stored for ever."""
    both = seen.select(*KEYS, "seen_at").unionByName(news.select(*KEYS, F.col("ts").alias("seen_at")))
    ends = lapsed.groupBy("company_key").agg(F.max("_expiry").alias("_expiry"))
    # What a set held when it ran out is older than that; what renewed it is not.
    joined = salted_join(both, ends, ["company_key"], "left", ["content_hash"])
    return joined.where(F.col("_expiry").isNull() | (F.col("seen_at") >= F.col("_expiry"))).drop("_expiry")


#: Slices whose news are only appended to the store before it is written anew.
APPENDS = 8


def fold_slices(rows: DataFrame, ttl_seconds: int,
                seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New postings of any span of time, slice after slice, and the store after
    the last one. The store may be carried over to rows that come later, also
    to those of a slice that is read in part.
    """
    spark = rows.sparkSession
    store = seen.select(*KEYS, "seen_at") if seen is not None else spark.createDataFrame([], schemas.SEEN)
    news, lapsed = fold_changes(rows, ttl_seconds, store)
    return news, materialize(seen_after(store, news, lapsed), "seen")


def fold_changes(rows: DataFrame, ttl_seconds: int, seen: DataFrame, last=None) -> tuple[DataFrame, DataFrame]:
    """What rows of any span of time change in a store: the new postings, and
    (company_key, _expiry) of the sets that ran out by the last row, or by ``last``
    if that is later.

    The rows are written once, by slice; each step reads its slice only and
    writes what it found. There are as many steps as slices hold rows, and each
    is a distributed job.
    """
    spark, store = rows.sparkSession, seen.select(*KEYS, "seen_at")
    width = _checked_ttl(ttl_seconds) * 1_000_000
    number = F.floor(F.unix_micros("ts") / F.lit(width)).cast("bigint")
    sliced = materialize(rows.select(*KEYS, "ts", "id", number.alias("slice")), "slices", ("slice",))
    # One row per ttl of the span covered; the postings stay where they are.
    ends = sliced.groupBy("slice").agg(F.unix_micros(F.max("ts")).alias("last")).orderBy("slice").collect()
    schema = rows.select(*KEYS, "ts", "id").schema
    news, lapsed = scratch_path(spark, "news"), scratch_path(spark, "lapsed")
    spark.createDataFrame([], schema).write.parquet(news)
    spark.createDataFrame([], "company_key string, _expiry timestamp").write.parquet(lapsed)
    steps = [(end["slice"], F.timestamp_micros(F.lit(end["last"]))) for end in ends]
    if last is not None:
        steps.append((None, last))  # no rows, but sets may run out until then
    for step, (slice_number, until) in enumerate(steps, 1):
        part = sliced.where(F.col("slice") == F.lit(slice_number)).drop("slice")
        found, gone = dedup_slice(part, store, ttl_seconds, until)
        found.write.mode("append").parquet(news)
        gone.write.mode("append").parquet(lapsed)
        if step < len(steps):
            store = seen_after(store, found, gone)
            if step % APPENDS == 0:
                store = materialize(store, "seen")
    return (spark.read.schema(schema).parquet(news),
            spark.read.schema("company_key string, _expiry timestamp").parquet(lapsed))


def _fold_sorted(ttl_micros: int):
    """Walks rows sorted by company and arrival; remembers the live set of the
    current company only."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        company, live, expiry = None, set(), 0
        for batch in batches:
            keep = []
            columns = (batch.column(name).to_pylist() for name in ("company_key", "content_hash", "at"))
            for row, (key, content, at) in enumerate(zip(*columns)):
                if key != company:
                    company, live, expiry = key, set(), at
                if at >= expiry:
                    live = set()
                if content not in live:
                    live.add(content)
                    expiry = at + ttl_micros
                    keep.append(row)
            yield batch.take(pa.array(keep, pa.int64()))
    return fold


def fold_companies(rows: DataFrame, ttl_seconds: int) -> DataFrame:
    """New postings, company by company: one shuffle and one walk over sorted
    rows. For companies whose postings one task can walk."""
    keyed = rows.select(*KEYS, "ts", "id", F.unix_micros("ts").alias("at"))
    ordered = keyed.repartition("company_key").sortWithinPartitions("company_key", "at", "id")
    walked = ordered.mapInArrow(_fold_sorted(ttl_seconds * 1_000_000), ordered.schema)
    return walked.drop("at")


def _walk_changes(ttl_micros: int, last: int):
    """Walks what companies hold and then what arrives for them, as :func:`_fold_sorted`
    does; returns the new rows, and for each company whose set ran out by ``last`` a row
    that is marked and has the latest such time."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        company, live, expiry, gone = None, set(), None, None
        ended: list[tuple[str, int]] = []

        def end() -> None:
            out = expiry if expiry is not None and expiry <= last else gone
            if out is not None:
                ended.append((company, out))

        def marks(schema: pa.Schema) -> pa.RecordBatch:
            keys, times = [key for key, _ in ended], [at for _, at in ended]
            ended.clear()
            return pa.RecordBatch.from_arrays([
                pa.array(keys, schema.field("company_key").type), pa.nulls(len(keys), schema.field("content_hash").type),
                pa.array(times, pa.int64()).cast(schema.field("ts").type), pa.nulls(len(keys), schema.field("id").type),
                pa.array([True] * len(keys), pa.bool_())], schema=schema)

        schema = None
        for batch in batches:
            keep = []
            columns = (batch.column(name).to_pylist() for name in ("company_key", "content_hash", "at", "marked"))
            for row, (key, content, at, held) in enumerate(zip(*columns)):
                if key != company:
                    end()
                    company, live, expiry, gone = key, set(), None, None
                if held:
                    live.add(content)
                    expiry = max(expiry or 0, at + ttl_micros)
                    continue
                if expiry is not None and at >= expiry:
                    live, gone, expiry = set(), expiry, None
                if content not in live:
                    live.add(content)
                    # A row that is late does not turn the clock back.
                    expiry = at + ttl_micros if expiry is None else max(expiry, at + ttl_micros)
                    keep.append(row)
            found = batch.take(pa.array(keep, pa.int64())).select(["company_key", "content_hash", "ts", "id", "marked"])
            schema = found.schema
            yield found
            yield marks(schema)
        end()
        if ended:
            yield marks(schema)
    return walk


def batch_changes(rows: DataFrame, ttl_seconds: int, seen: DataFrame,
                  hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """As :func:`fold_changes`, in a number of steps that does not grow with the time that
    the rows span: a company is walked in order, what it holds ahead of what arrives.

    Companies that hold or are sent more than ``hot_rows`` together are folded in slices,
    as no task may have them whole. Of the sets that ran out the latest one of a company is
    told, which is all that :func:`seen_after` asks for. Rows without a time are dropped.
    """
    width = _checked_ttl(ttl_seconds) * 1_000_000
    arriving = rows.where(F.col("ts").isNotNull()).select(*KEYS, "ts", "id", F.lit(False).alias("marked"))
    held = seen.select(*KEYS, F.col("seen_at").alias("ts"),
                       F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(True).alias("marked"))
    both = materialize(arriving.unionByName(held), "changes")
    last = both.where(~F.col("marked")).agg(F.max("ts").alias("last"), F.unix_micros(F.max("ts")).alias("at")).first()
    gone = [F.col("company_key"), F.col("ts").alias("_expiry")]
    if last["at"] is None:
        none = both.where("false")
        return none.select(*KEYS, "ts", "id"), none.select(*gone)
    sizes = both.groupBy("company_key").agg(F.count("*").alias("n"))
    hot = materialize(sizes.where(F.col("n") > hot_rows).select("company_key", F.lit(True).alias("_hot")), "hot")
    cold, some_hot = both, not hot.isEmpty()
    if some_hot:
        split = salted_join(both, hot, ["company_key"], "left", spread_by=["content_hash", "ts"])
        cold = split.where(F.col("_hot").isNull()).drop("_hot")
    ordered = cold.withColumn("at", F.unix_micros("ts")).repartition("company_key").sortWithinPartitions(
        "company_key", F.desc("marked"), "at", "id")
    walked = materialize(ordered.mapInArrow(_walk_changes(width, last["at"]), both.schema), "walked")
    news, lapsed = walked.where(~F.col("marked")).select(*KEYS, "ts", "id"), walked.where("marked").select(*gone)
    if some_hot:
        large = split.where("_hot").drop("_hot")
        more, ended = fold_changes(large.where(~F.col("marked")), ttl_seconds, large.where("marked").select(
            *KEYS, F.col("ts").alias("seen_at")), F.timestamp_micros(F.lit(last["at"])))
        news, lapsed = news.unionByName(more), lapsed.unionByName(ended)
    return news, lapsed


def dedup_with_expiry(postings: DataFrame, ttl_seconds: int, ts: str = "ts", id: str = "id",
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """The postings that were new when they arrived, in the order (ts, id).

    A posting needs a time and an id; a null in either is an error. Rows that
    share an id are one posting, and the first of them in time is returned.

    Companies of ordinary size are walked in one pass. A company with more than
    ``hot_rows`` postings is folded slice by slice instead, where its rows stay
    spread over all tasks. Both ways give the same rows.
    """
    _checked_ttl(ttl_seconds)
    # Written once and whole: what makes postings, such as parsing pages, is not done per use below.
    whole = materialize(postings.withColumns({
        "_arrived_at": _required(ts, "timestamp"), "_arrived_as": _required(id)}), "postings")
    keyed = whole.select(*KEYS, F.col("_arrived_at").alias("ts"), F.col("_arrived_as").alias("id"))
    hot = keyed.groupBy("company_key").agg(F.count("*").alias("n")).where(
        F.col("n") > hot_rows).select("company_key", F.lit(True).alias("_hot"))
    if hot.isEmpty():
        news = fold_companies(keyed, ttl_seconds)
    else:
        hot = materialize(hot, "hot")
        split = salted_join(keyed, hot, ["company_key"], "left", spread_by=["id"])
        cold = split.where(F.col("_hot").isNull()).drop("_hot")
        news = fold_companies(cold, ttl_seconds).unionByName(
            fold_slices(split.where("_hot").drop("_hot"), ttl_seconds)[0])
    # On all that tells a row, as an id may come with other contents.
    found = news.select(*KEYS, F.col("ts").alias("_ts"), F.col("id").alias("_id"))
    same = [whole[k].eqNullSafe(found[k]) for k in KEYS]
    same += [whole["_arrived_at"] == found["_ts"], whole["_arrived_as"] == found["_id"]]
    return keep_first(whole.join(found, same, "left_semi").select(*postings.columns), [*KEYS, ts, id], [F.lit(0)])
