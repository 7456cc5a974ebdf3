"""Category and tag shares, by batch, month and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rolecall.functions.taxonomy import DEFAULT_TAXONOMY
from rolecall.functions.text import parse_tags, percentage

LEVELS = ("name", "year", "month")

#: Name of the rollup level by the number of columns it still has.
GRAINS = ("all", "name", "year", "month")


def tag_array(jobs: DataFrame, tags: str = "tags") -> Column:
    """The tags as an array, whether stored as comma text or as an array."""
    is_text = jobs.schema[tags].dataType.typeName() == "string"
    return parse_tags(tags) if is_text else F.coalesce(F.col(tags), F.array().cast("array<string>"))


def total_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total_jobs"))


def _category_counters(categories: list[str], category: str) -> list[Column]:
    return [F.count_if(F.col(category) == name).alias(f"_n{i}")
            for i, name in enumerate(categories)]


def _unfold_categories(counts: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """One row per category from one counter column per category."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("category_ord"), F.lit(name).alias("category"),
                 F.col(f"_n{i}").alias("job_count"))
        for i, name in enumerate(categories)])
    return (counts.where("total_jobs > 0")
            .select(*keys, "total_jobs", F.inline(rows))
            .withColumn("percentage", percentage(F.col("job_count"), F.col("total_jobs"))))


def category_summary(jobs: DataFrame, by: tuple[str, ...] = (), category: str = "category",
                     categories: list[str] | None = None) -> DataFrame:
    """Jobs per category and their share, most frequent first.

    All listed categories appear; others count in the total only. One counter
    per category in a single aggregate: partial sums before the shuffle, and
    one row per task and group in it, however uneven the groups.
    """
    categories = categories or DEFAULT_TAXONOMY.categories
    counts = jobs.groupBy(*by).agg(
        F.count("*").alias("total_jobs"), *_category_counters(categories, category))
    return (_unfold_categories(counts, list(by), categories)
            .orderBy(*by, F.desc("job_count"), "category_ord")
            .select(*by, "category", "job_count", "percentage", "total_jobs"))


def tag_summary(jobs: DataFrame, tags: str = "tags", seq: str | None = None) -> DataFrame:
    """Jobs per tag and their share of the jobs, most frequent first.

    A tag listed twice in a row counts twice. Ties go to the tag seen first in
    the order of ``seq``, or else by name. Shares need not add up to 100.
    """
    # A scalar subquery: counting the rows needs no column of them.
    total = jobs.agg(F.count("*")).scalar()
    place = [F.min(_place(jobs, seq)).alias("_first")] if seq else []
    counts = (jobs.select(*([seq] if seq else []),
                          F.posexplode_outer(tag_array(jobs, tags)).alias("_pos", "tag"))
              .where(F.col("tag").isNotNull())
              .groupBy("tag").agg(F.count("*").alias("job_count"), *place))
    return (counts.withColumn("total_jobs", total)
            .withColumn("percentage", percentage(F.col("job_count"), F.col("total_jobs")))
            .orderBy(F.desc("job_count"), "_first" if seq else "tag")
            .select("tag", "job_count", "percentage", "total_jobs"))


def _place(jobs: DataFrame, seq: str) -> Column:
    """Where a tag stands: by row, then by position in the row. One number where
    rows are numbered, because Spark can hash-aggregate that."""
    if jobs.schema[seq].dataType.typeName() in ("long", "integer"):
        return F.col(seq).cast("decimal(20,0)") * 2**31 + F.col("_pos")
    return F.struct(seq, "_pos")


def top_tags(jobs: DataFrame, n: int, tags: str = "tags", seq: str | None = None) -> DataFrame:
    """The ``n`` most frequent tags."""
    return tag_summary(jobs, tags, seq).limit(n)


def _grain(keys: list[str]) -> Column:
    """How many level columns a rollup row still has, as a name."""
    names = GRAINS if tuple(keys) == LEVELS else tuple(["all", *keys])
    # grouping_id counts up from the full set: 0, 1, 3, 7.
    grain = F.lit(None).cast("string")
    for kept in range(len(keys) + 1):
        grain = F.when(F.col("_gid") == 2 ** (len(keys) - kept) - 1, names[kept]).otherwise(grain)
    return grain


def rollup_category_summary(jobs: DataFrame, keys: tuple[str, ...] = LEVELS,
                            category: str = "category",
                            categories: list[str] | None = None) -> DataFrame:
    """Category summary for each month, year and search, and overall.

    The rows are counted once at the finest level; the rollup works on counts.
    """
    keys = list(keys)
    categories = categories or DEFAULT_TAXONOMY.categories
    finest = jobs.groupBy(*keys).agg(
        F.count("*").alias("total_jobs"), *_category_counters(categories, category))
    return _category_levels(finest, keys, categories)


def _category_levels(finest: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """The rollup of counters that stand at the finest level."""
    sums = [F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(categories))]
    levels = (finest.rollup(*keys).agg(F.grouping_id().alias("_gid"),
                                       F.sum("total_jobs").alias("total_jobs"), *sums)
              .withColumn("grain", _grain(keys)))
    return (_unfold_categories(levels, ["grain", *keys], categories)
            .select("grain", *keys, "category", "job_count", "percentage", "total_jobs"))


def rollup_tag_summary(jobs: DataFrame, keys: tuple[str, ...] = LEVELS,
                       tags: str = "tags") -> DataFrame:
    """Tag summary for each month, year and search, and overall.

    Each job also counts once under no tag, so that one aggregate gives the
    tags and the number of jobs they are a share of.
    """
    keys = list(keys)
    marked = F.concat(F.array(F.lit(None).cast("string")), tag_array(jobs, tags))
    finest = (jobs.select(*keys, F.explode_outer(marked).alias("tag"))
              .groupBy(*keys, "tag").agg(F.count("*").alias("n")))
    return _tag_levels(finest, keys)


def _tag_levels(finest: DataFrame, keys: list[str]) -> DataFrame:
    """The rollup of counts by tag that stand at the finest level; under no tag, of jobs."""
    sets = [[*map(F.col, keys[:kept]), F.col("tag")] for kept in range(len(keys), -1, -1)]
    levels = finest.groupingSets(sets, *keys, "tag").agg(
        F.grouping_id().alias("_gid2"), F.sum("n").alias("job_count"))
    # The tag is in every set, so its bit of the grouping id is always 0.
    levels = levels.withColumn("_gid", F.shiftright("_gid2", 1)).withColumn("grain", _grain(keys))
    jobs_of_level = F.max(F.when(F.col("tag").isNull(), F.col("job_count"))).over(
        Window.partitionBy("grain", *keys))
    return (levels.withColumn("total_jobs", jobs_of_level).where(F.col("tag").isNotNull())
            .withColumn("percentage", percentage(F.col("job_count"), F.col("total_jobs")))
            .select("grain", *keys, "tag", "job_count", "percentage", "total_jobs"))


def summary_counts(jobs: DataFrame, keys: tuple[str, ...] = LEVELS, category: str = "category",
                   tags: str = "tags") -> DataFrame:
    """(*keys, kind, label, job_count): what the summaries of these jobs are made of.

    Counts of disjoint jobs add up (:func:`merge_counts`), so summaries over a history
    need the counts of its parts, not the jobs again. Kinds are ``job`` (no label),
    ``category`` (null where a job has none) and ``tag``. No jobs, no rows.
    """
    def counted(kind: str, label: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.cast("string").alias("label"))

    counted_once = F.array(counted("job", F.lit(None)), counted("category", F.col(category)))
    of_tags = F.transform(tag_array(jobs, tags), lambda tag: counted("tag", tag))
    return (jobs.select(*keys, F.inline(F.concat(counted_once, of_tags)))
            .groupBy(*keys, "kind", "label").agg(F.count("*").alias("job_count")))


def merge_counts(counts: DataFrame, keys: tuple[str, ...] = LEVELS) -> DataFrame:
    """Counts of several parts as one; of fewer keys too, where others are left out."""
    return counts.groupBy(*keys, "kind", "label").agg(F.sum("job_count").alias("job_count"))


def category_summary_of_counts(counts: DataFrame, keys: tuple[str, ...] = LEVELS,
                               categories: list[str] | None = None) -> DataFrame:
    """:func:`rollup_category_summary` from :func:`summary_counts`, of one or more parts."""
    categories = categories or DEFAULT_TAXONOMY.categories

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("job_count"))), F.lit(0))

    named = [total((F.col("kind") == "category") & (F.col("label") == name)).alias(f"_n{i}")
             for i, name in enumerate(categories)]
    finest = counts.groupBy(*keys).agg(total(F.col("kind") == "job").alias("total_jobs"), *named)
    return _category_levels(finest, list(keys), categories)


def tag_summary_of_counts(counts: DataFrame, keys: tuple[str, ...] = LEVELS) -> DataFrame:
    """:func:`rollup_tag_summary` from :func:`summary_counts`, of one or more parts."""
    finest = (counts.where("kind = 'job' or kind = 'tag' and label is not null")
              .groupBy(*keys, F.col("label").alias("tag")).agg(F.sum("job_count").alias("n")))
    return _tag_levels(finest, list(keys))


def run_totals(runs: DataFrame) -> DataFrame:
    """Searches run and jobs found so far, per search and run.

    ``runs`` (name, run_id, found) may hold several rows of a run; they are
    added up before the shuffle, so a window sees one row per run.
    """
    per_run = runs.groupBy("name", "run_id").agg(F.sum("found").alias("found"))
    so_far = Window.partitionBy("name").orderBy("run_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return per_run.withColumns({
        "searches": F.row_number().over(Window.partitionBy("name").orderBy("run_id")).cast("bigint"),
        "total_found": F.sum("found").over(so_far),
    })
