"""A corpus from raw documents: five stages, each written and read again.

1. Language: texts in no language (null, or without letters) go.
2. Near duplicates: of each group of documents linked by shingle similarity one stays.
3. Personal data: entities and the words that disclose them are masked.
4. Mixing: sources are brought to their target weights; a document may come up to
   three times, or not at all.
5. Packing: what is left, as token sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolecall.llm import jaccard, langid, mixing, packing, pii
from rolecall.llm.tokens import VOCABULARY
from rolecall.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: What a text without a language lacks, where there are no labels to learn from.
LETTER = r"\p{L}"


def row_key(*columns: str) -> Column:
    """A hash of columns that tells null from every value. Rows equal in all share it."""
    given = [F.col(c).cast("string") for c in columns]
    return F.xxhash64(*[x for c in given for x in (c.isNull(), F.coalesce(c, F.lit("")))])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; where no document has a label, those with
    letters. Rows come through whole, whatever their columns are called; repeated rows
    stay repeated, null ids pass, and an empty table stays empty."""
    samples = langid.learn(docs)
    if not samples:
        return docs.where(F.col("text").rlike(LETTER))
    others = [c for c in docs.columns if c != "text"]
    found = langid.identify(docs.select(F.struct(*others).alias("row"), "text"), samples)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select("row.*", "text").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id, those without an id last.
    Documents without words are no duplicates of anything. Rows with the same id and
    text are one document: one of them stays; an id alone doesn't make rows one, nor
    does the lack of one."""
    keyed = docs.withColumn("_key", row_key("doc_id", "text"))
    classes = jaccard.jaccard_join(keyed.select(F.col("_key").alias("doc_id"), "text")).documents().groupBy(
        F.col("doc_id").alias("_key")).agg(F.max("n_shingles").alias("n"), F.min("component_id").alias("component"))
    ids = keyed.groupBy("_key").agg(F.min("doc_id").alias("id"))
    classes = materialize(classes.join(ids, "_key"), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", "_key"))
    kept = classes.where("n > 0").groupBy("component").agg(first.alias("first")).select("first._key")
    once = materialize(kept.unionByName(classes.where("n = 0 and id is not null").select("_key")), "kept")
    nameless = materialize(classes.where("n = 0 and id is null").select("_key"), "nameless")
    return (keyed.join(once, "_key", "left_semi").dropDuplicates(["_key"]).unionByName(
        keyed.where("doc_id is null").join(nameless, "_key", "left_semi")).select(docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; the number of characters follows. Null
    texts stay null with a null number; other columns may have any name."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows equal in id, text and source
    are taken equally often, each by itself."""
    keyed = docs.withColumn("_key", row_key("doc_id", "text", "source"))
    mixed = mixing.mix(keyed, keep=("_key",))
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    taken = materialize(mixed.groupBy("_key").agg(F.max(times).alias("_times")).where("_times > 0"), "taken")
    return keyed.join(taken, "_key").withColumn("_nth", F.explode(F.sequence(F.lit(1), "_times"))).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they are packed. Null and empty texts are
    one end token; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("target_weights", target_weights),
    ("sequences", sequences),
]

#: Tokens, hashes and learned models have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
