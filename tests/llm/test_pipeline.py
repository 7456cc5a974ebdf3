import collections
import random

import corpus_pipeline as pipeline
from rolecall.llm import mixing

PROSE = "the quick brown fox jumps over a lazy dog while seven old owls watch from their dark tree".split()
ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) for _ in range(60))


def frame(spark, rows, lang=None):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, s in rows], ROWS)


def counted(df):
    return collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_a_corpus_without_labels_passes(spark):
    rows = [(1, prose(1), "a"), (None, prose(2), "a"), (2, "12 34", "a"), (3, None, "a")]
    assert counted(pipeline.language(spark, frame(spark, rows), "")) == collections.Counter(rows[:2])


def test_near_duplicates_by_row_not_by_id(spark):
    """An id with two texts, rows without ids, copies across ids, documents without words."""
    a, b, c, d = map(prose, range(4))
    rows = [(7, a, "s"), (7, b, "s"), (None, c, "s"), (None, d, "s"), (3, a + " end", "s"), (9, d, "s"),
            (7, b, "s"), (5, "", "s"), (5, "", "s"), (6, None, "s"), (None, None, "s"), (None, None, "s")]
    expected = [(3, a + " end", "s"), (7, b, "s"), (None, c, "s"), (9, d, "s"), (5, "", "s"), (6, None, "s"),
                (None, None, "s"), (None, None, "s")]
    assert counted(pipeline.near_duplicates(spark, frame(spark, rows), "")) == collections.Counter(expected)


def test_weights_of_null_and_repeated_ids(spark):
    rows = [(i % 5 if i % 3 else None, prose(i), f"s{i % 2}") for i in range(40)] + [(1, prose(100), "s0")] * 3
    docs = frame(spark, rows)
    expected = collections.Counter()
    for row in mixing.mix(docs.withColumn("body", docs.text).withColumn("of", docs.source), keep=("body", "of")).collect():
        expected[row.doc_id, row.body, row.of] += row.taken // row["size"]
    got = counted(pipeline.target_weights(spark, docs, ""))
    assert got == +expected and any(k[0] is None for k in got)
    assert all(n <= mixing.MOST_TIMES * rows.count(k) for k, n in got.items())
