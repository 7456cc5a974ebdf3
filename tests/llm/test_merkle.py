import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rolecall.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_tree(leaves, fanout):
    """Root, and of each leaf the (place, siblings) on its way there."""
    proofs, nodes = [[] for _ in leaves], leaves
    at = list(range(len(leaves)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place - place % fanout:place - place % fanout + fanout]
            proofs[i].append((place % fanout, run[:place % fanout] + run[place % fanout + 1:]))
            at[i] = place // fanout
        nodes = [h("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def slow_manifest(rows, fanout=3):
    """rows: (doc_id, source, lang, n_chars, text)"""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, slow_leaf(row)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    done = {name: slow_tree([leaf for *_, leaf in sorted(trees[name])], fanout) for name in names}
    root, tops = slow_tree([done[n][0] for n in names], fanout) if names else (None, [])
    return sorted((leaf, done[name][0], root, tuple((p, tuple(s)) for p, s in proof + top))
                  for name, top in zip(names, tops)
                  for (*_, leaf), proof in zip(sorted(trees[name]), done[name][1]))


def fast_manifest(frame, **options):
    return sorted((r.leaf, r.subroot, r.root, tuple((level.place, tuple(level.siblings)) for level in r.proof))
                  for r in merkle.manifest(frame, COLUMNS, "source", "doc_id", **options).collect())


def made(spark, rows):
    """With columns of names that are used inside."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                                 "doc_id bigint, source string, lang string, n_chars bigint, text string, "
                                 "tree string, block int, leaf int")


def corpus(seed, n):
    rng = random.Random(seed)
    ids = list(range(n))
    rng.shuffle(ids)
    return [(i, rng.choice(["hot"] * 6 + ["a", "é", None]), "en", i, f"text {i}\n of {seed}") for i in ids]


@pytest.mark.parametrize("n, fanout, block_levels", [(1, 3, 2), (60, 3, 1), (61, 3, 0), (50, 2, 1), (40, 5, 7)])
def test_manifest_agrees_with_plain_trees(spark, n, fanout, block_levels):
    rows = corpus(n, n)
    assert fast_manifest(made(spark, rows), fanout=fanout, block_levels=block_levels) == slow_manifest(rows, fanout)


def test_nulls_repeats_and_ties(spark):
    long = "word " * 100_000
    rows = [(None, None, None, None, None), (1, "a", "en", 0, ""), (1, "a", "en", 0, ""), (1, "a", "en", 1, ""),
            (None, "a", None, 5, "x"), (2, "a", "", None, "-"), (3, "", "é", 3, "1:1"), (4, "b", "de", 1, long)]
    assert fast_manifest(made(spark, rows), block_levels=1) == slow_manifest(rows)


def test_an_empty_table_has_no_rows(spark):
    assert fast_manifest(made(spark, [])) == []


def test_only_rows_as_they_were_lead_to_the_root(spark):
    rows = corpus(5, 40)
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    found = merkle.manifest(made(spark, rows), COLUMNS, "source", "doc_id", block_levels=1,
                            also={"again": merkle.digest(*COLUMNS[:4], changed)})
    got = found.select("doc_id", (merkle.folded("again", "proof") == F.col("root")).alias("same"),
                       (merkle.folded("leaf", "proof") == F.col("root")).alias("own")).collect()
    assert len(got) == 40 and all(r.own and r.same == (r.doc_id % 3 != 0) for r in got)


@pytest.mark.parametrize("options", [{"fanout": 1}, {"block_levels": -1}])
def test_sizes_are_checked(spark, options):
    with pytest.raises(ValueError):
        merkle.manifest(made(spark, []), COLUMNS, "source", "doc_id", **options)
