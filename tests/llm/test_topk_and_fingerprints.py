import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecall.llm import fingerprints as fp
from rolecall.llm import topk
from rolecall.llm.queries import op3_topk, op6_fingerprints


def by_hand(rows, picks, k=5):
    """All inner products, in whole numbers."""
    able = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = set()
    for q, a in able:
        if picks(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in able if i != q)
            found |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return found


def test_topk_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = op3_topk(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == by_hand(rows, lambda i: i % 50 == 0) and len(got) > 0


@pytest.mark.parametrize("lengths", ["equal", "varied", "ties"])
def test_topk_in_many_blocks(spark, lengths, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 12))
    if lengths == "varied":
        vectors *= rng.pareto(1, size=(400, 1))
    if lengths == "ties":
        vectors = np.round(vectors / 2)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    monkeypatch.setattr(topk, "BLOCK", 32)
    got = topk.search(frame, F.col("vec_id") % 20 == 0, 5, query_bytes=7 * 12 * 8)
    assert {tuple(r) for r in got.collect()} == by_hand(rows, lambda i: i % 20 == 0)


def test_topk_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [0.25]),
            (7, [1.0, 0.5]), (None, [9.0, 9.0]), (50, [-1.0, -0.001]), (8, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string")
    got = [tuple(r) for r in topk.search(frame, F.col("vec_id") % 50 == 0, 5).collect()]
    assert sorted(got) == sorted(by_hand(rows, lambda i: i % 50 == 0))
    big = spark.createDataFrame([(0, [1e6] * 3), (1, [1e6] * 3), (2, [-1e6] * 3)], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(big, F.col("vec_id") == 0, 5).orderBy("rank").collect()] == [
        (1, 3 * 256_000_000 ** 2), (2, -3 * 256_000_000 ** 2)]
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in topk.search(twice, F.col("vec_id") == 0, 5).orderBy("rank").collect()] == [(1, 1), (2, 1)]
    assert topk.search(frame.limit(0), F.col("vec_id") == 0, 5).collect() == []
    assert topk.search(frame, F.col("vec_id") == 1, 5).collect() == []


def test_syncmers_are_those_of_a_search():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcd é\U0001f600"), 400))
    k, s = 12, 5
    inner = {i: int(h) for i, h in enumerate(fp._runs(fp._code_points(text), s))}
    expected = [i for i in range(len(text) - k + 1)
                if min(inner[i + j] for j in range(k - s + 1)) in (inner[i], inner[i + k - s])]
    at, hashes = fp.anchors(text, k, s)
    assert at.tolist() == expected
    # Without context: the same run has the same hash and counts wherever it stands.
    moved, again = fp.anchors("zz" + text, k, s)
    assert set(zip((at + 2).tolist(), hashes.tolist())) <= set(zip(moved.tolist(), again.tolist()))


def test_likeness():
    a, b = "one text " * 40 + "end", "something else " * 30
    print_a, print_b = fp.fingerprint(a), fp.fingerprint(b)
    assert fp.likeness(print_a, print_a) == 1 and fp.likeness("", "") == 1 and fp.likeness("", print_a) == 0
    assert fp.likeness(print_a, print_b) < 0.1
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    half = text[:1500] + "".join(rng.choice(list("abcdefgh "), 1500))
    assert 0.4 < fp.likeness(fp.fingerprint(text), fp.fingerprint(half)) < 0.6
    shifted = fp.matches(fp.fingerprint(text), fp.fingerprint("0123456789" + text))
    assert len(shifted) > 100 and {y - x for x, y in shifted} == {10}
    assert all(0 <= fp.likeness(fp.fingerprint(text), fp.fingerprint(text[:n])) <= 1 for n in (0, 1, 31, 32, 33, 100))


def edits(rows):
    """(n_chars, sha256, fingerprints) by hand, next by descending id."""
    order = sorted(rows, reverse=True)
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        yield doc_id, (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(text),
                       fp.fingerprint(edited), fp.likeness(fp.fingerprint(text), fp.fingerprint(edited)),
                       fp.likeness(fp.fingerprint(text), fp.fingerprint(following)))


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_edits_query(spark, sf_dir, part_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = op6_fingerprints(spark, sf_dir) if part_rows == 1000 else fp.compare_edits(docs, part_rows=part_rows)
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == dict(edits(rows))


def test_edits_of_awkward_rows(documents, awkward):
    for part_rows in (2, 100):
        rows = fp.compare_edits(documents(awkward), part_rows=part_rows).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in awkward)
        assert {r.n_chars for r in rows if r.doc_id in (2, 3)} == {0}
        assert len({r.fingerprint for r in rows if r.doc_id in (1, 7)}) == 1
    alone = fp.compare_edits(documents([(5, "abcdef" * 20)])).collect()
    assert [(r.n_chars, r.near_next) for r in alone] == [(120, 1.0)]
    assert fp.compare_edits(documents([])).collect() == []
    one_id = fp.compare_edits(documents([(3, "a b"), (3, "a b"), (3, "c d")]), part_rows=1).collect()
    assert len(one_id) == 3


def test_topk_of_large_components(spark):
    """Beyond 32 bits, and beyond what doubles hold exactly."""
    vectors = [(0, [1.0, 0.0]), (1, [1e10, 0.0]), (2, [3e10, 0.0]), (3, [float(1 << 45), 3.0]), (4, [float(1 << 45) + 1 / 128, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors}
    for asked in range(5):
        try:
            got = [(r.vec_id, r.score) for r in topk.search(frame, F.col("vec_id") == asked, 5).orderBy("rank").collect()]
        except Exception as error:
            assert asked >= 1 and "beyond 64 bits" in str(error)
            continue
        expected = sorted(((sum(a * b for a, b in zip(whole[asked], v)), i) for i, v in whole.items() if i != asked),
                          key=lambda s: (-s[0], s[1]))
        assert got == [(i, s) for s, i in expected] and asked == 0
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.quantised(spark.createDataFrame([(1, [1e30])], "vec_id bigint, embedding array<double>"), "embedding").collect()
