import collections
import re

import pytest

from rolecall.llm.mixing import mix, targets
from rolecall.llm.queries import op2_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by source, water poured step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), dict.fromkeys(order, 0.0), set(order)
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += unit * weight[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def checked(rows, sources):
    """``rows`` against targets by hand; ``sources`` by row, in the same order."""
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r, source in zip(rows, sources):
        sizes[source] += r.size
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    target = shared(dict(sizes))
    for r, source in zip(rows, sources):
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
    for source in sizes:
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1e-6


def test_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_mixing(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.size == len(WORD.findall(docs[r.doc_id].text or ""))
    checked(rows, [docs[r.doc_id].source for r in rows])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op2_mixing(spark, sf_dir).collect()))


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 1}, {"a": 1, "b": 1, "c": 10_000, None: 3}, {"a": 0, "b": 5}, {"a": 7},
    {"é": 5, "z": 50, "\U0001f600": 500, "": 5000, None: 1}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in targets(frame).collect()}
    assert got == pytest.approx(shared(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_hot_source_and_small_ones(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), "hot") for i in range(400)]
    rows += [(1000 + i, "a b c", f"s{i % 5}") for i in range(40)] + [(2000, "x y", None), (2001, None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix(frame).orderBy("doc_id").collect()
    checked(got, [r[2] for r in sorted(rows)])


def test_order_of_rows_does_not_matter(documents):
    rows = [(i, "w " * (i % 9)) for i in range(100)]
    a = mix(documents(rows)).collect()
    b = mix(documents(rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_awkward_rows(documents, awkward):
    rows = mix(documents(awkward)).collect()
    assert len(rows) == len(awkward)
    assert sorted(r.size for r in rows) == sorted(len(WORD.findall(t or "")) for _, t in awkward)
    assert {r.target for r in rows} == {float(sum(r.size for r in rows))}
    assert all(r.taken == r.size for r in rows)


def test_nothing_to_mix(documents):
    assert mix(documents([])).collect() == []
    [row] = mix(documents([(1, None)])).collect()
    assert tuple(row) == (1, 0, 0, 0.0, 0)
