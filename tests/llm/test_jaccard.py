import collections
import random
import re

import pytest

from pyspark.sql import functions as F

from rolecall.llm import jaccard
from rolecall.llm.graph import components
from rolecall.llm.jaccard import all_links, jaccard_join, link_counts
from rolecall.llm.queries import op8_jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def brute_force(rows):
    """(n_shingles, component) by doc_id, from all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, common = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        common.update((a, b) for k, b in enumerate(ids) for a in ids[:k])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_agrees_with_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text").collect()]
    assert found(op8_jaccard(spark, sf_dir)) == brute_force(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_at_all_distances(documents, seed):
    """Copies with a few words changed, chains of them, and passages many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(120):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
            if rng.random() < 0.5:
                words += passage
        rows.append((i, " ".join(words)))
    assert found(jaccard_join(documents(rows)).documents()) == brute_force(rows)


def test_links_on_the_bound(documents):
    """6 of 8 shingles in common link; 5 of 8 do not."""
    base = [f"a{i}" for i in range(11)]  # 7 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[1:] + ["z"])), (3, " ".join(base[2:] + ["x", "y"]))]
    assert found(jaccard_join(documents(rows)).documents()) == brute_force(rows)


def test_one_large_group_of_near_copies(documents):
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 50 + 5] + [f"own{i}"] + base[i % 50 + 6:])) for i in range(300)]
    assert found(jaccard_join(documents(rows)).documents()) == brute_force(rows)


def test_awkward_rows(documents, awkward):
    result = jaccard_join(documents(awkward)).documents().collect()
    assert len(result) == len(awkward)
    by_id = collections.defaultdict(set)
    for r in result:
        by_id[r.doc_id].add((r.n_shingles, r.component_id))
    assert by_id[1] == {(2, 1)} and by_id[7] == {(2, 1)}
    assert by_id[2] == {(0, 2)} and by_id[3] == {(0, 3)} and by_id[4] == {(0, 4)}
    assert by_id[None] == {(2, None), (0, None)} and by_id[5] == {(1, 5)}


def test_empty_table(documents):
    assert jaccard_join(documents([])).documents().collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (9, 8), (8, 10), (10, 9), (3, 11), (1, 2)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (11, 1), (4, 4), (5, 4), (8, 8), (9, 8), (10, 8)}
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r.component for r in components(path).collect()} == {0}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (None, 3), (5, 4)], [(i, i + 1) for i in range(300)],
    [(0, i) for i in range(1, 200)], [(500, i) for i in range(200)], [(i * 37 % 211, i * 53 % 199) for i in range(130)]])
def test_components(spark, edges):
    least = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in rows} == least and len(rows) == len(least)


@pytest.mark.parametrize("block", [7, 1000])
def test_every_link_of_a_group(documents, block):
    """Near copies of one text: each class has all of its links, not one to its pivot."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1:])) for i in range(40)]
    rows += [(100, " ".join(base)), (101, " ".join(base)), (102, "something else of five words or more"), (103, None)]
    sets = [set(s) for s in {frozenset(shingles(t)) for _, t in rows} if s]
    similar = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    expected = sorted(sum(similar(a, b) for b in sets) - 1 for a in sets)
    assert max(expected) > 30
    links = all_links(documents(rows), block=block)
    pairs = [(r.x, r.y) for r in links.collect()]
    assert len(pairs) == len(set(pairs)) == sum(expected) // 2 and all(x < y for x, y in pairs)
    counts = link_counts(jaccard_join(documents(rows)).members, links)
    assert sorted(r.n_links for r in counts.collect()) == expected


def test_shingles_of_the_same_classes_are_one(spark):
    """Two classes with 30 shingles in common, of which a third has 10, and copies of rows."""
    rows = [(g, sig, False) for g in range(30) for sig in (1, 2)] + [(g, 3, False) for g in range(10)]
    rows += [(99, 4, False)] + [(100, 5, True), (100, 6, True), (100, 6, True)] + rows[:7]
    found = jaccard._shared(spark.createDataFrame(rows, "shingle bigint, sig bigint, frequent boolean"))
    held = collections.defaultdict(list)
    for r in found.collect():
        held[r.shingle].append((r.sig, r.times))
    assert sorted(map(sorted, held.values())) == [
        [(1, 10), (2, 10), (3, 10)], [(1, 20), (2, 20)], [(5, 1), (6, 1)]]


@pytest.mark.parametrize("earlier", [1, 8, 100])
def test_a_pair_is_not_made_at_each_shingle(spark, monkeypatch, earlier):
    """Each pair at the first shingle it shares, and at a later one only after others in between."""
    monkeypatch.setattr(jaccard, "EARLIER", earlier)
    rng = random.Random(earlier)
    sets = {sig: {g for g in range(60) if rng.random() < 0.5} for sig in range(12)} | {20: set(range(60)), 21: set(range(60))}
    entries = spark.createDataFrame([(g, sig, 9, sig, 1) for sig, s in sets.items() for g in s],
                                    "shingle bigint, sig bigint, n bigint, component bigint, times bigint")
    bits = spark.createDataFrame([(sig,) for sig in sets], "sig bigint").withColumns(
        {b: F.lit(0).cast("bigint") for b in jaccard._BITS})
    made = collections.Counter((r.x, r.y) for r in jaccard._all_pairs(entries, bits, jaccard.THRESHOLD).collect())
    assert set(made) == {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert made[20, 21] == 1 and (earlier < 60 or max(made.values()) == 1)


def test_repeated_values():
    np = jaccard.np
    for seed in range(30):
        values = np.random.default_rng(seed).integers(0, 20, seed).astype(np.uint64)
        every, times = np.unique(values, return_counts=True)
        found, counts = jaccard._repeated(values)
        assert found.tolist() == every[times > 1].tolist() and counts.tolist() == times[times > 1].tolist()
