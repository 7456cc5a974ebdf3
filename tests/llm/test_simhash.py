import random
import re

import numpy as np
import pytest
import xxhash

from rolecall.llm import queries, simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, radius):
    """Smallest id reachable, by comparing all pairs."""
    of = np.array(prints, np.uint64)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(of[i + 1:] ^ of[i]) <= radius) + i + 1:
            parent[root(int(j))] = root(i)
    least = {}
    for i, id in enumerate(ids):
        if id is not None:
            least[root(i)] = min(least.get(root(i), id), id)
    return [least.get(root(i)) for i in range(len(ids))]


def test_fingerprints_of_awkward_rows(spark, documents, awkward):
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in simhash.fingerprints(documents(awkward)).collect())
    assert got == sorted((str(i), slow_fingerprint(t)) for i, t in awkward)


def test_slices_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500))
    whole = simhash.text_fingerprint(text.encode())
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.text_fingerprint(text.encode()) == whole == slow_fingerprint(text)


def near_prints(seed, groups=12, each=14):
    """Fingerprints in chains and clusters around a few centres, some of them equal, with zero among them."""
    rng = random.Random(seed)
    found = [0, 0, 1, 1 << 63]
    for _ in range(groups):
        fp = rng.getrandbits(64)
        for _ in range(each):
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 3, 4])):
                fp ^= 1 << bit
            found.append(fp)
    return found


@pytest.mark.parametrize("radius, segments, block", [(3, 2, 4096), (3, 2, 3), (1, 1, 4096), (3, 4, 5), (0, 2, 9), (5, 2, 64)])
def test_links_connect_what_all_pairs_connect(spark, radius, segments, block):
    prints = sorted(set(near_prints(radius)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint").repartition(3)
    edges = [(r.x, r.y) for r in simhash.links(frame, radius, segments, block).collect()]
    at = {p: i for i, p in enumerate(signed)}
    assert all((prints[at[x]] ^ prints[at[y]]).bit_count() <= radius for x, y in edges)
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        parent[max(root(at[x]), root(at[y]))] = min(root(at[x]), root(at[y]))
    least = {}
    for i in range(len(prints)):
        least.setdefault(root(i), i)
    assert [least[root(i)] for i in range(len(prints))] == slow_components(range(len(prints)), prints, radius)
    assert len(edges) <= segments * len(prints) * 40


def test_rows_null_ids_and_empty_tables(spark, documents, awkward):
    rows = awkward + [(10, "one two three four five six"), (11, None), (None, "alone without any id at all here")]
    found = simhash.near_duplicates(documents(rows)).collect()
    expected = slow_components([i for i, _ in rows], [slow_fingerprint(t) for _, t in rows], 3)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == sorted(
        (str(i), str(c)) for (i, _), c in zip(rows, expected))
    assert simhash.near_duplicates(documents([])).collect() == []
    with pytest.raises(ValueError):
        simhash.near_duplicates(documents(rows), radius=-1)


def test_query_agrees_with_all_pairs(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    prints = [slow_fingerprint(t) for _, t in texts]
    expected = slow_components([i for i, _ in texts], prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", c) for (i, _), p, c in zip(texts, prints, expected)}
