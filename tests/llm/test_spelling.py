import itertools
import random

import pytest

from rolecall.llm import spelling

WORDS = "word string, n bigint"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(words, ratio=10):
    of = {w: [v for v in words if v != w and near(v, w)] for w in words}
    forms = {}
    for w, found in of.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= ratio * words[w] else None
    rows = []
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, words[w], len(of[w]), forms[w], words.get(forms[w]), root))
    return sorted(rows)


def fast_variants(spark, words, **options):
    frame = spark.createDataFrame(list(words.items()), WORDS)
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(frame, **options).collect())


def test_pivots_are_the_lightest_disjoint_grams():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(14), rng.randint(3, 8)))
        weights = [rng.randint(1, 9) for _ in places]
        weight = dict(zip(places, weights))
        got = spelling._pivots(places, weights, 2)
        pairs = [p for p in itertools.combinations(places, 2) if p[1] - p[0] >= 2]
        assert tuple(got) in pairs and sum(weight[p] for p in got) == min(sum(weight[p] for p in pair) for pair in pairs)


def edited(rng, word, letters):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:],
                       word[:at] + rng.choice(letters) + word[at + 1:]])


@pytest.mark.parametrize("letters, block", [("ab", 2000), ("abcdé", 7), ("abcdefghijklmnoÿ", 2000)])
def test_variants_agree_with_all_pairs(spark, letters, block):
    """Few letters make grams that repeat within a word, and prefixes that end in ties."""
    rng = random.Random(letters)
    words = {}
    for _ in range(40):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(7, 10)))
        for times in (5000, 400, 30, 3, 2):
            if len(word) >= 4:
                words[word] = rng.choice([times, times // 2 + 1])
            word = edited(rng, word, letters)
    assert fast_variants(spark, words, block=block) == slow_variants(words)


def test_chains_lead_to_the_root_and_ties_to_the_first(spark):
    words = {"aaaaaaaa": 100_000, "aaaaaaab": 10_000, "aaaaaabb": 1_000, "aaaaabbb": 100, "aaaabbbb": 10,
             "xyzxyza": 50, "xyzxyzb": 50, "xyzxyzc": 5, "lonelyword": 2}
    got = fast_variants(spark, words)
    assert got == slow_variants(words)
    assert dict((r[0], r[5]) for r in got)["aaaabbbb"] == "aaaaaaaa"
    assert dict((r[0], r[3]) for r in got)["xyzxyzc"] == "xyzxyza"


def test_runs_and_words_of_awkward_rows(spark, documents, awkward):
    rows = awkward + [(20, "ÉCOLE×école÷ Straße naïveté-NAÏVETÉ  Überfluss überfluss Überfluss"), (21, "word1word")]
    found = spelling.runs(documents(rows))
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "size", "sig", "run"]
    got = sorted(r.run for r in found.where("doc_id in (20, 21)").collect())
    # Only A to Z are lower-cased; the signs of product and quotient lie among the letters.
    assert got == sorted(["École×école÷", "straße", "naïveté", "naÏvetÉ", "Überfluss", "überfluss", "Überfluss",
                          "word", "word"])
    words = {r.word: r.n for r in spelling.vocabulary(found).collect()}
    assert words["Überfluss"] == 2 and "überfluss" not in words


def test_an_empty_vocabulary(spark):
    assert fast_variants(spark, {"lonelyword": 2}) == [("lonelyword", 2, 0, None, None, "lonelyword")]
    assert spelling.variants(spark.createDataFrame([], WORDS)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], WORDS), ratio=1)
