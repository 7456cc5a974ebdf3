import zlib

import pytest

from rolecall.llm import langid
from rolecall.llm.queries import op1_language


def phrases(text: bytes, sample: bytes) -> int:
    """Greedy parsing by search."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        if text[at:at + 1] not in sample:
            size = 1
        at += size
        count += 1
    return count


SAMPLES = {"de": b"die katze und der hund schlafen nicht auf dem dach der alten kirche",
           "en": b"the cat and the dog do not sleep on the roof of the old church at night",
           "xx": b"aaaa"}


@pytest.mark.parametrize("text", [
    "the dog on the roof", "die alte Kirche", "zzz qqq", "a", "aaaaaaaaa", "the", "nicht the Hund ",
    "catcatcat and dogs, 42 of them! " * 60])
def test_phrases_are_those_of_a_search(text):
    model = langid.LanguageModel(SAMPLES)
    raw = langid.letters(text)
    expected = [sum(phrases(raw[k:k + langid.PIECE], SAMPLES[language]) for k in range(0, len(raw), langid.PIECE))
                for language in model.languages]
    names, scores, bits = model.predict([text])
    costs = [c * cost for c, cost in zip(expected, model.cost)]
    assert bits[0] == pytest.approx(min(costs) / len(raw))
    assert names[0] == model.languages[costs.index(min(costs))] and 0 <= scores[0] <= 1


def test_held_out_documents_are_known(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_language(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) >= 0.98


def test_only_text_counts(spark, documents, sf_dir):
    samples = langid.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = "and the cat is on the roof"
    rows = langid.identify(documents([(1, text), (2, text)], lang=None), samples).collect()
    assert rows[0].lang_pred == rows[1].lang_pred == "en" and rows[0].size == 7


def test_awkward_rows(documents, awkward):
    result = langid.identify(documents(awkward), SAMPLES).collect()
    assert len(result) == len(awkward)
    for r in result:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
        else:
            assert r.lang_pred in SAMPLES and 0 <= r.lang_score <= 1


def test_nothing_learned_and_empty_tables(documents):
    none = documents([])
    assert langid.learn(none) == {}
    assert langid.learn(documents([(1, "text")], lang=None)) == {}
    assert [r.lang_pred for r in langid.identify(documents([(1, "text")]), {}).collect()] == ["und"]
    assert langid.identify(none, SAMPLES).collect() == []


def test_sample_is_bounded(documents):
    rows = [(i, f"some text number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} " * 40) for i in range(600)]
    sample = langid.learn(documents(rows), rows=20, most=64)["en"]
    assert 0 < len(sample) <= 20 * 65


def test_copies_do_not_shrink_the_sample(documents):
    """Ten texts of ten words each, and very many copies of one of them."""
    rows = [(i, " ".join(f"w{chr(97 + i)}{chr(97 + k)}" for k in range(10))) for i in range(10)]
    frame = documents(rows + [rows[0]] * 20_000)
    assert len(langid.learn(frame, rows=10)["en"].split()) == 100


@pytest.mark.parametrize("text, read", [
    ("½²", b""), ("①", b""), ("12 Ⅷ", b""), ("́", b""), ("नमस्ते", "नमस्ते".encode()), ("a½b", b"a b"),
    ("ét́e", "ét́e".encode())])
def test_letters_and_their_marks(text, read):
    assert langid.letters(text) == read
