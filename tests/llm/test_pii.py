import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from rolecall.llm import pii
from rolecall.llm.queries import op9_pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and passes_luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def spans(text):
    return {kind: [m.span() for m in pattern.finditer(text or "") if valid(kind, m.group())]
            for kind, pattern in PLAIN.items()}


def checked(rows, texts):
    for r in rows:
        base = spans(texts[r.doc_id])
        printed = ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in base[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in PLAIN)
        assert r.base_sha256 == hashlib.sha256(printed.encode()).hexdigest()
        assert r.spans.split(",term:")[0] in (printed, "") or r.spans.startswith("term:") and not printed


def test_query_agrees_with_plain_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op9_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    checked(rows, texts)


TRICKY = [
    "a@b.c", "a@b.c_d@e.f", "x@y y@z.w", "a@@b.c", "..@a-.b-", "a@b.c.d.", "é@b.co", "éa@b.co \U0001f600 z@q.rs",
    "user%1+2@sub.dom-ain.org.", "a@b", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "1.2.3.256",
    "001.002.003.255", "1.2.3.4444444444444444444444444", "a1.2.3.4b", "4111 1111 1111 1111", "4111-1111-1111-1111",
    "4111111111111112", "4111  1111 1111 1111", "4111 1111 1111 1111 1", "0000000000000", "1 2 3 4 5 6 7 8 9 0 1 2 3",
    "12345678901234567890", "x4111111111111111y", "4111111111111111-", "-4111111111111111", "5 4111111111111111",
    "+1 (523) 555-1055", "+1 (523) 555-1055)", "+12", "+1234567", "+123456789", "++1 23456789 0", "+1 2 3",
    "+1234567890123456", "+44 20.7946 0958 +44 20.7946 0958", "call +1-202-555-0143.", "+1 4111111111111111",
    "12-12-12 1.1.1.1 +9 87654321 a@b.cd", "9" * 5000, "1 " * 3000, "a" * 30_000, "a.b" * 3000 + "@" + "c.d" * 500]


def test_tricky_texts(spark):
    frame = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.with_entities(frame).collect()}
    for i, text in enumerate(TRICKY):
        for kind, expected in spans(text).items():
            found = [(s.start, s.end) for s in got[i][kind]]
            assert found == expected, (text[:60], kind)
            assert all(text[s.start:s.end] == s.value for s in got[i][kind])


FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


@pytest.fixture()
def corpus():
    """A nickname that stands by one address only; a common word by many; plain documents."""
    rows = [(i, f"{FILLER[i % 12]} write to Zorblax now at zed@corp.example or {FILLER[i % 7]} number {i}") for i in range(6)]
    rows += [(100 + i, f"{FILLER[i % 12]} {FILLER[i % 5]} now write number {i} of {FILLER[i % 11]}") for i in range(60)]
    rows += [(200 + i, f"write now u{i}@corp.example {FILLER[i % 9]}") for i in range(8)]
    return rows


def test_disclosing_terms_are_added(documents, corpus):
    texts = dict(corpus)
    for r in pii.find(documents(corpus)).collect():
        words = {texts[r.doc_id][t.start:t.end] for t in r.terms}
        assert words == ({"Zorblax"} if r.doc_id < 6 else set())
        assert all(t.remove and t.term == "zorblax" for t in r.terms)


def test_sanitised_texts(documents, corpus):
    clean = {r.doc_id: r for r in pii.sanitise(documents(corpus)).collect()}
    assert len(clean) == len(corpus) and clean[0].sig == "clash"
    for doc_id, text in corpus:
        if doc_id < 6:
            assert clean[doc_id].text == text.replace("Zorblax", "").replace("zed@corp.example", "<EMAIL>")
        elif doc_id < 200:
            assert clean[doc_id].text == text
        else:
            assert "@" not in clean[doc_id].text and "<EMAIL>" in clean[doc_id].text


def test_copies_give_nothing_away(documents):
    """Words of one text are no evidence, however often it is copied."""
    rows = [(i, "unusual words beside qq@corp.example in one text") for i in range(30)]
    assert all(not r.terms for r in pii.find(documents(rows + [(99, "other words")])).collect())


def test_overlapping_spans(documents):
    """The phone number holds the address, and begins first."""
    [row] = pii.sanitise(documents([(1, "call +250.100.200.100 or 1.2.3.4")])).collect()
    assert row.text == "call <PHONE> or <IP>"


def test_awkward_rows(documents, awkward):
    rows = pii.find(documents(awkward)).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in awkward)
    kept = pii.sanitise(documents(awkward)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter(awkward)
    assert pii.find(documents([])).collect() == [] and pii.sanitise(documents([])).collect() == []


def test_main_path_is_native(documents, corpus):
    plan = pii.sanitise(documents(corpus))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_luhn(spark):
    numbers = ["4111111111111111", "4111111111111112", "79927398713", "0", "18"]
    frame = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", pii.luhn(F.col("n")).alias("ok"))
    assert {r.n: r.ok for r in frame.collect()} == {n: passes_luhn(n) for n in numbers}


def names(text):
    """Entities of a text and their classes."""
    for kind, found in spans(text).items():
        for a, b in found:
            value = text[a:b].lower()
            digits = re.sub("[^0-9]", "", value)
            yield kind, digits if kind in ("card", "phone") else value
            yield kind, {"email": "@" + value.split("@")[-1], "ip": ".".join(value.split(".")[:3]) + ".*",
                         "card": digits[:6] + "*", "phone": digits[:-7] + "*"}[kind]


def words(text, outside=False):
    """(start, end, word) of the words, without those that an entity touches."""
    inside = [s for found in spans(text).values() for s in found] if outside else []
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", text)
            if not any(a < m.end() and m.start() < b for a, b in inside)]


def disclosed(rows):
    """Term spans by id, counted out."""
    rows = {i: t or "" for i, t in rows}
    copies = collections.Counter(rows.values())
    of_term, of_entity = collections.defaultdict(set), collections.defaultdict(set)
    near = {}
    for text in copies:
        for _, _, w in words(text):
            of_term[w].add(text)
        for e in names(text):
            of_entity[e].add(text)
        near[text] = {w for _, _, w in words(text, True)} if any(spans(text).values()) else set()
    n = lambda texts: sum(copies[t] for t in texts)
    told = collections.defaultdict(set)
    for e, texts in of_entity.items():
        tried = set().union(*(near[t] for t in texts))
        ic = math.log2(len(rows) / n(texts))
        for w in tried if ic else ():
            both = {t for t in texts if w in near[t]}
            hits, others = len(both) - 1, len(of_term[w]) - 1
            usual = (len(texts) - 1) / max(1, len(copies) - 1)
            if not hits or hits / others <= usual:
                continue
            rate = hits / others
            bits = hits * math.log2(rate / usual) + (
                (others - hits) * math.log2((1 - rate) / (1 - usual)) if hits < others else 0)
            share = math.log2(n(both) * len(rows) / (n(of_term[w]) * n(texts))) / ic
            if share >= pii.GENERALISE and bits >= math.log2(len(tried) / pii.CHANCE):
                told[e].add(w)
    return {i: [(a, b, w) for a, b, w in words(t, True) if any(w in told[e] for e in names(t))] for i, t in rows.items()}


def test_terms_of_given_tables_are_counted_out(spark, documents, sf_dir):
    """The documents, and a name far from a number that two texts hold."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    far = " und der die das" * 20
    rows += [(10**6 + i, f"Qwertzu{far} {x} +44 20 7946 0958") for i, x in enumerate(("eins", "zwei", "drei"))]
    got = {r.doc_id: [(t.start, t.end, t.term) for t in r.terms] for r in pii.find(documents(rows)).collect()}
    expected = disclosed(rows)
    assert got == expected
    assert all((0, 7, "qwertzu") in got[10**6 + i] for i in range(3))


def test_a_term_of_two_texts_far_from_the_entity(documents, corpus):
    rows = [(1000 + i, f"{i} by Quuxley {'and so on ' * 30} solo@two.example end") for i in range(2)]
    rows += [(2000 + i, f"{FILLER[i % 12]} and so on by end {i} {FILLER[i * 5 % 11]}") for i in range(900)]
    found = {r.doc_id: [t.term for t in r.terms] for r in pii.find(documents(corpus + rows)).collect()}
    assert found[1000] == found[1001] == ["quuxley"]


def test_a_term_of_a_domain(documents, corpus):
    """Every address is in one text; the name gives their domain away."""
    rows = [(1000 + i, f"ask Fizzbuzz {FILLER[i % 12]} {i} by p{i}@fizz.example") for i in range(7)]
    found = {r.doc_id: [t.term for t in r.terms] for r in pii.find(documents(corpus + rows)).collect()}
    assert all("fizzbuzz" in found[1000 + i] for i in range(7))


def test_sanitise_leaves_other_columns_alone(spark):
    names = ["email", "ip", "card", "phone", "key", "terms", "_key", "_spans", "_terms", "all", "label"]
    frame = spark.createDataFrame([("write to a.b@example.org now", *names), (None, *names), ("", *names)],
                                  "text string, " + ", ".join(f"{n} string" for n in names))
    got = pii.sanitise(frame)
    assert got.columns == frame.columns
    rows = got.collect()
    assert sorted(str(r.text) for r in rows) == ["", "None", "write to <EMAIL> now"]
    assert all(list(r)[1:] == names for r in rows)
