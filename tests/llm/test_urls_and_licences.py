import re

import pytest
from pyspark.sql import functions as F

from rolecall.llm import licences, urls
from rolecall.llm.queries import RULES, op5_urls, op10_licences


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.split("[?#]", rest[len(host):])[0]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.place), default=None)


def test_query(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op5_urls(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = parts(pages[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.place)
        assert r.verdict == (rule.verdict if rule else "allow")


URLS = ["http://a.org", "https://X.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://notorg/x", "http://b.com/fr/1",
        "http://com/de/", "http://c.com/de", "no scheme/org/", None, "", "http://", "http://u.example.org?x=/es/",
        "a://b://c.org/es/", "http://Ä.ORG/", "http://example.org/es/\U0001f600/#x", "//x.org/"]


def test_parts_of_awkward_urls(spark):
    frame = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumn(
        "html", F.lit(None).cast("string")).withColumn("host", F.lit("clash"))
    for r in urls.judge(frame, RULES).collect():
        host, path = parts(URLS[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.place), r.url
        assert r.verdict == (rule.verdict if rule else "allow")
    assert urls.judge(frame.limit(0), RULES).collect() == []


def page(url, head=""):
    return url, f"<html><head>{head}</head><body>x</body></html>"


def canonical(target):
    return f"<link  REL='canonical' href=\"{target}\">"


def test_blocks_reach_aliases_and_allows_win(spark):
    blocked, allowed = "http://h.com/de/1", "http://h.com/fr/1"
    rows = [
        page("http://a.net/1", canonical(blocked)),                                      # alias of a blocked url
        page("http://a.net/2", "<meta http-equiv=refresh content='0; url=http://a.net/1'>"),  # by two steps
        page("http://b.net/1", canonical("/2")), page("http://b.net/2", canonical(allowed)),
        page("http://b.net/3", canonical("http://b.net/1") + "<meta http-equiv=\"refresh\" content=\"1;URL=" + blocked + "2\">"),
        page("http://org.org/1", canonical(blocked)),                                    # its own rule stands
        page("http://c.net/1"), page("http://c.net/1"), (None, None), page("http://d.net/1", "<link rel=icon href=/x>")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(frame, RULES).collect()}
    # The component of a.net/1 holds org.org/1, which a rule allows.
    assert got[0] == got[1] == (None, "allow") and got[5] == ("org/", "allow")
    assert got[2] == got[3] == got[4] == (None, "allow")
    assert got[6] == got[7] == got[8] == got[9] == (None, "allow") and len(got) == len(rows)
    without = {r.page_id: r.verdict for r in urls.judge(frame.where("page_id != 5"), RULES).collect()}
    assert without[0] == without[1] == "block"
    more = spark.createDataFrame([("http://c.net/1", "http://c.net/2"), ("http://c.net/2", blocked + "9"), (None, "x")],
                                 "url string, target string")
    assert {r.page_id: r.verdict for r in urls.judge(frame, RULES, more).collect()}[6] == "block"


@pytest.fixture(scope="module")
def model():
    words = ["the", "and", "ing", "tion", "her", "that", "ent", "all", "ous"]
    return licences.train([" ".join(words[(i * k + k) % 9] + words[i % 9] for k in range(30)) for i in range(60)])


PLANTED = {
    "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc", "licensed under cc by-sa 4.0": "cc",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:": "bsd"}


def test_notices_are_found(documents, model):
    rows = []
    for text in PLANTED:
        rows += [text, f"some words before\n{text}\nand words after", "plain the text and more words " * 30 + text + " that goes on" * 20]
    found = {r.doc_id: r for r in licences.scan(documents(list(enumerate(rows))), model).collect()}
    for i, text in enumerate(rows):
        planted = list(PLANTED)[i // 3]
        assert [n.family for n in found[i].notices] == [PLANTED[planted]], text
        [notice] = found[i].notices
        place = text.index(planted)
        assert notice.start < place + len(planted) and place < notice.end and 0.5 <= notice.probability <= 1


def test_plain_texts_and_unknown_notices(documents, model):
    rows = [(1, "the and ing her that all the work of the day"), (2, "A licence to talk about public things")]
    assert all(not n.similarity >= licences.CONFIRMED for r in licences.scan(documents(rows), model).collect() for n in r.notices)


def test_held_out_accuracy(model):
    import numpy as np
    kept = licences._examples(["of that day her work went on and all was well"] * 40, np.random.default_rng(99), 100)
    p = model.of([t for t, _ in kept])
    truth = np.array([label for _, label in kept])
    assert (p.argmax(1) == truth).mean() >= 0.95


def test_licence_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_licences(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        for text, family in PLANTED.items():
            if text in texts[r.doc_id]:
                assert family in r.families.split(",")
        if not re.search(r"(?i)licen|CC BY", texts[r.doc_id]):
            assert r.families in ("", "unknown")
    plain = [r for r in rows if not re.search(r"(?i)licen|CC BY", texts[r.doc_id])]
    assert sum(r.n_notices for r in plain) <= 0.02 * len(plain)


def test_licences_of_awkward_rows(documents, awkward, model):
    rows = licences.scan(documents(awkward), model).collect()
    assert len(rows) == len(awkward)
    assert {(r.n_paragraphs, len(r.notices)) for r in rows if r.doc_id in (2, 3, 4)} == {(0, 0)}
    assert licences.scan(documents([]), model).collect() == []
    assert licences.learn(documents([])).least >= 0.5


@pytest.mark.parametrize("to, expected", [
    ("index.html", "http://a.net/d/index.html"), ("../new/", "http://a.net/new/"), ("?p=2", "http://a.net/d/e?p=2"),
    ("./x?u=http://z.net/", "http://a.net/d/x?u=http://z.net/"), ("../../../y", "http://a.net/y"),
    ("//c.net/z", "http://c.net/z"), ("/r/./s/..", "http://a.net/r/"), ("HTTP://c.net", "HTTP://c.net"),
    ("mailto:a@b.c", None), ("#top", "http://a.net/d/e?q=1")])
def test_relative_targets(spark, to, expected):
    frame = spark.createDataFrame([(to, "http://a.net/d/e?q=1#f")], "t string, b string")
    assert frame.select(urls.resolved(F.col("t"), F.col("b"))).first()[0] == expected


def test_every_link_of_a_page(spark):
    html = (canonical("one") + canonical("two") + "<meta http-equiv=refresh content='0; url=?p=2'>"
            + "<meta http-equiv='refresh' content='9;url=../up'>")
    frame = spark.createDataFrame([(1, "http://a.net/d/", html), (2, "http://a.net", canonical("x")),
                                   (3, "http://a.net/q", "<base href='/b/'>" + canonical("x"))],
                                  "page_id bigint, url string, html string")
    assert sorted((r.url, r.target) for r in urls.page_links(frame).collect()) == sorted([
        ("http://a.net/d/", "http://a.net/d/one"), ("http://a.net/d/", "http://a.net/d/two"),
        ("http://a.net/d/", "http://a.net/d/?p=2"), ("http://a.net/d/", "http://a.net/up"),
        ("http://a.net", "http://a.net/x"), ("http://a.net/q", "http://a.net/b/x")])


WRAPPED = {
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that "
    "the following conditions are met": "bsd",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
    "documentation files (the \"Software\"), to deal\nin the Software without restriction": "mit",
    "// This program is free software: you can redistribute it\n// and/or modify it under the terms of the GNU "
    "General\n// Public License as published by the Free Software Foundation": "gpl"}


def test_wrapped_notices(documents, model):
    rows = [(i, f"of that day\n\n{t}\n\nher work went on") for i, t in enumerate(WRAPPED)]
    found = {r.doc_id: r.notices for r in licences.scan(documents(rows), model).collect()}
    for (i, text), (wrapped, family) in zip(rows, WRAPPED.items()):
        assert [n.family for n in found[i]] == [family], text
        assert found[i][0].start <= text.index(wrapped.split("\n")[0]) + 3
        assert found[i][0].end >= text.index(wrapped.split("\n")[-1])
