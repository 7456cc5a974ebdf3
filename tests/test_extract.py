import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from rolecall.operators.joins import enrich_description
from rolecall.sources import extract as x
from rolecall.sources import html

LINK = 'a data-tracking-control-name="public_jobs_jserp-result_search-card"'


def card(title="<h3> Dev </h3>", company="<h4>Acme</h4>", link=f'<{LINK} href="https://j/1?x=1">l</a>',
         place='<span class="y job-search-card__location">Remote</span>',
         time='<time datetime="2025-11-02">2 days ago</time>'):
    return f"<li>{title}{company}{link}{place}{time}</li>"


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"p{i}", h) for i, h in enumerate(htmls)],
                                 "page_id bigint, url string, html string")


def listed(spark, *cards):
    df = x.list_cards(x.extract_cards(pages(spark, "<ul>" + "".join(cards) + "</ul>"), "list"))
    return [r.asDict() for r in df.orderBy("seq").collect()]


def test_list_card(spark):
    got, = listed(spark, card())
    assert got == {"page_id": 0, "seq": 0, "title": "Dev", "company": "Acme", "location": "Remote",
                   "url": "https://j/1", "description": "", "source": "linkedin",
                   "posted_date": date(2025, 11, 2), "posted_time": 172800, "scraped_at": None}


@pytest.mark.parametrize("change, kept", [
    ({"time": ""}, None), ({"title": ""}, None), ({"link": ""}, None),
    ({"link": f'<{LINK} href="?a">l</a>'}, None), ({"link": f"<{LINK}>l</a>"}, None),
    ({"title": "<h3>Unknown</h3>"}, None), ({"title": "<h3>A</h3><h3>B</h3>"}, None),
    ({"company": ""}, {"company": "Unknown"}), ({"place": ""}, {"location": "Not specified"}),
    ({"time": "<time>soon</time>"}, {"posted_time": None, "posted_date": None}),
    ({"title": "<h3></h3>"}, {"title": ""}),
])
def test_list_card_variants(spark, change, kept):
    got = listed(spark, card(**change))
    if kept is None:
        assert got == []
    else:
        assert {k: got[0][k] for k in kept} == kept


def test_unclosed_list_items_are_apart(spark):
    one = card()[:-len("</li>")]
    assert len(listed(spark, one, one.replace("j/1", "j/2"))) == 2


def main(*cards):
    return ('<a href="/out"><p>a · b · Nov 4, 2025</p></a><div data-framer-name="Main"><div>'
            + "".join(cards) + "</div></div>")


def row(record="Acme · Remote · Posted on Nov 4, 2025", href="/j", inside="<h3>Dev</h3>"):
    return f'<a href="{href}">{inside}<p>{record}</p></a>'


def linked(spark, *cards):
    raw = x.extract_cards(pages(spark, main(*cards)), "link")
    return [r.asDict() for r in x.link_cards(raw, date(2025, 11, 4)).orderBy("seq").collect()]


def test_link_card(spark):
    got, = linked(spark, row())
    assert got == {"page_id": 0, "seq": 0, "title": "Dev", "company": "Acme", "location": "Remote",
                   "url": x.LINK_BASE + "/j", "description": "", "source": "startups",
                   "posted_date": date(2025, 11, 4), "posted_time": None, "scraped_at": None}


def test_link_cards_stop_at_the_first_older_one(spark):
    got = linked(spark, row("only · two"), row("a · b · soon"), row(href=""), "<a href='/n'>no p</a>",
                 row(href="/1"), row("two<p>", href="/2"), row("Old · X · Nov 3, 2025"), row(href="/3"))
    assert [r["url"] for r in got] == [x.LINK_BASE + "/1"]


@pytest.mark.parametrize("inside, title", [
    ("<h1> </h1><h4>Four</h4><h2>Two</h2>", "Two"), ("<span>First line</span>", "First line"),
    ("<h5>A</h5><h5>B</h5>", "A")])
def test_link_title(spark, inside, title):
    assert linked(spark, row(inside=inside))[0]["title"] == title


def test_link_url_forms(spark):
    got = linked(spark, row(href="/a"), row(href="b"), row(href="https://c/d"))
    assert [r["url"] for r in got] == [x.LINK_BASE + "/a", x.LINK_BASE + "/b", "https://c/d"]


SECTION = '<section class="description core-section-container extra my-3">{}</section>'


@pytest.mark.parametrize("layout, page, expected", [
    ("list", "<div class='mt4'>No</div>" + SECTION.format(" <p>We NEED</p><p>You</p>"), "we need\n\nyou"),
    ("list", "<div class='x mt4'>Fall Back</div>", "fall back"),
    ("list", SECTION.format("") + "<div class='mt4'>unused</div>", ""),
    ("list", "<p>neither</p>", ""),
    ("link", "<div class='a-content'></div><article>Art</article>", "Art"),
    ("link", "<main>M<div class='my-description-x'>D</div></main>", "D"),
    ("link", "<main>M</main>", "M"),
])
def test_descriptions(spark, layout, page, expected):
    assert x.extract_description(pages(spark, page), layout).first().description == expected


def test_details_skip_redirects_and_keep_the_first_capture(spark):
    captures = spark.createDataFrame(
        [(2, "u", "<main>second</main>"), (1, "u", "<main>first</main>"),
         (0, "u", '<html><head>\n <meta http-equiv="refresh" content="1"></head></html>'),
         (3, "v", "<main>other</main>")], "page_id bigint, url string, html string")
    assert {r.url: r.description for r in x.details(captures, "link").collect()} == {
        "u": "first", "v": "other"}
    cards = spark.createDataFrame([("u", ""), ("w", "")], "url string, description string")
    got = enrich_description(cards, x.details(captures, "link")).collect()
    assert {r.url: r.description for r in got} == {"u": "first", "w": ""}


@pytest.mark.parametrize("page, text", [
    ("a  b\n\tc", "a b c"), ("<p>a</p><p>b</p>", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b", "a\nb"), ("<b>a</b> <i>b</i>", "a b"), ("x<script>var t='</p>';</script>y", "xy"),
    ("a &amp;amp; b", "a &amp; b"), ("<!-- <p>no</p> -->a", "a"), ("<p>a<p>b", "a\n\nb"),
    ("<style>p{}</style>  a ", "a "), ("a</nope>b", "ab"), ("1 < 2", "1 < 2"),
])
def test_visible_text(page, text):
    assert html.visible_text(html.Page(page).root).strip(" ") == text.strip(" ")


def test_deep_pages_do_not_overflow():
    page = html.Page("<b>" * 5000 + "x")
    assert html.visible_text(page.root) == "x" and len(page.inside(page.root)) == 5000


@pytest.mark.parametrize("css", ["", "a b", "a >b", "[x", "a:first"])
def test_unknown_selectors_are_refused(css):
    with pytest.raises(ValueError):
        html.selector(css)


def test_register_layout(spark):
    layout = x.CardLayout("td", (x.Field("text"),))
    x.register_layout("Table", layout)
    try:
        got = x.extract_cards(pages(spark, "<table><tr><td>a<td>b</table>"), "table")
        assert got.count() == 2
    finally:
        del x.CARD_LAYOUTS["table"]
    with pytest.raises(TypeError):
        x.register_layout("bad", object())
    with pytest.raises(ValueError):
        x.extract_cards(pages(spark, ""), "nope")


def test_cards_in_sql(spark):
    x.register_cards_udtf(spark)
    pages(spark, "<ul>" + card() + card() + "</ul>").createOrReplaceTempView("captured")
    got = spark.sql("SELECT page_id, c.seq, c.fields['title'] AS title FROM captured, "
                    "LATERAL extract_cards(html, 'list') c ORDER BY seq").collect()
    assert [(r.page_id, r.seq, r.title.strip()) for r in got] == [(0, 0, "Dev"), (0, 1, "Dev")]


@pytest.mark.parametrize("page", [
    "<a href='x " * 100_000, "<div>" * 100_000, "<p>" + "<i></b>" * 50_000, "<table><p>" + "<li><b></p>" * 30_000,
    "<!x" * 100_000])
def test_malformed_pages_take_linear_time(page):
    start = time.monotonic()
    html.Page(page)
    assert time.monotonic() - start < 2
