"""Postings and descriptions from captured pages.

A layout names the elements of a page. Tasks read the raw fields from each page
(:func:`extract_cards`, :func:`extract_texts`); what they mean is decided by
columns (:func:`list_cards`, :func:`link_cards`, :func:`details`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from rolecall.functions import text
from rolecall.operators.ordering import keep_first, take_while
from rolecall.sources import html as page_html


@dataclass(frozen=True)
class Field:
    """A value of a card: the text or an attribute of an element in it.

    ``css`` is empty for the card itself. A card with several such elements is
    ambiguous, unless ``first`` allows taking the first.
    """

    name: str
    css: str = ""
    attribute: str | None = None
    first: bool = False


@dataclass(frozen=True)
class CardLayout:
    """Where a list page has its cards."""

    item: str
    fields: tuple[Field, ...]
    container: str = ""


@dataclass(frozen=True)
class DetailLayout:
    """Where a detail page has its description: selectors, best first."""

    selectors: tuple[str, ...]
    #: Take the first container that has text, not just the first there is.
    skip_empty: bool = False
    normalize: bool = False


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# Where the two known sites show what.
CARD_LAYOUTS: dict[str, CardLayout] = {
    "list": CardLayout("li", (
        Field("title", "h3"),
        Field("company", "h4"),
        Field("link", "a[data-tracking-control-name='public_jobs_jserp-result_search-card']", "href"),
        Field("location", ".job-search-card__location"),
        Field("posted", "time", "datetime"),
        Field("age", "time"),
    )),
    "link": CardLayout("a", (
        Field("link", "", "href"),
        Field("record", "p"),
        *(Field(h, h, first=True) for h in HEADINGS),
        Field("text"),
    ), container='div[data-framer-name="Main"]'),
}
DETAIL_LAYOUTS: dict[str, DetailLayout] = {
    "list": DetailLayout(("section.core-section-container.my-3.description", "div.mt4"),
                         normalize=True),
    "link": DetailLayout(('div[class*="description"]', 'div[class*="content"]', "article", "main"),
                         skip_empty=True),
}
LINK_BASE = "https://startups.gallery"
REDIRECT_STUB = '<meta http-equiv="refresh"'

PAGES_AT_ONCE = 256

RAW_CARDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("page_url", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ambiguous", T.BooleanType()),
])


def register_layout(name: str, layout: CardLayout | DetailLayout) -> None:
    """Adds a source type."""
    if isinstance(layout, CardLayout):
        CARD_LAYOUTS[name.lower()] = layout
    elif isinstance(layout, DetailLayout):
        DETAIL_LAYOUTS[name.lower()] = layout
    else:
        raise TypeError(f"a layout must be a CardLayout or DetailLayout, got {type(layout).__name__}")


def _layout(layouts: dict, layout):
    if not isinstance(layout, str):
        return layout
    if layout.lower() not in layouts:
        raise ValueError(f"unknown layout {layout!r}; known: {', '.join(layouts)}")
    return layouts[layout.lower()]


def card_reader(layout: CardLayout):
    """A function from a page to the raw fields of each card, and whether any of
    them was ambiguous."""
    items = page_html.Finder([layout.item])
    containers = page_html.Finder([layout.container]) if layout.container else None
    inner = [f for f in layout.fields if f.css]
    own = [f for f in layout.fields if not f.css]
    fields = page_html.Finder([f.css for f in inner])

    def value(field: Field, element: page_html.Element) -> str | None:
        if field.attribute is None:
            return page_html.visible_text(element)
        return element.attrs.get(field.attribute)

    def read(html: str) -> Iterator[tuple[dict[str, str], bool]]:
        page = page_html.Page(html)
        roots = [page.root] if containers is None else [
            e for _, e in containers.matches(page.elements)]
        done = set()
        for item in (e for r in roots for _, e in items.matches(page.inside(r))):
            if item.order in done:
                continue
            done.add(item.order)
            values = {f.name: value(f, item) for f in own}
            met, ambiguous = set(), False
            for i, element in fields.matches(page.inside(item)):
                if i not in met:
                    met.add(i)
                    values[inner[i].name] = value(inner[i], element)
                elif not inner[i].first:
                    ambiguous = True
            yield {k: v for k, v in values.items() if v is not None}, ambiguous

    return read


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages are wide, so only some of a batch become Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, PAGES_AT_ONCE):
            yield batch.slice(start, PAGES_AT_ONCE)


def extract_cards(pages: DataFrame, layout: str | CardLayout) -> DataFrame:
    """One row of raw fields per card of each page (page_id, url, html)."""
    layout = _layout(CARD_LAYOUTS, layout)
    schema = pa.schema([("page_id", pa.int64()), ("page_url", pa.string()), ("seq", pa.int64()),
                        ("fields", pa.map_(pa.string(), pa.string())), ("ambiguous", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cards_of = card_reader(layout)
        for batch in _small(batches):
            rows = []
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for seq, (values, ambiguous) in enumerate(cards_of(html or "")):
                    rows.append({"page_id": page_id, "page_url": url, "seq": seq,
                                 "fields": list(values.items()), "ambiguous": ambiguous})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(read, RAW_CARDS)


def _field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def valid_card() -> Column:
    """A title, a link and a time element. ``age`` is null without the latter."""
    return (F.col("title") != "Unknown") & (F.coalesce("url", F.lit("")) != "") & F.col("age").isNotNull()


def list_cards(raw: DataFrame, scraped_at: Column | None = None) -> DataFrame:
    """Postings from the raw fields of list cards; incomplete cards are dropped."""
    shown = text.card_defaults(text.strip(_field("title")), text.strip(_field("company")),
                               text.strip(_field("location")))
    return (raw.where(~F.col("ambiguous"))
            .select("page_id", "seq", *[c.alias(n) for n, c in shown.items()],
                    text.strip_query(_field("link")).alias("url"),
                    _field("posted").try_cast("date").alias("posted_date"),
                    text.strip(_field("age")).alias("age"))
            .where(valid_card())
            .select("page_id", "seq", "title", "company", "location", "url",
                    F.lit("").alias("description"), F.lit("linkedin").alias("source"),
                    "posted_date", text.age_seconds("age").alias("posted_time"),
                    _scraped_at(scraped_at)))


def link_cards(raw: DataFrame, as_of, base: str = LINK_BASE,
               scraped_at: Column | None = None) -> DataFrame:
    """Postings of the run date from the raw fields of link cards.

    Cards that cannot be read are passed over; the first readable card of
    another date ends its page.
    """
    record = text.split_record(_field("record"))
    readable = (
        raw.where(~F.col("ambiguous") & (F.coalesce(_field("link"), F.lit("")) != "")
                  & _field("record").isNotNull())
        .withColumn("_record", record).where(F.col("_record").isNotNull())
        .withColumn("posted_date", text.parse_posted_date("_record.posted"))
        .where(F.col("posted_date").isNotNull()))
    current = take_while(readable, "page_id", "seq", ~text.is_on("posted_date", as_of),
                         short_runs=True)
    return current.select(
        "page_id", "seq",
        text.title_fallback([_field(h) for h in HEADINGS], _field("text"),
                            F.col("_record.company")).alias("title"),
        F.col("_record.company").alias("company"), F.col("_record.location").alias("location"),
        text.absolute_url(_field("link"), base).alias("url"),
        F.lit("").alias("description"), F.lit("startups").alias("source"),
        "posted_date", F.lit(None).cast("bigint").alias("posted_time"),
        _scraped_at(scraped_at))


def _scraped_at(value: Column | None) -> Column:
    return (F.lit(None) if value is None else value).cast("timestamp").alias("scraped_at")


def not_interstitial(pages: DataFrame) -> DataFrame:
    """Without captures that only redirect elsewhere."""
    return pages.where(~F.col("html").contains(REDIRECT_STUB))


def extract_texts(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Adds, for each name, the visible text of the first element the selector
    finds, or null where there is none. ``html`` itself is left behind."""
    names = list(selectors)
    kept = pages.drop("html")
    schema = T.StructType(kept.schema.fields + [T.StructField(n, T.StringType()) for n in names])
    css = list(selectors.values())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = page_html.Finder(css)
        for batch in _small(batches):
            texts: list[list[str | None]] = [[] for _ in css]
            for html in batch.column("html").to_pylist():
                found: list[str | None] = [None] * len(css)
                for i, element in finder.matches(page_html.Page(html or "").elements):
                    if found[i] is None:
                        found[i] = page_html.visible_text(element)
                for column, value in zip(texts, found):
                    column.append(value)
            names_kept = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names_kept] + [pa.array(t, pa.string()) for t in texts],
                names_kept + names)

    return pages.mapInArrow(read, schema)


def extract_description(pages: DataFrame, layout: str | DetailLayout) -> DataFrame:
    """Adds the description of each page: the text of the best container it has,
    empty without one."""
    layout = _layout(DETAIL_LAYOUTS, layout)
    names = {f"_text{i}": css for i, css in enumerate(layout.selectors)}
    texts = [text.non_empty(n) if layout.skip_empty else F.col(n) for n in names]
    description = F.coalesce(*texts, F.lit(""))
    if layout.normalize:
        description = F.lower(text.strip(description))
    return (extract_texts(pages, names).withColumn("description", description).drop(*names))


def details(pages: DataFrame, layout: str | DetailLayout) -> DataFrame:
    """Description by url: the first capture that is not a redirect. Pages are
    read before they are compared, so that only texts are shuffled."""
    captures = not_interstitial(pages.select("page_id", "url", "html"))
    described = extract_description(captures, layout)
    return keep_first(described, ["url"], ["page_id"]).select("url", "description")


def register_cards_udtf(spark: SparkSession, name: str = "extract_cards") -> None:
    """Cards as a table function for SQL: ``extract_cards(html, layout)``."""
    layouts = dict(CARD_LAYOUTS)

    @F.udtf(returnType="seq bigint, fields map<string,string>, ambiguous boolean")
    class Cards:
        def eval(self, html: str, layout: str):
            cards_of = card_reader(_layout(layouts, layout))
            for seq, (values, ambiguous) in enumerate(cards_of(html or "")):
                yield seq, values, ambiguous

    spark.udtf.register(name, Cards)
