"""Personal data in texts, and the words that give it away. Spark functions only.

Patterns find the entities: addresses, numbers. Sanitising them alone leaves
words that stand by an entity wherever it occurs and so reveal it. How much a
term t tells about an entity e is its pointwise mutual information

    PMI(t; e) = log2(p(t, e) / (p(t) p(e))),

estimated from the documents in which they occur, wherever in them. It can reach the
information of the entity, IC(e) = -log2 p(e), at most: then whoever reads t knows e.
Terms in a text with an entity that disclose a large share of it are removed, those
that disclose a fair share are generalised, that is, replaced by a word for their kind.
What many entities have in common, as the domain of addresses or the first digits of
numbers, is an entity, too.

Words of one text come together because it is one text, so a text is no evidence for
itself: a share counts if the other texts with the term hold the entity more often than
chance lets any word of that entity's texts do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolecall.session import materialize

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone", "term")

# Each pattern finds what the plain one does: runs are taken whole, since what
# ends a run can't be part of it, and only where a run begins, so that no start
# within a run that has failed is tried again.
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+, of 13 to 19 digits
#   phone  \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

TERM = r"\p{L}{3,}"

#: Terms by an entity that chance may bring up (expected number), and the shares of
#: the entity's information from which a term is generalised or removed.
CHANCE, GENERALISE, REMOVE = 0.05, 0.85, 0.95

#: Last digits of a phone number that its class lacks, first ones that a card's has.
SUBSCRIBER, ISSUER = 7, 6

#: Stands for an entity where its text is read for words.
MARK = "\ufffc"

PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def _placed(matches: Column, between: Column) -> Column:
    """Starts and ends of matches, from their lengths and those of what is between them."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("spans"))

    def add(acc: Column, pair: Column) -> Column:
        low = acc["at"] + F.length(pair["gap"])
        high = low + F.length(pair["value"])
        span = F.struct(low.alias("start"), high.alias("end"), pair["value"].alias("value"))
        return F.struct(high.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("value"))
    return F.aggregate(pairs, start, add, lambda acc: acc["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a number fits."""
    back = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    worth = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.floor(d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10))
    return F.aggregate(worth, F.lit(0), lambda t, d: t + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(PART))
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _kept(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _entity(kind: str, span: Column) -> Column:
    """An entity's name: what it is, and its value in lower case or its digits."""
    value = span["value"]
    return F.concat(F.lit(f"{kind}:"), _digits(value) if kind in ("card", "phone") else F.lower(value))


def _class(kind: str, span: Column) -> Column:
    """The name of what an entity has in common with others: the domain, the network,
    the first digits."""
    value, digits = span["value"], _digits(span["value"])
    shared = {"email": F.concat(F.lit("@"), F.lower(F.substring_index(value, "@", -1))),
              "ip": F.concat(F.substring_index(value, ".", 3), F.lit(".*")),
              "card": F.concat(F.substring(digits, 1, ISSUER), F.lit("*")),
              "phone": F.concat(digits.substr(F.lit(1), F.length(digits) - SUBSCRIBER), F.lit("*"))}
    return F.concat(F.lit(f"{kind}:"), shared[kind])


def with_entities(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with an array ``email``, ``ip``, ``card`` and ``phone`` of
    (start, end, value), in code points, the end exclusive. Null texts have none."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = documents
    for kind, pattern in PATTERNS.items():
        # Few texts match at all, and only those are taken apart.
        tried = whole.contains(NEEDS[kind]) & whole.rlike(pattern) if kind in NEEDS else whole.rlike(pattern)
        parts = F.when(tried, F.struct(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)).alias("matches"),
                                       F.split(whole, pattern, -1).alias("between")))
        found = found.withColumn(f"_{kind}", parts)
    for kind in PATTERNS:
        spans = F.when(F.col(f"_{kind}").isNotNull(),
                       _placed(F.col(f"_{kind}.matches"), F.col(f"_{kind}.between")))
        found = found.withColumn(kind, F.coalesce(
            _kept(kind, spans), F.expr(f"cast(array() as {_SPANS})")))
    return found.drop(*[f"_{k}" for k in PATTERNS])


def text_key(text: str) -> Column:
    """What tells texts apart, in place of the text."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def _words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _replaced(text: Column, spans: Column) -> Column:
    """A text with labels in place of the spans, which are in order. Where spans
    overlap, the first one stands for all it touches."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return (F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, s["label"])).alias("parts")))
            .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(
        text, (acc["at"] + 1).cast("int"), F.length(text))))


def _outside(text: Column) -> Column:
    """The distinct words of a text that no entity touches. Column ``all`` has the spans."""
    marked = F.transform("all", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(MARK).alias("label")))
    touched = rf"(?<!\p{{L}})\p{{L}}*+{MARK}\p{{L}}*+"
    return _words(F.regexp_replace(_replaced(text, marked), touched, " "))


def disclosing(held: DataFrame, named: DataFrame, documents: DataFrame, texts: int, text: str = "text") -> DataFrame:
    """(entity, term, share): terms in texts with an entity, and the share of its
    information that they disclose, where it is large enough and no chance.

    ``held``: (key, rows, words), a row per text with an entity, how many documents
    hold it and its distinct words. ``named``: (key, rows, entity). ``texts``: how many
    different texts there are. Shares are of documents, chance is of texts.
    """
    # An entity of one text has no other text that could be evidence.
    of_entity = materialize(named.groupBy("entity").agg(F.count("*").alias("texts_e"), F.sum("rows").alias("n_e"))
                            .where("texts_e > 1"), "entities")
    # Pairs are made within the row of a text, so that no entity is a hot key.
    names = named.join(of_entity, "entity").groupBy("key").agg(F.collect_list("entity").alias("names"))
    pairs = held.join(names, "key").select("rows", "words", F.explode("names").alias("entity")).select(
        "rows", "entity", F.explode("words").alias("term"))
    joint = materialize(pairs.groupBy("entity", "term").agg(
        F.count("*").alias("texts_te"), F.sum("rows").alias("n_te")), "joint")
    tried = joint.groupBy("entity").agg(F.count("*").alias("tried"))
    met = joint.where("texts_te > 1")
    asked = met.select("term").distinct()
    # Words are counted within tasks first; what is shuffled is a row per word and task.
    each = documents.where(F.col(text).isNotNull()).groupBy(F.col(text).cast("string").alias("text")).agg(
        F.count("*").alias("rows"))
    # An inner join stays behind the aggregate; a semi join would be moved before it.
    counts = (each.select("rows", F.explode(_words(F.col("text"))).alias("term")).groupBy("term")
              .agg(F.count("*").alias("texts_t"), F.sum("rows").alias("n_t")).join(asked, "term"))
    total = documents.count()
    ic = F.log2(F.lit(float(max(1, total))) / F.col("n_e"))
    pmi = F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t").cast("double") * F.col("n_e")))
    # Of the other texts with the term, so many hold the entity: a bound of how
    # unlikely that is, in bits (Chernoff).
    others, hits = F.col("texts_t") - 1, F.col("texts_te") - 1
    rate, usual = hits / others, (F.col("texts_e") - 1) / F.lit(float(max(1, texts - 1)))
    bits = F.when(rate > usual, hits * F.log2(rate / usual) + F.when(
        hits < others, (others - hits) * F.log2((1 - rate) / (1 - usual))).otherwise(0.0))
    return (met.join(counts, "term").join(of_entity, "entity").join(tried, "entity")
            .withColumn("share", F.when(ic > 0, pmi / ic)).where(F.col("share") >= GENERALISE)
            .where(bits >= F.log2(F.col("tried") / F.lit(CHANCE))).select("entity", "term", "share"))


def _told_spans() -> Column:
    """(start, end, term, remove) of the words of ``text`` that ``told`` names and no
    span of ``all`` touches."""
    kind = "array<struct<start:bigint,end:bigint,term:string,remove:boolean>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {kind})").alias("spans"))
    words = F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split("text", TERM, -1), 1, F.size(words)).alias("gap"), words.alias("value"))

    def add(acc: Column, pair: Column) -> Column:
        low = acc["at"] + F.length(pair["gap"])
        high, term = low + F.length(pair["value"]), F.lower(pair["value"])
        remove = F.try_element_at("told", term)
        span = F.struct(low.alias("start"), high.alias("end"), term.alias("term"), remove.alias("remove"))
        return F.struct(high.alias("at"), F.when(remove.isNull(), acc["spans"]).otherwise(
            F.concat(acc["spans"], F.array(span))).alias("spans"))

    found = F.aggregate(pairs, start, add, lambda acc: acc["spans"])
    return F.filter(found, lambda t: ~F.exists("all", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, key, email, ip, card, phone, terms) of every document.

    ``documents`` holds (doc_id, text); other columns are ignored, whatever their
    names. The first four are arrays of (start, end, value), ``terms`` one of
    (start, end, term, remove). Terms are added only to texts that hold the
    entity they disclose, or one of its class, and there wherever they stand. Null
    texts are empty and have nothing; equal texts get equal spans; repeated rows
    come out as often as they go in, null ids as null. An empty table gives no rows.
    """
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    some = with_entities(texts.withColumn("key", text_key("text")))
    base = materialize(some.drop("text"), "entities")
    def names(kind: str) -> Column:
        return F.flatten(F.transform(kind, lambda s: F.array(_entity(kind, s), _class(kind, s))))

    # Words are read in a pass of their own, over the texts that hold an entity.
    whole = some.where(F.greatest(*[F.size(k) for k in PATTERNS]) > 0).groupBy("key").agg(
        F.count("*").alias("rows"), F.first(F.struct("text", *PATTERNS)).alias("one"))
    held = (whole.select("key", "rows", "one.*").withColumn("all", F.array_sort(F.concat(*PATTERNS)))
            .withColumn("names", F.array_distinct(F.concat(*map(names, PATTERNS)))).drop(*PATTERNS))
    held = materialize(held.withColumn("words", _outside(F.col("text"))), "held")
    named = held.select("key", "rows", F.explode("names").alias("entity"))
    different = base.select("key").distinct().count()
    told = materialize(disclosing(held.select("key", "rows", "words"), named, texts, different), "told")
    by_text = named.join(told, "entity").groupBy("key", "term").agg(F.max("share").alias("share")).groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("term", F.col("share") >= REMOVE))).alias("told"))
    spans = materialize(held.join(by_text, "key").select("key", _told_spans().alias("terms")), "terms")
    return base.join(spans, "key", "left").select("doc_id", "key", *PATTERNS, F.coalesce(
        "terms", F.expr("cast(array() as array<struct<start:bigint,end:bigint,term:string,remove:boolean>>)")).alias("terms"))


def sanitise(documents: DataFrame) -> DataFrame:
    """``documents`` with their texts sanitised, all other columns as they are.

    Entities become ``<EMAIL>`` and so on; what they disclose is removed or
    becomes ``<TERM>``. Where spans overlap, the first one stands for all it
    touches. Texts without spans stay as they are, also null ones; columns may have
    any name, repeated rows stay repeated, and an empty table stays empty.
    """
    names = documents.columns
    # The row goes along as one value, so that none of its columns meets a name used here.
    keyed = with_entities(documents.select(F.struct(*[documents[n] for n in names]).alias("_row"), "text",
                                           text_key("text").alias("_key")))
    found = find(documents.select(F.lit(None).cast("bigint").alias("doc_id"), "text"))
    terms = materialize(found.where(F.size("terms") > 0).groupBy("key").agg(F.first("terms").alias("_terms")), "spans")
    joined = keyed.join(terms, F.col("_key") == F.col("key"), "left")
    def labelled(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("label")))

    more = F.coalesce(F.transform("_terms", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.when(s["remove"], "").otherwise("<TERM>").alias("label"))),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint,label:string>>)"))
    spans = joined.withColumn("_spans", F.array_sort(F.concat(*map(labelled, PATTERNS), more)))

    clean = F.when(F.size("_spans") > 0, _replaced(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    return spans.select(*[clean.alias(n) if n == "text" else F.col("_row").getField(n).alias(n) for n in names])
