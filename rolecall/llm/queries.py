"""The numbered queries: each operator over its whole table, with the parameters
it is meant to run with, and the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolecall.llm import (
    binary, fingerprints, jaccard, langid, licences, merkle, mixing, packing, pii, simhash, spelling, topk, urls)
from rolecall.llm.tokens import VOCABULARY
from rolecall.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

RULES = [urls.Rule.parse(*r.split()) for r in (
    "allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Documents that nothing is learned from; those without an id are not among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), samples).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    written = binary.write_tokens(table(spark, sf_dir, "documents"), path, end_id=2)
    return binary.read_tokens(written).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=0)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).documents()


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    def printed(kind: str, column: str) -> Column:
        return F.transform(column, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat(*[printed(k, k) for k in pii.PATTERNS])
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in pii.PATTERNS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, printed("term", "terms")), ",").alias("spans"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.learn(docs))
    names = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"])))
    spans = F.transform("notices", lambda n: F.concat_ws(
        ":", n["family"], n["start"].cast("string"), n["end"].cast("string")))
    return found.select("doc_id", "n_paragraphs", F.size("notices").cast("bigint").alias("n_notices"),
                        F.array_join(names, ",").alias("families"), F.array_join(spans, ",").alias("spans"),
                        F.array_max(F.transform("notices", lambda n: n["probability"])).alias("probability"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # A word may lose a letter, so shorter runs are no words, whatever happens to them.
    found = spelling.runs(docs).where(F.char_length("run") >= spelling.LEAST_LENGTH).withColumn("h", F.crc32(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.char_length("run")))
    misspelt = found.withColumn("run", F.when(F.col("h") % 31 == 0, short).otherwise(F.col("run")))
    return spelling.variants(materialize(spelling.vocabulary(misspelt), "words"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    row = ["doc_id", "source", "lang", "n_chars"]
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(
        F.col("text"))
    found = merkle.manifest(docs, [*row, "text"], "source", "doc_id", also={"tampered": merkle.digest(*row, text)})
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"),
                        merkle.folded("tampered", "proof").alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_language, op2_mixing, op3_topk, op4_tokens, op5_urls, op6_fingerprints, op7_packing, op8_jaccard, op9_pii,
    op10_licences, op11_spelling, op12_simhash, op13_merkle)}

#: The crc32 of one byte, for each byte.
_CRC = """crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM range(256) r(i))
)"""

ORACLE_SQL: dict[str, str] = {
    # All inner products, counted out.
    "op3_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
    # Words are near if they agree but for the place left out, or one is the other with a place left out.
    "op11_spelling": """
WITH RECURSIVE """ + _CRC + """, runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, times, xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM runs, crc
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
    FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), without AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word AS x, b.word AS y, b.n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM without a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word, a.n FROM without a JOIN words w ON a.rest = w.word
), best AS (
  SELECT x, count(*) AS n_near, first(y ORDER BY n DESC, y) AS form, max(n) AS form_n FROM near GROUP BY x
), formed AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form,
    CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best ON x = word
), followed AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT f.word, g.form FROM followed f JOIN formed g ON g.word = f.at WHERE g.form IS NOT NULL
), roots AS (
  SELECT f.word, f.at AS root FROM followed f JOIN formed g ON g.word = f.at WHERE g.form IS NULL
)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN roots USING (word)
""",
    # Level by level; the crc32 of an id from its table of bytes.
    "op13_merkle": """
WITH RECURSIVE """ + _CRC + """, rows AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n,
    list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
      lambda v: coalesce(strlen(v) || ':' || v, '-')) AS head, text,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM documents, crc
), leaves AS (
  SELECT doc_id, source, pos, n, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(array_to_string(head, '') || coalesce(strlen(x) || ':' || x, '-')) AS tampered
  FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS x FROM rows)
), nodes AS (
  SELECT source, 0 AS level, pos, leaf AS node, n FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3
), subroots AS (
  SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, node, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM tops WHERE n > 1 GROUP BY level, pos // 3
), ways AS (
  SELECT d.doc_id, 0 AS part, o.level, d.pos // CAST(pow(3, o.level) AS BIGINT) AS own, o.pos, o.node
  FROM leaves d JOIN nodes o ON o.source IS NOT DISTINCT FROM d.source AND o.n > 1
    AND o.pos // 3 = d.pos // CAST(pow(3, o.level + 1) AS BIGINT)
  UNION ALL
  SELECT d.doc_id, 1, o.level, s.pos // CAST(pow(3, o.level) AS BIGINT), o.pos, o.node
  FROM leaves d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
    JOIN tops o ON o.n > 1 AND o.pos // 3 = s.pos // CAST(pow(3, o.level + 1) AS BIGINT)
), steps AS (
  SELECT doc_id, part, level, coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos < own), '') AS a,
    coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos > own), '') AS b
  FROM ways GROUP BY doc_id, part, level
), proofs AS (
  SELECT doc_id, sha256(string_agg(a || b, '' ORDER BY part, level)) AS proof_sha256,
    list({'a': a, 'b': b, 'h': ''} ORDER BY part, level) AS steps FROM steps GROUP BY doc_id
)
SELECT d.doc_id, d.leaf, s.node AS subroot, r.node AS root, p.proof_sha256, f.h AS folded_root, f.h = r.node AS verified
FROM leaves d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source JOIN tops r ON r.n = 1 JOIN proofs p USING (doc_id),
  LATERAL (SELECT list_reduce(p.steps, lambda x, y: {'a': '', 'b': '', 'h': sha256(y.a || x.h || y.b)},
    {'a': '', 'b': '', 'h': d.tampered}).h AS h) f
""",
    # All pairs that share a shingle, then the closure of the links.
    "op8_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), incidence AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), linked AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM incidence a JOIN incidence b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.y FROM reached r JOIN linked l ON r.other = l.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
""",
}
