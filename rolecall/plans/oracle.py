"""The SQL each query of the catalogue must agree with.

Written relationally (keyword tables joined to texts, recursive folds), not in
the way the queries work.
"""

from __future__ import annotations

from rolecall.functions.taxonomy import DEFAULT_TAXONOMY, Taxonomy
from rolecall.functions.text import WHITESPACE
from rolecall.plans import catalogue as c


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SPACES = " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)

DOCS = """docs AS (
  SELECT doc_id, source AS company, lang, text, n_chars, split_part(text, chr(10), 1) AS title,
         lower(split_part(text, chr(10), 1)) AS t, lower(text) AS d,
         TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS scraped_at
  FROM documents)"""


def _found(keyword: str, text: str) -> str:
    r"""Keyword test; ``\bword\b`` as letters on neither side."""
    if keyword.startswith(r"\b"):
        word = keyword.removeprefix(r"\b").removesuffix(r"\b")
        edge = r"[^\pL\pN\pM_]"
        return f"regexp_matches({text}, '(^|{edge}){word}({edge}|$)')"
    return f"contains({text}, {quote(keyword)})"


def classified(taxonomy: Taxonomy, docs: str, key: str) -> str:
    """CTEs ``scored`` (key, category, classification_confidence) and ``tagged``
    (key, tag) over a CTE ``docs`` with lower-cased ``t`` and ``d``."""
    ords = {name: i for i, name in enumerate(taxonomy.categories)}
    plain = [r for r in taxonomy.category_rows if not r[2].startswith(r"\b")]
    regex = [r for r in taxonomy.category_rows if r[2].startswith(r"\b")]
    rows = ", ".join(f"({quote(cat)}, {ords[cat]}, '{f}', {quote(k)}, {w})" for cat, f, k, w in plain)
    columns = {"title": "t", "description": "d"}
    extra = "".join(
        f" UNION ALL SELECT {key}, {quote(cat)}, {ords[cat]},"
        f" CASE WHEN {_found(k, columns[f])} THEN {w} ELSE 0 END FROM docs"
        for cat, f, k, w in regex)
    tag_plain = ", ".join(f"({quote(tag)}, {quote(k)})" for _, tag, k in taxonomy.tag_rows
                          if not k.startswith(r"\b"))
    tag_extra = "".join(
        f" UNION SELECT {key}, {quote(tag)} FROM docs WHERE {_found(k, quote('') + ' || both_texts')}"
        for _, tag, k in taxonomy.tag_rows if k.startswith(r"\b"))
    default = quote(taxonomy.default_category)
    return f"""{docs},
  joined AS (SELECT *, t || ' ' || d AS both_texts FROM docs),
  kw(category, ord, field, k, w) AS (VALUES {rows}),
  hits AS (
    SELECT {key}, category, ord,
           CASE WHEN contains(CASE field WHEN 'title' THEN t ELSE d END, k) THEN w ELSE 0 END AS s
    FROM docs CROSS JOIN kw{extra}),
  sums AS (SELECT {key}, category, ord, sum(s) AS score FROM hits GROUP BY ALL),
  best AS (
    SELECT {key}, category, score, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, ord) AS rn
    FROM sums),
  scored AS (
    SELECT {key}, CASE WHEN score < 1 THEN {default} ELSE category END AS category,
           CASE WHEN score < 1 THEN 0.3::DOUBLE
                ELSE least(score::DOUBLE / 10::DOUBLE, 1.0::DOUBLE) END AS classification_confidence
    FROM best WHERE rn = 1),
  tag_kw(tag, k) AS (VALUES {tag_plain}),
  tagged AS (
    SELECT DISTINCT {key}, tag FROM joined JOIN tag_kw ON contains(both_texts, k)
    {tag_extra.replace("FROM docs", "FROM joined")})"""


REAL = classified(DEFAULT_TAXONOMY, DOCS, "doc_id")
FRAGMENT = classified(c.FRAGMENTS, DOCS, "doc_id")


def _categories(taxonomy: Taxonomy) -> str:
    return ", ".join(f"({i}, {quote(n)})" for i, n in enumerate(taxonomy.categories))


def _share(count: str, total: str) -> str:
    return (f"CASE WHEN {total} = 0 THEN 0.0::DOUBLE "
            f"ELSE round_even({count}::DOUBLE / {total}::DOUBLE * 100, 2) END AS percentage")


def _count_keyword(keyword: str) -> str:
    """Overlapping occurrences. Where two may share letters, the text is first
    rewritten so that each has its own."""
    text = "d"
    if keyword == "ere":
        text = "replace(d, 'e', 'ee')"
    elif keyword == "anan":
        text, keyword = "replace(replace(d, 'an', chr(1)), chr(1), chr(1) || chr(2) || chr(1))", "\x01\x01"
    elif any(keyword.startswith(keyword[i:]) for i in range(1, len(keyword))):
        raise ValueError(f"occurrences of {keyword!r} may overlap")
    return f"(length({text}) - length(replace({text}, {quote(keyword)}, ''))) // {len(keyword)}"


def _all(keywords, text="d") -> str:
    return " AND ".join(f"contains({text}, {quote(k.lower())})" for k in keywords)


SPECS = """matched AS (
  SELECT doc_id, n_chars, 'common' AS spec, 40 AS max_results FROM docs
    WHERE contains(d, 'the') AND contains(d, 'tion')
  UNION ALL SELECT doc_id, n_chars, 'german', 1000 FROM docs
    WHERE contains(d, 'und') AND contains(d, 'der') AND lang = 'de'
  UNION ALL SELECT doc_id, n_chars, 'short', 25 FROM docs
    WHERE contains(d, 'er') AND n_chars <= 400
  UNION ALL SELECT doc_id, n_chars, 'anything', 100 FROM docs
    WHERE d <> '' AND lower(company) NOT IN ('src1', 'src2'))"""

LIMITED = """limited AS (
  SELECT doc_id, spec FROM (
    SELECT *, row_number() OVER (PARTITION BY spec ORDER BY n_chars, doc_id) AS rn FROM {matches})
  WHERE rn <= max_results)"""

KEYED_DOCS = f"""keyed AS (
  SELECT doc_id, scraped_at,
         'job:company:' || replace(trim(lower(company), {SPACES}), ' ', '_') AS company_key,
         sha256(trim(d, {SPACES})) AS content_hash
  FROM docs)"""

ARRIVALS = f"""arrivals AS (
  SELECT event_id, ts, 'job:company:' || user_id AS company_key,
         sha256(trim(lower(props), {SPACES})) AS content_hash FROM events)"""


def _expiry_fold(company: str, ttl: str, before: str = "") -> str:
    """One arrival of each company per step."""
    return f"""
WITH RECURSIVE {before + "," if before else ""} ordered AS (
  SELECT event_id, {company} AS company, props, ts,
         row_number() OVER (PARTITION BY {company} ORDER BY ts, event_id) AS rn FROM events),
fold(event_id, company, rn, is_new, live, expiry) AS (
  SELECT event_id, company, rn, true, [props], ts + {ttl} FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.event_id, o.company, o.rn,
         o.ts >= f.expiry OR NOT list_contains(f.live, o.props),
         CASE WHEN o.ts >= f.expiry THEN [o.props]
              WHEN list_contains(f.live, o.props) THEN f.live
              ELSE list_append(f.live, o.props) END,
         CASE WHEN o.ts >= f.expiry OR NOT list_contains(f.live, o.props)
              THEN o.ts + {ttl} ELSE f.expiry END
  FROM fold f JOIN ordered o ON o.company = f.company AND o.rn = f.rn + 1)
SELECT event_id FROM fold WHERE is_new"""


ORDER_CARDS = """cards AS (
  SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_orderpriority AS priority,
         o_orderdate, c_custkey, c_name, c_mktsegment, n_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

LIST_CARDS = ORDER_CARDS + """,
listed AS (
  SELECT c_custkey AS page_id, o_orderkey, c_mktsegment, priority, 'Order & ' || o_orderkey AS title,
         CASE WHEN priority = '4-NOT SPECIFIED' THEN 'Unknown' ELSE c_name END AS company,
         CASE WHEN priority = '1-URGENT' THEN 'Not specified' ELSE n_name END AS location,
         'https://jobs.example.com/view/' || o_orderkey AS url,
         CAST(o_orderdate AS DATE) AS posted_date,
         CAST(o_orderkey % 40 * 86400 AS BIGINT) AS posted_time
  FROM cards WHERE priority <> '5-LOW' AND status <> 'F')"""


def _article_text() -> str:
    """The article of a page with its tags turned to lines: chr(1) marks the
    edge of a block, which shows only between texts."""
    x = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"
    x = f"regexp_replace({x}, '</?b>', '', 'g')"
    x = f"regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g')"
    x = f"regexp_replace({x}, '(</?(h1|p)> ?)+', chr(1), 'g')"
    x = f"replace({x}, '<br>', chr(10))"
    x = f"regexp_replace({x}, ' *([\\n\\x01]) *', '\\1', 'g')"
    x = f"replace(trim({x}, ' ' || chr(1)), chr(1), chr(10) || chr(10))"
    return _unescaped(x)


def _unescaped(x: str) -> str:
    for name, value in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{value}')"
    return x


def all_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["classify_documents"] = f"WITH {REAL} SELECT doc_id, category, classification_confidence FROM scored"
    sql["classify_fragments"] = f"""WITH {FRAGMENT},
      lists AS (SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tagged GROUP BY doc_id)
      SELECT scored.doc_id, category, classification_confidence, coalesce(tags, '') AS tags
      FROM scored LEFT JOIN lists USING (doc_id)"""
    turns = """docs AS (SELECT conv_id * 10000 + turn AS id, conv_id, turn, '' AS t, lower(text) AS d
                FROM conversations)"""
    sql["classify_conversations"] = f"""WITH {classified(DEFAULT_TAXONOMY, turns, "id")},
      lists AS (SELECT id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tagged GROUP BY id)
      SELECT conv_id, turn, category, coalesce(tags, '') AS tags
      FROM docs JOIN scored USING (id) LEFT JOIN lists USING (id)"""
    sql["document_tags"] = f"WITH {REAL} SELECT doc_id, tag FROM tagged"
    sql["category_summary"] = f"""WITH {REAL}, cats(ord, category) AS (VALUES {_categories(DEFAULT_TAXONOMY)}),
      counts AS (SELECT category, count(*) AS n FROM scored GROUP BY category),
      total AS (SELECT count(*) AS total_jobs FROM documents)
      SELECT category, coalesce(n, 0)::BIGINT AS job_count, {_share("coalesce(n, 0)", "total_jobs")}, total_jobs
      FROM cats LEFT JOIN counts USING (category) CROSS JOIN total"""
    sql["category_summary_by_source"] = f"""WITH {REAL},
      cats(ord, category) AS (VALUES {_categories(DEFAULT_TAXONOMY)}),
      jobs AS (SELECT company, category FROM docs JOIN scored USING (doc_id)),
      counts AS (SELECT company, category, count(*) AS n FROM jobs GROUP BY ALL),
      totals AS (SELECT company, count(*) AS total_jobs FROM jobs GROUP BY ALL)
      SELECT company, category, coalesce(n, 0)::BIGINT AS job_count,
             {_share("coalesce(n, 0)", "total_jobs")}, total_jobs
      FROM totals CROSS JOIN cats LEFT JOIN counts USING (company, category)"""
    tags_sql = f"""counts AS (SELECT tag, count(*) AS job_count FROM tagged GROUP BY tag),
      total AS (SELECT count(*) AS total_jobs FROM documents)
      SELECT tag, job_count, {_share("job_count", "total_jobs")}, total_jobs FROM counts CROSS JOIN total"""
    sql["tag_summary"] = f"WITH {REAL}, {tags_sql}"
    sql["top_tags"] = f"WITH {FRAGMENT}, {tags_sql} ORDER BY job_count DESC, tag LIMIT 3"

    dated = """dated AS (SELECT doc_id, lang AS name, strftime(scraped_at, '%Y') AS year,
                                strftime(scraped_at, '%m') AS month FROM docs)"""
    grain = """CASE grouping(name, year, month) WHEN 0 THEN 'month' WHEN 1 THEN 'year'
               WHEN 3 THEN 'name' ELSE 'all' END"""
    same = "l.grain = n.grain AND l.name IS NOT DISTINCT FROM n.name AND " \
           "l.year IS NOT DISTINCT FROM n.year AND l.month IS NOT DISTINCT FROM n.month"
    levels = f"""levels AS (SELECT {grain} AS grain, name, year, month, count(*) AS total_jobs
                 FROM dated GROUP BY ROLLUP (name, year, month))"""
    sql["monthly_rollup"] = f"""WITH {FRAGMENT}, {dated}, {levels},
      cats(ord, category) AS (VALUES {_categories(c.FRAGMENTS)}),
      n AS (SELECT {grain} AS grain, name, year, month, category, count(*) AS n
            FROM dated JOIN scored USING (doc_id) GROUP BY category, ROLLUP (name, year, month))
      SELECT l.grain, l.name, l.year, l.month, cats.category, coalesce(n.n, 0)::BIGINT AS job_count,
             {_share("coalesce(n.n, 0)", "l.total_jobs")}, l.total_jobs
      FROM levels l CROSS JOIN cats LEFT JOIN n ON n.category = cats.category AND {same}"""
    sql["monthly_tag_rollup"] = f"""WITH {FRAGMENT}, {dated}, {levels},
      n AS (SELECT {grain} AS grain, name, year, month, tag, count(*) AS job_count
            FROM dated JOIN tagged USING (doc_id) GROUP BY tag, ROLLUP (name, year, month))
      SELECT l.grain, l.name, l.year, l.month, n.tag, n.job_count,
             {_share("n.job_count", "l.total_jobs")}, l.total_jobs
      FROM n JOIN levels l ON {same}"""
    for name in ("monthly_rollup", "monthly_tag_rollup"):
        sql[f"{name}_of_counts"] = sql[name]
    sql["zero_fill_categories"] = """SELECT category, category_ord, count(event_id)::BIGINT AS job_count
      FROM (VALUES (0, 'click'), (1, 'error'), (2, 'never'), (3, 'view')) v(category_ord, category)
      LEFT JOIN events ON event_type = category GROUP BY ALL"""
    sql["total_jobs"] = "SELECT count(*) AS total_jobs FROM documents"
    sql["run_totals"] = """WITH runs AS (
        SELECT event_type AS name, strftime(ts, '%Y%m%d')::BIGINT AS run_id, count(*) AS found
        FROM events GROUP BY ALL)
      SELECT name, run_id, found, row_number() OVER w AS searches, sum(found) OVER w::BIGINT AS total_found
      FROM runs WINDOW w AS (PARTITION BY name ORDER BY run_id)""".replace(
        "sum(found) OVER w::BIGINT", "CAST(sum(found) OVER w AS BIGINT)")
    sql["taxonomy_coverage"] = f"""WITH {REAL}, cats(ord, category) AS (VALUES {_categories(DEFAULT_TAXONOMY)})
      SELECT category, ord AS category_ord, count(doc_id) AS documents
      FROM cats LEFT JOIN scored USING (category) GROUP BY ALL"""
    groups = ", ".join(f"({quote(g)}, {quote(t)})"
                       for g, tags in DEFAULT_TAXONOMY.tags_by_group.items() for t in tags)
    sql["unused_tags"] = f"""WITH {REAL} SELECT tag, tag_group FROM (VALUES {groups}) g(tag_group, tag)
      WHERE tag NOT IN (SELECT tag FROM tagged)"""

    sql["match_all_keywords"] = f"""WITH {DOCS} SELECT doc_id, {_all(c.KEYWORDS)} AS all_common,
      {_all(c.RARE_KEYWORDS)} AS all_rare, contains(text, 'The') AND contains(text, 'Tion') AS all_cased,
      false AS all_repeated, true AS all_none FROM docs"""
    any_rare = " OR ".join(f"contains(d, {quote(k.lower())})" for k in c.RARE_KEYWORDS)
    sql["match_any_keywords"] = f"""WITH {DOCS} SELECT doc_id, {any_rare} AS any_rare,
      contains(title, 'Tion') OR contains(title, 'Rest') AS any_cased FROM docs"""
    asked = [k.lower() for k in c.KEYWORDS + c.RARE_KEYWORDS]
    hits = " + ".join(f"contains(d, {quote(k)})::INT" for k in asked)
    absent = ", ".join(f"CASE WHEN NOT contains(d, {quote(k)}) THEN {quote(k)} END" for k in asked)
    sql["match_score_keywords"] = f"""WITH {DOCS} SELECT doc_id,
      ({hits})::DOUBLE / {len(asked)}::DOUBLE AS score, concat_ws(',', {absent}) AS missing FROM docs"""
    parts = [f"SELECT doc_id, {quote(k)} AS keyword, CAST({_count_keyword(k)} AS BIGINT) AS occurrences FROM docs"
             for k in c.COUNTED_KEYWORDS]
    sql["matched_keyword_counts"] = f"""WITH {DOCS}, counted AS ({" UNION ALL ".join(parts)})
      SELECT * FROM counted WHERE occurrences > 0"""
    sql["match_words_of_title"] = f"""WITH turns AS (
        SELECT conv_id, turn, role, lower(text) AS d,
               list_filter(string_split(trim(split_part(text, chr(10), 1), {SPACES}), ' '), lambda w: w <> '') AS words
        FROM conversations),
      lowered AS (SELECT *, list_transform(words, lambda w: lower(w)) AS ws FROM turns)
      SELECT conv_id, turn,
        CASE WHEN len(ws) = 0 THEN true WHEN d = '' THEN false
             ELSE len(list_distinct(ws)) = len(ws) AND len(list_filter(ws, lambda w: NOT contains(d, w))) = 0 END AS all_words,
        CASE WHEN len(ws) = 0 THEN true ELSE len(list_filter(ws, lambda w: contains(lower(role), w))) > 0 END AS any_in_role,
        CASE WHEN len(ws) = 0 THEN 1.0::DOUBLE WHEN d = '' THEN 0.0::DOUBLE
             ELSE len(list_filter(list_distinct(ws), lambda w: contains(d, w)))::DOUBLE / len(ws)::DOUBLE END AS score
      FROM lowered"""
    sql["accept_postings"] = f"""WITH {DOCS} SELECT doc_id, title || ' at ' || company || ' (' || lang || ')' AS label
      FROM docs WHERE text <> '' AND contains(d, 'the') AND contains(d, 'rest')"""
    sql["match_specs"] = f"WITH {DOCS}, {SPECS} SELECT doc_id, spec FROM matched"
    sql["limit_per_spec"] = f"""WITH {DOCS}, {SPECS}, {LIMITED.format(matches="matched")}
      SELECT doc_id, spec FROM limited"""
    sql["match_searches"] = f"""WITH {DOCS}, words AS (
        SELECT c_custkey AS k, [lower(substr(n_name, 2, 3)), lower(substr(c_mktsegment, 1, 2)),
               substr(c_custkey::VARCHAR, 1, 1)] AS w
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0),
      asked AS (
        SELECT k, CASE WHEN k % 7 = 0 THEN [] WHEN k % 11 = 0 THEN ['er', 'er'] ELSE list_slice(w, 1, k % 3 + 1) END AS w,
               CASE WHEN k % 7 = 0 OR k % 3 = 0 THEN (['en', 'de', 'fr', 'es'])[k % 4 + 1] END AS lang,
               CASE WHEN k % 2 = 0 THEN k * 10 END AS within FROM words)
      SELECT 's' || k AS spec, count(*) AS found, min(doc_id) AS first, max(doc_id) AS last
      FROM asked JOIN docs ON d <> '' AND len(w) = len(list_distinct(w)) AND len(list_filter(w, lambda x: NOT contains(d, x))) = 0
        AND (asked.lang IS NULL OR asked.lang = docs.lang) AND (within IS NULL OR n_chars <= within)
        AND lower(company) <> 'src' || (k % 20)
      GROUP BY k"""
    sql["spec_filters"] = f"""WITH {DOCS} SELECT doc_id FROM docs
      WHERE lang = 'en' AND n_chars <= 2000 AND lower(company) NOT IN ('src3', 'src4')"""
    sql["search_expressions"] = f"""WITH {DOCS}, {SPECS},
      asked(spec, expression) AS (VALUES ('common', 'the AND tion'), ('german', 'und AND der'),
        ('short', 'Er'), ('anything', 'NOT(SRC1 OR src2)'), ('repeated', 'the AND THE'), ('off', 'the'))
      SELECT spec, expression, count(*) AS found FROM matched JOIN asked USING (spec) GROUP BY ALL"""
    fresh = """firsts AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (
        PARTITION BY company_key, content_hash ORDER BY doc_id) AS rn FROM keyed) WHERE rn = 1)"""
    sql["search_cycle"] = f"""WITH {REAL}, {KEYED_DOCS}, {fresh}, {SPECS},
      kept AS (SELECT * FROM matched JOIN firsts USING (doc_id)), {LIMITED.format(matches="kept")},
      lists AS (SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tagged GROUP BY doc_id)
      SELECT spec AS name, doc_id, category, classification_confidence, coalesce(tags, '') AS tags
      FROM limited JOIN scored USING (doc_id) LEFT JOIN lists USING (doc_id)"""

    sql["company_content_keys"] = f"WITH {DOCS}, {KEYED_DOCS} SELECT doc_id, company_key, content_hash FROM keyed"
    sql["dedup_exact"] = f"WITH {DOCS}, {KEYED_DOCS}, {fresh} SELECT doc_id FROM firsts"
    half = "seen AS (SELECT company_key, content_hash FROM keyed WHERE doc_id < (SELECT max(doc_id) / 2 FROM documents))"
    for name, test in (("new_only", "NOT EXISTS"), ("seen_before", "EXISTS")):
        sql[name] = f"""WITH {DOCS}, {KEYED_DOCS}, {half} SELECT doc_id FROM keyed k WHERE {test} (
          SELECT 1 FROM seen s WHERE s.company_key = k.company_key AND s.content_hash = k.content_hash)"""
    sql["new_only_bucketed"] = sql["new_only"]
    sql["mark_seen"] = f"""WITH {ARRIVALS} SELECT company_key, content_hash, epoch_us(max(ts)) AS seen_at
      FROM arrivals GROUP BY ALL"""
    sql["live_seen"] = f"""WITH {ARRIVALS}, past AS (SELECT * FROM arrivals WHERE ts < TIMESTAMP '2024-01-28'),
      alive AS (SELECT company_key FROM past GROUP BY company_key
                HAVING max(ts) + INTERVAL 1 DAY > TIMESTAMP '2024-01-28')
      SELECT DISTINCT company_key, content_hash FROM past WHERE company_key IN (SELECT company_key FROM alive)"""
    sql["seen_store_stats"] = f"""WITH {DOCS}, {KEYED_DOCS} SELECT count(DISTINCT company_key) AS total_companies,
      count(DISTINCT (company_key, content_hash)) AS total_cached_jobs FROM keyed"""
    sql["reset_seen"] = f"""WITH {DOCS}, {KEYED_DOCS} SELECT count(DISTINCT company_key) AS total_companies,
      0::BIGINT AS total_cached_jobs FROM keyed"""
    by_user = _expiry_fold("user_id", "INTERVAL 5 DAY")
    for name in ("dedup_with_expiry", "dedup_with_expiry_slices", "stream_dedup_with_expiry"):
        sql[name] = by_user
    sql["dedup_carried_over"] = _expiry_fold("user_id", "INTERVAL 12 DAY")
    sql["dedup_one_hot_company"] = _expiry_fold("'One'", "INTERVAL 5 DAY")

    # The stream comes in three files by time; each batch is limited on its own.
    folded = _expiry_fold("company", "INTERVAL 14 DAY", f"""{REAL},
      events AS (SELECT doc_id AS event_id, company, trim(d, {SPACES}) AS props, scraped_at AS ts FROM docs)""")
    sql["stream_process_batch"] = f"""{folded.rsplit("SELECT", 1)[0]},
      top AS (SELECT max(doc_id) AS m FROM documents), {SPECS},
      kept AS (
        SELECT matched.*, CASE WHEN doc_id * 3 < m THEN 0 WHEN doc_id * 3 < m * 2 THEN 1 ELSE 2 END AS batch
        FROM matched CROSS JOIN top JOIN fold ON event_id = doc_id AND is_new)
      SELECT spec AS name, doc_id, category FROM (
        SELECT *, row_number() OVER (PARTITION BY spec, batch ORDER BY doc_id) AS rn FROM kept)
      JOIN scored USING (doc_id) WHERE rn <= max_results"""

    stored = f"""stored AS ({sql["stream_process_batch"]}),
      dated AS (SELECT *, strftime(came, '%Y') AS year, strftime(came, '%m') AS month FROM (
        SELECT *, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS came FROM stored))"""
    sql["stream_totals"] = f"""WITH {stored}, {levels},
      cats(ord, category) AS (VALUES {_categories(DEFAULT_TAXONOMY)}),
      n AS (SELECT {grain} AS grain, name, year, month, category, count(*) AS n
            FROM dated GROUP BY category, ROLLUP (name, year, month))
      SELECT l.grain, l.name, l.year, l.month, cats.category, coalesce(n.n, 0)::BIGINT AS job_count,
             {_share("coalesce(n.n, 0)", "l.total_jobs")}, l.total_jobs
      FROM levels l CROSS JOIN cats LEFT JOIN n ON n.category = cats.category AND {same}"""
    longest = 7 * 86400
    sql["search_clocks"] = f"""WITH matched AS (
        SELECT 'often' AS name, 60 AS width, ts FROM events WHERE props <> ''
        UNION ALL SELECT 'seldom', 150, ts FROM events WHERE contains(props, '1') AND contains(props, '2')
        UNION ALL SELECT 'weekly', {longest}, ts FROM events
          WHERE props <> '' AND (user_id NOT IN (1, 2) OR user_id IS NULL)),
      due AS (SELECT name, (epoch_us(ts) // (width * 1000000::BIGINT) + 1) * width AS due_second FROM matched WHERE ts IS NOT NULL)
      SELECT name, due_second, count(*) AS found FROM due
      WHERE due_second <= (SELECT max(due_second) FROM due) - {longest} GROUP BY ALL"""

    sql["strip_query"] = "SELECT page_id, split_part(url, '?', 1) AS url FROM pages"
    base = c.extract.LINK_BASE

    def absolute(x: str) -> str:
        return (f"CASE WHEN starts_with({x}, '/') THEN '{base}' || {x} "
                f"WHEN NOT starts_with({x}, 'http') THEN '{base}/' || {x} ELSE {x} END")

    path = "regexp_extract(url, '^https?://[^/]+(.*)$', 1)"
    sql["absolute_url"] = f"""SELECT page_id, {absolute("url")} AS whole, {absolute(path)} AS rooted,
      {absolute(f"ltrim({path}, '/')")} AS bare FROM pages"""
    sql["age_seconds"] = """SELECT event_id, CAST(floor(value) AS BIGINT) *
      CASE event_id % 6 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 86400 WHEN 4 THEN 60 WHEN 5 THEN 86400 END AS age
      FROM events"""
    sql["parse_posted_date"] = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS short,
      CAST(o_orderdate AS DATE) AS padded, CAST(o_orderdate AS DATE) AS full, CAST(NULL AS DATE) AS other,
      CAST(o_orderdate AS DATE) = DATE '1997-05-28' AS on_day FROM orders"""
    sql["split_record"] = """SELECT c_custkey, c_name AS company, n_name AS location, c_mktsegment AS posted
      FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'"""
    sql["output_rows"] = f"""WITH {FRAGMENT},
      lists AS (SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags, count(*) AS n FROM tagged GROUP BY doc_id)
      SELECT company, lang AS location,
             'https://jobs.example.com/' || company || '/' || doc_id || '?ref=' || lang AS url,
             'linkedin' AS source, CAST(scraped_at AS DATE) AS posted_date,
             strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS scraped_at, category, coalesce(tags, '') AS tags,
             classification_confidence, coalesce(n, 0)::INTEGER AS n_tags
      FROM docs JOIN scored USING (doc_id) LEFT JOIN lists USING (doc_id)"""
    sql["date_parts"] = f"""WITH {DOCS} SELECT doc_id, strftime(scraped_at, '%Y') AS year,
      strftime(scraped_at, '%m') AS month, strftime(scraped_at, '%Y%m%d') AS day FROM docs"""

    sql["take_while"] = """SELECT event_id, user_id FROM (SELECT *, count(*) FILTER (event_type = 'error') OVER (
        PARTITION BY user_id ORDER BY event_id) AS errors FROM events) WHERE errors = 0"""
    sql["keep_first"] = """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (
        PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1"""
    sql["newest_page"] = """SELECT doc_id, n_chars AS posted_time FROM documents
      ORDER BY n_chars, doc_id LIMIT 10 OFFSET 20"""

    sql["upsert_orders"] = """WITH top AS (SELECT max(o_orderkey) AS k FROM orders),
      first AS (SELECT orders.* FROM orders, top WHERE o_orderkey <= k * 0.6),
      second AS (SELECT orders.* FROM orders, top WHERE o_orderkey > k * 0.4)
      SELECT o_orderkey, o_totalprice, NULL AS note FROM first
      UNION ALL SELECT o_orderkey, o_totalprice + 1, 'second' FROM second
      WHERE o_orderkey NOT IN (SELECT o_orderkey FROM first)"""
    sql["postings_store"] = f"""WITH {REAL} SELECT doc_id, lang AS name, category,
      doc_id >= (SELECT max(doc_id) / 2 FROM documents) AS added_later FROM docs JOIN scored USING (doc_id)"""
    sql["versioned_store"] = f"""WITH {REAL}, stored AS (
        SELECT doc_id, lang AS name, category, doc_id >= (SELECT max(doc_id) / 2 FROM documents) AS added_later
        FROM docs JOIN scored USING (doc_id))
      SELECT version::INT AS version, stored.* FROM stored JOIN (VALUES (1), (2), (3)) AS v(version)
        ON version > 1 OR NOT added_later"""
    sql["day_file_merged"] = """SELECT doc_id, n_chars AS posted_time,
      doc_id >= (SELECT max(doc_id) / 2 FROM documents) AS added_later FROM documents"""
    titles = DOCS.replace("lower(text) AS d", "'' AS d")
    sql["history_summary"] = f"""WITH {classified(c.FRAGMENTS, titles, "doc_id")},
      cats(ord, category) AS (VALUES {_categories(c.FRAGMENTS)}),
      counts AS (SELECT category, count(*) AS n FROM scored GROUP BY category),
      total AS (SELECT count(*) AS total_jobs FROM docs)
      SELECT category, coalesce(n, 0)::BIGINT AS job_count, {_share("coalesce(n, 0)", "total_jobs")}, total_jobs
      FROM cats LEFT JOIN counts USING (category) CROSS JOIN total"""

    title = _unescaped("trim(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'))")
    sql["extract_pages"] = f"SELECT page_id, {title} AS title, {_article_text()} AS description FROM pages"
    sql["extract_navigation"] = """WITH navs AS (
        SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*)</nav>', 1, 's'), '<a .*?</a>') AS links FROM pages),
      each AS (SELECT page_id, unnest(links) AS a, unnest(range(len(links))) AS seq FROM navs)
      SELECT page_id, seq, replace(replace(regexp_extract(a, 'href="([^"]*)"', 1), '&quot;', '"'), '&amp;', '&') AS link,
             replace(replace(regexp_extract(a, '>(.*)</a>', 1), '&quot;', '"'), '&amp;', '&') AS text FROM each"""
    sql["extract_list_cards"] = f"""WITH {LIST_CARDS}
      SELECT page_id, title, company, location, url, posted_date, posted_time FROM listed"""
    sql["extract_link_cards"] = f"""WITH {ORDER_CARDS},
      readable AS (SELECT * FROM cards WHERE priority <> '4-NOT SPECIFIED' AND status <> 'P'),
      marked AS (SELECT *, count(*) FILTER (priority = '5-LOW') OVER (
        PARTITION BY c_custkey ORDER BY o_orderkey) AS old FROM readable)
      SELECT c_custkey AS page_id, CASE WHEN priority = '1-URGENT' THEN 'Urgent' ELSE 'Order ' || o_orderkey END AS title,
             c_name AS company, n_name AS location, '{base}/jobs/' || o_orderkey AS url,
             DATE '2025-11-04' AS posted_date, 'startups' AS source
      FROM marked WHERE old = 0"""
    sql["list_cycle"] = f"""WITH {LIST_CARDS},
      described AS (SELECT *, 'python and ' || lower(c_mktsegment) || ' docker, ' || lower(priority) AS d FROM listed),
      fresh AS (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY lower(company), d ORDER BY page_id, o_orderkey) AS rn FROM described) WHERE rn = 1),
      found AS (
        SELECT 'machines' AS name, 500 AS max_results, * FROM fresh WHERE contains(d, 'python') AND contains(d, 'machinery')
        UNION ALL SELECT 'urgent', 20, * FROM fresh WHERE contains(d, 'docker') AND contains(d, '1-urgent')),
      limited AS (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY name ORDER BY posted_time, page_id, o_orderkey) AS place FROM found) WHERE place <= max_results)
      SELECT name, url, company, 'DevOps' AS category, 0.1::DOUBLE AS classification_confidence,
             'Docker,Python' AS tags FROM limited"""
    numbered = """numbered AS (
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM orders)"""
    day_of_card = "TIMESTAMP '2024-01-01' + seq * INTERVAL 1 DAY"
    kept = _expiry_fold("lower(company)", "INTERVAL 3 DAY", f"""{LIST_CARDS}, {numbered},
      events AS (SELECT *, page_id * 1000000 + seq AS event_id, {day_of_card} AS ts,
        'python and ' || lower(c_mktsegment) || ' docker, ' || lower(priority) AS props FROM listed JOIN numbered USING (o_orderkey))""")
    sql["list_cycle_with_expiry"] = f"""{kept.rsplit("SELECT", 1)[0]},
      fresh AS (SELECT events.* FROM events JOIN fold USING (event_id) WHERE is_new),
      found AS (
        SELECT 'machines' AS name, 500 AS max_results, * FROM fresh WHERE contains(props, 'machinery')
        UNION ALL SELECT 'urgent', 20, * FROM fresh WHERE contains(props, '1-urgent')),
      limited AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY posted_time, event_id) AS place FROM found)
      SELECT name, url, company, epoch(ts)::BIGINT AS second, 'DevOps' AS category FROM limited WHERE place <= max_results"""
    shown = classified(DEFAULT_TAXONOMY, "docs AS (SELECT event_id, lower(title) AS t, '' AS d FROM events)", "event_id")
    kept = _expiry_fold("lower(company)", "INTERVAL 2 DAY", f"""{ORDER_CARDS}, {numbered},
      readable AS (SELECT * FROM cards WHERE priority <> '4-NOT SPECIFIED' AND status <> 'P'),
      marked AS (SELECT *, count(*) FILTER (priority = '5-LOW') OVER (
        PARTITION BY c_custkey ORDER BY o_orderkey) AS old FROM readable),
      events AS (SELECT c_custkey * 1000000 + seq AS event_id, {day_of_card} AS ts, '' AS props, c_name AS company,
          n_name AS location, '{base}/jobs/' || o_orderkey AS url,
          CASE WHEN priority = '1-URGENT' THEN 'Urgent' ELSE 'Order ' || o_orderkey END AS title
        FROM marked JOIN numbered USING (o_orderkey) WHERE old = 0), {shown},
      lists AS (SELECT event_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tagged GROUP BY event_id)""")
    sql["link_cycle"] = f"""{kept.rsplit("SELECT", 1)[0]}
      SELECT title, events.company, location, url, epoch(events.ts)::BIGINT AS second, category,
        classification_confidence, coalesce(tags, '') AS tags
      FROM events JOIN fold USING (event_id) JOIN scored USING (event_id) LEFT JOIN lists USING (event_id) WHERE is_new"""
    cats = f"cats(ord, category) AS (VALUES {_categories(DEFAULT_TAXONOMY)})"
    def shares(place: str, which: str) -> str:
        """Category and tag shares of some of the documents."""
        return f"""SELECT {place} 'category' AS kind, category AS label, count(doc_id) AS job_count,
          {_share("count(doc_id)", "any_value(t.n)")}, any_value(t.n) AS total_jobs
        FROM cats LEFT JOIN (SELECT * FROM scored WHERE {which}) USING (category), (SELECT count(*) AS n FROM docs WHERE {which}) t
        GROUP BY category
        UNION ALL SELECT {place} 'tag', tag, count(*), {_share("count(*)", "any_value(t.n)").removesuffix(" AS percentage")}, any_value(t.n)
        FROM tagged, (SELECT count(*) AS n FROM docs WHERE {which}) t WHERE {which} GROUP BY tag"""

    earlier = "doc_id < (SELECT max(doc_id) / 2 FROM documents)"
    sql["summary_files"] = f"WITH {REAL}, {cats} {shares('', 'true')}"
    sql["monthly_and_total_files"] = f"""WITH {REAL}, {cats} {shares("'monthly' AS place,", earlier)}
      UNION ALL {shares("'total' AS place,", "true")}"""
    sql["classify_if_needed"] = f"""WITH {REAL} SELECT doc_id, true AS had_one, 'as given by ' || company AS category FROM docs
      UNION ALL SELECT doc_id, false, category FROM scored"""
    sql["newest_page_by_url"] = """SELECT 'https://jobs.example.com/' || source || '/' || doc_id || '?ref=' || lang AS url,
      n_chars AS posted_time FROM documents ORDER BY posted_time, url LIMIT 10 OFFSET 20"""
    sql["pages_until_empty"] = """WITH clicks AS (
        SELECT event_id, user_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 2 AS BIGINT) AS page
        FROM events WHERE event_type = 'click'),
      numbered AS (SELECT DISTINCT user_id, page, dense_rank() OVER (PARTITION BY user_id ORDER BY page) - 1 AS nth FROM clicks)
      SELECT event_id, user_id, page FROM clicks JOIN numbered USING (user_id, page) WHERE page = nth"""
    sql["loaded_pages"] = """SELECT page_id, CAST(length(html) AS INTEGER) AS length FROM pages
      WHERE page_id % 3 <> 0 AND NOT contains(html, '<meta http-equiv="refresh"')"""
    sql["registered_layout"] = sql["extract_navigation"]
    sql["sql_functions"] = f"""WITH {REAL}, {KEYED_DOCS},
      lists AS (SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tagged GROUP BY doc_id)
      SELECT doc_id, company_key, content_hash, d <> '' AND contains(d, 'the') AND contains(d, 'tion') AS found_all,
        contains(d, 'zw') OR contains(d, 'les') AS found_any,
        CASE WHEN d = '' THEN 0.0::DOUBLE ELSE (contains(d, 'the')::INT + contains(d, 'zw')::INT + contains(d, 'les')::INT
          + contains(d, 'er')::INT)::DOUBLE / 4::DOUBLE END AS score,
        {_share("n_chars", "99991")}, category, classification_confidence AS confidence, coalesce(tags, '') AS tags
      FROM docs JOIN keyed USING (doc_id) JOIN scored USING (doc_id) LEFT JOIN lists USING (doc_id)"""
    return sql
