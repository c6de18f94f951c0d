"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rateline.llm.quality_rules import STOP_WORDS

SQL: dict[str, str] = {}

SQL["op2_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
)
SELECT query_id,
       (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id, score
FROM scored
QUALIFY rank <= 5
"""

_BLANK = r"[\x20\x09-\x0D]"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL["op5_quality_rules"] = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1),
           lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g
  FROM t
), counted AS (
  SELECT *, list_filter(map_entries(list_histogram(g)), lambda e: e.value > 1) AS often FROM grams
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '{_BLANK}+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines)::BIGINT AS n_lines,
    (CASE WHEN len(often) = 0 THEN 0 ELSE len(list_distinct(flatten(list_transform(
        list_filter(range(1, len(w) - 1), lambda i: list_contains(list_transform(often, lambda e: e.key), g[i])),
        lambda i: [i, i + 1, i + 2])))) END)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words
  FROM counted
), f AS (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
  NOT base_failed AND n_words <= 1000000 AND word_chars * 10 BETWEEN 20 * n_words AND 150 * n_words
    AND n_symbols * 100 <= 10 * n_words AND n_stop_words * 100 >= 2 * n_words
    AND n_dup_lines * 100 <= 50 * n_lines AS kept
FROM f
"""

SQL["op10_url_filter"] = r"""
WITH p AS (
  SELECT page_id,
    lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '://[^?#]*\?([^#]*)', 1) AS query
  FROM pages
), c AS (
  SELECT *, list_aggregate(list_sort(list_filter(string_split(query, '&'), lambda x: x <> ''
      AND NOT starts_with(x, 'utm_')
      AND split_part(x, '=', 1) NOT IN ('ref', 'fbclid', 'gclid'))), 'string_agg', '&') AS kept
  FROM p
), k AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\.', '')
      || regexp_replace(path, '/+$', '')
      || CASE WHEN coalesce(kept, '') = '' THEN '' ELSE '?' || kept END END AS canonical
  FROM c
), listed AS (
  SELECT DISTINCT canonical FROM k
  WHERE canonical <> '' AND list_has_any(string_split(host, '.'),
    ['ads-track', 'spam-farm', 'casino-win', 'adult-x', 'cheap-pills', 'free-bets'])
), r AS (
  SELECT k.*, l.canonical IS NOT NULL AS listed,
    CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM k LEFT JOIN listed l ON k.canonical = l.canonical
)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(text, '') AS text
  FROM documents
), w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+')) AS term
  FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
    (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
    (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
  QUALIFY rank <= 10
)
SELECT * FROM ranked
"""

SQL["op12_content_sort"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  coalesce(doc_id = max(doc_id) OVER same, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _vector_codes(parts: int, rounds: int, entries: int) -> str:
    """Assignments and means in turn, a step a round."""
    nearest = """
  SELECT u.vec_id, u.label, u.part, u.x, arg_min(b.entry, d.value * {n} + b.entry) AS entry, min(d.value) AS error
  FROM u JOIN {books} b ON b.part = u.part,
    LATERAL (SELECT list_sum(list_transform(list_zip(u.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS value) d
  GROUP BY u.vec_id, u.label, u.part, u.x"""
    means = """
  SELECT part, entry, list(m ORDER BY place) AS x FROM (
    SELECT part, entry, place, floor(sum(v) / count(*))::BIGINT AS m FROM (
      SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{r}) GROUP BY ALL) GROUP BY ALL
  UNION ALL
  SELECT b.part, b.entry, b.x FROM b{r} b WHERE NOT EXISTS (
    SELECT 1 FROM a{r} a WHERE a.part = b.part AND a.entry = b.entry)"""
    steps = [f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT vec_id, label, p AS part, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x
  FROM v, range({parts}) r(p)
), seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {entries}),
b0 AS (SELECT u.part, s.entry, u.x FROM u JOIN seeds s USING (vec_id))"""]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(n=entries, books=f'b{r}')})")
        steps.append(f"b{r + 1} AS MATERIALIZED ({means.format(r=r)})")
    steps.append(f"coded AS ({nearest.format(n=entries, books=f'b{rounds}')})")
    steps.append("""each AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
  FROM coded GROUP BY vec_id, label
)""")
    return ", ".join(steps) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM each
"""


SQL["op13_vector_codes"] = _vector_codes(16, 2, 64)
