"""DuckDB SQL for the registered queries that SQL can state."""

from html import unescape
from html.entities import html5

OP4 = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i AS pos, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS win
  FROM words, unnest(range(1, len(w) - 18)) AS t(i) WHERE len(w) >= 20
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(0, 20) AS t(k)
), lost AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id
)
SELECT words.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(list_aggregate(CASE WHEN gone IS NULL THEN w ELSE
    [x[1] FOR x IN list_zip(w, range(1, len(w) + 1)) IF NOT list_contains(gone, x[2])] END, 'string_agg', ' '), '')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v AS q, v AS c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""



def _rake_sql(sweeps: int = 8, temperature: float = 0.9) -> str:
    """Raking unrolled: one step for each margin of each sweep."""
    parts = ["""described AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN regexp_matches(t, '[lL]icense|[cC]opyright|rights reserved') THEN 'legal'
      WHEN regexp_matches(t, 'https?://|password|token =|@') THEN 'technical'
      WHEN regexp_matches(t, ' \\| |\\t') THEN 'tabular' ELSE 'general' END AS topic,
    len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM described GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for m in ("source", "lang", "topic"):
        parts.append(f"p_{m} AS (SELECT {m}, pow(sum(n) / (SELECT sum(n) FROM cells), {temperature}) AS p FROM cells GROUP BY {m})")
        parts.append(f"t_{m} AS (SELECT {m}, p / (SELECT sum(p) FROM p_{m}) AS target FROM p_{m})")
    parts.append("w0 AS MATERIALIZED (SELECT *, n AS w FROM cells)")
    step = 0
    for _ in range(sweeps):
        for m in ("source", "lang", "topic"):
            parts.append(f"w{step + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (w), w * target / sum(w) OVER (PARTITION BY {m}) AS w FROM w{step} AS a JOIN t_{m} USING ({m}))")
            step += 1
    return f"""
WITH {", ".join(parts)}, done AS (SELECT *, w / n / (SELECT max(w / n) FROM w{step}) AS p FROM w{step})
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(w, 0), 9) AS weight, round(coalesce(p, 1.0), 9) AS probability,
  ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < coalesce(p, 1.0) AS kept
FROM described AS d LEFT JOIN done USING (source, lang, topic)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _map_sql(of: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{_quoted(k)}: {_quoted(v)}' for k, v in of.items())}}}"


#: Character references: by name with semicolon, by name without, and numbers that do not stand for themselves.
_NAMES = {k: v for k, v in html5.items() if k.endswith(";")}
_SHORT_NAMES = {k: v for k, v in html5.items() if not k.endswith(";")}
_NUMBERS = {str(n): unescape(f"&#{n};") for n in (*range(160), *range(0xFDD0, 0xFDF0), *(0x10000 * p + e for p in range(17) for e in (0xFFFE, 0xFFFF))) if unescape(f"&#{n};") != chr(n)}


def _decoded_sql(text: str) -> str:
    """Pieces after each ampersand, each beginning with a reference or not."""
    number = "regexp_extract(p, '^#([0-9]+|[xX][0-9a-fA-F]+)', 1)"
    digits = f"regexp_extract({number}, '^[xX]?0*([0-9a-fA-F]*)$', 1)"
    code = (f"CASE WHEN length({digits}) > 7 THEN 1114112 WHEN {digits} = '' THEN 0 WHEN lower({number}[1]) = 'x' THEN ('0x' || {digits})::BIGINT ELSE {digits}::BIGINT END")
    character = (f"coalesce(numbers[({code})::VARCHAR], CASE WHEN {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533) ELSE chr(({code})::INTEGER) END)")
    short = f"regexp_extract(p, '^({'|'.join(sorted(_SHORT_NAMES, key=lambda k: (-len(k), k)))})')"
    named = "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')"
    piece = f"""CASE WHEN i = 1 THEN p
      WHEN {number} <> '' THEN {character} || regexp_replace(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '')
      WHEN names[{named}] IS NOT NULL THEN names[{named}] || substr(p, length({named}) + 1)
      WHEN {short} <> '' THEN short_names[{short}] || substr(p, length({short}) + 1)
      ELSE '&' || p END"""
    return f"replace(array_to_string(list_transform(string_split({text}, '&'), lambda p, i: {piece}), ''), chr(160), ' ')"


_IN_TAG = r"""[^>=]*(?:=[ \t\n\r\f]*(?:"[^"]*(?:"|\z)|''[^'']*(?:''|\z))?[^>=]*)*"""


def _tag_sql(name: str) -> str:
    return rf"(?:{name})(?:[ \t\n\r\f/]{_IN_TAG})?(?:>|\z)"


_LINE_TAGS = "p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|thead|tbody|article|section|nav|header|footer|main|aside|form|blockquote|pre|title|head|body|html"


def _text_sql(shown: str) -> str:
    lines = rf"regexp_replace({shown}, '(?is)</?{_tag_sql(_LINE_TAGS)}', chr(10), 'g')"
    bare = rf"regexp_replace({lines}, '(?s)</?[A-Za-z]{_IN_TAG}(?:>|\z)|<[!?/][^>]*(?:>|\z)', '', 'g')"
    spaced = rf"regexp_replace({_decoded_sql(bare)}, '[ \t\r\f\x0B]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({spaced}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '')"


def _attribute_sql(tag: str, name: str) -> str:
    pattern = r"""([^ \t\n\r\f"''>/=]+)(?:[ \t\n\r\f]*=[ \t\n\r\f]*("[^"]*"|''[^'']*''|[^ \t\n\r\f"''>][^ \t\n\r\f>]*))?"""
    pairs = f"list_zip(regexp_extract_all({tag}, '{pattern}', 1), list_transform(regexp_extract_all({tag}, '{pattern}', 2), lambda v: coalesce(v, '')))"
    value = f"list_filter({pairs}, lambda a: lower(a[1]) = '{name}' AND a[2] <> '')[1][2]"
    return rf"""regexp_replace(regexp_replace({value}, '^["'']|["'']$', '', 'g'), '[\r\n]+', ' ', 'g')"""


def _uuid_sql(parts: str) -> str:
    return f"regexp_replace(md5({parts}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"


OP9 = rf"""
WITH tables AS MATERIALIZED (SELECT {_map_sql(_NAMES)} AS names, {_map_sql(_SHORT_NAMES)} AS short_names, {_map_sql(_NUMBERS)} AS numbers
), r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS source_payload_digest FROM pages
), s AS MATERIALIZED (
  SELECT *, {_uuid_sql("concat_ws(chr(10), 'response', coalesce(page_id::VARCHAR, ''), target_uri, source_payload_digest)")} AS refers_to,
    regexp_replace(payload, '(?is)<!--.*?(?:-->|\z)|<script[ \t\n\r\f/>].*?(?:</script[ \t\n\r\f]*(?:>|\z)|\z)|<style[ \t\n\r\f/>].*?(?:</style[ \t\n\r\f]*(?:>|\z)|\z)', '', 'g') AS shown
  FROM r
), t AS MATERIALIZED (
  SELECT *, regexp_extract(shown, '(?is)<{_tag_sql("title")}(.*?)(?:</title[ \t\n\r\f]*(?:>|\z)|\z)', 1) AS title,
    coalesce(list_filter(list_transform(list_filter(tags, lambda g: regexp_matches(g, '(?i)^<html[ \t\n\r\f/]')), lambda g: {_attribute_sql("g", "lang")}), lambda x: x IS NOT NULL)[1], '') AS lang,
    list_filter(list_transform(list_filter(tags, lambda g: regexp_matches(g, '(?i)^<a[ \t\n\r\f/]')), lambda g: {_attribute_sql("g", "href")}), lambda x: x IS NOT NULL) AS links
  FROM (SELECT *, regexp_extract_all(shown, '(?s)</?[A-Za-z]{_IN_TAG}(?:>|\z)|<[!?/][^>]*(?:>|\z)') AS tags FROM s)
), d AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || {_text_sql("title")} || chr(13) || chr(10) || 'language: ' || lang || chr(13) || chr(10) || 'payload-length: ' || strlen(payload) || chr(13) || chr(10)
    || array_to_string(list_transform(links, lambda x: 'outlink: ' || x || chr(13) || chr(10)), '') AS block
  FROM t, tables
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {_text_sql("shown")} FROM t, tables
)
SELECT page_id, record_type, {_uuid_sql("record_type || chr(10) || refers_to")} AS record_id, refers_to, target_uri, source_payload_digest, content_type,
  strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, block FROM d
"""

OP11 = r"""
WITH RECURSIVE steps AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) AS r(i))
), runs AS (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS word
    FROM documents) GROUP BY ALL HAVING length(word) >= 6
), hashed AS (
  SELECT word, n, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || word, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195, ord(x)::BIGINT - 64] END)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h
  FROM runs, steps
), written AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM hashed
), v AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), shorter AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM v, unnest(range(1, length(word) + 1)) AS r(i)
), pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM shorter AS a JOIN shorter AS b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter AS a JOIN v AS b ON a.less = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter AS a JOIN v AS b ON a.less = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word, n
), forms AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN top END AS form_n,
    CASE WHEN top >= 5 * v.n THEN (SELECT min(other) FROM pairs AS p WHERE p.word = v.word AND p.other_n = top) END AS form
  FROM v LEFT JOIN best ON v.word = best.word
), followed AS (
  SELECT word, word AS place, 0 AS step FROM forms
  UNION ALL SELECT followed.word, form, step + 1 FROM followed JOIN forms ON place = forms.word WHERE form IS NOT NULL
), last AS (SELECT word, arg_max(place, step) AS root FROM followed GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN last USING (word)
"""

EXPECTED = {
    "op4_substring_dedup": OP4,
    "op5_metric_tree_top_k": OP5,
    "op7_mixing": _rake_sql(),
    "op9_warc_derivatives": OP9,
    "op11_spelling_variants": OP11,
}
