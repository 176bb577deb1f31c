"""The same results as the registered queries, in SQL over the same tables."""

from __future__ import annotations

from faultscope.functions.rules import (
    ALERT_ADVICE, CRITICAL_PATTERNS, DEFAULT_ADVICE, DEFAULT_HOURS, DEVICE_RULES, FALLBACK_WORDS, FOLDED_EXTRAS,
    MAINTENANCE_HOURS, OTHER_TYPE,
)
from faultscope.functions.text import ENGLISH_STOPS, FRENCH_STOPS
from faultscope.plans.stand_ins import DEVICE_PHRASES, EQUIPMENT, TROUBLE_PHRASES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(_quoted(i) for i in items) + "]"


def _pick(items: list[str], number: str) -> str:
    return f"{_list(items)}[({number}) % {len(items)} + 1]"


def _clean(c: str) -> str:
    ascii_only = f"lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]+', '', 'g'))"
    return f"trim(regexp_replace({ascii_only}, '[^a-z_]+', ' ', 'g'))"


def _language(c: str) -> str:
    words = f"string_split(lower({c}), ' ')"
    return (f"CASE WHEN len(list_intersect({words}, {_list(ENGLISH_STOPS)})) > "
            f"len(list_intersect({words}, {_list(FRENCH_STOPS)})) THEN 'en' ELSE 'fr' END")


def _rules(c: str, rules: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({c}), {_quoted(rf'\b({p})\b')}) THEN {_quoted(n)}" for p, n in rules)
    return f"CASE {cases} ELSE {_quoted(OTHER_TYPE)} END"


def _words(c: str, patterns: list[str]) -> str:
    return f"CAST(regexp_matches({c}, {_quoted(rf'\b({"|".join(patterns)})\b')}) AS INTEGER)"


DEVICE_TEXT = f"p_name || ' ' || {_pick(DEVICE_PHRASES, 'p_partkey')} || ' near ' || {_pick(DEVICE_PHRASES, 'p_size')}"
TROUBLE_TEXT = f"p_name || ' ' || {_pick(TROUBLE_PHRASES, 'p_partkey')}"
ADVICE = "CASE " + " ".join(f"WHEN a LIKE '{p}%' THEN {_quoted(t)}" for p, t in ALERT_ADVICE) + f" ELSE {_quoted(DEFAULT_ADVICE)} END"
HOURS = "CASE equipment " + " ".join(f"WHEN {_quoted(e)} THEN {h}" for e, h in MAINTENANCE_HOURS.items()) + f" ELSE {DEFAULT_HOURS} END"

MIXED = """
SELECT doc_id, CASE WHEN lang = 'en' THEN trim(text, chr(9) || chr(10) || chr(13) || ' ')
                    WHEN lang = 'fr' THEN trim(text, chr(9) || chr(10) || chr(13) || ' ')
                    ELSE concat_ws(' ', source, lang, nullif(trim(text, chr(9) || chr(10) || chr(13) || ' '), ''), nullif(trim(etype), ''), CAST(n_chars AS VARCHAR)) END AS event_text,
       etype, n_chars, lang
FROM (SELECT *, CASE source WHEN 'src0' THEN ' Death' WHEN 'src1' THEN 'INJURY ' WHEN 'src2' THEN 'Malfunction' END AS etype
      FROM documents)"""

NESTED = """
WITH nested AS (
  SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS date_received, o_orderstatus AS event_type,
         list(DISTINCT CASE WHEN l_linestatus <> 'F' THEN p_brand END) AS brands,
         list(DISTINCT p_name) AS generics,
         list(CASE WHEN l_returnflag <> 'N' THEN 'line ' || l_linenumber || ' of ' || p_type || ' returned ' || l_returnflag END) AS remarks
  FROM orders LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey
  GROUP BY ALL),
flat AS (
  SELECT o_orderkey, date_received, event_type,
         coalesce(array_to_string(list_sort(list_filter(brands, lambda b: b IS NOT NULL)), '; '), '') AS brand_name,
         coalesce(array_to_string(list_sort(list_filter(generics, lambda b: b IS NOT NULL)), '; '), '') AS generic_name,
         coalesce(array_to_string(list_sort(list_filter(remarks, lambda b: b IS NOT NULL)), ' '), '') AS event_text
  FROM nested)"""

# A keyword is found in a single name or remark; none of the phrases can span two of them.
FOUND = NESTED + """,
keywords AS (SELECT * FROM (VALUES (0, 'blue bolt'), (1, 'widget'), (2, 'economy')) k(pos, keyword)),
found AS (
  SELECT flat.*, pos, keyword FROM flat JOIN keywords
  ON regexp_matches(lower(brand_name || ' | ' || generic_name || ' | ' || event_text), '\\b' || keyword || '\\b')
  WHERE date_received BETWEEN '19960101' AND '19991231'),
capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY o_orderkey) AS rn FROM found) WHERE rn <= 200)"""

LABELLED = """(SELECT doc_id, text AS event_text, source AS event_type, n_chars, quality AS label
  FROM documents {how} JOIN labels USING (doc_id))"""

GATE = """
SELECT (null_texts = 0 AND bad_labels = 0) AS passed,
       concat_ws('; ', CASE WHEN null_texts > 0 THEN 'null text' END, CASE WHEN bad_labels > 0 THEN 'non-binary label' END) AS failed_checks,
       * FROM (
  SELECT count(*) - count(event_text) AS null_texts,
         count(CASE WHEN label IS NULL OR label NOT IN (0, 1) THEN 1 END) AS bad_labels,
         count(*) - count(DISTINCT event_text) AS dup_texts, {stats} FROM {src})"""
STATS = """count(*) AS n_rows, CAST(min(length(event_text)) AS INTEGER) AS len_min,
         CAST(floor(quantile_cont(length(event_text), 0.5)) AS INTEGER) AS len_p50,
         CAST(floor(quantile_cont(length(event_text), 0.95)) AS INTEGER) AS len_p95,
         CAST(max(length(event_text)) AS INTEGER) AS len_max, round(avg(label), 6) AS label_ratio"""

REPORTS = """(SELECT o_orderkey, o_orderdate AS date_dt, nullif(o_orderstatus, 'P') AS event_type,
  o_orderpriority AS "TypeDetecte" FROM orders)"""

FORECAST = """
WITH monthly AS (SELECT {g} CAST(date_trunc('month', date_dt) AS DATE) AS month, count(*) AS n FROM {src} GROUP BY ALL),
pos AS (SELECT *, row_number() OVER ({part} ORDER BY month) - 1 AS x FROM monthly),
fit AS (SELECT {g} regr_slope(n, x) AS s, regr_intercept(n, x) AS i, max(month) AS last, count(*) AS c FROM pos GROUP BY ALL HAVING count(*) >= 6)
SELECT {g} CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS month, round(greatest(0.0, i + s * (c + step - 1)), 4) AS incidents
FROM fit, (SELECT unnest([1, 2, 3]) AS step)"""

ALL_TERMS = f"""
WITH cleaned AS (SELECT doc_id, list_filter(string_split({_clean('text')}, ' '), lambda w: length(w) >= 2) AS w FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM cleaned),
postings AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocabulary AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf
  FROM postings GROUP BY term {{limit}}),
weights AS (SELECT doc_id, term, tf * idf AS weight FROM postings JOIN vocabulary USING (term))"""
TERMS = ALL_TERMS.format(limit="")
FULL_TERMS = ALL_TERMS.format(limit="HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 20000")

SIMILAR = TERMS + f""",
qclean AS (SELECT item_id, list_filter(string_split({_clean('text')}, ' '), lambda w: length(w) >= 2) AS w FROM benchmark),
qgrams AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM qclean),
qweights AS (SELECT item_id, term, count(*) * any_value(idf) AS weight FROM qgrams JOIN vocabulary USING (term) GROUP BY ALL),
qnorms AS (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM qweights GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY ALL),
dots AS (SELECT item_id, doc_id, sum(q.weight * d.weight) AS dot FROM qweights q JOIN weights d USING (term) GROUP BY ALL),
sims AS (SELECT item_id, doc_id, round(dot / (q.norm * d.norm), 9) AS similarity
         FROM dots JOIN qnorms q USING (item_id) JOIN norms d USING (doc_id)),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank, doc_id, similarity FROM sims)"""

SCORED = """(SELECT doc_id, quality AS label, least(1.0, floor(n_chars / 50) / 64.0) AS proba,
  CAST(least(1.0, floor(n_chars / 50) / 64.0) >= 0.5 AS INTEGER) AS pred FROM documents JOIN labels USING (doc_id))"""
CURVE = f"""
WITH g AS (SELECT proba, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label <> 1 THEN 1 END) AS neg FROM {SCORED} GROUP BY proba),
t AS (SELECT *, sum(pos) OVER (ORDER BY proba DESC) AS tp, sum(neg) OVER (ORDER BY proba DESC) AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n,
             lead(pos) OVER (ORDER BY proba DESC) AS next_pos, lead(neg) OVER (ORDER BY proba DESC) AS next_neg,
             row_number() OVER (ORDER BY proba DESC) AS rn FROM g)"""
METRICS = CURVE + """
SELECT round((sum(CASE WHEN proba >= 0.5 THEN pos ELSE neg END)) / sum(pos + neg), 6) AS accuracy,
       round(2.0 * sum(CASE WHEN proba >= 0.5 THEN pos ELSE 0 END)
             / (sum(pos) + sum(CASE WHEN proba >= 0.5 THEN pos + neg ELSE 0 END)), 6) AS f1,
       round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
       CAST(sum(pos + neg) AS BIGINT) AS n_samples FROM t"""
REPORT = f"""
WITH c AS (SELECT k, count(CASE WHEN label = k AND pred = k THEN 1 END) AS tp, count(CASE WHEN pred = k THEN 1 END) AS said,
                  count(CASE WHEN label = k THEN 1 END) AS support, count(*) AS n FROM {SCORED}, (VALUES (0), (1)) v(k) GROUP BY k),
m AS (SELECT CAST(k AS VARCHAR) AS class, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
             coalesce(2 * tp / nullif(said + support, 0), 0) AS f1, support, n, tp FROM c),
a AS (
  SELECT class, precision, recall, f1, support FROM m UNION ALL
  SELECT 'accuracy', sum(tp) / max(n), sum(tp) / max(n), sum(tp) / max(n), max(n) FROM m UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), max(n) FROM m UNION ALL
  SELECT 'weighted avg', sum(precision * support) / max(n), sum(recall * support) / max(n), sum(f1 * support) / max(n), max(n) FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM a"""

_STRIPPED = r"""regexp_replace(regexp_replace({c}, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
  '<[!/a-zA-Z][^>]*>', ' ', 'g')"""
_DECODED = _STRIPPED
for _entity, _char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_char}')"
HTML = "trim(regexp_replace(" + _DECODED + r", '[ \t\r\n]+', ' ', 'g'))"

STORED = """(SELECT strftime(to_timestamp(1704067200 + conv_id * 100 + turn) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts,
  CASE WHEN role = 'user' THEN 'input' ELSE 'doc' END AS source,
  CASE WHEN role <> 'user' THEN 'Case_' || conv_id || '_' || turn END AS file_name,
  text AS input_text, 'TFIDF' AS model_type,
  CASE WHEN length(text) >= 200 THEN 'Critique' ELSE 'Pas critique' END AS label,
  (length(text) % 1000) / 1000.0 AS proba, CASE WHEN turn > 0 THEN 'Autre' END AS detected_type, 'fr' AS src_lang,
  CAST(turn = 1 AS INTEGER) AS translated,
  CASE WHEN turn < 2 THEN '[[' || CAST(to_json(string_split(text, ' ')[1]) AS VARCHAR) || ', 62.5], ["été", 37.5]]' ELSE '[]' END AS top_keywords,
  string_split(text, ' ')[1] AS first_word, turn FROM conversations)"""
HISTORY_COLUMNS = "ts, source, file_name, model_type, label, proba, detected_type, src_lang, translated, top_keywords"


def _split(table: str, row_id: str, group: str | None) -> str:
    n = "count(*) OVER ()"
    rank = f"row_number() OVER (PARTITION BY {group or 1} ORDER BY md5('42:' || {row_id}))"
    if group is None:
        return f"SELECT {row_id}, CAST({rank} <= CAST(ceil(round({n} * 0.2, 9)) AS BIGINT) AS INTEGER) AS is_test FROM {table}"
    return f"""
WITH c AS (SELECT {group} AS g, count(*) AS n, sum(count(*)) OVER () AS total FROM {table} GROUP BY {group}),
e AS (SELECT *, total - CAST(ceil(round(total * 0.2, 9)) AS BIGINT) AS n_train,
             (total - CAST(ceil(round(total * 0.2, 9)) AS BIGINT)) * n / total AS exact FROM c),
s AS (SELECT *, floor(exact) + CAST(row_number() OVER (ORDER BY exact - floor(exact) DESC, CAST(g AS VARCHAR))
             <= n_train - sum(floor(exact)) OVER () AS INTEGER) AS train FROM e)
SELECT {row_id}, CAST({rank} <= n - train AS INTEGER) AS is_test FROM {table} JOIN s ON {group} = g"""


EXPECTED = {
    "low_quality_by_language": f"""
SELECT {_language('text')} AS guessed, count(*) AS n_docs, count(CASE WHEN quality = 0 THEN 1 END) AS n_low,
       round(avg(CASE WHEN quality = 0 THEN 1 ELSE 0 END), 6) AS low_share
FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "clean_text_profile": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "plain_lower": "SELECT doc_id, lower(text) AS lowered FROM documents",
    "lang_guess_matrix": f"SELECT lang, {_language('text')} AS guessed, count(*) AS n FROM documents GROUP BY 1, 2",
    "translation_policy": f"""
SELECT doc_id, src_lang, CAST(model_text <> text AS INTEGER) AS translated, model_text FROM (
  SELECT *, CASE WHEN src_lang = 'en' THEN replace(text, ' the ', ' le ') ELSE text END AS model_text FROM (
    SELECT doc_id, text, {_language('text')} AS src_lang FROM documents))""",
    "clipped_text": "SELECT doc_id, substring(trim(text, chr(9) || chr(10) || chr(13) || ' '), 1, 2000) AS clipped FROM documents",
    "device_type_first": f"SELECT p_partkey, {_rules(DEVICE_TEXT, DEVICE_RULES)} AS device_type FROM part",
    "device_type_last": f"SELECT p_partkey, {_rules(DEVICE_TEXT, DEVICE_RULES[::-1])} AS device_type FROM part",
    "device_type_counts": f"SELECT {_rules(DEVICE_TEXT, DEVICE_RULES[::-1])} AS value, count(*) AS n FROM part GROUP BY 1",
    "critical_word_label": f"""
SELECT p_partkey, {_words('c', CRITICAL_PATTERNS)} AS label, {_words('c', CRITICAL_PATTERNS + FOLDED_EXTRAS)} AS label_folded
FROM (SELECT p_partkey, {_clean(TROUBLE_TEXT)} AS c FROM part)""",
    "fallback_word_label": f"SELECT p_partkey, {_words(f'lower({TROUBLE_TEXT})', [FALLBACK_WORDS])} AS label FROM part",
    "event_type_label": """
SELECT ' ' || upper(event_type) AS event_type, CAST(event_type = 'error' AS INTEGER) AS label, count(*) AS n FROM events GROUP BY 1, 2""",
    "recommendation": f"""
SELECT a AS "Alerte", {ADVICE} AS "Recommandation", count(*) AS n FROM (
  SELECT CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Critique ' WHEN '2' THEN 'Modérée ' WHEN '3' THEN 'Faible ' END
         || o_orderpriority AS a FROM orders) GROUP BY 1, 2""",
    "maintenance_interval": f"SELECT *, {HOURS} AS hours FROM (SELECT p_partkey, {_pick(EQUIPMENT, 'p_partkey')} AS equipment FROM part)",
    "first_non_blank": f"SELECT doc_id, event_text FROM ({MIXED})",
    "processed_table": f"""
SELECT event_text || CASE WHEN lang IN ('en', 'fr') THEN '' ELSE ' ' || n_chars END AS event_text,
       CAST(coalesce(lower(trim(etype)) IN ('death', 'injury'), false) AS INTEGER) AS label, etype AS event_type,
       CAST(n_chars AS VARCHAR) AS date_received FROM ({MIXED})""",
    "legacy_table": f"""
SELECT '20240101' AS date_received, lang AS event_type, source AS brand_name, '' AS generic_name, text, text_clean,
       {_words('text_clean', CRITICAL_PATTERNS)} AS label_critique FROM (SELECT *, {_clean('text')} AS text_clean FROM documents)""",
    "flatten_events": NESTED + " SELECT * FROM flat",
    "keyword_hits": FOUND + " SELECT keyword, event_type, count(*) AS n FROM found GROUP BY 1, 2",
    "keyword_capped": FOUND + " SELECT keyword, o_orderkey FROM capped",
    "incident_collection": FOUND + """
SELECT date_received, event_type, brand_name, generic_name, event_text FROM (
  SELECT *, row_number() OVER (PARTITION BY date_received, brand_name, generic_name, event_text ORDER BY pos, o_orderkey) AS k
  FROM capped WHERE event_text <> '') WHERE k = 1""",
    "dedup_first": """
SELECT doc_id, lang AS date_received, source, CAST(length(text) AS INTEGER) AS chars FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS k FROM documents WHERE text <> '') WHERE k = 1""",
    "enriched_table": f"""
SELECT p_partkey, {_rules("p_brand || ' ' || " + DEVICE_TEXT, DEVICE_RULES[::-1])} AS "TypeDetecte", {ADVICE} AS "Recommandation",
       CAST(DATE '2020-01-01' + CAST(p_partkey % 700 AS INTEGER) AS DATE) AS date_dt
FROM (SELECT *, CASE WHEN p_brand LIKE '%1' THEN 'Critique' ELSE 'Faible' END AS a FROM part)""",
    "quality_counts": f"""
SELECT count(*) AS n_rows, 3 AS n_cols, count(*) - count(DISTINCT (event_text, event_type, label)) AS dup_rows,
       count(*) - count(event_text) AS nulls_event_text, count(*) - count(event_type) AS nulls_event_type, count(*) - count(label) AS nulls_label
FROM {LABELLED.format(how='LEFT')}""",
    "class_balance": f"SELECT label, count(*) AS n FROM {LABELLED.format(how='LEFT')} GROUP BY 1",
    "quality_report": f"""
WITH d AS (SELECT event_text, event_type, label FROM {LABELLED.format(how='LEFT')})
SELECT 'rows' AS section, CAST(NULL AS VARCHAR) AS item, count(*) AS n FROM d
UNION ALL SELECT 'cols', NULL, 3
UNION ALL SELECT 'dup_rows', NULL, count(*) - count(DISTINCT (event_text, event_type, label)) FROM d
UNION ALL SELECT 'nulls_by_col', 'event_text', count(*) - count(event_text) FROM d
UNION ALL SELECT 'nulls_by_col', 'event_type', count(*) - count(event_type) FROM d
UNION ALL SELECT 'nulls_by_col', 'label', count(*) - count(label) FROM d
UNION ALL SELECT 'class_balance', CAST(label AS VARCHAR), count(*) FROM d GROUP BY label
UNION ALL SELECT * FROM (SELECT 'top_event_type', event_type, count(*) FROM d WHERE event_type IS NOT NULL
                         GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 10)""",
    "dataset_fingerprint": """
SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substring(md5(concat_ws(chr(31), coalesce('=' || doc_id, '-'), coalesce('=' || text, '-'),
  coalesce('=' || lang, '-'), coalesce('=' || source, '-'), coalesce('=' || n_chars, '-'))), 1, 15) AS BIGINT)) AS VARCHAR) AS checksum
FROM documents""",
    "dataset_gate": GATE.format(src=LABELLED.format(how="LEFT"), stats=STATS),
    "dataset_gate_labelled": GATE.format(src=LABELLED.format(how=""), stats=STATS),
    "length_stats": f"SELECT {STATS} FROM {LABELLED.format(how='LEFT')}",
    "monthly_counts": f"SELECT event_type, CAST(date_trunc('month', date_dt) AS DATE) AS month, count(*) AS incidents FROM {REPORTS} GROUP BY 1, 2",
    "monthly_counts_of_type": f"""
SELECT CAST(date_trunc('month', date_dt) AS DATE) AS month, count(*) AS incidents FROM {REPORTS}
WHERE "TypeDetecte" = '1-URGENT' AND event_type IS NOT NULL GROUP BY 1""",
    "severity_filter": f"""
SELECT 'default' AS kind, count(*) AS n_reports, strftime(max(date_dt), '%Y-%m-%d') AS last_date FROM {REPORTS} WHERE event_type IS NOT NULL
UNION ALL SELECT 'none', count(*), strftime(max(date_dt), '%Y-%m-%d') FROM {REPORTS}
UNION ALL SELECT 'open', count(*), strftime(max(date_dt), '%Y-%m-%d') FROM {REPORTS} WHERE event_type = 'O'""",
    "top_values_with_missing": """
SELECT coalesce(nullif(event_type, 'signup'), 'nan') AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 12""",
    "top_values_present": "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1 ORDER BY n DESC, value LIMIT 3",
    "facet_values": f"SELECT DISTINCT event_type FROM {REPORTS} WHERE event_type IS NOT NULL",
    "kpis": f'SELECT "TypeDetecte", count(*) AS n_reports, strftime(max(date_dt), \'%Y-%m-%d\') AS last_date FROM {REPORTS} GROUP BY 1',
    "forecast_by_status": FORECAST.format(g="event_type,", src=REPORTS, part="PARTITION BY event_type"),
    "forecast_total": FORECAST.format(g="", src=REPORTS, part=""),
    "date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 5 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders",
    "preview": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000",
    "stratified_split": _split("labels", "doc_id", "quality"),
    "plain_split": _split("orders", "o_orderkey", None),
    "training_sample": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY md5('42:' || o_orderkey) LIMIT 4000",
    "term_vocabulary": FULL_TERMS + " SELECT term, df, cf, round(idf, 6) AS idf FROM vocabulary",
    "whole_vocabulary": TERMS + " SELECT term, df, cf, round(idf, 6) AS idf FROM vocabulary",
    "document_norms": TERMS + " SELECT doc_id, count(*) AS n_terms, round(sqrt(sum(weight * weight)), 5) AS norm FROM weights GROUP BY 1",
    "tfidf_keywords": TERMS + """,
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM weights)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, term AS word, round(100 * weight / sum(weight) OVER (PARTITION BY doc_id), 1) AS pct FROM top WHERE rank <= 15""",
    "similar_cases": SIMILAR + " SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(similarity, 5) AS similarity FROM ranked WHERE rank <= 10",
    "kept_case_search": SIMILAR + " SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(similarity, 5) AS similarity FROM ranked WHERE rank <= 10",
    "case_fill": """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
grams AS (SELECT p_partkey, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM part)) / (1 + count(DISTINCT p_partkey))) + 1 AS idf FROM grams GROUP BY term),
weights AS (SELECT p_partkey, term, count(*) * any_value(idf) AS weight FROM grams JOIN idf USING (term) GROUP BY ALL),
norms AS (SELECT p_partkey, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY ALL),
asked AS (SELECT DISTINCT p_type AS kind FROM part WHERE lower(p_type) IN (SELECT term FROM idf)),
sims AS (SELECT kind, p.p_partkey, coalesce(round(weight / norm, 9), 0) AS similarity
         FROM asked CROSS JOIN part p LEFT JOIN weights x ON x.p_partkey = p.p_partkey AND term = lower(kind) LEFT JOIN norms n ON n.p_partkey = p.p_partkey)
SELECT kind, CAST(row_number() OVER w AS INTEGER) AS rank, p_partkey, round(similarity, 5) AS similarity FROM sims
WINDOW w AS (PARTITION BY kind ORDER BY similarity DESC, p_partkey) QUALIFY row_number() OVER w <= 400""",
    "similar_case_view": SIMILAR + """
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(100 * similarity, 1) AS similarity_pct, source AS date, lang AS detected_type,
       CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS excerpt
FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5""",
    "score_metrics": METRICS,
    "decision_and_confidence": f"""
SELECT doc_id, CASE WHEN proba >= 0.5 THEN 'Critique' ELSE 'Pas critique' END AS decision,
       CASE WHEN proba >= 0.25 THEN 'Critique' ELSE 'Pas critique' END AS strict_decision, round(100 * proba, 1) AS confidence FROM {SCORED}""",
    "metrics_record": METRICS,
    "confusion": f"""
SELECT t.k AS label, p.k AS pred, count(doc_id) AS n FROM (VALUES (0), (1)) t(k), (VALUES (0), (1)) p(k)
LEFT JOIN {SCORED} s ON s.label = t.k AND s.pred = p.k GROUP BY 1, 2""",
    "roc_points": CURVE + " SELECT round(proba, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM t UNION ALL SELECT NULL, 0.0, 0.0",
    "roc_points_plotted": CURVE + """
SELECT round(proba, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM t
WHERE rn = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg
UNION ALL SELECT NULL, 0.0, 0.0""",
    "pr_points": CURVE + """
SELECT round(proba, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM t
UNION ALL SELECT NULL, 1.0, 0.0""",
    "class_report": REPORT,
    "html_text": f"SELECT page_id, {HTML.format(c='html')} AS text FROM pages",
    "file_text": f"""
SELECT 'page_' || page_id || '.HTML' AS name, {HTML.format(c='html')} AS text FROM pages
UNION ALL SELECT 'event_' || event_id || '.json', '{{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}}' FROM events
UNION ALL SELECT 'order_' || l_orderkey || '.csv', string_agg(l_linenumber || ' ' || l_returnflag || ' ok ' || CAST(l_quantity AS VARCHAR), chr(10)
    ORDER BY l_linenumber || ',"' || l_returnflag || ' ok",' || CAST(l_quantity AS VARCHAR)) FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'turn_' || conv_id || '_' || turn || '.docx', text FROM conversations
UNION ALL SELECT 'note_' || doc_id || '.txt', text FROM documents
UNION ALL SELECT 'scan_' || item_id || '.png', '' FROM benchmark""",
    "unreadable_trace": """
SELECT event_id, CASE WHEN event_type = 'click' THEN props
  ELSE '(binaire) ' || base64(unhex(regexp_replace(printf('%X', event_id), '(.)', 'F\\1', 'g'))) || '…' END AS text FROM events""",
    "history_recent": f"SELECT {HISTORY_COLUMNS} FROM {STORED} ORDER BY ts DESC LIMIT 200",
    "history_search": f"""
SELECT {HISTORY_COLUMNS} FROM {STORED} WHERE lower(coalesce(file_name, '')) LIKE '%case_1%_1%' OR lower(input_text) LIKE '%case_1%_1%'
ORDER BY ts DESC LIMIT 1000""",
    "history_view": f"""
SELECT ts, source, coalesce(file_name, '') AS file_name, model_type, label, round(proba, 3) AS proba,
       coalesce(detected_type, '') AS detected_type, src_lang, CASE WHEN translated = 1 THEN 'Oui' ELSE 'Non' END AS translated,
       CASE WHEN turn < 2 THEN first_word || ' (62.5%), été (37.5%)' ELSE '' END AS top_keywords
FROM {STORED} ORDER BY ts DESC LIMIT 1000""",
    "csv_round_trip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "kept_table": "SELECT p_partkey, p_name FROM part",
    "report_documents": f"""
SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_cols, count(*) - count(DISTINCT (event_text, event_type, label)) AS dup_rows
FROM {LABELLED.format(how='LEFT')}""",
    "event_archive_round_trip": NESTED + """
SELECT date_received, event_type, count(*) AS n, CAST(sum(length(event_text)) AS BIGINT) AS chars,
       CAST(sum(length(brand_name)) AS BIGINT) AS brand_chars FROM flat GROUP BY 1, 2""",
    "stream_dedup": "SELECT event_id, user_id, event_type FROM events",
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS incidents FROM events GROUP BY 1, 2",
    "stream_monthly_counts": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, count(*) AS incidents FROM orders GROUP BY 1, 2",
}
