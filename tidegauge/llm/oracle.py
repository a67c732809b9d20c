"""DuckDB SQL for the training-data queries that SQL can express, each written as a brute-force check of its own."""

from __future__ import annotations

from tidegauge.llm.license_scan import build_index
from tidegauge.llm.url_rules import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_sql() -> str:
    """Every start of every template is tried; the index and its IDF have no part in it."""
    parts = []
    pad = max(len(n.words) for n in build_index())
    for n in build_index():
        at = lambda i: f"coalesce(pw[s + {pad} + {i} + 1] = '{n.words[i]}', false)"  # noqa: B023, E731
        must = " AND ".join(at(i) for i in n.must)
        share = " + ".join(f"{at(i)}::int" for i in range(len(n.words)))
        m = len(n.words)
        parts.append(
            f"list_transform(list_filter(range(-{m}, len(ws)), lambda s: {must}), "
            f"lambda s: {{'label': '{n.label}', 's': s, 'base': {str(n.base).lower()}, 'share': ({share}) / {m}.0}})"
        )
    hits = "flatten([" + ",\n".join(parts) + "])"
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, list_concat(list_transform(range({pad}), lambda x: ''), ws) AS pw FROM w),
h AS (SELECT doc_id, len(ws) AS n, {hits} AS hit FROM p),
b AS (SELECT *, list_filter(hit, lambda x: x.base) AS bs FROM h)
SELECT doc_id, n AS n_words, len(bs) AS n_base,
  list_min(list_transform(bs, lambda x: x.s)) AS first_word, list_max(list_transform(bs, lambda x: x.s)) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(bs, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(hit, lambda x: x.label))), ','), '') AS labels,
  round(coalesce(list_max(list_transform(hit, lambda x: x.share)), 0.0)::double, 6) AS score
FROM b"""


def url_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return rf"""
WITH r(verdict, host, path) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT k, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
x AS (SELECT k, page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
f AS (SELECT x.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC) AS n
      FROM x LEFT JOIN r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1"""


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha1(html) AS digest, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS holder FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < holder THEN holder END AS refers_to FROM d"""

QUALITY_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT k, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
n AS (SELECT k, count(DISTINCT i + j) AS c FROM r, (VALUES (0), (1), (2)) AS v(j) GROUP BY k),
f AS (SELECT w.k, doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, coalesce(n.c, 0) AS n_repeat_words
      FROM w LEFT JOIN n ON w.k = n.k),
a AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
s AS (SELECT *, n_symbols > 0.3 * n_words OR n_dup_lines > 0.3 * greatest(len(ls), 1) AS soft_failed FROM a),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft_failed) AS bad FROM s GROUP BY source),
p AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h),
z AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1e6 END AS s FROM p),
q AS (SELECT source, m, (bad + m * z.s) / (n + z.s) AS rate FROM h, z),
y AS (SELECT source, round(1 + (2.0 - 1) * CASE WHEN rate > 0.5 THEN 0.0 WHEN rate > 0 THEN least(1.0, m / (2 * rate)) ELSE 1.0 END, 9) AS allowed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols > allowed * 0.3 * n_words OR n_dup_lines > allowed * 0.3 * greatest(len(ls), 1)) AS kept
FROM s JOIN y ON s.source IS NOT DISTINCT FROM y.source"""

CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS x(i)),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS safe FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(safe) + length('<|im_end|>') + 1)::bigint AS formatted_chars
FROM e GROUP BY conv_id"""

FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::varchar, '')) AS x,
             regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS ws FROM documents),
h AS (SELECT *, len(ws) AS n, ('0x' || substr(x, 1, 8))::bigint AS h1, ('0x' || substr(x, 9, 8))::bigint AS h2,
        ('0x' || substr(x, 17, 8))::bigint AS h3, ('0x' || substr(x, 25, 8))::bigint AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(ws[1:a], '') AS prefix, array_to_string(ws[a + 1:b], '') AS middle, array_to_string(ws[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLE = {
    "op1_license_scan": license_sql(),
    "op3_url_filter": url_sql(),
    "op5_warc": WARC_SQL,
    "op6_quality_rules": QUALITY_SQL,
    "op7_chat_format": CHAT_SQL,
    "op11_fill_in_middle": FIM_SQL,
}
