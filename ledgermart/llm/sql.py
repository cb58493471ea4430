"""DuckDB SQL for the queries that SQL can express, written from the
rules of each query and not from the operators' plans."""

from __future__ import annotations

from ledgermart.llm import license_scan as licenses

_SPACED = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERED = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_LETTERED} AS w FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_LETTERED} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT uid, i, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM (
  SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT uid, i, n, item_id FROM dw JOIN bw USING (n, said)),
words AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY uid),
items AS (SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT uid, item_id FROM hits) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (uid) LEFT JOIN items USING (uid)
"""

OP3 = rf"""
WITH templates(t, label, t_words, win) AS (VALUES {licenses.sql_templates()}),
d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS body, {_LETTERED} AS w FROM documents),
places AS (
  SELECT uid, i - 1 AS pos, CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by'
      WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl'
      WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END AS label
  FROM (SELECT uid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
base AS (SELECT uid, count(*) AS n, min(pos) AS a, max(pos) AS z, list(DISTINCT label) AS ls
         FROM places WHERE label IS NOT NULL GROUP BY uid),
spots AS (SELECT uid, pos, t, word, win, len(t_words) AS size FROM (SELECT uid, i AS pos, w[i] AS word FROM (SELECT uid, w, unnest(range(1, len(w) + 1)) AS i FROM d))
  JOIN (SELECT t, win, t_words, unnest(t_words) AS word FROM templates) USING (word)),
held AS (SELECT a.uid, a.t, count(DISTINCT b.word) / any_value(a.size) AS share FROM spots a JOIN spots b
  ON b.uid = a.uid AND b.t = a.t AND b.pos >= a.pos AND b.pos < a.pos + a.win GROUP BY a.uid, a.t, a.pos),
own AS (SELECT uid, max(share) AS best, list(DISTINCT label) AS ls FROM held JOIN templates USING (t) WHERE share >= {licenses.THRESHOLD} GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base,
  CAST(base.a AS BIGINT) AS first_word, CAST(base.z AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(own.ls, [])))), ',') AS labels,
  CAST(CASE WHEN base.n > 0 THEN 1 ELSE coalesce(own.best, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (uid) LEFT JOIN own USING (uid)
"""

OP7 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<|im_start|>') + length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + 1 + length('<|im_end|>') + 1 + length(regexp_replace(text,
    '([<\[])(\\*)(\|[A-Za-z_]+\|>|/?s>|/?INST\]|<?/?SYS>>)', '\1\2\\\3', 'g'))) AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS body, {_SPACED} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
wins AS (SELECT uid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
         FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT uid, unnest([i, i + 1, i + 2]) AS i FROM wins
          QUALIFY count(*) OVER (PARTITION BY uid, win) > 1),
rep AS (SELECT uid, count(DISTINCT i) AS n FROM twice GROUP BY uid),
lines AS (SELECT uid, host, body, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l,
  len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT uid, host, body, unnest(ls) AS l FROM d)),
hosts AS (SELECT host, count(DISTINCT body) AS host_docs FROM d GROUP BY host),
bad AS (SELECT host, l FROM lines JOIN hosts USING (host) GROUP BY host, l, host_docs
        HAVING count(DISTINCT body) > 20
            OR (0.1 * host_docs <= 20 AND count(DISTINCT body) >= 3 AND count(DISTINCT body) > 0.1 * host_docs)),
lost AS (SELECT uid, count(*) AS n_lines, sum(n) AS n_words FROM lines JOIN bad USING (host, l) GROUP BY uid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(lost.n_lines, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(lost.n_words, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN rep USING (uid) LEFT JOIN lost USING (uid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.8 * n_words AS kept,
  n_removed_lines, n_removed_words FROM m
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(
  {_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
total AS (SELECT count(*) AS docs, sum(len(w)) AS len FROM d WHERE len(w) > 0),
tf AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY uid, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, total GROUP BY term),
m AS (SELECT uid, doc_id, 50 + CAST((50 * len(w) * docs) // len AS BIGINT) AS m FROM d, total WHERE len(w) > 0),
scored AS (SELECT item, any_value(item_id) AS item_id, uid, any_value(doc_id) AS doc_id,
  CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (uid) GROUP BY item, uid)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

ORACLE_SQL = {
    "op1_decontaminate": OP1,
    "op3_license_scan": OP3,
    "op7_chat_format": OP7,
    "op9_line_quality": OP9,
    "op13_ranked_search": OP13,
}
