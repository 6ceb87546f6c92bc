"""DuckDB SQL for the corpus queries that SQL can express."""

from quillstat.llm.chat_format import CONTROLS

OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
i AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM i),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n_rep FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
s AS (
  SELECT d.doc_id, d.text, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 25 * word_chars OR word_chars > 40 * n_words
            OR 10 * word_chars < 15 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)
            OR 100 * letters < 30 * word_chars) AS kept
FROM b
"""


def _escaped(text: str) -> str:
    out = f"replace({text}, chr(27), chr(27) || 'e')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(27) || 'c' || '{c[1:]}')"
    return out


def _role(role: str) -> str:
    for c, letter in ((None, "e"), ("[", "o"), ("]", "q"), ("<", "l"), (">", "g"), ("|", "p")):
        role = f"replace({role}, {f"'{c}'" if c else 'chr(27)'}, chr(27) || '{letter}')"
    return role


OP2 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(11 + length({_role("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         greatest(0.1::DOUBLE, length(translate(coalesce(text, ''), '#*$%&|<>{}[]=_', ''))::DOUBLE / greatest(1, length(coalesce(text, '')))) AS q,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / q AS key FROM d),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (
  SELECT source, source_size, 3::DOUBLE * source_size AS cap,
         ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM per),
lv AS (
  SELECT *, ((SELECT sum(source_size) FROM w)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
best AS (SELECT level FROM lv WHERE level * weight <= cap ORDER BY cap / weight, level LIMIT 1),
t AS (SELECT lv.source, source_size, least(best.level * weight, cap) AS target FROM lv, best),
e AS (SELECT *, CAST(floor(target / greatest(1, source_size)) AS BIGINT) AS epochs FROM t),
j AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + CASE WHEN size > 0 AND start + size / 2.0::DOUBLE <= rest THEN size ELSE 0 END AS BIGINT) AS taken
FROM j
"""

ORACLE = {"op2_chat_format": OP2, "op6_quality_rules": OP6, "op9_mixing": OP9}
