"""DuckDB SQL for the operators of this folder that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# crc32 of a decimal number, bit by bit: the polynomial is a fixed value.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
  string_split({x}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b:
  list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i:
    CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)),
  4294967295::BIGINT)"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC.format(x="doc_id")} % 2 = 0
              THEN {_leaf("replace(text, chr(10), '')")} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree(source, height, k, h, n) AS (
  SELECT source, 0::BIGINT, rank, leaf, n FROM placed
  UNION ALL
  SELECT source, height + 1, k // 3, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 2) // 3
  FROM tree WHERE n > 1 GROUP BY source, height, k // 3),
subroots AS (
  SELECT source, height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank,
         count(*) OVER () AS n FROM tree WHERE n = 1),
top(height, k, h, n) AS (
  SELECT 0::BIGINT, rank, h, n FROM subroots
  UNION ALL
  SELECT height + 1, k // 3, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY height, k // 3),
climbed(source, rank, k, height) AS (
  SELECT source, rank, rank, 0::BIGINT FROM placed
  UNION ALL
  SELECT c.source, c.rank, c.k // 3, c.height + 1 FROM climbed c
  JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source WHERE c.height < s.height),
climbed_top(source, k, height) AS (
  SELECT source, rank, 0::BIGINT FROM subroots
  UNION ALL
  SELECT source, k // 3, height + 1 FROM climbed_top
  WHERE height < (SELECT max(height) FROM top)),
steps AS (
  SELECT c.source, c.rank, c.height AS step,
         coalesce(string_agg(t.h, '' ORDER BY t.k) FILTER (t.k < c.k), '') AS before,
         coalesce(string_agg(t.h, '' ORDER BY t.k) FILTER (t.k > c.k), '') AS after
  FROM climbed c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source
  JOIN tree t ON t.source IS NOT DISTINCT FROM c.source AND t.height = c.height
    AND t.k // 3 = c.k // 3
  WHERE c.height < s.height GROUP BY ALL
  UNION ALL
  SELECT p.source, p.rank, s.height + c.height,
         coalesce(string_agg(t.h, '' ORDER BY t.k) FILTER (t.k < c.k), ''),
         coalesce(string_agg(t.h, '' ORDER BY t.k) FILTER (t.k > c.k), '')
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
  JOIN climbed_top c ON c.source IS NOT DISTINCT FROM s.source
  JOIN top t ON t.height = c.height AND t.k // 3 = c.k // 3
  WHERE c.height < (SELECT max(height) FROM top) GROUP BY p.source, p.rank, s.height, c.height),
proofs AS (
  SELECT source, rank, sha256(string_agg(before || after, '' ORDER BY step)) AS proof
  FROM steps GROUP BY source, rank),
folded(source, rank, step, h) AS (
  SELECT source, rank, 0::BIGINT, coalesce(tampered, leaf) FROM placed
  UNION ALL
  SELECT f.source, f.rank, f.step + 1, sha256(s.before || f.h || s.after)
  FROM folded f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.rank = f.rank
    AND s.step = f.step),
ends AS (SELECT source, rank, max_by(h, step) AS h FROM folded GROUP BY source, rank),
root AS (SELECT h FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root.h AS root,
       coalesce(x.proof, sha256('')) AS proof_sha256, e.h AS folded_root,
       e.h = root.h AS verified
FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
JOIN ends e ON e.source IS NOT DISTINCT FROM p.source AND e.rank = p.rank
LEFT JOIN proofs x ON x.source IS NOT DISTINCT FROM p.source AND x.rank = p.rank
CROSS JOIN root
"""

# A word is a run of other characters than blank and \x09-\x0D.
_WORD = r"[^\x20\x09-\x0D]"
_WORDS = f"regexp_extract_all(text, '{_WORD}+')"

ORACLES["op4_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {_WORDS} AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls
      FROM d),
k AS (SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i:
        ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS key,
        unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
again AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY r, key) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n
            FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 AS b1, 100 * n_repeat_words > 50 * n_words AS b2,
        10 * n_symbols > n_words AS b3, 100 * n_dup_lines > 30 * n_lines AS b4,
        word_chars < 2 * n_words AS b5, word_chars > 15 * n_words AS b6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  b1 OR b2 AS base_failed, NOT (b1 OR b2 OR b3) AS kept,
  CAST(b1::INT + 2 * b2::INT + 4 * b3::INT + 8 * b4::INT + 16 * b5::INT + 32 * b6::INT
       AS BIGINT) AS failed_rules FROM b
"""

ORACLES["op6_substring_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, {_WORDS} AS ws FROM d),
wins AS (SELECT r, doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i:
           md5(array_to_string(ws[i:i + 49], ' ')))) AS key,
           unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) > 49),
gone AS (SELECT r, i FROM wins QUALIFY doc_id > min(doc_id) OVER (PARTITION BY key)),
places AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM gone)),
each AS (SELECT r, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
         FROM each ANTI JOIN places USING (r, p) GROUP BY r)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""

ORACLES["op9_jaccard_join"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, CASE WHEN regexp_matches(text, '{_WORD}') THEN md5(text) END AS copy
  FROM documents),
c AS (SELECT copy, min(doc_id) AS doc, count(*) AS copies, {_WORDS} AS ws
      FROM d WHERE copy IS NOT NULL GROUP BY copy, text),
s AS (SELECT DISTINCT copy, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i:
        array_to_string(ws[i:i + 4], ' '))) AS sh FROM c),
n AS (SELECT copy, count(*) AS n FROM s GROUP BY copy),
pairs AS (SELECT a.copy AS a, b.copy AS b, count(*) AS shared FROM s a JOIN s b
          ON a.sh = b.sh AND a.copy <> b.copy GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.copy = a JOIN n nb ON nb.copy = b
          WHERE shared >= 0.8 * (na.n + nb.n - shared) - 1e-9),
near AS (SELECT a AS copy, sum(copies) AS docs, count(*) AS texts
         FROM links JOIN c ON c.copy = b GROUP BY a),
reach(copy, far) AS (SELECT copy, copy FROM c
  UNION SELECT reach.copy, links.b FROM reach JOIN links ON links.a = reach.far),
label AS (SELECT reach.copy, min(c.doc) AS class_id FROM reach JOIN c ON c.copy = far GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.copy IS NULL THEN d.doc_id ELSE class_id END AS class_id,
  coalesce(copies, 1) AS n_copies,
  CAST(coalesce(copies, 1) - 1 + coalesce(docs, 0) AS BIGINT) AS n_links,
  coalesce(texts, 0) AS n_text_links
FROM d LEFT JOIN c USING (copy) LEFT JOIN near USING (copy) LEFT JOIN label USING (copy)
"""

# Control strings of the template, and what its frames add to a turn.
_CONTROL = r"\\|</?s>|\[/?(?:INST|SYS|ASSISTANT|ROLE)\]"


def _escaped(column: str) -> str:
    return f"length({column}) + len(regexp_extract_all({column}, '{_CONTROL}'))"


ORACLES["op10_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k,
        {_escaped('text')} + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 16
          WHEN 'assistant' THEN 20 ELSE 22 + {_escaped('role')} END AS size FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
