"""DuckDB SQL of the queries that SQL can express at the size of a test: op3, op5 and op8."""

from __future__ import annotations

from orbweave.llm import chat_tree, ngram_join, quality_rules

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_tree_sql() -> str:
    escape = lambda x: f"regexp_replace({x}, {_quoted(chat_tree.CONTROL.pattern)}, '\\1\\\\\\2\\3', 'g')"
    marks = len(chat_tree.OPEN) + len(chat_tree.HEAD_END) + len(chat_tree.CLOSE)
    head = r"replace(replace(r, '\', '\\'), chr(10), '\n')"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT conv_id::BIGINT AS conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM rows
), formatted AS (
  SELECT *, {marks} + length({escape(head)}) + length({escape("t")}) AS size FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r = '{chat_tree.LEARNED_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (r = '{chat_tree.LEARNED_ROLE}'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars,
       (sum(size) - arg_max(size, k))::BIGINT AS attended_chars
FROM formatted GROUP BY conv_id
"""


def quality_rules_sql() -> str:
    rules = quality_rules.RULES
    share = quality_rules.EPSILON / len(rules)
    tests = sum(len(grid) for grid in rules.values())
    grid = ", ".join(f"('{rule}', {c})" for rule, cuts in rules.items() for c in cuts)
    parts = {
        "symbol_words": ("n_symbols", "n_words"), "repeat_words": ("n_repeat_words", "n_words"),
        "dup_lines": ("n_dup_lines", "n_lines"), "word_chars": ("word_chars", "n_words"), "upper_chars": ("n_upper", "word_chars"),
    }
    rates = ", ".join(f"CASE WHEN {b} > 0 THEN {a} * 1000 // {b} ELSE 0 END AS r_{rule}" for rule, (a, b) in parts.items())
    passed = " AND ".join(
        f"coalesce(r_{rule} <= (SELECT min(cutoff) FROM proven p WHERE p.lang = f.lang AND p.rule = '{rule}'), true)" for rule in rules
    )
    value = "CASE rule " + " ".join(f"WHEN '{rule}' THEN r_{rule}" for rule in rules) + " END"
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share}))"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS uid, doc_id, lang, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '{_WORD}') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM docs
), eights AS (
  SELECT uid, unnest(range(1, len(w) - {quality_rules.WINDOW - 2})) AS i, w FROM split WHERE len(w) >= {quality_rules.WINDOW}
), keyed AS (
  SELECT uid, i, array_to_string(w[i : i + {quality_rules.WINDOW - 1}], ' ') AS g FROM eights
), again AS (
  SELECT uid, i FROM keyed QUALIFY count(*) OVER (PARTITION BY uid, g) > 1
), repeats AS (
  SELECT uid, sum(least({quality_rules.WINDOW}, coalesce(following - i, {quality_rules.WINDOW}))) AS n
  FROM (SELECT uid, i, lead(i) OVER (PARTITION BY uid ORDER BY i) AS following FROM again) GROUP BY uid
), counted AS (
  SELECT s.uid, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON r.uid = s.uid
), rated AS (
  SELECT *, {rates},
         n_words < {quality_rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality_rules.MAX_REPEAT_PERCENT} AS base_failed
  FROM counted
), held AS (
  SELECT * FROM rated WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), tests AS (
  SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER ({value} > cutoff) AS k
  FROM held, (VALUES {grid}) AS grid(rule, cutoff) GROUP BY lang, rule, cutoff
), level AS (
  SELECT {quality_rules.DELTA} / ({tests} * greatest(count(DISTINCT lang) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END), 1)) AS a FROM held
), proven AS (
  SELECT lang, rule, cutoff FROM tests, level
  WHERE k < n * {share} AND list_sum(list_transform(range(k + 1), lambda i: {term})) <= a
), final AS (
  SELECT f.*, {passed} AS passed FROM rated f
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND passed AS kept
FROM final
"""


def ngram_join_sql() -> str:
    width, percent = ngram_join.WIDTH, ngram_join.PERCENT
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id::BIGINT AS doc_id, regexp_extract_all({lower}, '{_WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {width - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS d, doc_id AS root FROM sizes
  UNION
  SELECT b AS d, root FROM reach JOIN links ON a = d WHERE b > root
), least AS (
  SELECT d, min(root) AS component_id FROM reach GROUP BY d
)
SELECT s.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id)::BIGINT AS component_id
FROM split s LEFT JOIN sizes z ON z.doc_id = s.doc_id LEFT JOIN least ON d = s.doc_id
"""


ORACLE = {"op3_chat_tree": chat_tree_sql(), "op5_quality_rules": quality_rules_sql(), "op8_ngram_join": ngram_join_sql()}
