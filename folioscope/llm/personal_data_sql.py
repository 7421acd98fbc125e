"""DuckDB SQL of personal_data: the same patterns and rounds, written out."""

from __future__ import annotations

from folioscope.llm import personal_data as pd

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_WORD = "[A-Za-z0-9._%+@:/#()-]"
_CANDIDATE = rf"{_WORD}*[0-9@]{_WORD}*(?: [(]*[0-9][0-9().-]*)*"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _luhn(x: str) -> str:
    d = _digits(x)
    return f"""(length({d}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i:
      CASE WHEN (length({d}) - i) % 2 = 0 THEN substr({d}, i, 1)::INT ELSE (substr({d}, i, 1)::INT * 2) % 10 + substr({d}, i, 1)::INT // 5 END)) % 10 = 0)"""


def _test(kind: str, x: str) -> str:
    return {
        "email": "true",
        "ip": rf"regexp_matches({x}, '^{pd._BYTE}(?:\.{pd._BYTE}){{3}}$')",
        "card": _luhn(x),
        "phone": f"length({_digits(x)}) BETWEEN 8 AND 15",
    }[kind]


def _matches(name: str, pattern: str) -> str:
    return f"""
{name} AS (
  SELECT rid, i, found, before, (sum(length(before) + length(found)) OVER (PARTITION BY rid ORDER BY i))::BIGINT - length(found) AS start FROM (
    SELECT rid, unnest(f) AS found, unnest(p[:len(f)]) AS before, generate_subscripts(f, 1) AS i
    FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS p FROM d)))"""


def _quoted(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"


def personal_data_sql() -> str:
    base = ",".join(_matches(f"m_{k}", p) for k, p in _BASE.items())
    every = " UNION ALL ".join(f"SELECT rid, {i} AS kind, start, start + length(found) AS stop FROM m_{k} WHERE {_test(k, 'found')}" for i, k in enumerate(_BASE))
    seed = " ".join(f"WHEN regexp_matches(found, '^{p}$') AND {_test(k, 'found')} THEN {i}" for i, (k, p) in enumerate(_BASE.items()))
    rounds = ""
    for r in range(pd.ROUNDS):
        rounds += f""",
supported{r} AS MATERIALIZED (
  SELECT pattern, -arg_max(-kind, score * 10 - kind) AS kind, max(score) AS score FROM (
    SELECT pattern, k.kind, sum(k.score)::BIGINT AS score FROM edges e JOIN known{r} k USING (found) GROUP BY pattern, k.kind HAVING count(*) >= {pd.SUPPORT}) GROUP BY pattern),
patterns{r} AS MATERIALIZED (
  SELECT * FROM (
    SELECT s.pattern, s.kind, s.score // (z.n + coalesce(o.n, 0)) AS confidence FROM supported{r} s JOIN sizes z USING (pattern) LEFT JOIN ordinary o USING (pattern))
  WHERE confidence >= {pd.CONFIDENCE}),
known{r + 1} AS MATERIALIZED (
  SELECT * FROM known0 UNION ALL
  SELECT found, -arg_max(-p.kind, confidence * 10 - p.kind) AS kind, least(max(confidence), 999)::BIGINT AS score
  FROM (SELECT pattern, found FROM edges WHERE kind IS NULL) e JOIN patterns{r} p USING (pattern) GROUP BY found)"""
    names = "['email', 'ip', 'card', 'phone']"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),{base},
base AS MATERIALIZED ({every}),{_matches("looked", _CANDIDATE)},
trimmed AS (
  SELECT rid, i, before, rtrim(ltrim(found, {_quoted(pd._BEFORE)}), {_quoted(pd._AFTER)}) AS found, start = length(before) AS first, start + length(found) - length(ltrim(found, {_quoted(pd._BEFORE)})) AS start
  FROM looked WHERE length(found) <= {pd.LONGEST + 16}),
likely AS (
  SELECT *, string_split_regex(regexp_replace(translate(right(before, 96), '{pd._CAPITALS}', '{pd._SMALL}'), '[^\\x20\\x09-\\x0D\\p{{L}}\\p{{N}}]*$', ''), '{pd._SPACE}') AS ws
  FROM trimmed WHERE length(found) BETWEEN {pd.SHORTEST} AND {pd.LONGEST} AND (length({_digits("found")}) >= {pd.DIGITS} OR regexp_matches(found, '[A-Za-z0-9]@[A-Za-z0-9]'))),
cands AS MATERIALIZED (
  SELECT rid, start, start + length(found) AS stop, found, CASE {seed} END AS kind, w[-1] AS one, w[-2] AS two FROM (
    SELECT *, CASE WHEN ws[-1] = '' THEN list_transform(list_filter(CASE WHEN first AND length(before) <= 96 THEN ws ELSE ws[2:] END, lambda x: x <> ''), lambda x: trim(x, {_quoted(pd._EDGES)})) ELSE [] END AS w FROM likely)),
edges AS MATERIALIZED (
  SELECT DISTINCT pattern, found, kind FROM (
    SELECT one AS pattern, found, kind FROM cands WHERE one <> ''
    UNION ALL SELECT two || ' ' || one, found, kind FROM cands WHERE one <> '' AND two <> '')),
words AS (
  SELECT rid, i, trim(w, {_quoted(pd._EDGES)}) AS w FROM (
    SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT rid, string_split_regex(trim(translate(text, '{pd._CAPITALS}', '{pd._SMALL}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{pd._SPACE}') AS ws FROM d))),
slots AS (SELECT w, lag(w, 1) OVER o AS one, lag(w, 2) OVER o AS two FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
fillers AS (SELECT * FROM slots WHERE NOT contains(w, '@') AND (length({_digits("w")}) < {pd.DIGITS} OR length(w) < {pd.SHORTEST})),
ordinary AS MATERIALIZED (
  SELECT pattern, count(DISTINCT w) AS n FROM (
    SELECT one AS pattern, w FROM fillers WHERE one <> '' UNION ALL SELECT two || ' ' || one, w FROM fillers WHERE one <> '' AND two <> '')
  WHERE pattern IN (SELECT pattern FROM edges) GROUP BY pattern),
sizes AS (SELECT pattern, count(*) AS n FROM edges GROUP BY pattern),
known0 AS MATERIALIZED (SELECT DISTINCT found, kind, 1000::BIGINT AS score FROM edges WHERE kind IS NOT NULL){rounds},
added AS (
  SELECT c.rid, k.kind, c.start, c.stop FROM cands c JOIN known{pd.ROUNDS} k USING (found)
  WHERE c.kind IS NULL AND k.score < 1000 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start < c.stop AND b.stop > c.start)),
listed AS (
  SELECT rid, string_agg(s, ',' ORDER BY kind, start) FILTER (base) AS base, string_agg(s, ',' ORDER BY kind, start) AS spans,
         {", ".join(f"count(*) FILTER (base AND kind = {i}) AS n_{k}" for i, k in enumerate(_BASE))}
  FROM (SELECT *, {names}[kind + 1] || ':' || start || ':' || stop AS s FROM (SELECT *, true AS base FROM base UNION ALL SELECT *, false FROM added)) GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (rid)
"""
