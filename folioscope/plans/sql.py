"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations

import re

from folioscope.operators import consensus, prompts
from folioscope.operators.chunks import WORD

_CHUNKS = """
chunks AS (
  SELECT doc_id, doc_id || '_p1_c' || pos AS chunk_id, pos AS chunk_index, 1::INTEGER AS page, text
  FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos
        FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)))"""

_TOKENS = (
    _CHUNKS
    + f""",
cut AS (
  SELECT doc_id, chunk_index, regexp_extract_all(text, '{WORD}') AS w, string_split_regex(text, '{WORD}') AS g FROM (SELECT doc_id, chunk_index, lower(text) AS text FROM chunks)),
parts AS (SELECT doc_id, chunk_index, unnest(w) AS token, unnest(g[:len(w)]) AS gap, generate_subscripts(w, 1) AS ord FROM cut),
placed AS (
  SELECT doc_id, chunk_index, token, (sum(length(gap) + length(token)) OVER (PARTITION BY doc_id, chunk_index ORDER BY ord))::BIGINT - length(token) AS pos FROM parts),
occ AS MATERIALIZED (SELECT doc_id, chunk_index, token AS term, list(pos ORDER BY pos) AS positions FROM placed GROUP BY ALL)"""
)

_KEYWORDS = (
    _TOKENS
    + """,
kw AS (SELECT * FROM occ)"""
)

_ACRONYMS = """,
acr AS (
  SELECT * FROM (SELECT doc_id, page, chunk_index, unnest(string_split_regex(text, '[^A-Za-z0-9]+')) AS term FROM chunks)
  WHERE regexp_full_match(term, '[A-Z]{2,6}'))"""

_SCORES = """,
totals AS (SELECT doc_id, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')))::BIGINT AS n_words FROM chunks GROUP BY doc_id),
tf AS (
  SELECT term, doc_id, tf, CASE WHEN n_words > 0 THEN least(1.0, tf::DOUBLE / n_words * 1000) ELSE 0 END AS score
  FROM (SELECT term, doc_id, sum(len(positions))::BIGINT AS tf FROM kw GROUP BY ALL) JOIN totals USING (doc_id))"""

_COOC = """,
tot AS (SELECT term, count(*) AS total_count FROM kw GROUP BY term),
pairs AS (
  SELECT a.term, b.term AS other, a.doc_id, a.chunk_index,
         greatest(exp(-list_min(list_transform(flatten(list_transform(a.positions, lambda x: list_transform(b.positions, lambda y: x - y))), lambda g: abs(g))) / 100.0), 0.1) AS w
  FROM kw a JOIN kw b ON a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index AND a.term < b.term),
scored AS (SELECT term, other, sum(w) AS score FROM pairs GROUP BY ALL),
both_ways AS (SELECT term, other, score FROM scored UNION ALL SELECT other, term, score FROM scored),
rated AS (
  SELECT term, other, greatest(1, floor(score + 0.5))::BIGINT AS frequency, round(least(score / total_count, 1.0), 9) AS confidence
  FROM both_ways JOIN tot USING (term)),
cooc AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY confidence DESC, other) AS rank FROM rated) WHERE rank <= 10)"""

_PART_LINKS = """
names AS (SELECT DISTINCT p_name AS acronym, p_name || ' ' || p_type AS full_form FROM part),
words AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS keyword FROM part),
links AS (
  SELECT acronym, keyword, 0.7 + 0.3 * length(keyword) / length(lower(full_form)) AS match_score
  FROM names, words WHERE length(keyword) > 1 AND contains(lower(full_form), keyword))"""

_ORDER_VOTES = """
votes AS (SELECT l_orderkey AS item, l_linenumber AS seq, min(l_returnflag) AS key FROM lineitem GROUP BY ALL),
groups AS (SELECT item, key, count(*) AS n, min(seq) AS first_seq FROM votes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, first_seq, key) AS place FROM groups),
decided AS (
  SELECT item, sum(n)::BIGINT AS n_votes, max(key) FILTER (place = 1) AS winner, max(n) FILTER (place = 1) AS top,
         coalesce(max(n) FILTER (place = 2), 0) AS second, max(key) FILTER (place = 2) AS rival
  FROM ranked GROUP BY item)"""

_ORDER_LISTS = """
lists AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_partkey, l_suppkey) AS f FROM lineitem GROUP BY l_orderkey)"""

_DAILY = """
votes AS (
  SELECT strftime(ts, '%Y-%m-%d') AS item, hour(ts)::INTEGER AS round, user_id::VARCHAR AS model_id, user_id::INTEGER AS seq, arg_min(event_type, event_id) AS key
  FROM events GROUP BY ALL)"""

_DAILY_GROUPS = (
    _DAILY
    + """,
groups AS (SELECT item, round, key, count(*) AS n, min(seq) AS first_seq FROM votes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item, round ORDER BY n DESC, first_seq, key) AS place FROM groups),
decided AS (
  SELECT item, round, sum(n)::BIGINT AS n_votes, max(n) FILTER (place = 1) AS top, coalesce(max(n) FILTER (place = 2), 0) AS second
  FROM ranked GROUP BY ALL)"""
)

_DAILY_CONSISTENCY = (
    _DAILY
    + """,
kept AS (SELECT *, (key = lag(key) OVER (PARTITION BY item, model_id ORDER BY round))::INTEGER AS kept FROM votes),
consistent AS (SELECT item, model_id, coalesce(avg(kept), 1.0) AS consistency FROM kept GROUP BY ALL)"""
)

_ANSWERS = "\n".join(f"    WHEN contains(lower(issue), '{said}') THEN '{answer}'" for said, answer in prompts.ISSUE_PRINCIPLES)
_ISSUES = f"""
issues AS (
  SELECT p_partkey, p_size, p_name || ' ' || ['lacks detail', 'Missing context here', 'is unclear', 'seems ambiguous', 'too vague now', 'too long', 'no examples at all', 'not bad, no harm'][p_size % 8 + 1] AS issue
  FROM part),
answers AS (
  SELECT p_partkey, issue, CASE
    WHEN contains(lower(issue), 'lacks') THEN replace(issue, 'lacks', '{prompts.INCLUDE}')
    WHEN contains(lower(issue), 'missing') THEN CASE WHEN contains(issue, 'Missing') THEN replace(issue, 'Missing', '{prompts.INCLUDE}') ELSE replace(issue, 'missing', '{prompts.INCLUDE}') END
{_ANSWERS}
    ELSE '{prompts.ENSURE}' || trim(replace(replace(issue, 'not', ''), 'no', '')) END AS principle
  FROM issues)"""

_ACTIONABLE = "|".join(prompts.ACTIONABLE)

_BOTH_KINDS = """,
both_kinds AS (
  SELECT doc_id, chunk_index, term, 'acronym' AS kind FROM acr UNION ALL SELECT doc_id, chunk_index, term, 'keyword' FROM kw)"""

_REGION_TABLES = """
cells AS (
  SELECT n_regionkey, 0 AS ord, ['key', 'name', 'note'] AS c FROM (SELECT DISTINCT n_regionkey FROM nation)
  UNION ALL
  SELECT n_regionkey, n_nationkey + 1, [n_nationkey::VARCHAR, n_name, CASE WHEN n_nationkey % 2 = 0 THEN '<even & |>' END] FROM nation)"""

_FLOW = """,
flow AS (
  SELECT v.item, v.round, v.model_id, string_agg(p.model_id, ',' ORDER BY p.seq, p.model_id) AS peers
  FROM votes v JOIN votes p ON p.item = v.item AND p.round = v.round - 1 AND p.model_id <> v.model_id GROUP BY ALL)"""

_ACHIEVED = "n_votes < 2 OR top * 2 > n_votes OR (top <> second AND top >= 0.85 * n_votes)"

_PART_RELATIONS = (
    _PART_LINKS
    + """,
known AS (SELECT acronym AS term_key, 'acronym' AS term_type FROM names UNION ALL SELECT keyword, 'keyword' FROM words ANTI JOIN names ON keyword = acronym),
companions AS (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, other) AS rank
  FROM (SELECT term, other, count(*) AS n FROM (SELECT lower(p_brand) AS term, unnest(string_split(lower(p_type), ' ')) AS other FROM part) GROUP BY ALL))"""
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _principle_apply() -> str:
    said = {k: _quoted(v).replace("\n", "' || chr(10) || '") for k, v in vars(prompts).items() if isinstance(v, str) and k.isupper()}
    gap = "chr(10) || chr(10)"
    has = lambda *words: " OR ".join(f"contains(low, '{w}')" for w in words)
    questions = " OR ".join(f"contains(lower(x), '{w}')" for w in prompts.QUESTIONS)
    rules = (("clarity", "clear"), ("specific", "concrete"), ("concise", "shorten"), ("simple", "break down"), ("context",), ("add", "include"), ("structure",), ("example",), ("format",))
    example = f"prompt || {said['EXAMPLE_AFTER']}"
    kept = (f"prompt || {said['REQUIREMENTS_AFTER']}", f"prompt || {said['SPECIFICALLY_AFTER']}", "simple", "parts", f"{said['BACKGROUND_BEFORE']} || prompt", f"prompt || {gap} || added", "structure", example, "format")
    free = (f"{said['INSTRUCTION_BEFORE']} || clear", "exact", "simple", "parts", f"{said['DOMAIN_BEFORE']} || prompt", f"added || {gap} || prompt", "structure", example, "format")
    cases = lambda out, rest: "CASE " + " ".join(f"WHEN {has(*r)} THEN {o}" for r, o in zip(rules, out)) + f" ELSE {rest} END"
    return f"""
WITH {_ISSUES},
asked AS (SELECT p_partkey, issue, lower(issue) AS low, 'Maybe explain the parts, the whole and the ' || issue || '. What could it cost?' AS prompt FROM issues),
cut AS (
  SELECT *, list_filter(string_split_regex(prompt, '\\s+'), lambda w: w <> '') AS words, string_split_regex(prompt, '[;,]|\\band\\b') AS bits,
         list_filter(list_transform(string_split_regex(prompt, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS sentences,
         trim(regexp_extract(issue, '(?i)(?:add|include)\\s+(.+)', 1)) AS more
  FROM asked),
folded AS (SELECT *, list_transform(words, lambda w: lower(w)) AS lows, list_filter(sentences, lambda x: {questions}) AS questions FROM cut),
made AS (
  SELECT *, trim(regexp_replace(regexp_replace(prompt, '(?i)\\b(?:{'|'.join(prompts.HEDGES)})\\b', '', 'g'), '\\s+', ' ', 'g')) AS clear,
         replace(prompt, '?', {said['DETAILS']}) AS exact, trim(regexp_extract(prompt, '([^.]*\\?)', 1)) AS core,
         array_to_string(list_filter(words, lambda w, i: list_contains({list(prompts.REPEATABLE)}, lower(w)) OR list_position(lows, lower(w)) = i), ' ') AS simple,
         {said['ADDRESS']} || array_to_string(list_filter(list_transform(bits, lambda b, i: CASE WHEN trim(b) <> '' THEN i || '. ' || trim(b) END), lambda b: b IS NOT NULL), chr(10)) AS parts,
         {said['MAIN_REQUEST']} || array_to_string(questions, '. ') || {said['CONTEXT_AFTER']} || array_to_string(list_filter(sentences, lambda x: NOT list_contains(questions, x)), '. ') AS structure,
         array_to_string(list_transform(regexp_extract_all(prompt, '[^.!?]*[.!?]+|[^.!?]+$'), lambda x: upper(x[1]) || x[2:]), '') AS format,
         CASE WHEN more <> '' THEN more ELSE {said['NOTHING_TO_ADD']} END AS added
  FROM folded)
SELECT p_partkey, {cases(kept, f"{said['PRINCIPLE_BEFORE']} || issue || {gap} || prompt")} AS kept, {cases(free, f"issue || {gap} || core")} AS free, simple, parts, structure, format FROM made"""


def _formatted(text: str, *values: str) -> str:
    """A text with %d and %s places as an expression that joins it with values."""
    parts = re.split("%[ds]", text)
    return " || ".join(x for i, p in enumerate(parts) for x in (_quoted(p), *values[i : i + 1]))


_QUERY_SCORES = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)"

ORACLES: dict[str, str] = {
    "chunk_documents": f"WITH {_CHUNKS} SELECT * FROM chunks",
    "doc_word_count": "SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n_words FROM documents",
    "normalize_terms": """
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('1. • ' || upper(p_name) || ' (note)  -'),
  '\\s*\\([^)]*\\)', '', 'g'), '^(?:\\s*(?:[-•·*▪▸◦‣⁃]|\\d+[.)]|[a-z][.)]|[ivxlcdm]+[.)])\\s*)+', ''), '\\s+', ' ', 'g'), '^-+|-+$', '', 'g')) AS term
FROM part""",
    "dehyphenate": "SELECT p_partkey, regexp_replace(replace(p_name, ' ', '-' || chr(10)), '([a-zA-Z]+)-\\n([a-zA-Z]+)', '\\1\\2', 'g') AS name FROM part",
    "clean_toc_lines": r"""
SELECT doc_id, array_to_string(list_filter(string_split(text || chr(10) || 'Page 3 of 9' || chr(10) || '1.2 Title ....... 17' || chr(10) || '- 4 -' || chr(10) || '[7]'
    || chr(10) || '12/40' || chr(10) || '3.1 Scope    9' || chr(10) || 'end', chr(10)), lambda x: NOT (
  regexp_matches(x, '\.{5,}') OR (regexp_matches(x, '^\s*\d+(\.\d+)*\s+.*?\s+\d+\s*$') AND regexp_matches(x, '[\s.]{3,}\d+\s*$'))
  OR regexp_matches(x, '^\s*\.+\s*\d+\s*$') OR regexp_matches(x, '^\s*\d+(\.\d+)*\s+.*?\.{3,}') OR regexp_matches(x, '(?i)^\s*page\s+\d+\s*(of|/)\s*\d+\s*$')
  OR regexp_matches(x, '^\s*\d+\s*(of|/)\s*\d+\s*$') OR regexp_matches(x, '(?i)^\s*page\s+\d+\s*$') OR regexp_matches(x, '^\s*-\s*\d+\s*-\s*$')
  OR regexp_matches(x, '^\s*\[\s*\d+\s*\]\s*$'))), chr(10)) AS text
FROM documents""",
    "clean_markdown_ws": r"""
SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(text || chr(1), chr(10)), lambda x: CASE WHEN contains(x, '|') THEN x || '  ' ELSE rtrim(x, ' ') END), chr(10) || chr(10)), '\x01 *$', '') AS text
FROM documents""",
    "truncate_limit": """
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 380) || chr(10) || chr(10) || '[... truncated to fit token limit ...]' END AS text,
       CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS excerpt
FROM documents""",
    "fixed_slices": """
SELECT doc_id, pos::INTEGER AS "at", substr(text, pos * 500 + 1, 500) AS slice
FROM (SELECT doc_id, text, unnest(range((length(text) + 499) // 500)) AS pos FROM documents)""",
    "substring_counts": """
SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS n_the, (length(lower(text)) - length(replace(lower(text), 'an', ''))) // 2 AS n_an
FROM documents""",
    "table_html": f"""
WITH {_REGION_TABLES},
escaped AS (SELECT *, list_transform(c, lambda x: replace(replace(replace(coalesce(x, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS e FROM cells),
rows_ AS (
  SELECT n_regionkey, ord, '    <tr>' || chr(10) || array_to_string(list_transform(e, lambda x: CASE WHEN ord = 0 THEN '      <th>' || x || '</th>' ELSE '      <td>' || x || '</td>' END), chr(10)) || chr(10) || '    </tr>' || chr(10) AS r
  FROM escaped)
SELECT n_regionkey, '<table border="1" cellpadding="4" cellspacing="0">' || chr(10) || '  <thead>' || chr(10) || max(r) FILTER (ord = 0) || '  </thead>' || chr(10)
  || '  <tbody>' || chr(10) || string_agg(r, '' ORDER BY ord) FILTER (ord > 0) || '  </tbody>' || chr(10) || '</table>' AS html
FROM rows_ GROUP BY n_regionkey""",
    "table_ascii": f"""
WITH {_REGION_TABLES},
widths AS (SELECT n_regionkey, max(length(coalesce(c[1], ''))) AS a, max(length(coalesce(c[2], ''))) AS b, max(length(coalesce(c[3], ''))) AS d FROM cells GROUP BY 1),
rows_ AS (
  SELECT n_regionkey, ord, rpad(coalesce(c[1], ''), a::INTEGER, ' ') || '  ' || rpad(coalesce(c[2], ''), b::INTEGER, ' ') || '  ' || rpad(coalesce(c[3], ''), d::INTEGER, ' ') AS r
  FROM cells JOIN widths USING (n_regionkey))
SELECT n_regionkey, max(r) FILTER (ord = 0) || chr(10) || chr(10) || string_agg(r, chr(10) ORDER BY ord) FILTER (ord > 0) AS ascii FROM rows_ GROUP BY 1""",
    "table_markdown": f"""
WITH {_REGION_TABLES},
rows_ AS (SELECT n_regionkey, ord, '| ' || array_to_string(list_transform(c, lambda x: replace(coalesce(x, ''), '|', '\\|')), ' | ') || ' |' AS r FROM cells)
SELECT n_regionkey, max(r) FILTER (ord = 0) || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(r, chr(10) ORDER BY ord) FILTER (ord > 0) AS markdown
FROM rows_ GROUP BY 1""",
    "html_to_text_chunks": r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</(?:p|div|li|h[1-6]|tr|title|section|article)>|<br\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM b),
l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM c)
SELECT page_id AS doc_id, generate_subscripts(l, 1) - 1 AS chunk_index, unnest(l) AS text FROM l""",
    "content_hash_dedupe": "SELECT sha256(text) AS document_id, max(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1",
    "files_by_extension": """
SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension, count(*) AS n_files
FROM (SELECT url || '.HTML' AS path FROM pages UNION ALL SELECT '/in/' || p_name || '.pdf' FROM part) GROUP BY 1""",
    "acronym_candidates": f"WITH {_CHUNKS}{_ACRONYMS} SELECT doc_id, page, chunk_index, term FROM acr",
    "acronym_groups": f"WITH {_CHUNKS}{_ACRONYMS} SELECT term, count(*) AS total_count, count(DISTINCT doc_id) AS n_documents, 0::DOUBLE AS mean_score FROM acr GROUP BY term",
    "keyword_candidates_tf": f"WITH {_KEYWORDS}{_SCORES} SELECT term, doc_id, tf, round(score, 9) AS score FROM tf",
    "keyword_groups": f"WITH {_KEYWORDS}{_SCORES} SELECT term, count(*) AS total_count, round(avg(score), 6) AS mean_score FROM kw JOIN tf USING (term, doc_id) GROUP BY term",
    "term_positions": f"WITH {_KEYWORDS} SELECT term, doc_id, chunk_index, array_to_string(list_transform(positions, lambda x: x::BIGINT), ',') AS positions FROM kw",
    "cooccurrence_topn": f"WITH {_KEYWORDS}{_COOC} SELECT term, other, frequency, round(confidence, 6) AS confidence, rank FROM cooc",
    "term_contexts": f"""
WITH {_KEYWORDS},
firsts AS (SELECT term, doc_id, arg_min(text, chunk_index) AS context FROM kw JOIN chunks USING (doc_id, chunk_index) GROUP BY ALL)
SELECT term, doc_id, chunk_index, context FROM kw JOIN firsts USING (term, doc_id)""",
    "merge_rejected_terms": f"""
WITH {_TOKENS}{_ACRONYMS},
k AS (SELECT token AS term, doc_id, chunk_index FROM placed GROUP BY ALL),
r AS (SELECT lower(term) AS term, doc_id, chunk_index FROM acr),
nk AS (SELECT term, count(*) AS n FROM k GROUP BY term),
nr AS (SELECT term, count(*) AS n, count(*) FILTER (NOT held) AS fresh
       FROM (SELECT r.*, k.term IS NOT NULL AS held FROM r LEFT JOIN k USING (term, doc_id, chunk_index)) GROUP BY term)
SELECT term, (coalesce(nk.n, 0) + coalesce(nr.fresh, 0))::BIGINT AS total_count,
       round(CASE WHEN nk.n IS NULL THEN 0.25 WHEN nr.n IS NULL THEN 0.5 ELSE (0.5 * nk.n + 0.25 * nr.n) / (nk.n + nr.n) END, 6)::DOUBLE AS mean_score
FROM nk FULL JOIN nr USING (term)""",
    "acronym_links_substring": f"WITH {_PART_LINKS} SELECT DISTINCT acronym, keyword, round(match_score, 9)::DOUBLE AS match_score FROM links",
    "inverted_index": f"WITH {_KEYWORDS} SELECT term, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS documents FROM (SELECT DISTINCT term, doc_id FROM kw) GROUP BY term",
    "page_chunk_index": f"WITH {_CHUNKS} SELECT doc_id, page, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunks FROM chunks GROUP BY ALL",
    "chunk_terms": f"WITH {_KEYWORDS} SELECT doc_id, chunk_index, string_agg(term, ',' ORDER BY term) AS terms FROM kw GROUP BY ALL",
    "document_stats": f"""
WITH {_KEYWORDS}{_ACRONYMS}{_BOTH_KINDS},
c AS (SELECT doc_id, count(*) AS n_chunks, count(DISTINCT page) AS n_pages FROM chunks GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_terms, count(*) FILTER (kind = 'acronym') AS n_acronyms, count(*) FILTER (kind = 'keyword') AS n_keywords
      FROM (SELECT DISTINCT doc_id, term, kind FROM both_kinds) GROUP BY doc_id)
SELECT doc_id, coalesce(n_pages, 0) AS n_pages, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_terms, 0) AS n_terms, coalesce(n_acronyms, 0) AS n_acronyms, coalesce(n_keywords, 0) AS n_keywords
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "corpus_totals": f"""
WITH {_KEYWORDS}{_ACRONYMS}{_BOTH_KINDS}, {_PART_LINKS.strip()},
t AS (SELECT DISTINCT term, kind FROM both_kinds)
SELECT (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(DISTINCT doc_id) FROM chunks) AS n_documents, (SELECT count(*) FROM t WHERE kind = 'acronym') AS n_acronyms,
       (SELECT count(*) FROM t WHERE kind = 'keyword') AS n_keywords, (SELECT count(*) FROM links) AS n_links""",
    "terms_union_override": f"""
WITH {_KEYWORDS}{_ACRONYMS}{_BOTH_KINDS},
g AS (SELECT lower(term) AS term_key, kind, count(*) AS total_count FROM both_kinds GROUP BY ALL)
SELECT term_key, kind, total_count FROM (SELECT *, row_number() OVER (PARTITION BY term_key ORDER BY kind) AS n FROM g) WHERE n = 1""",
    "vector_topk": f"""
SELECT e.vec_id, e.label, round({_QUERY_SCORES}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY {_QUERY_SCORES} DESC, e.vec_id LIMIT 10""",
    "vector_topk_threshold": f"""
SELECT vec_id, label, round(s, 6) AS score FROM (
  SELECT e.vec_id, e.label, {_QUERY_SCORES} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY s DESC, e.vec_id LIMIT 50)
WHERE s >= 0.3""",
    "vector_batch_topk": f"""
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
  SELECT q.label AS query_id, e.vec_id, {_QUERY_SCORES} AS s, row_number() OVER (PARTITION BY q.label ORDER BY {_QUERY_SCORES} DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q)
WHERE rank <= 5""",
    "vote_struct_keys": """
SELECT substr(sha256('{"l_extendedprice":"' || CASE WHEN l_extendedprice = 0 THEN 'range_zero' ELSE 'range_log_bin_' || (trunc(ln(abs(l_extendedprice)) / ln(1.5))::BIGINT * CASE WHEN l_extendedprice < 0 THEN -1 ELSE 1 END) END
  || '","l_linestatus":"' || l_linestatus || '","l_returnflag":"' || lower(trim(l_returnflag)) || '"}'), 1, 16) AS key, count(*) AS n
FROM lineitem GROUP BY 1""",
    "compare_sequences": f"""
WITH {_ORDER_LISTS},
pairs AS (SELECT x.l_orderkey, x.f AS a, y.f AS b FROM lists x JOIN lists y ON y.l_orderkey = x.l_orderkey + 1),
sized AS (SELECT *, len(a) AS na, len(b) AS nb, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS short, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS long FROM pairs),
counted AS (
  SELECT *, len(list_filter(list_zip(a, b), lambda z: z[1] = z[2])) AS hits,
         list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS shared,
         list_max(list_transform(range(0, len(long) - len(short) + 1), lambda p: len(list_filter(range(1, len(short) + 1), lambda i: short[i] = long[i + p])))) AS best,
         len(list_filter(range(1, len(short) + 1), lambda i: short[1:i] = long[1:i])) AS start
  FROM sized)
SELECT l_orderkey, na = nb AND hits / na >= 0.6 AS ordered, shared / greatest(na, nb) >= 0.6 AS unordered,
       greatest(best / least(na, nb), start / greatest(na, nb)) >= 0.6 AS ordered_alike, shared / greatest(na, nb) >= 0.4 AS unordered_alike
FROM counted""",
    "primary_term_matches": f"""
WITH {_KEYWORDS}, t AS (SELECT DISTINCT term FROM kw),
-- terms are whole words, so that a text contains one if a word of it does
starts AS (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM t),
sub AS (SELECT DISTINCT term, substr(term, i, n) AS term_key FROM (SELECT term, i, unnest(range(1, length(term) - i + 2)) AS n FROM starts)),
held AS MATERIALIZED (SELECT sub.term, term_key FROM sub SEMI JOIN t ON t.term = sub.term_key)
SELECT DISTINCT chunk_id AS result_id, term_key FROM kw JOIN held USING (term) JOIN chunks USING (doc_id, chunk_index)""",
    "related_terms_one_hop": f"""
WITH {_KEYWORDS}{_COOC}
SELECT DISTINCT other AS term_key, tot.total_count FROM cooc JOIN tot ON tot.term = cooc.other WHERE rank <= 5""",
    "query_relevance": """
WITH w AS (SELECT DISTINCT lower(substr(p_name, 1, 2)) AS term FROM part),
f AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) AS n FROM documents JOIN w ON contains(lower(text), term))
SELECT doc_id AS result_id, round(0.7 * sum(n) + 0.3 * count(*), 6)::DOUBLE AS relevance, count(*) AS n_terms FROM f WHERE n > 0 GROUP BY doc_id""",
    "rerank_combined": """
SELECT event_id, round(value / 100 * 0.6 + least(user_id::DOUBLE / 10, 0.4), 6) AS combined FROM events ORDER BY combined DESC, event_id LIMIT 25""",
    "vote_majority": f"""
WITH {_ORDER_VOTES}
SELECT item, n_votes, winner, top, second, n_votes < 2 OR top * 2 > n_votes OR (top <> second AND top >= 0.85 * n_votes) AS achieved, top = second AS tie FROM decided""",
    "vote_judge_ties": f"""
WITH {_ORDER_VOTES}
SELECT item, winner, rival, top = second AS tie, CASE WHEN top = second THEN least(winner, rival) || greatest(winner, rival) ELSE winner END AS chosen FROM decided""",
    "vote_outliers": f"""
WITH {_ORDER_VOTES},
alone AS (SELECT item, key FROM (SELECT *, sum(n) OVER (PARTITION BY item) AS whole, max(n) OVER (PARTITION BY item) AS largest FROM groups) WHERE whole >= 3 AND n = 1 AND largest >= 0.7 * whole)
SELECT item, seq::VARCHAR AS model_id, key FROM votes SEMI JOIN alone USING (item, key)""",
    "vote_agreement": f"""
WITH {_ORDER_VOTES}
SELECT item, round(CASE WHEN count(*) < 2 THEN 1.0::DOUBLE ELSE 1 - (count(DISTINCT key) - 1) / (count(*) - 1)::DOUBLE END, 6) AS agreement FROM votes GROUP BY item""",
    "vote_range_bins": """
SELECT CASE WHEN l_extendedprice = 0 THEN 'range_zero' ELSE 'range_log_bin_' || (sign(l_extendedprice) * trunc(ln(abs(l_extendedprice)) / ln(1.2::DOUBLE)))::INTEGER END AS bin, count(*) AS n
FROM lineitem GROUP BY 1""",
    "vote_sequence_keys": f"""
WITH {_ORDER_LISTS}
SELECT l_orderkey, 'ordered:' || len(f) || ':' || array_to_string(f, ':') AS ordered,
       'unordered:' || len(f) || ':' || array_to_string(list_sort(list_distinct(f)), ':') AS unordered,
       'ordered_alike:size_exact_' || len(f) || ':content_' || array_to_string(f[1:floor(len(f) * 0.8)::INTEGER], ':') AS ordered_alike,
       'unordered_alike:size_' || CASE WHEN len(f) <= 1 THEN 'tiny' WHEN len(f) <= 3 THEN 'small' WHEN len(f) <= 5 THEN 'medium' ELSE 'large' END
         || ':content_' || array_to_string(list_sort(f)[1:greatest(1, floor(len(f) * 0.6))::INTEGER], ':') AS unordered_alike
FROM lists""",
    "compare_ranges": """
SELECT p.p_partkey, abs(p.p_size - q.p_size) <= 0.2 * greatest(abs(p.p_size), abs(q.p_size), 1) AS close FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1""",
    "round_consistency": f"WITH {_DAILY_CONSISTENCY} SELECT item, model_id, round(consistency, 6) AS consistency FROM consistent",
    "convergence_score": f"""
WITH {_DAILY},
a AS (SELECT item, round, CASE WHEN count(*) < 2 THEN 1.0::DOUBLE ELSE 1 - (count(DISTINCT key) - 1) / (count(*) - 1)::DOUBLE END AS agreement FROM votes GROUP BY ALL),
r AS (SELECT *, greatest(agreement - lag(agreement) OVER (PARTITION BY item ORDER BY round), 0) AS rise, lag(agreement) OVER (PARTITION BY item ORDER BY round) AS before FROM a)
SELECT item, round(round(0.6 * arg_max(agreement, round) + 0.4 * coalesce(avg(rise) FILTER (before IS NOT NULL), 0), 9), 6)::DOUBLE AS convergence FROM r GROUP BY item""",
    "model_contribution": f"""
WITH {_DAILY_CONSISTENCY},
final AS (SELECT item, arg_max(key, (round, model_id)) AS final FROM votes GROUP BY item),
s AS (SELECT item, model_id, count(*) AS n, avg((key = final)::INTEGER) AS share, arg_max((key = final)::INTEGER, round) AS late, arg_min((key = final)::INTEGER, round) AS early
      FROM votes JOIN final USING (item) GROUP BY ALL),
t AS (SELECT *, CASE WHEN n < 2 THEN 1.0 ELSE least(share + CASE WHEN late = 1 AND early = 0 THEN 0.3 ELSE 0 END, 1.0) END AS toward FROM s JOIN consistent USING (item, model_id))
SELECT item, model_id, round(toward, 6)::DOUBLE AS toward, round(0.5 * consistency + 0.5 * toward, 6)::DOUBLE AS contribution FROM t""",
    "influence": f"""
WITH {_DAILY},
e AS (SELECT *, lag(key) OVER o AS previous, lag(round) OVER o AS before FROM votes WINDOW o AS (PARTITION BY item, model_id ORDER BY round))
SELECT e.item, e.model_id, e.round, e.key, e.previous, e.key <> e.previous AS changed,
       coalesce((SELECT string_agg(DISTINCT p.model_id, ',' ORDER BY p.model_id) FROM votes p WHERE p.item = e.item AND p.round = e.before AND p.key = e.key AND p.model_id <> e.model_id AND e.key <> e.previous), '') AS influenced_by
FROM e WHERE e.previous IS NOT NULL""",
    "disagreement_fields": """
SELECT l_orderkey, field, count(DISTINCT value) AS n_values, count(DISTINCT value) = 1 AS agreed, string_agg(DISTINCT value, ',' ORDER BY value) AS values
FROM (SELECT l_orderkey, 'l_returnflag' AS field, l_returnflag AS value FROM lineitem UNION ALL SELECT l_orderkey, 'l_linestatus', l_linestatus FROM lineitem
      UNION ALL SELECT l_orderkey, 'l_linenumber', l_linenumber::VARCHAR FROM lineitem) GROUP BY ALL""",
    "consensus_confidence": f"""
WITH {_DAILY_GROUPS}
SELECT item, round, round(CASE WHEN n_votes < 2 OR top * 2 > n_votes OR (top <> second AND top >= 0.85 * n_votes)
  THEN least(top::DOUBLE / n_votes + 0.2 * greatest((24 - round)::DOUBLE / 24, 0), 1.0) ELSE 0 END, 6)::DOUBLE AS confidence FROM decided""",
    "gossip_peers": f"""
WITH {_DAILY}
SELECT o.item, o.model_id, o.key AS own, coalesce(string_agg(p.key, ',' ORDER BY p.seq, p.key), '') AS peers
FROM votes o LEFT JOIN votes p ON p.item = o.item AND p.round = 0 AND p.model_id <> o.model_id WHERE o.round = 0 GROUP BY o.item, o.model_id, o.key""",
    "terms_filter": "SELECT p_partkey, p_name AS term, p_type AS meaning FROM part WHERE contains(lower(p_name), 'eco') OR contains(lower(p_type), 'eco')",
    "terms_filter_page": """
SELECT p_partkey, p_name AS term FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') ORDER BY p_partkey LIMIT 20 OFFSET 20""",
    "terms_total_pages": """
SELECT ceil(count(*) / 20.0)::BIGINT AS total_pages, count(*) AS total FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')""",
    "link_graph_nodes": f"WITH {_PART_LINKS} SELECT id, min(kind) AS kind FROM (SELECT acronym AS id, 'acronym' AS kind FROM links UNION ALL SELECT keyword, 'keyword' FROM links) GROUP BY id",
    "links_page": f"""
WITH {_PART_LINKS}
SELECT acronym, keyword, match_score::DOUBLE AS match_score FROM (SELECT DISTINCT acronym, keyword, round(match_score, 9) AS match_score FROM links) ORDER BY match_score DESC, acronym, keyword LIMIT 15""",
    "document_term_frequency": f"WITH {_CHUNKS}{_ACRONYMS} SELECT doc_id, term, count(*) AS frequency FROM acr GROUP BY ALL",
    "term_details": f"""
WITH {_CHUNKS}{_ACRONYMS}
SELECT doc_id, chunk_index, term, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS excerpt FROM acr JOIN chunks USING (doc_id, chunk_index)""",
    "source_links": """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '/documents/' || p_name || '.PDF#page=' || p_size ELSE p_name || '.txt' END AS link, p_partkey || '_' || p_size AS key FROM part""",
    "principle_from_issue": f"WITH {_ISSUES} SELECT p_partkey, principle, regexp_matches(lower(issue), '{_ACTIONABLE}') AS actionable FROM answers",
    "principle_extract": f"""
WITH {_ISSUES},
l AS (SELECT p_partkey, list_concat(list_concat(
    CASE WHEN length(issue) BETWEEN 10 AND 200 THEN [{{'p': issue, 'i': 0.7::DOUBLE}}] ELSE [] END,
    list_transform(list_filter(['Add ' || issue, issue], lambda x: regexp_matches(lower(x), '{_ACTIONABLE}')), lambda x: {{'p': x, 'i': 0.8::DOUBLE}})),
    [{{'p': principle, 'i': 0.9::DOUBLE}}]) AS l FROM answers)
SELECT p_partkey AS feedback_id, (generate_subscripts(l, 1) - 1)::INTEGER AS place, unnest(l).p AS principle, unnest(l).i AS importance FROM l""",
    "principle_apply": _principle_apply(),
    "prompt_clarify": f"""
WITH {_ISSUES}
SELECT p_partkey, trim(regexp_replace(regexp_replace('Maybe it might ' || issue || ' or PERHAPS  not?', '(?i)\\b(?:{'|'.join(prompts.HEDGES)})\\b', '', 'g'), '\\s+', ' ', 'g')) AS clear,
       replace('Maybe it might ' || issue || ' or PERHAPS  not?', '?', ' with specific details and examples?') AS specific
FROM issues""",
    "principle_dedupe": """
WITH stored AS (SELECT min(p_partkey) AS seq, p_name AS principle, 0.5::DOUBLE AS importance FROM part WHERE p_size <= 10 GROUP BY p_name),
fresh AS (SELECT p_partkey AS seq, CASE WHEN p_size > 30 THEN p_name || ' ' || p_type ELSE p_name END AS principle FROM part WHERE p_size > 10)
SELECT * FROM stored UNION ALL SELECT min(seq), principle, 0.8::DOUBLE FROM fresh ANTI JOIN stored USING (principle) GROUP BY principle""",
    "principle_combine": """
SELECT principle, round(i, 6) AS importance, round(least(i * 1.2, 1.0), 6)::DOUBLE AS boosted
FROM (SELECT p_name AS principle, CASE WHEN p_size > 25 THEN p_size / 50::DOUBLE ELSE p_size / 50::DOUBLE * 0.9 END AS i FROM part)""",
    "alignment_metrics": """
WITH c AS (SELECT user_id, event_id, value / 1000 AS s, value / 1000 - lag(value / 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS ch FROM events)
SELECT user_id AS prompt_id, count(*) AS n_iterations, round(coalesce(avg(ch), 0), 9) AS mean_change,
       round((max(s) - arg_min(s, event_id)) / count(*), 9) AS convergence_rate, round(CASE WHEN count(ch) > 1 THEN 1 / (1 + var_pop(ch)) ELSE 1 END, 9) AS stability
FROM c GROUP BY user_id""",
    "layout_outside_tables": """
SELECT l_suppkey AS doc_id, l_linenumber AS page, l_orderkey, l_partkey, l_quantity AS x0, l_discount * 1000 AS top FROM lineitem
WHERE NOT (l_linenumber <= 4 AND l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_quantity + 1 >= 5 AND l_quantity + 1 < 30 AND l_discount * 1000 + 2 >= 20 AND l_discount * 1000 + 2 < 60)""",
    "batch_flat_map": """SELECT p_partkey, (generate_subscripts(s, 1) - 1)::INTEGER AS "at", unnest(s) AS output FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS key, count(*) AS n FROM events GROUP BY ALL",
    "token_document_counts": f"WITH {_TOKENS} SELECT term AS token, count(DISTINCT doc_id) AS n_documents, sum(len(positions))::BIGINT AS n_occurrences FROM occ GROUP BY term",
    "toc_summary": """
SELECT doc_id, CASE WHEN len(p) > 0 THEN 'Sections: ' || array_to_string(p[1:8], '; ') ELSE '' END AS summary
FROM (SELECT doc_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: trim(x)), lambda x: length(x) < 100)[1:10] AS p FROM documents)""",
    "whole_word_matches": f"""
WITH {_CHUNKS}{_ACRONYMS},
named AS (SELECT DISTINCT lower(term) AS term, doc_id FROM acr),
held AS (SELECT n.term, c.doc_id, c.chunk_index, lower(c.text) AS t FROM named n JOIN chunks c ON c.doc_id = n.doc_id AND contains(lower(c.text), n.term)),
places AS (SELECT *, unnest(range(length(t))) AS pos FROM held)
SELECT term, doc_id, chunk_index, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM places
WHERE substr(t, pos + 1, length(term)) = term AND (pos = 0 OR NOT regexp_matches(substr(t, pos, 1), '[\\pL\\pN\\pM_]')) AND NOT regexp_matches(substr(t, pos + 1 + length(term), 1), '[\\pL\\pN\\pM_]')
GROUP BY term, doc_id, chunk_index""",
    "vector_norms": """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
       substr(md5(array_to_string(list_transform(embedding, lambda x: round_even(x::DOUBLE * 12, 0)::INTEGER::VARCHAR), ',')), 1, 8) AS bucket FROM embeddings""",
    "vote_item_keys": f"""
WITH {_ORDER_LISTS}
SELECT l_orderkey, 'ordered_alike:size_exact_' || len(f) || ':content_' || array_to_string(f[1:floor(len(f) * 0.8)::INTEGER], ':') AS key FROM lists""",
    "information_flow": f"WITH {_DAILY}{_FLOW} SELECT * FROM flow",
    "weighted_votes": f"""
WITH {_DAILY},
g AS (SELECT item, round, key, sum(seq % 3)::BIGINT AS n, min(seq) AS first_seq FROM votes GROUP BY ALL)
SELECT item, round, key AS winner, n AS weight FROM (SELECT *, row_number() OVER (PARTITION BY item, round ORDER BY n DESC, first_seq, key) AS place FROM g) WHERE place = 1""",
    "call_statistics": "SELECT count(*) AS total_calls, sum(round(value)) AS total_duration_ms, round(avg(round(value)), 6) AS avg_duration_ms FROM events",
    "round_metrics": f"""
WITH {_DAILY_GROUPS},
u AS (SELECT item, round, count(DISTINCT key) AS unique_votes, count(*) AS n FROM votes GROUP BY ALL)
SELECT item, round, round(CASE WHEN {_ACHIEVED} THEN 1.0 ELSE 0.6::DOUBLE * (1 - (unique_votes - 1) / (n - 1)::DOUBLE) END, 6)::DOUBLE AS convergence, {_ACHIEVED} AS achieved, n_votes AS n_responses, unique_votes
FROM decided JOIN u USING (item, round)""",
    "consensus_results": f"""
WITH {_DAILY_GROUPS}{_FLOW},
sizes AS (SELECT item, count(DISTINCT round) AS total_rounds, count(*) AS total_model_calls, count(DISTINCT model_id) AS n_models, max(round) AS last FROM votes GROUP BY item),
done AS (SELECT item, {_ACHIEVED} AS achieved FROM decided JOIN sizes USING (item) WHERE round = last),
spread AS (SELECT item, round, key, n, sum(n) OVER w AS whole, max(n) OVER w AS largest FROM groups WINDOW w AS (PARTITION BY item, round)),
alone AS (
  SELECT v.item, string_agg(model_id, ',' ORDER BY v.seq, model_id) AS names, count(*) AS n FROM votes v JOIN sizes s ON s.item = v.item AND v.round = s.last
  JOIN spread g ON g.item = v.item AND g.round = v.round AND g.key = v.key WHERE whole >= 3 AND g.n = 1 AND largest >= 0.7 * whole GROUP BY v.item),
refined AS (SELECT item, count(*) AS total FROM flow GROUP BY item),
r AS (
  SELECT s.*, achieved, CASE WHEN achieved THEN 0 ELSE coalesce(a.n, 0) END AS n, CASE WHEN achieved THEN '' ELSE coalesce(names, '') END AS names, coalesce(total, 0) AS total
  FROM sizes s JOIN done USING (item) LEFT JOIN alone a USING (item) LEFT JOIN refined USING (item))
SELECT item, total_rounds, total_model_calls, n_models, achieved, names AS dissenting, round(n / n_models, 6) AS dissent_rate, total AS total_refinements, round(total / total_rounds, 6) AS avg_refinements,
  CASE WHEN achieved THEN {_formatted(consensus.ACHIEVED_TEXT, "total_rounds", "n_models")}
       ELSE {_formatted(consensus.FAILED_TEXT, "total_rounds", "CASE WHEN n > 0 THEN " + _formatted(consensus.DISSENT_TEXT, "n", "replace(names, ',', ', ')") + " ELSE '' END")} END AS reasoning
FROM r""",
    "document_chunk_order": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, text FROM chunks WHERE doc_id IN (1, 2, 3) ORDER BY doc_id, chunk_index",
    "companions_by_frequency": f"WITH {_KEYWORDS}{_COOC} SELECT term, string_agg(other || ':' || frequency, ',' ORDER BY frequency DESC, other) AS others FROM cooc GROUP BY term",
    "page_tables": "SELECT n_regionkey AS doc_id, sum(n_nationkey % 3)::BIGINT AS n_tables FROM nation GROUP BY 1",
    "related_terms_linked": f"""
WITH {_PART_RELATIONS}
SELECT DISTINCT p_partkey AS result_id, keyword AS term_key FROM part JOIN links ON acronym = p_name
UNION SELECT p_partkey, other FROM part JOIN companions ON term = p_name WHERE rank <= 5 AND other IN (SELECT term_key FROM known)""",
    "term_relations": f"""
WITH {_PART_RELATIONS},
asked AS (SELECT term_key FROM known WHERE term_type = 'keyword'),
linked AS (
  SELECT term_key, related FROM asked JOIN (SELECT acronym AS term_key, keyword AS related FROM links UNION ALL SELECT keyword, acronym FROM links WHERE keyword <> acronym) USING (term_key)
  WHERE related IN (SELECT term_key FROM known)),
near AS (
  SELECT term_key, other AS related, rank FROM asked JOIN companions ON term = term_key
  WHERE rank <= 5 AND other IN (SELECT term_key FROM known) AND (term_key, other) NOT IN (SELECT term_key, related FROM linked))
SELECT term_key, kind, related, row_number() OVER (PARTITION BY term_key ORDER BY kind = 'companion', rank, related) AS place
FROM (SELECT term_key, 'link' AS kind, related, 0 AS rank FROM linked UNION ALL SELECT term_key, 'companion', related, rank FROM near)""",
    "related_terms_three_hops": f"""
WITH RECURSIVE {_PART_RELATIONS},
hop AS (
  SELECT acronym AS term_key, keyword AS other FROM links SEMI JOIN (SELECT term_key FROM known WHERE term_type = 'acronym') k ON k.term_key = acronym
  UNION SELECT keyword, acronym FROM links SEMI JOIN (SELECT term_key FROM known WHERE term_type = 'keyword') k ON k.term_key = keyword
  UNION SELECT term, other FROM companions WHERE rank <= 5),
steps AS MATERIALIZED (SELECT DISTINCT h.term_key, other FROM hop h SEMI JOIN known k ON k.term_key = h.term_key SEMI JOIN known o ON o.term_key = h.other),
reach AS (
  SELECT p_partkey AS result_id, p_name AS term_key, 0 AS hops FROM part WHERE p_partkey % 10 = 0
  UNION SELECT result_id, other, hops + 1 FROM reach r JOIN steps s ON s.term_key = r.term_key WHERE hops < 3)
SELECT result_id, term_key, min(hops)::INTEGER AS hops FROM reach GROUP BY ALL HAVING min(hops) > 0""",
    "search_saved_base": f"""
WITH {_PART_RELATIONS},
q AS (SELECT 'standard polished steel and large brass' AS q),
letters AS (SELECT string_split('abcdefghijklmnopqrstuvwxyz', '') AS l),
v AS (
  SELECT p_partkey::VARCHAR AS chunk_id, p_partkey % 7 AS doc_id, p_size % 3 AS page, lower(p_name || ' ' || p_type) AS t, q,
         list_transform(l, lambda x: (length(lower(p_name || ' ' || p_type)) - length(replace(lower(p_name || ' ' || p_type), x, '')))::DOUBLE) AS a,
         list_transform(l, lambda x: (length(q) - length(replace(q, x, '')))::DOUBLE) AS b
  FROM part, q, letters),
found AS (
  SELECT * FROM (
    SELECT chunk_id AS result_id, doc_id, page, t, q, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 9) AS score FROM v)
  WHERE score >= 0.1 ORDER BY score DESC, result_id LIMIT 25),
prim AS (SELECT result_id, term_key, term_type FROM found JOIN known ON term_key <> '' AND contains(t, lower(term_key))),
rel AS (
  SELECT result_id, keyword AS term_key FROM prim JOIN links ON acronym = term_key WHERE term_type = 'acronym' AND keyword IN (SELECT term_key FROM known)
  UNION SELECT result_id, acronym FROM prim JOIN links ON keyword = term_key WHERE term_type = 'keyword' AND acronym IN (SELECT term_key FROM known)
  UNION SELECT result_id, other FROM prim JOIN companions ON term = term_key WHERE rank <= 5 AND other IN (SELECT term_key FROM known)),
said AS (
  SELECT result_id, (length(q) - length(replace(q, lower(term_key), ''))) // length(term_key) AS n
  FROM (SELECT result_id, term_key FROM prim UNION SELECT result_id, term_key FROM rel), q),
rated AS (SELECT result_id, round(0.7 * sum(n) + 0.3 * count(*), 9) AS relevance FROM said WHERE n > 0 GROUP BY result_id),
media AS (SELECT n_nationkey % 7 AS doc_id, n_regionkey % 2 + 1 AS page, string_agg(n_name, ',' ORDER BY n_name) AS images, string_agg(lower(n_name), ',' ORDER BY lower(n_name)) AS tables FROM nation GROUP BY ALL)
SELECT result_id AS chunk_id, round(score, 6) AS score, round(coalesce(relevance, 0), 6)::DOUBLE AS relevance, round(score * 0.6 + least(coalesce(relevance, 0)::DOUBLE / 10, 0.4), 6) AS combined,
  coalesce((SELECT string_agg(DISTINCT term_key, ',' ORDER BY term_key) FROM prim p WHERE p.result_id = f.result_id), '') AS primary_terms,
  (SELECT count(DISTINCT term_key) FROM rel r WHERE r.result_id = f.result_id)::INTEGER AS n_related,
  coalesce(m.images, '') AS images, coalesce(m.tables, '') AS tables
FROM found f LEFT JOIN rated USING (result_id) LEFT JOIN media m ON m.doc_id = f.doc_id AND m.page = f.page AND f.page <> 0""",
    "search_with_links": f"""
WITH {_PART_RELATIONS},
found AS (SELECT p_partkey AS result_id, lower(p_name || ' ' || p_type) AS t, p_size / 100::DOUBLE AS score FROM part WHERE p_partkey % 50 = 0),
prim AS (SELECT result_id, term_key, term_type FROM found JOIN known ON term_key <> '' AND contains(t, lower(term_key))),
rel AS (
  SELECT result_id, keyword AS term_key FROM prim JOIN links ON acronym = term_key WHERE term_type = 'acronym' AND keyword IN (SELECT term_key FROM known)
  UNION SELECT result_id, acronym FROM prim JOIN links ON keyword = term_key WHERE term_type = 'keyword' AND acronym IN (SELECT term_key FROM known)
  UNION SELECT result_id, other FROM prim JOIN companions ON term = term_key WHERE rank <= 5 AND other IN (SELECT term_key FROM known)),
said AS (
  SELECT result_id, (length(q) - length(replace(q, lower(term_key), ''))) // length(term_key) AS n
  FROM (SELECT result_id, term_key FROM prim UNION SELECT result_id, term_key FROM rel), (SELECT 'standard polished steel and large brass' AS q)),
rated AS (SELECT result_id, round(0.7 * sum(n) + 0.3 * count(*), 9) AS relevance FROM said WHERE n > 0 GROUP BY result_id)
SELECT result_id, round(coalesce(relevance, 0), 6)::DOUBLE AS relevance, round(score * 0.6 + least(coalesce(relevance, 0)::DOUBLE / 10, 0.4), 6) AS combined,
  coalesce((SELECT string_agg(DISTINCT term_key, ',' ORDER BY term_key) FROM prim p WHERE p.result_id = f.result_id), '') AS primary_terms,
  (SELECT count(DISTINCT term_key) FROM rel r WHERE r.result_id = f.result_id)::INTEGER AS n_related
FROM found f LEFT JOIN rated USING (result_id)""",
    "static_vectors": """
WITH w AS (SELECT p_partkey, unnest(list_filter(string_split_regex(lower(p_name), '[^\\pL\\pN]+'), lambda x: x <> '')) AS t FROM part),
m AS (SELECT p_partkey, avg(length(t)) AS x, avg(ascii(t)) AS y, 1.0::DOUBLE AS z FROM w GROUP BY p_partkey)
SELECT p_partkey, round(x / sqrt(x * x + y * y + z * z), 6) AS x, round(y / sqrt(x * x + y * y + z * z), 6) AS y, round(z / sqrt(x * x + y * y + z * z), 6) AS z FROM m""",
    "prompt_builders": """
SELECT p_partkey,
  'Cut this page into passages that can be understood alone. Keep its words and their order.' || chr(10) || chr(10) || substr(p_name, 1, 10) AS chunking,
  'Say whether ' || p_name || ' is a term of these documents, and what it means in them.' || chr(10) || chr(10) || substr('- ' || p_type || chr(10) || '- ' || p_name, 1, 20) AS meaning,
  p_name || chr(10) || chr(10) || 'Round ' || p_size || '. You answered: ' || p_type || chr(10) || chr(10) || 'Others answered:' || chr(10) || 'Answer 1: ' || p_name || chr(10) || 'Answer 2: ' || p_type
    || chr(10) || chr(10) || 'Answer again; keep your answer where theirs don''t convince you.' AS refinement,
  p_size || ' votes end in a tie of two answers.' || chr(10) || chr(10) || 'First: ' || p_name || chr(10) || chr(10) || 'Second: ' || p_type || chr(10) || chr(10)
    || 'Give the better one, or one that is better than both, in the same form.' AS judge
FROM part""",
    "map_reduce": "SELECT p_size, count(DISTINCT w) AS n_words FROM (SELECT p_size, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_size",
}
