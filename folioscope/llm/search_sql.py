"""DuckDB SQL of ranked lexical search and of vector codes, by plain comparison of everything that is asked for."""

from __future__ import annotations

from folioscope.llm import vector_codes, wand_search

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

WAND_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
words AS (SELECT rid, doc_id, unnest({_WORDS}) AS term FROM d WHERE text IS NOT NULL),
tf AS (SELECT rid, doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
sizes AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_words FROM sizes),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, totals),
lengths AS (SELECT rid, {100 - wand_search.LENGTH} + (({wand_search.LENGTH} * n * n_docs) // n_words) AS m FROM sizes, totals),
asked AS (SELECT DISTINCT i, item_id, unnest({_WORDS}) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark WHERE text IS NOT NULL)),
scores AS (
  SELECT i, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + {wand_search.SATURATION} * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (rid) GROUP BY i, item_id, rid, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= {wand_search.TOP}
"""


def vector_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    assign = """
near{r} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, apart * 1024 + entry) AS entry, min(apart) AS apart FROM (
    SELECT v.rid, v.part, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS apart
    FROM parts v JOIN book{r} b USING (part)) GROUP BY rid, part)"""
    move = """
book{next} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS x FROM (
      SELECT part, entry, i, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS mean FROM (
        SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM parts JOIN near{r} USING (rid, part)) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))"""
    steps = ",".join(assign.format(r=r) + "," + move.format(r=r, next=r + 1) for r in range(rounds)) + "," + assign.format(r=rounds)
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS part)),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM parts WHERE rid <= {entries}),{steps},
codes AS (SELECT rid, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(apart)::BIGINT AS error FROM near{rounds} GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (rid), digest
"""
