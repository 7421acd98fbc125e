"""The corpus operators as queries over the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import context_tree, language_id, line_dedup, mixing, packing, personal_data, personal_data_sql, quality_rules, search_sql, simhash_golay, spotsigs, token_counts, toxicity, vector_codes, wand_search
from folioscope.llm.common import read_table, remainder


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_golay.simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.train(*toxicity.labelled_sample(docs, labels.where(~held_out)))
    return toxicity.score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.vocabulary(vocabulary_file("piece_bpe_32k.model"), bare_mark=True)
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), pieces, keep=["doc_id"])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    samples = language_id.labelled_samples(docs.where(~held_out))
    return language_id.identify_languages(docs, samples, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(docs, vocabulary_file("word_bpe_49k.json"), keep=["doc_id"], with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    scored = context_tree.score_texts(docs, ~held_out).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.quality_verdicts(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    rules = F.array_join("failed_rules", ",").alias("failed_rules")
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", rules)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(read_table(spark, sf_dir, "documents"))
    spans = F.array_sort(F.concat("base", F.transform("found", lambda s: s.dropFields("score"))))
    counts = [F.size(F.filter("base", personal_data.of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(personal_data.KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(personal_data.span_list(F.col("base")), 256).alias("base_sha256"), personal_data.span_list(spans).alias("spans"))


def op12_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(read_table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_spotsigs, op2_line_dedup, op3_simhash_golay, op4_toxicity, op5_token_counts, op6_language_id, op7_mixing, op8_packing, op9_context_tree, op10_quality_rules, op11_personal_data, op12_wand, op13_vector_codes)
    return {f.__name__: f for f in every}


_LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
worded AS (
  SELECT doc_id, text, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines
  WHERE trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
windows AS (
  SELECT doc_id, text, pos AS p0, lead(pos, 1) OVER w AS p1, lead(pos, 2) OVER w AS p2,
         line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS passage
  FROM worded WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
later AS (
  SELECT * FROM (SELECT *, rank() OVER (PARTITION BY passage ORDER BY doc_id, text, p0) AS nth FROM windows WHERE p2 IS NOT NULL) WHERE nth > 1),
gone AS (
  SELECT DISTINCT doc_id, text, unnest([p0, p1, p2]) AS pos FROM later)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(g.n, 0) AS n_removed
FROM documents d
LEFT JOIN (
  SELECT l.doc_id, l.text AS old, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l ANTI JOIN gone USING (doc_id, text, pos) GROUP BY ALL) k ON k.doc_id = d.doc_id AND k.old = d.text
LEFT JOIN (SELECT doc_id, text, count(*) AS n FROM gone GROUP BY ALL) g ON g.doc_id = d.doc_id AND g.text = d.text
"""

_MIXING_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS size FROM documents GROUP BY source),
raised AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size::DOUBLE, {mixing.TEMPERATURE}) ELSE 0 END AS raw FROM sizes),
rates AS (
  SELECT source, round(CASE WHEN size > 0 THEN raw / (SELECT sum(raw) FROM raised) * (SELECT sum(size) FROM raised)::DOUBLE / size ELSE 1 END, 12) AS rate
  FROM raised),
chances AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS chance, exp(-rate) AS upto FROM rates
  UNION ALL
  SELECT source, rate, k + 1, chance * rate / (k + 1), upto + chance * rate / (k + 1) FROM chances
  WHERE k + 1 < ceil(rate + 12 * sqrt(rate) + 40)),
placed AS (
  SELECT d.*, r.rate, ('0x' || substr(md5('{mixing.SEED}/' || doc_id || '/' || md5(coalesce(text, ''))), 1, 13))::BIGINT / pow(2, 52) AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
counted AS (
  SELECT p.doc_id, p.text, p.lang, p.source, p.n_chars, p.rate, count(c.k)::INTEGER AS copies
  FROM placed p LEFT JOIN chances c ON p.source IS NOT DISTINCT FROM c.source AND p.u >= c.upto GROUP BY ALL),
copied AS (SELECT doc_id, text, lang, source, n_chars, rate, unnest(range(copies))::INTEGER AS replica FROM counted)
SELECT *, ('0x' || substr(md5('{mixing.SEED + 1}/' || doc_id || '/' || md5(coalesce(text, '')) || '/' || replica), 1, 13))::BIGINT / pow(2, 52) AS shuffle_key
FROM copied
"""

_SPACE_SQL = r"'[\x20\x09-\x0D]'"
_QUALITY_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
split AS (
  SELECT rid, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda l: trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS lines
  FROM d),
placed AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
windows AS (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS win FROM placed WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1),
covered AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, {_SPACE_SQL}, '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_capitals,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts
  FROM d JOIN split USING (rid) LEFT JOIN covered c USING (rid)),
v AS (
  SELECT rid, lang, source, unnest([{", ".join(f"{{'rule': '{k}', 'v': CASE WHEN {of} > 0 THEN {part} * {scale} // {of} END}}" for k, (part, of, scale, _) in quality_rules.RULES.items())},
    {", ".join(f"{{'rule': '{k}', 'v': nullif({k}, 0)}}" for k in quality_rules.SIZES)}], recursive := true)
  FROM m),
tops AS (
  SELECT *, CASE WHEN v < 64 THEN v ELSE ((v // (1 << e) + 1) * (1 << e) - 1) END AS top
  FROM (SELECT *, CASE WHEN v < 64 THEN 0 ELSE length(ltrim(bin(v), '0')) - 6 END AS e FROM v WHERE v IS NOT NULL)),
own AS (SELECT lang, source, rule, top, count(*) AS n FROM tops GROUP BY ALL),
every AS (SELECT rule, top, sum(n) AS n FROM own GROUP BY ALL),
prior_lang AS (SELECT rule, top, floor(n::DOUBLE / (sum(n) OVER (PARTITION BY rule))::DOUBLE * {quality_rules.PRIOR * 1000})::BIGINT AS n FROM every),
of_lang AS (
  SELECT lang, rule, top, sum(n) AS n FROM (
    SELECT lang, rule, top, n * 1000 AS n FROM own
    UNION ALL SELECT lang, rule, top, n FROM (SELECT DISTINCT lang, rule FROM own) JOIN prior_lang USING (rule)) GROUP BY ALL),
prior AS (SELECT lang, rule, top, floor(n::DOUBLE / (sum(n) OVER (PARTITION BY lang, rule))::DOUBLE * {quality_rules.PRIOR * 1000})::BIGINT AS n FROM of_lang),
of_group AS (
  SELECT lang, source, rule, top, sum(n) AS n FROM (
    SELECT lang, source, rule, top, n * 1000 AS n FROM own
    UNION ALL SELECT lang, source, rule, top, n FROM (SELECT DISTINCT lang, source, rule FROM own) JOIN prior USING (lang, rule)) GROUP BY ALL),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY top) AS upto, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM of_group),
quartiles AS (
  SELECT lang, source, rule, {", ".join(f"min(top) FILTER (upto * 100 >= total * {p}) AS q{p}" for p in quality_rules.PERCENTILES)}
  FROM run GROUP BY ALL),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{of}', {scale * events}, {scale if k in quality_rules.SHARES else 'NULL'})" for k, (_, of, scale, events) in quality_rules.RULES.items())}) AS t(rule, of_size, events, whole)),
fences AS (
  SELECT lang, source, rule, greatest(q25 - spread, q1 // {quality_rules.LOWEST}) AS low, least(q75 + spread, (q99 + whole) // 2) AS high FROM (
    SELECT *, {quality_rules.SPREADS} * greatest(q75 - q25, least(q90 - q75, {quality_rules.TAIL} * event), event, q75 // 32) AS spread FROM (
      SELECT q.*, whole, (events + s.q50 - 1) // s.q50 AS event
      FROM quartiles q JOIN rules USING (rule) JOIN quartiles s ON s.lang = q.lang AND s.source = q.source AND s.rule = of_size))),
failed AS (
  SELECT rid, string_agg(rule, ',' ORDER BY list_position([{", ".join(f"'{k}'" for k in quality_rules.RULES)}], rule)) AS rules
  FROM v JOIN fences USING (lang, source, rule) WHERE v > high OR v < low GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words) AND rules IS NULL AS kept,
       coalesce(rules, '') AS failed_rules
FROM m LEFT JOIN failed USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _LINE_DEDUP_SQL, "op7_mixing": _MIXING_SQL, "op10_quality_rules": _QUALITY_SQL, "op11_personal_data": personal_data_sql.personal_data_sql(), "op12_wand": search_sql.WAND_SQL, "op13_vector_codes": search_sql.vector_sql()}
