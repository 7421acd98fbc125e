"""Quality rules whose thresholds adapt to each language and source.

Every text is measured once. The measures, as whole numbers, go to mergeable quantile sketches: histograms of
fixed log-linear bins (exact below 64, at most 1/32 wide above), so a sketch is a bounded set of (bin, count) and
merging is adding counts, in any order with the same result. A group's sketch is merged with that of its language at
the weight of ``PRIOR`` documents, and this with that of all documents, so a small group's is smoothed and a large
one's is its own, without a size at which this changes.

Both fences of a rule come from the group's sketches. The upper one stands ``SPREADS`` spreads beyond the upper quartile; a spread is the
interquartile range, or, for measures that most documents share, that of the upper tail (from the upper quartile to the 90th
percentile, as far as ``TAIL`` events) or what one event (one symbol, one repeated line, ...) changes in the group's median
document. A share of a whole is fenced at the middle between its 99th percentile and the whole at the latest, so that it can
be beyond. The lower fence stands as many spreads below the lower quartile, at a quarter of the first percentile at the least;
there is none where that is 0. The fences are then joined to the documents.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import scratch_table, text_slices, unused_name

#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"

#: The hard rules: least words, and most repeated words of a hundred.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Documents that a language's sketch counts for in its groups', and that of all documents in a language's.
PRIOR = 40
#: Spreads beyond the quartiles where the fences stand.
SPREADS = 10
#: So many events count at most as the tail's spread; the least part of the first percentile that a lower fence is.
TAIL, LOWEST = 3, 4
#: The rules that are shares of a whole.
SHARES = ("dup_lines", "repeats", "capitals", "marks")
#: Each rule: what is counted, of what, in parts of how many, and how much of it one event adds (a window found twice is six words).
RULES = {
    "symbols": ("n_symbols", "n_words", 1000, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1),
    "repeats": ("n_repeat_words", "n_words", 1000, 6),
    "capitals": ("n_capitals", "n_letters", 1000, 1),
    "shouts": ("n_shouts", "n_words", 1000, 1),
    "marks": ("(word_chars - n_letters)", "word_chars", 1000, 1),
    "word_length": ("word_chars", "n_words", 100, 1),
}
SIZES = ("n_words", "n_lines", "n_letters", "word_chars")
#: A document is so many units of a merged sketch's counts.
_UNIT = 1000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_shouts")
_SCHEMA = ", ".join(f"{m} long" for m in MEASURES)


def _letter_table() -> np.ndarray:
    """For each code point: 1 for a letter, 3 for a capital."""
    kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
    return np.array([(k[0] == "L") + 2 * (k == "Lu") for k in kinds], np.uint8)


def measure(text: str | None, kinds: np.ndarray) -> tuple[int, ...]:
    """The MEASURES of a text; all 0 for a null or empty one."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        times = Counter(triples)
        covered = 0
        for i, t in enumerate(triples):
            if times[t] > 1:
                repeated += i + 3 - max(covered, i)
                covered = i + 3
    kind = kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    spaces = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int(np.count_nonzero(kind)),
        int(np.count_nonzero(kind & 2)),
        raw.count(b"!"),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = _letter_table()
    for batch in batches:
        for part, texts in text_slices(batch, batch.num_columns - 1):
            rows = np.array([measure(t, kinds) for t in texts], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c) for c in rows.T)], names=[*part.schema.names[:-1], *MEASURES])


def rule_measures() -> dict[str, Column]:
    """Each rule's whole number; null where a document has nothing to count in."""
    return {k: F.expr(f"if({of} > 0, {part} * {scale} div {of}, null)") for k, (part, of, scale, _) in RULES.items()}


def bin_of(value: Column) -> Column:
    """The bin of a whole number >= 0: itself below 64, else 32 bins to each power of two."""
    exponent = F.length(F.bin(value)) - 6  # 1 for 64..127
    coarse = exponent * 32 + F.floor(value / F.pow(F.lit(2.0), exponent))
    return F.when(value < 64, value).otherwise(coarse).cast("long")


def bin_top(b: Column) -> Column:
    """The greatest value of a bin."""
    exponent = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise((b - exponent * 32 + 1) * F.pow(F.lit(2.0), exponent) - 1).cast("long")


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rule, bin, n): one mergeable sketch per group and rule, and per group and size."""
    every = {**rule_measures(), **{k: F.when(F.col(k) > 0, F.col(k)) for k in SIZES}}
    values = F.array(*(F.struct(F.lit(k).alias("rule"), bin_of(v).alias("bin")) for k, v in every.items()))
    return measured.select(*by, F.inline(values)).where("bin is not null").groupBy(*by, "rule", "bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))


def smooth(sketches: DataFrame, wider: DataFrame, by: list[str], wider_by: list[str]) -> DataFrame:
    """sketches, in units, with their wider group's sketch merged in at the weight of PRIOR documents."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*wider_by, "rule"))
    prior = wider.select(*wider_by, "rule", "bin", F.floor(share * (PRIOR * _UNIT)).cast("long").alias("n"))
    prior = sketches.select(*by, "rule").distinct().join(prior, [*wider_by, "rule"])
    own = sketches.select(*by, "rule", "bin", (F.col("n") * _UNIT).alias("n"))
    return merge(own.unionByName(prior.select(*by, "rule", "bin", "n")), by)


#: Percentiles that fences are made of.
PERCENTILES = (1, 25, 50, 75, 90, 99)


def quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rule, q1, q25, ..., q99) of each sketch; a quantile is the greatest value of the bin that it falls into."""
    group = Window.partitionBy(*by, "rule")
    run = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, bin_top(F.col("bin")))).alias(f"q{p}") for p in PERCENTILES]
    return run.groupBy(*by, "rule").agg(*at)


def thresholds(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, fences map<rule, struct<low, high>>): the least and greatest value that a document of the group may have."""
    own = scratch_table(sketch(measured, [lang, source]), "sketches")
    of_lang = smooth(merge(own, [lang]), merge(own, []), [lang], [])
    of_group = scratch_table(quantiles(smooth(own, of_lang, [lang, source], [lang]), [lang, source]), "quantiles")
    size = of_group.where(F.col("rule").isin(*SIZES)).select(lang, source, F.col("rule").alias("of"), F.col("q50").alias("median"))
    about = F.create_map(*(F.lit(x) for k, (_, of, _, _) in RULES.items() for x in (k, of)))
    event = F.create_map(*(F.lit(x) for k, (_, _, scale, events) in RULES.items() for x in (k, scale * events)))
    whole = F.create_map(*(F.lit(x) for k in SHARES for x in (k, RULES[k][2])))
    rules = of_group.where(F.col("rule").isin(*RULES)).withColumns({"of": about[F.col("rule")], "events": event[F.col("rule")], "whole": F.try_element_at(whole, F.col("rule"))})
    sized = rules.join(size, [lang, source, "of"]).withColumn("event", F.expr("(events + median - 1) div median"))
    spread = SPREADS * F.greatest(F.col("q75") - F.col("q25"), F.least(F.col("q90") - F.col("q75"), TAIL * F.col("event")), F.col("event"), F.expr("q75 div 32"))
    high = F.least(F.col("q75") + spread, F.expr("(q99 + whole) div 2"))  # least passes over a null
    low = F.greatest(F.col("q25") - spread, F.expr(f"q1 div {LOWEST}"))
    fences = sized.select(lang, source, "rule", F.struct(low.alias("low"), high.alias("high")).alias("fence"))
    return fences.groupBy(lang, source).agg(F.map_from_entries(F.collect_list(F.struct("rule", "fence"))).alias("fences"))  # one entry a rule


def quality_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with MEASURES, base_failed, failed_rules and kept.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEATED of a hundred words repeated. failed_rules: the
    rules whose fences the document is beyond. kept: neither. Null texts count as empty and fail. Null languages and
    sources are groups of their own ("" joins them). Repeated rows count each time and get equal verdicts. An empty
    table gives an empty result. Columns of docs with the names of new ones are replaced. A sketch has at most some hundred
    bins per rule, whatever the number of its documents. Very long texts are measured whole.
    """
    new = {*MEASURES, "base_failed", "failed_rules", "kept"}
    keep = [c for c in (keep or docs.columns) if c.lower() not in new]
    lang, source, words = (unused_name(docs, x) for x in ("lang_", "source_", "text_"))
    rows = docs.select(*keep, F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias(lang), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias(source), F.col(text_col).alias(words))
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    measured = scratch_table(rows.mapInArrow(_measured, f"{carried}, {_SCHEMA}"), "measured")
    fences = scratch_table(thresholds(measured, lang, source), "fences")  # its size is known: broadcast if small, else hot groups can be split
    judged = measured.join(fences, [lang, source], "left")  # no fences where all of a group's documents are empty
    beyond = (F.when((v > F.col("fences")[k]["high"]) | (v < F.col("fences")[k]["low"]), F.lit(k)) for k, v in rule_measures().items())
    failed = F.filter(F.array(*beyond), lambda x: x.isNotNull())
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = judged.withColumn("base_failed", base).withColumn("failed_rules", failed)
    return judged.select(*keep, *MEASURES, "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with docs' columns.

    Verdicts are joined back by a hash of the text, language and source, on which alone they depend.
    """
    names = [unused_name(docs, x) for x in ("h1", "h2")]
    of_row = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col)]
    keyed = docs.withColumns({names[0]: F.xxhash64(*of_row), names[1]: F.xxhash64(F.lit(13), *of_row)})
    verdicts = quality_verdicts(keyed, text_col, lang_col, source_col, keep=names)
    gone = verdicts.where(~F.col("kept")).select(*names).distinct()
    return keyed.join(gone, names, "left_anti").select(*(keyed[c] for c in docs.columns))
