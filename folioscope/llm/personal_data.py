"""Personal data by bootstrapped contextual extraction: DataFrame functions only.

Seeds are what the four base patterns find (email, ip, card, phone). Candidates are other strings that look like
identifiers: of 5 to 64 characters, with two digits or an @. A lexical pattern is what stands before a string: its last word, or its last
two. The graph joins patterns to the distinct strings that they precede. In each round a pattern's confidence is the
share of known strings of one kind among all distinct strings that it precedes anywhere in the collection (ordinary
words too), and a candidate's score is the greatest confidence of its patterns. Candidates that reach CONFIDENCE become
known, which raises other patterns and gives new ones; the rounds end when nothing new is found.

Scores are whole thousandths, so they don't depend on the order of rows. A pattern's strings are counted from distinct pairs
and partly aggregated before each shuffle; joins on patterns or strings deal frequent keys to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.arrays import matches
from folioscope.functions.text import let
from folioscope.llm.common import drop_scratch, scratch_table
from folioscope.llm.components import join_hot

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs SUPPORT known strings and CONFIDENCE thousandths; so many rounds at most.
SUPPORT, CONFIDENCE, ROUNDS = 3, 600, 4
SHORTEST, LONGEST, DIGITS = 5, 64, 2
#: Up to so many patterns are sent to all tasks (8 bytes each); more are joined by a shuffle.
SENT = 500_000

# The base patterns, with possessive repeats and starts that can't lie within a run, so that a text is read in linear time.
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IN_WORD = r"[A-Za-z0-9._%+@:/#()-]"
CANDIDATE = rf"(?:\G|(?<!{_IN_WORD}))(?=[A-Za-z._%+:/#()-]*+[0-9@]){_IN_WORD}++(?: [(]?+[0-9][0-9().-]*+)*+"
#: What a candidate sheds at its ends, and a word of a context.
_BEFORE, _AFTER = "._%@:/#)-", "._%+@:/#(-"
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-"
_SPACE = r"[\x20\x09-\x0D]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _no_digits(x: Column) -> Column:
    return F.translate(x, "0123456789", "")


def _n_digits(x: Column) -> Column:
    return F.length(x) - F.length(_no_digits(x))


def _luhn(digits: Column) -> Column:
    worth = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_card(x: Column) -> Column:
    return let(F.translate(x, " -", ""), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))


def _is_ip(x: Column) -> Column:
    return x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")


def _is_phone(x: Column) -> Column:
    return _n_digits(x).between(8, 15)


def base_spans(text: Column) -> Column:
    """array<struct<kind int, start long, end long>> by kind, then start; kind is an index of KINDS."""

    def of(kind: int, pattern: str, hint: Column, test=None) -> Column:
        found = matches(text, pattern)
        if test is not None:
            found = F.filter(found, lambda m: test(m["found"]))
        spans = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"], m["end"]))
        return F.when(hint, spans).otherwise(F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))

    return F.concat(
        of(0, EMAIL, F.contains(text, F.lit("@"))), of(1, IP, text.rlike(r"[0-9]\.[0-9]"), _is_ip),
        of(2, CARD, text.rlike(r"[0-9]"), _is_card), of(3, PHONE, F.contains(text, F.lit("+")), _is_phone),
    )


def seed_kind(found: Column) -> Column:
    """Index of the kind of a string that is personal data by itself; null for others."""
    return (
        F.when(found.rlike(f"^{_LOCAL}++@{_DOMAIN}++(?:\\.{_DOMAIN}++)++$"), 0)
        .when(_is_ip(found), 1)
        .when(found.rlike(f"^{CARD}$") & _is_card(found), 2)
        .when(found.rlike(rf"^{PHONE}$") & _is_phone(found), 3)
    )


def _context_word(word: Column) -> Column:
    return F.btrim(word, F.lit(_EDGES))


def _keys(words: Column, j: Column) -> Column:
    """Keys of the patterns before position j of an array of context words: of the last word, and of the last two. Blank words give none."""
    one, two = F.get(words, j - 1), F.get(words, j - 2)
    keys = F.array(F.when(one != "", F.xxhash64(F.lit(1), one)), F.when((one != "") & (two != ""), F.xxhash64(F.lit(2), two, one)))
    return F.filter(keys, lambda k: k.isNotNull())


def candidates(text: Column) -> Column:
    """array<struct<start, end, found, kind, patterns array<long>>> of the strings that look like identifiers, seeds (with their kind) among them."""

    def trimmed(m: Column) -> Column:
        short = F.length(m["found"]) <= LONGEST + 16
        shed = F.when(short, F.length(m["found"]) - F.length(F.ltrim(m["found"], F.lit(_BEFORE)))).otherwise(0)
        found = F.when(short, F.rtrim(F.ltrim(m["found"], F.lit(_BEFORE)), F.lit(_AFTER)))
        start = m["start"] + shed
        # the text before, without quotes and the like that touch the string; a letter or digit there glues it to a word
        before = F.translate(F.right(m["before"], F.lit(96)), _CAPITALS, _SMALL)
        words = F.split(F.regexp_replace(before, r"[^\x20\x09-\x0D\p{L}\p{N}]*$", ""), _SPACE)
        # the first word may be cut, or belong to the match before: it counts only at the start of the text
        whole = F.when((F.length(m["before"]) <= 96) & (m["start"] == F.length(m["before"])), words).otherwise(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
        last = F.transform(F.filter(whole, lambda w: w != ""), _context_word)
        keys = F.when(F.element_at(words, -1) == "", let(last, lambda w: _keys(w, F.size(w)))).otherwise(F.array().cast("array<long>"))
        return F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("found"), seed_kind(found).alias("kind"), keys.alias("patterns"))

    def like(m: Column) -> Column:
        return m["found"].isNotNull() & F.length(m["found"]).between(SHORTEST, LONGEST) & ((_n_digits(m["found"]) >= DIGITS) | m["found"].rlike("[A-Za-z0-9]@[A-Za-z0-9]"))

    found = F.filter(F.transform(matches(text, CANDIDATE), trimmed), like)
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string,kind:int,patterns:array<bigint>>>"))


def _slots(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, filler): the words that follow each of the patterns, wherever they stand, and don't look like identifiers."""
    words = F.split(F.btrim(F.translate(F.coalesce("text", F.lit("")), _CAPITALS, _SMALL), F.lit(" \t\n\x0b\x0c\r")), _SPACE)
    led = texts.select(F.concat(F.array(F.lit("")), words).alias("w"))
    # three arrays side by side, so that the rest is compiled: lambdas over every word would be interpreted
    threes = led.select(F.explode(F.arrays_zip(F.col("w").alias("two"), F.slice("w", 2, F.size("w")).alias("one"), F.slice("w", 3, F.size("w")).alias("filler"))).alias("t")).select("t.*")
    one, two = _context_word(F.col("one")), _context_word(F.col("two"))
    keyed = threes.where("filler is not null").select(
        F.when(one != "", F.xxhash64(F.lit(1), one)).alias("k1"), F.when((one != "") & (two != ""), F.xxhash64(F.lit(2), two, one)).alias("k2"), "filler"
    )
    known = patterns.select("pattern")
    if known.count() <= SENT:
        for k, p in (("k1", "p1"), ("k2", "p2")):
            keyed = keyed.join(F.broadcast(known.select(F.col("pattern").alias(p))), F.col(k) == F.col(p), "left")
        slots = keyed.where("p1 is not null or p2 is not null").select(F.explode(F.array("p1", "p2")).alias("pattern"), "filler").where("pattern is not null")
    else:
        slots = keyed.select(F.explode(F.array("k1", "k2")).alias("pattern"), "filler").where("pattern is not null").distinct()
        slots = join_hot(slots, known, "pattern", "filler")
    ordinary = slots.where(~F.contains("filler", F.lit("@")) & ((_n_digits(F.col("filler")) < DIGITS) | (F.length("filler") < SHORTEST)))
    return ordinary.select("pattern", _context_word(F.col("filler")).alias("filler"))


def _ordinary(texts: DataFrame, patterns: DataFrame, confidence: int) -> DataFrame:
    """(pattern, n_ordinary): the number of distinct other words that follow each of patterns(pattern, n), where n candidates do.

    Patterns that can't reach the confidence even if all their candidates become known are left out: a first pass sets one bit of
    256 for each word, and so many bits are at most the number of words. The second one counts the rest exactly.
    """
    bit = F.pmod(F.xxhash64("filler"), F.lit(256))
    masks = [F.coalesce(F.bit_or(F.when(F.floor(bit / 64) == i, F.expr("shiftleft(1L, cast(pmod(xxhash64(filler), 64) as int))"))), F.lit(0)) for i in range(4)]
    least = _slots(texts, patterns).groupBy("pattern").agg(sum(map(F.bit_count, masks)).alias("least"))
    open_ = patterns.join(least, "pattern", "left").where(1000 * F.col("n") >= confidence * (F.col("n") + F.coalesce("least", F.lit(0)))).select("pattern", "n")
    open_ = scratch_table(open_, "open")
    if open_.isEmpty():
        return open_.select("pattern", F.lit(0).cast("long").alias("n_ordinary"))
    counts = _slots(texts, open_).distinct().groupBy("pattern").agg(F.count("*").alias("c"))
    return open_.join(counts, "pattern", "left").select("pattern", F.coalesce("c", F.lit(0)).cast("long").alias("n_ordinary"))


def _supported(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, kind, score): patterns with SUPPORT known strings of a kind, and the sum of the strings' scores; one kind a pattern."""
    scored = join_hot(edges.select("pattern", "found"), known, "found", "pattern")
    per = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    return per.groupBy("pattern").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("pattern", (-F.col("b.k")).alias("kind"), "b.score")


def bootstrap(edges: DataFrame, texts: DataFrame, rounds: int = ROUNDS, confidence: int = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """edges(pattern, found, kind), distinct, with null kinds for unknown strings; texts(text) -> (known, patterns).

    known(found, kind, score): seeds with 1000, discovered strings with the confidence of their best pattern.
    patterns(pattern, kind, confidence): those that reached the least confidence in the last round.
    """
    spark = edges.sparkSession
    size = scratch_table(edges.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    known = scratch_table(edges.where("kind is not null").groupBy("found").agg(F.min("kind").alias("kind"), F.lit(1000).cast("long").alias("score")), "known")
    if edges.where("kind is null").isEmpty():
        rounds = 0
    counted, ordinary = spark.createDataFrame([], "pattern long"), spark.createDataFrame([], "pattern long, n_ordinary long")
    patterns = spark.createDataFrame([], "pattern long, kind int, confidence long")
    for _ in range(rounds):
        supported = scratch_table(_supported(edges, known), "supported")
        fresh = scratch_table(supported.select("pattern").join(counted, "pattern", "left_anti").join(size, "pattern"), "fresh")
        if not fresh.isEmpty():
            counted = counted.unionByName(fresh.select("pattern"))
            ordinary = scratch_table(ordinary.unionByName(_ordinary(texts, fresh, confidence)), "ordinary")
        sure = supported.join(ordinary, "pattern").join(size, "pattern").select("pattern", "kind", F.floor(F.col("score") / (F.col("n") + F.col("n_ordinary"))).alias("confidence"))
        patterns = scratch_table(sure.where(F.col("confidence") >= confidence), "patterns")
        reached = join_hot(edges.where("kind is null").select("pattern", "found"), patterns, "pattern", "found")
        best = reached.groupBy("found").agg(F.max(F.struct(F.col("confidence").alias("score"), (-F.col("kind")).alias("k"))).alias("b"))
        found = scratch_table(best.select("found", (-F.col("b.k")).alias("kind"), "b.score"), "reached")
        now = scratch_table(known.where("score = 1000").unionByName(found.where("score < 1000")).unionByName(found.where("score >= 1000").withColumn("score", F.lit(999).cast("long"))), "known")
        settled = now.where("score < 1000").exceptAll(known.where("score < 1000")).isEmpty()
        drop_scratch(known, supported, found)
        known = now
        if settled:
            break
    return known, patterns


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, confidence: int = CONFIDENCE) -> DataFrame:
    """One row per document: (id, base array<struct<kind, start, end>>, found array<struct<kind, start, end, score>>).

    base: the base patterns' spans by kind and start, kind being an index of KINDS; found: what the contexts add, by kind and start, never over a base
    span. Positions are code points, the end exclusive. Null and empty texts have none; repeated rows and ids, and null
    ids, are rows of their own; an empty table gives no rows. Texts of any length are read whole, in time
    in proportion to their length, and aren't kept. Other columns, whatever their names, aren't read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = scratch_table(texts.select(F.monotonically_increasing_id().alias("row"), "id", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("candidates")), "spans")
    each = rows.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "found", "kind").distinct()
    edges = scratch_table(edges, "edges")
    known, _ = bootstrap(edges, texts.select("text"), rounds, confidence)
    new = known.where("score < 1000")
    occurrences = join_hot(each.where("kind is null").select("row", "start", "end", "found"), new, "found", "row").select("row", "start", "end", "kind", "score")
    occurrences = scratch_table(occurrences, "occurrences")
    near = rows.join(occurrences.select("row").distinct(), "row", "left_semi").select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end", "b.kind", F.lit(None).cast("long").alias("score"))
    line = Window.partitionBy("row").orderBy("start", F.col("score").isNotNull())
    is_base = F.col("score").isNull()
    before = F.max(F.when(is_base, F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))
    free = occurrences.unionByName(near).withColumns({"before": before, "after": after}).where(~is_base)
    free = free.where((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))
    added = free.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "score"))).alias("found"))  # of one text
    added = scratch_table(added, "added")
    drop_scratch(edges, occurrences)
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,score:bigint>>")
    return rows.select("row", "id", "base").join(added, "row", "left").select("id", "base", F.coalesce("found", none).alias("found"))


def of_kind(kind: int):
    return lambda s: s["kind"] == kind


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, with commas between."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
