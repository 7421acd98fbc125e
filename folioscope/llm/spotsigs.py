"""Document fingerprints from spot signatures, and near-duplicate groups found through them.

DataFrame functions only. A signature is an anchor (a common word) with the chain of the content words that follow
it; the set of a text's hashed signatures is what texts are compared by (Jaccard), and a digest of the set is the
text's fingerprint. Texts are lower-cased and cut at everything but letters and digits.

Between anchors stand content words only, so the content words before the r-th anchor at position p number p - r:
each chain is read off the array of content words by index, in one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from folioscope.llm.common import scratch_table, text_key
from folioscope.llm.components import connected_components

#: Common words of English, French, German and Spanish.
ANCHORS = tuple(
    """the of and to in is that it was for on with as be by this are at from or an a
    le la les de des du et en un une que est pour dans qui sur pas
    der die und den von zu das mit ist im ein eine nicht
    el los las del y se por con para al es no""".split()
)
CHAIN = 2
#: Quantiles of the ids by which documents are dealt out.
CELLS = 128
#: Up to so many heads of blocks are sent to all tasks, which pick out their texts; more are joined by a shuffle.
SENT = 1_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """The set of signatures (array of long, sorted) of a text.

    A text too short or too odd to have a signature gets one of its whole words; one without words (or null) gets
    one signature too, so no set is empty.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    return _let(words, lambda w: _of_words(w, anchors, chain))


def _of_words(words: Column, anchors: tuple[str, ...], chain: int) -> Column:
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*anchors), i)), lambda i: i.isNotNull())
    content = F.filter(words, lambda w: ~w.isin(*anchors))
    return _let(F.struct(words.alias("w"), places.alias("p"), content.alias("c")), lambda t: _chains(t["w"], t["p"], t["c"], chain))


def _chains(words: Column, places: Column, content: Column, chain: int) -> Column:
    last = F.size(content) - chain
    found = F.transform(places, lambda p, r: F.when(p - r <= last, F.xxhash64(F.get(words, p), *(F.get(content, p - r + k) for k in range(chain)))))
    found = F.filter(found, lambda h: h.isNotNull())
    return _let(found, lambda f: F.when(F.size(f) > 0, F.sort_array(F.array_distinct(f))).otherwise(F.array(F.xxhash64(F.lit(3), words))))


def digest(sigs: Column) -> Column:
    """128 bits of a sorted signature set, as 32 lowercase hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(sigs), F.xxhash64(F.lit(5), sigs)))))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two signature sets."""
    return _let(F.size(F.array_intersect(a, b)), lambda common: common / (F.size(a) + F.size(b) - common))


def _block_of(docs: DataFrame, id_col: str, rows_per_block: int) -> tuple[Column, Column]:
    """(cell, block) of an id, the second given the first: neighbouring ids are dealt to blocks of about that many rows.

    Cells are equal shares of the rows (quantiles of the ids, at most CELLS), so a gap in the ids is one cell's matter;
    a cell of numbers is cut into blocks of equal width. Null ids have cell and block -1.
    """
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
    parts = max(1, min(CELLS, known.count() // rows_per_block))
    cells = known.repartitionByRange(parts, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    cells = sorted((r["low"], r["high"], r["n"]) for r in cells.collect())  # at most CELLS rows
    numeric = isinstance(known.schema["id"].dataType, NumericType)

    def cell(first: int, last: int) -> Column:  # a binary search: the last cell that begins at the id or before
        if first >= last:
            return F.lit(first)
        middle = (first + last + 1) // 2
        return F.when(F.col("id") < F.lit(cells[middle][0]), cell(first, middle - 1)).otherwise(cell(middle, last))

    widths = [max(1, n // rows_per_block) if numeric else 1 for _, _, n in cells]
    starts = list(accumulate(widths, initial=0))
    number = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(cell(0, len(cells) - 1) if cells else F.lit(-1))
    block = F.col("cell").cast("long")
    if numeric and cells:

        def of_cell(values: list, kind: str) -> Column:
            return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cell"))

        low, high, width = of_cell([c[0] for c in cells], "double"), of_cell([c[1] for c in cells], "double"), of_cell(widths, "long")
        within = F.floor((F.col("id").cast("double") - low) * width / (high - low + 1.0))
        block = of_cell(starts[:-1], "long") + F.greatest(F.lit(0), F.least(width - 1, within))
    return number, F.coalesce(block, F.lit(-1)).cast("long")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 256) -> DataFrame:
    """(id, text, next_text): next is the document with the next smaller id, and the greatest after the least.

    Null texts are empty. Ids of any type that has an order are dealt to blocks of neighbouring ids (see _block_of); within
    a block next is the following row, and the least of a block is followed by the head of the next lower one, found on
    one row per block. Rows that share an id follow each other in the order of a hash of their text; null ids come last.
    """
    cell, block = _block_of(docs, id_col, rows_per_block)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("cell", cell).withColumn("block", block)
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    # the head of a block: its greatest id and, among ties, the least hash; its text is looked up by both
    hashed = rows.select("id", F.xxhash64("text").alias("h"), "cell", "block")
    top = hashed.groupBy("cell", "block").agg(F.max("id").alias("id"))
    of_top = hashed.join(top.withColumnsRenamed({"block": "of_block", "id": "top_id"}).drop("cell"), F.col("block") == F.col("of_block"))
    heads = of_top.where(F.col("id").eqNullSafe(F.col("top_id"))).groupBy("cell", "block").agg(F.min("h").alias("h"), F.first("id").alias("id"))
    heads = scratch_table(heads, "heads")
    # the next lower block of the cell, or the highest one of the next lower cell, of which there are at most CELLS
    highest = sorted((r["cell"], r["top"]) for r in heads.groupBy("cell").agg(F.max("block").alias("top")).collect())
    below = {c: highest[i - 1][1] for i, (c, _) in enumerate(highest)}
    lower = F.lead("block").over(Window.partitionBy("cell").orderBy(F.col("block").desc()))
    down = F.create_map(*(F.lit(x) for pair in below.items() for x in pair))[F.col("cell")] if below else F.lit(None)
    ring = heads.select("block", F.coalesce(lower, down.cast("long")).alias("goes_to"))
    asked = heads.select(F.col("block").alias("goes_to"), F.col("h").alias("head_h"), F.col("id").alias("head_id"))
    if heads.count() <= SENT:  # else all texts would be shuffled to find these
        asked = F.broadcast(asked)
    texts = rows.withColumn("h", F.xxhash64("text")).join(asked, F.col("block") == F.col("goes_to"))
    texts = texts.where(F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))).groupBy("goes_to").agg(F.min("text").alias("head"))
    after = scratch_table(ring.join(texts, "goes_to").select("block", "head"), "after")
    rows = rows.withColumn("following", F.lead("text").over(Window.partitionBy("block").orderBy(*order)))
    return rows.join(after, "block", "left").select("id", "text", F.coalesce("following", "head").alias("next_text"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: (id, fingerprint, group, n_links).

    group names the texts joined by chains of Jaccard >= threshold between signature sets; n_links counts the
    distinct other fingerprints within the threshold. Equal sets are one node. Sets are dealt to partitions by
    length so that partners lie in the same or the next partition; within these, partners must share one of the
    rarest signatures of the shorter prefix, and a pair is skipped where the lengths alone put the likeness below
    the threshold. A signature in very many prefixes gives long candidate lists; the rarest-first order is what
    keeps them short. Null ids are kept.
    """
    rows = docs.select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("sigs")).withColumn("fingerprint", digest(F.col("sigs")))
    rows = scratch_table(rows, "signatures")
    nodes = rows.groupBy("fingerprint").agg(F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs"))
    nodes = scratch_table(nodes, "nodes")
    common = nodes.select("fingerprint", "n", F.explode("sigs").alias("sig"))
    ranked = common.join(common.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    ordered = ranked.groupBy("fingerprint", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    prefix = F.slice("by_df", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    part = F.floor(F.log("n") / -F.log(F.lit(threshold)) + 1e-9)
    probes = ordered.select("fingerprint", "n", F.explode(F.transform(prefix, lambda s: s["sig"])).alias("sig")).withColumn("part", part)
    left = probes.select(F.col("fingerprint").alias("u"), F.col("n").alias("nu"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = probes.select(F.col("fingerprint").alias("v"), F.col("n").alias("nv"), "sig", "part")
    shorter = (F.col("nu") < F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))
    pairs = left.join(right, ["sig", "part"]).where(shorter & (F.col("nu") >= F.col("nv") * threshold - 1e-9)).select("u", "v").distinct()
    a = nodes.select(F.col("fingerprint").alias("u"), F.col("sigs").alias("su"))
    b = nodes.select(F.col("fingerprint").alias("v"), F.col("sigs").alias("sv"))
    links = scratch_table(pairs.join(a, "u").join(b, "v").where(jaccard(F.col("su"), F.col("sv")) >= threshold - 1e-9).select("u", "v"), "links")
    roots = connected_components(links).select(F.col("node").alias("fingerprint"), F.col("root").alias("group"))
    degree = links.select(F.explode(F.array("u", "v")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n_links"))
    out = rows.join(roots, "fingerprint", "left").join(degree, "fingerprint", "left")
    return out.select("id", "fingerprint", F.coalesce("group", "fingerprint").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of an edited copy and of the next document (see with_next).

    The edited text is the text with its last floor(n / 2) code points replaced by as many (or all) first ones of
    the next document. Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_signatures. Null texts are empty; an empty table gives an empty result; other columns of docs are
    not read.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited)
    sets = rows.select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.transform(F.array("text", "edited", "next_text"), lambda t: signatures(t)).alias("s"),
    )
    # one evaluation of the three sets per row
    one = F.transform(
        F.array(F.col("s")),
        lambda s: F.struct(
            digest(s[0]).alias("fingerprint"),
            digest(s[1]).alias("edited_fingerprint"),
            jaccard(s[0], s[1]).alias("near_edited"),
            jaccard(s[0], s[2]).alias("near_next"),
            F.size(s[0]).cast("long").alias("n_signatures"),
        ),
    )
    return sets.select("id", "n_chars", "edited_sha256", F.inline(one))
