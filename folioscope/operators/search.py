"""Vector and term-enhanced search over a knowledge base, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import count_substring
from folioscope.functions.vectors import cosine, hashed_vectors, literal_vector, text_cosine
from folioscope.operators.chunks import WORD
from folioscope.operators.vector_index import batch_top_k  # noqa: F401 - part of search
from folioscope.sources.scratch import written

K, THRESHOLD, MAX_COOCCURRENCES = 10, 0.1, 5
FREQUENCY_WEIGHT, DIVERSITY_WEIGHT = 0.7, 0.3
SIMILARITY_WEIGHT, RELEVANCE_CAP = 0.6, 0.4


def top_k(vectors: DataFrame, query: list[float], k: int = K, threshold: float | None = None, id_col: str = "chunk_id", vector_col: str = "vector", score_mode: str = "cosine") -> DataFrame:
    """The k rows most like a query vector (ties by id), with score; those below threshold are then left out.

    score_mode: "cosine", or "one_minus" for 1 - cosine (the order stays that of the cosine). Each task keeps its
    own k best, so k rows a task reach the last one.
    """
    return _best(vectors, cosine(F.col(vector_col), literal_vector(query)), k, threshold, id_col, score_mode)


def top_k_texts(texts: DataFrame, query: list[float], k: int = K, threshold: float | None = None, id_col: str = "chunk_id", text_col: str = "text", encode=hashed_vectors, score_mode: str = "cosine") -> DataFrame:
    """top_k of rows that have no vectors yet: encode (from a list of texts to an array with a row for each) is called and its vectors are scored in the same pass."""
    return _best(texts, text_cosine(F.col(text_col), query, encode), k, threshold, id_col, score_mode)


def _best(rows: DataFrame, likeness: Column, k: int, threshold: float | None, id_col: str, score_mode: str) -> DataFrame:
    if k < 0 or score_mode not in ("cosine", "one_minus"):
        raise ValueError("k must be 0 or more, score_mode cosine or one_minus")
    scored = rows.withColumn("_cos", F.round(likeness, 9))
    best = scored.orderBy(F.col("_cos").desc(), id_col).limit(k)
    best = best.withColumn("score", F.col("_cos") if score_mode == "cosine" else 1 - F.col("_cos")).drop("_cos")
    return best if threshold is None else best.where(F.col("score") >= threshold)


#: Terms that one automaton finds in a pass over the texts; more are looked for in several passes.
AUTOMATON_TERMS = 200_000


def _found_terms(names):
    """(id, text) -> (id, folded) for each of the lower-cased names that the text contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names.value:
            automaton.add_word(name, name)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text and len(automaton):
                    found = {name for _, name in automaton.iter(text)}
                    rows.extend([i] * len(found))
                    keys.extend(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.string())], names=[batch.schema.names[0], "folded"])

    return run


#: Words are cut into all their pieces of at most so many characters; longer keys are met by their first ones.
PIECE = 64


def _found_words(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts(result_id, text), keys(term_key, folded, n), folded made of a word's characters only -> (result_id, term_key): the keys that a text contains, each n times.

    Such a key lies within one word, so each distinct word's pieces are joined with the keys once, however many texts hold it. A word of a text takes
    its keys along as one string, and those of a text are made distinct when its words are together.
    """
    words = written(texts.select("result_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word")), "words")
    size = F.length("word")
    starts = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    pieces = starts.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.least(size - F.col("at") + 1, F.lit(PIECE))), lambda n: F.substring("word", F.col("at"), n))).alias("piece"))
    held = pieces.join(keys.select("folded").distinct().withColumn("piece", F.substring("folded", 1, PIECE)), "piece").where(F.contains("word", "folded")).select("word", "folded").distinct()
    said = F.when(F.col("n") > 1, F.concat_ws(":", "term_key", F.col("n").cast("string"))).otherwise(F.col("term_key"))  # blanks and colons aren't part of a word
    lists = held.join(keys, "folded").groupBy("word").agg(F.array_join(F.collect_list(said), " ").alias("keys"))
    found = words.join(lists, "word").groupBy("result_id").agg(F.array_distinct(F.split(F.array_join(F.collect_list("keys"), " "), " ")).alias("keys"))  # of one text
    times = lambda k: F.coalesce(F.get(F.split(k, ":"), F.lit(1)).cast("int"), F.lit(1))
    return found.select("result_id", F.explode(F.flatten(F.transform("keys", lambda k: F.array_repeat(F.substring_index(k, ":", 1), times(k))))).alias("term_key"))


def primary_terms(results: DataFrame, terms: DataFrame, at_once: int = AUTOMATON_TERMS) -> DataFrame:
    """results(result_id, text) with terms(term_key, ...) whose key the text contains, whole word or not, in any case.

    Keys made of a word's characters are found by joins with the distinct words of the texts. The other distinct lower-cased keys
    go to the tasks as automata, about at_once keys in each; each automaton reads each text once. Keys that differ in case
    only are each found.
    """
    spark = results.sparkSession
    kind = results.schema["result_id"].dataType.simpleString()
    folded = terms.where("term_key <> ''").withColumn("folded", F.lower("term_key"))
    plain = F.col("folded").rlike(f"^(?:{WORD})$") & ~F.contains("folded", F.lit("\n"))
    texts = results.select("result_id", F.lower("text").alias("text"))
    alone = terms.columns == ["term_key"]
    of_words = folded.where(plain).groupBy("term_key", "folded").agg((F.count("*") if alone else F.lit(1)).alias("n"))
    named = _found_words(texts, of_words)
    named = named if alone else named.join(terms, "term_key").select("result_id", *terms.columns)
    found = None
    keys = folded.select("folded").where(~plain).distinct().persist()
    pieces = -(-keys.count() // at_once)
    for piece in range(pieces):
        names = [r[0] for r in keys.where(F.pmod(F.xxhash64("folded"), F.lit(pieces)) == piece).collect()]
        part = texts.mapInArrow(_found_terms(spark.sparkContext.broadcast(names)), f"result_id {kind}, folded string")
        found = part if found is None else found.unionByName(part)
    keys.unpersist()
    return named if found is None else named.unionByName(found.join(folded, "folded").select("result_id", *terms.columns))


def related_terms(primary: DataFrame, terms: DataFrame, links: DataFrame, companions: DataFrame, max_cooccurrences: int = MAX_COOCCURRENCES) -> DataFrame:
    """(result_id, term_key, ...) one hop from primary(result_id, term, term_type): terms linked to them (an acronym's
    keywords, a keyword's acronyms) and their first companions, each once per result. Names that are no term's key
    are dropped."""
    at = primary.select("result_id", "term", "term_type")
    of_acronym = at.where("term_type = 'acronym'").join(links, F.col("term") == F.col("acronym")).select("result_id", F.col("keyword").alias("term_key"))
    of_keyword = at.where("term_type = 'keyword'").join(links, F.col("term") == F.col("keyword")).select("result_id", F.col("acronym").alias("term_key"))
    c = companions.where(F.col("rank") <= max_cooccurrences).select("term", F.col("other").alias("term_key"))
    keys = of_acronym.unionByName(of_keyword).unionByName(at.join(c, "term").select("result_id", "term_key")).distinct()
    return keys.join(terms, "term_key")


def related_to_depth(primary: DataFrame, terms: DataFrame, links: DataFrame, companions: DataFrame, depth: int, max_cooccurrences: int = MAX_COOCCURRENCES, save=written) -> DataFrame:
    """(result_id, term_key, hops): the terms within depth hops of a result's primary terms, each with the least number of hops.

    A hop is that of related_terms. Each round joins only the terms that the last one reached for the first time, and what was
    reached before is left out, so that cycles end; the primary terms themselves are at 0 hops and aren't returned.
    save(df, name) writes a round's table.
    """
    known = terms.select("term_key", "term", "term_type")
    frontier = primary.select("result_id", "term").distinct().join(known, "term").select("result_id", "term_key", "term", "term_type").distinct()
    reached = save(frontier.select("result_id", "term_key", F.lit(0).alias("hops")), "reached")
    for hop in range(1, depth + 1):
        found = related_terms(frontier, known, links, companions, max_cooccurrences).select("result_id", "term_key", "term", "term_type")
        frontier = save(found.join(reached, ["result_id", "term_key"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        reached = save(reached.unionByName(frontier.select("result_id", "term_key", F.lit(hop).alias("hops"))), "reached")
    return reached.where("hops > 0")


def relations_of(names: DataFrame, terms: DataFrame, links: DataFrame, companions: DataFrame, max_cooccurrences: int = MAX_COOCCURRENCES) -> DataFrame:
    """names(term_key) -> (term_key, kind, related, place): the terms related to each name that is a term's key.

    First those linked to it, in either direction, as often as they are (kind "link", by name), then its first
    companions that aren't linked to it ("companion", by rank). Related names that are no term's key are dropped.
    """
    known = terms.select("term_key").distinct()
    asked = names.select("term_key").distinct().join(known, "term_key", "left_semi")
    ends = links.select(F.col("acronym").alias("term_key"), F.col("keyword").alias("related")).unionByName(links.where("acronym <> keyword").select(F.col("keyword").alias("term_key"), F.col("acronym").alias("related")))
    linked = asked.join(ends, "term_key").join(known.withColumnRenamed("term_key", "related"), "related", "left_semi").select("term_key", "related")
    near = companions.where(F.col("rank") <= max_cooccurrences).select(F.col("term").alias("term_key"), F.col("other").alias("related"), F.col("rank").cast("long").alias("rank"))
    near = asked.join(near, "term_key").join(known.withColumnRenamed("term_key", "related"), "related", "left_semi").join(linked.distinct(), ["term_key", "related"], "left_anti")
    both = linked.select("term_key", F.lit("link").alias("kind"), "related", F.lit(0).cast("long").alias("rank")).unionByName(near.select("term_key", F.lit("companion").alias("kind"), "related", "rank"))
    order = Window.partitionBy("term_key").orderBy((F.col("kind") == "companion"), "rank", "related")
    return both.select("term_key", "kind", "related", F.row_number().over(order).cast("long").alias("place"))


def query_frequencies(all_terms: DataFrame, query: Column) -> DataFrame:
    """(result_id, term) with frequency: how often each term stands in the query, where it does."""
    return all_terms.withColumn("frequency", count_substring(F.lower(query), F.lower("term"))).where("frequency > 0")


def relevance(frequencies: DataFrame) -> DataFrame:
    """(result_id, relevance, n_terms): weighted sum of frequencies and number of terms."""
    score = F.lit(FREQUENCY_WEIGHT) * F.sum("frequency") + F.lit(DIVERSITY_WEIGHT) * F.count("*")
    return frequencies.groupBy("result_id").agg(F.round(score, 9).alias("relevance"), F.count("*").alias("n_terms"))


def combined_score(score: Column, relevance_: Column) -> Column:
    return score * SIMILARITY_WEIGHT + F.least(relevance_ / 10, F.lit(RELEVANCE_CAP))


def page_media(results: DataFrame, pages: DataFrame) -> DataFrame:
    """results(doc_id, page) with the images and tables of their page; none where the page is null or 0."""
    media = pages.select("doc_id", "page", "images", "tables")
    known = F.when(F.coalesce("page", F.lit(0)) != 0, F.col("page"))
    joined = results.withColumn("_p", known).join(media.withColumnRenamed("page", "_p"), ["doc_id", "_p"], "left").drop("_p")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(media.schema[c].dataType)) for c in ("images", "tables")})


def enhanced(results: DataFrame, query: str, terms: DataFrame, links: DataFrame, companions: DataFrame, max_cooccurrences: int = MAX_COOCCURRENCES) -> DataFrame:
    """Search results(result_id, text, score, ...) with their terms, ranked by similarity and term relevance.

    Adds primary_terms, related_terms (arrays of names), term_frequencies (map), relevance and combined, and sorts
    by combined (ties by result_id).
    """
    names = ["term_key", "term", "term_type"]
    primary = primary_terms(results, terms.select(*names))
    related = related_terms(primary, terms.select(*names), links, companions, max_cooccurrences)
    either = primary.select("result_id", "term").unionByName(related.select("result_id", "term")).distinct()
    found = query_frequencies(either, F.lit(query))
    lists = [d.groupBy("result_id").agg(F.sort_array(F.collect_set("term")).alias(n)) for d, n in ((primary, "primary_terms"), (related, "related_terms"))]
    counts = found.groupBy("result_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "frequency")))).alias("term_frequencies"))
    out = results
    for part in (*lists, counts, relevance(found).drop("n_terms")):
        out = out.join(part, "result_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({
        "primary_terms": F.coalesce("primary_terms", none),
        "related_terms": F.coalesce("related_terms", none),
        "term_frequencies": F.coalesce("term_frequencies", F.create_map().cast("map<string,bigint>")),
        "relevance": F.coalesce("relevance", F.lit(0.0)),
    })
    out = out.withColumn("combined", F.round(combined_score(F.col("score"), F.col("relevance")), 9))
    return out.orderBy(F.col("combined").desc(), "result_id")


class SearchEngine:
    """Search over chunks(chunk_id, text, doc_id, page, vector) and a knowledge base's relations."""

    def __init__(self, chunks: DataFrame, terms: DataFrame, links: DataFrame, companions: DataFrame, pages: DataFrame, encode):
        """encode: a function from a query string to its vector, as the chunks' vectors were made."""
        self.chunks, self.terms, self.links, self.companions, self.pages, self.encode = chunks, terms, links, companions, pages, encode

    def similar(self, query: str, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
        """The chunks most like a query, with their page's media; none for a blank query."""
        if not query.strip() or k == 0:
            return page_media(self.chunks.limit(0).withColumn("score", F.lit(0.0)).drop("vector"), self.pages)
        best = top_k(self.chunks, self.encode(query), k, threshold).drop("vector")
        return page_media(best, self.pages).orderBy(F.col("score").desc(), "chunk_id")

    def enhanced(self, query: str, k: int = K, threshold: float = THRESHOLD, max_cooccurrences: int = MAX_COOCCURRENCES) -> DataFrame:
        found = self.similar(query, k, threshold).withColumn("result_id", F.col("chunk_id"))
        return enhanced(found, query, self.terms, self.links, self.companions, max_cooccurrences)
