"""Inverted indices and statistics of a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.postings import SEGMENT, segmented_index


def inverted_index(occurrences: DataFrame, by: list[str], of: list[str], name: str) -> DataFrame:
    """by -> the set of of (a struct if several columns), sorted."""
    value = F.struct(*of) if len(of) > 1 else F.col(of[0])
    return occurrences.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias(name))


#: The indices of a knowledge base: what they read (occurrences or chunks), their keys and their values.
SEARCH_INDICES = {
    "term_to_chunks": ("occurrences", ["term"], ["doc_id", "chunk_index"]),
    "term_to_pages": ("occurrences", ["term"], ["doc_id", "page"]),
    "term_to_documents": ("occurrences", ["term"], ["doc_id"]),
    "document_to_terms": ("occurrences", ["doc_id"], ["term"]),
    "document_to_chunks": ("chunks", ["doc_id"], ["chunk_id"]),
    "page_to_chunks": ("chunks", ["doc_id", "page"], ["chunk_id"]),
}


def search_index(name: str, occurrences: DataFrame, chunks: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One of SEARCH_INDICES of occurrences(term, doc_id, page, chunk_index) and chunks, in segments of at most size values."""
    of, by, values = SEARCH_INDICES[name]
    return segmented_index(occurrences if of == "occurrences" else chunks, by, values, size)


def search_indices(occurrences: DataFrame, chunks: DataFrame, size: int = SEGMENT) -> dict[str, DataFrame]:
    """All SEARCH_INDICES by name."""
    return {name: search_index(name, occurrences, chunks, size) for name in SEARCH_INDICES}


def chunk_terms(chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """chunks with the set of terms that occur in each (chunks without any are left out)."""
    keys = ["doc_id", "page", "chunk_index"]
    lists = occurrences.groupBy(*keys).agg(F.sort_array(F.collect_set("term")).alias("terms"))  # of one chunk: a row of it for each task that has some
    return chunks.join(lists, keys)


def table_counts(pages: DataFrame) -> DataFrame:
    """pages(doc_id, tables array) -> (doc_id, n_tables)."""
    return pages.groupBy("doc_id").agg(F.sum(F.coalesce(F.size("tables"), F.lit(0))).cast("long").alias("n_tables"))


def document_stats(documents: DataFrame, chunks: DataFrame, occurrences: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """documents(doc_id) with pages, chunks, distinct terms, and acronyms and keywords among them.

    occurrences(doc_id, term, kind). pages(doc_id, tables): adds n_tables.
    """
    of_chunks = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("page").alias("n_pages"))
    terms = occurrences.select("doc_id", "term", "kind").distinct()
    of_terms = terms.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.count_if(F.col("kind") == "acronym").alias("n_acronyms"), F.count_if(F.col("kind") == "keyword").alias("n_keywords"))
    out = documents.select("doc_id").join(of_chunks, "doc_id", "left").join(of_terms, "doc_id", "left")
    names = ["n_pages", "n_chunks", "n_terms", "n_acronyms", "n_keywords"]
    if pages is not None:
        out, names = out.join(table_counts(pages), "doc_id", "left"), [*names, "n_tables"]
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names))


def corpus_totals(chunks: DataFrame, terms: DataFrame, links: DataFrame) -> DataFrame:
    """One row: documents, chunks, acronyms, keywords, links."""
    c = chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_documents"))
    t = terms.agg(F.count_if(F.col("term_type") == "acronym").alias("n_acronyms"), F.count_if(F.col("term_type") == "keyword").alias("n_keywords"))
    return c.join(t, F.lit(True)).join(links.agg(F.count("*").alias("n_links")), F.lit(True))  # one row each


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last in the given order."""
    columns = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key).agg(last.alias("_last")).select(key, *(F.col(f"_last.{c}").alias(c) for c in columns)).select(*df.columns)
