"""Ranked lexical search of many queries over a collection, by WAND in shards of documents.

Two passes: the first one reads each text once and keeps, for the words that the queries ask for, what a document has
of them (a table that grows with the collection); counts of documents and words come from that table. The second one
gathers its rows into shards, each with its posting lists and every term's greatest impact there, and walks all queries
of a block side by side: lists in order of their next document, the pivot being the first document whose lists' greatest
impacts could reach the query's threshold; documents before it are skipped. Thresholds go on from shard to shard of a
task. Each task hands over at most k documents a query, which are merged in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import drop_scratch, scratch_table, text_slices

#: Bytes that are letters of words (ASCII letters and digits, all of other characters); capitals become small.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Factors of the score: weights count in thousandths, frequencies in thousand-millionths, saturation and share of length.
SATURATION, LENGTH = 20, 50

TOP = 50
#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 19
#: Bytes of queries that are searched for in one pass, and cells (queries x their words) that are walked side by side.
BLOCK_BYTES, CELLS = 1 << 20, 1 << 14
#: Tasks whose documents are merged in one step.
MERGED = 64


def words(text: str | None) -> list[bytes]:
    """The words of a text in order, as UTF-8: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * m))


def length_factor(n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    return 100 - LENGTH + (LENGTH * n * n_docs) // max(n_words, 1)


def _looked_up(vocabulary: dict[bytes, int]):
    """Texts -> the number of their words, and term numbers (ascending) and counts of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                sizes, terms, counts = [], [], []
                for text in texts:
                    found = words(text)
                    sizes.append(len(found))
                    own = sorted((vocabulary[w], n) for w, n in Counter(found).items() if w in vocabulary)
                    both = np.array(own, np.int32).reshape(-1, 2)
                    terms.append(both[:, 0].tobytes())
                    counts.append(both[:, 1].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["id", "n", "terms", "counts"])

    return run


def _document_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(start, 1024).to_pylist()), np.int32), minlength=size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "df"])

    return run


class Heap:
    """The best k (score, id) of a query: higher scores first, then lower ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows, self.threshold = k, [], 1

    def add(self, score: int, id) -> None:
        self.rows.append((-score, id is None, id if id is not None else 0))
        if len(self.rows) >= 2 * self.k:
            self.cut()

    def cut(self) -> None:
        self.rows = sorted(self.rows)[: self.k]
        if len(self.rows) == self.k:
            self.threshold = max(1, -self.rows[-1][0])


class Shard:
    """Posting lists of some documents: rows of (term, document) in order, with their impacts."""

    def __init__(self, ids: list, terms: list[np.ndarray], impact: np.ndarray, n_terms: int):
        self.ids, self.size = ids, len(ids)
        docs = np.repeat(np.arange(self.size), [len(t) for t in terms])
        term = np.concatenate(terms).astype(np.int64)
        order = np.argsort(term, kind="stable")
        term, docs = term[order], docs[order]
        self.span = self.size + 1
        # a last, empty term for the padding of short queries; each list ends with the number of documents, where nothing is gained
        ends = np.arange(n_terms + 1) * self.span + self.size
        keys = np.concatenate([term * self.span + docs, ends])
        order = np.argsort(keys, kind="stable")
        self.keys, self.gain = keys[order], np.concatenate([impact[np.argsort(np.concatenate([*terms]), kind="stable")], np.zeros(n_terms + 1, np.int64)])[order]
        self.most = np.zeros(n_terms + 1, np.int64)
        np.maximum.at(self.most, self.keys // self.span, self.gain)

    def search(self, queries: np.ndarray, heaps: list[Heap]) -> int:
        """queries[i]: numbers of a query's terms, padded with the number of terms. Adds to heaps[i]; the documents scored."""
        rows, scored = np.arange(len(queries)), 0
        base = queries * self.span
        most = self.most[queries]
        at = np.searchsorted(self.keys, base)
        now = self.keys[at] - base
        limits = np.array([h.threshold for h in heaps], np.int64)
        while len(rows):
            order = np.argsort(now, axis=1)
            sorted_now = np.take_along_axis(now, order, 1)
            bound = np.cumsum(np.where(sorted_now < self.size, np.take_along_axis(most, order, 1), 0), axis=1)
            alive = bound[:, -1] >= limits[rows]
            if not alive.all():
                rows, base, most, now, at, sorted_now, bound = (x[alive] for x in (rows, base, most, now, at, sorted_now, bound))
                if not len(rows):
                    break
            pivot = sorted_now[np.arange(len(rows)), (bound >= limits[rows][:, None]).argmax(axis=1)][:, None]
            self._advance(now, at, base, now < pivot, pivot)
            here = now == pivot
            hopeful = np.where(here, most, 0).sum(axis=1) >= limits[rows]
            score = np.where(here & hopeful[:, None], self.gain[at], 0).sum(axis=1)
            scored += int(hopeful.sum())
            for i in np.nonzero(hopeful & (score >= limits[rows]))[0].tolist():
                heap = heaps[rows[i]]
                heap.add(int(score[i]), self.ids[pivot[i, 0]])
                limits[rows[i]] = heap.threshold
            self._advance(now, at, base, here, pivot + 1)
        return scored

    def _advance(self, now: np.ndarray, at: np.ndarray, base: np.ndarray, which: np.ndarray, to: np.ndarray) -> None:
        """Move the lists that are chosen to their first document at or beyond to."""
        to = np.broadcast_to(to, now.shape)[which]
        found = np.searchsorted(self.keys, base[which] + np.minimum(to, self.size))
        at[which] = found
        now[which] = self.keys[found] - base[which]


def _side_by_side(queries: list[list[int]], n_terms: int) -> list[tuple[list[int], np.ndarray]]:
    """(numbers of queries, their terms padded to one width) in groups of at most CELLS cells, or of one query."""
    order = sorted(range(len(queries)), key=lambda i: len(queries[i]))
    groups, start = [], 0
    for end in range(1, len(order) + 1):
        if end == len(order) or (end + 1 - start) * len(queries[order[end]]) > CELLS:
            own = order[start:end]
            table = np.full((len(own), max(1, len(queries[own[-1]]))), n_terms, np.int64)
            for row, i in zip(table, own):
                row[: len(queries[i])] = queries[i]
            groups.append((own, table))
            start = end
    return groups


def _searched(queries: list[list[int]], weights: np.ndarray, n_docs: int, n_words: int, k: int, id_type: pa.DataType):
    """Rows (id, n, terms, counts) -> (query, id, score), at most k for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in queries]
        groups = _side_by_side(queries, len(weights))
        ids, sizes, terms, counts, postings = [], [], [], [], 0

        def done() -> None:
            nonlocal postings
            if postings:
                lengths = [len(t) for t in terms]
                m = np.repeat(length_factor(np.array(sizes, np.int64), n_docs, n_words), lengths)
                gained = impacts(weights[np.concatenate(terms)], np.concatenate(counts).astype(np.int64), m)
                shard = Shard(list(ids), terms, gained, len(weights))
                for own, table in groups:
                    shard.search(table, [heaps[i] for i in own])
            for x in (ids, sizes, terms, counts):
                x.clear()
            postings = 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(row[0])
                sizes.append(row[1])
                terms.append(np.frombuffer(row[2], np.int32))
                counts.append(np.frombuffer(row[3], np.int32))
                postings += len(terms[-1])
                if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    done()
        done()
        for heap in heaps:
            heap.cut()
        found = [(i, None if none else id, -score) for i, heap in enumerate(heaps) for score, none, id in heap.rows]
        for start in range(0, len(found), 8192):
            part = found[start : start + 8192]
            columns = zip(*part)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), id_type, pa.int64()))], names=["query", "id", "score"])

    return run


def query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(id, words once each) of the queries, in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in queries.select(id_col, text_col).toLocalIterator():
        own = sorted(set(words(row[1])))
        if own:
            block.append((row[0], own))
            size += sum(map(len, own))
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = [F.desc("score"), F.asc_nulls_last("id")]
    for by in (["query", "some"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
    return found.drop("some")


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = TOP) -> DataFrame:
    """(query id, rank int, id, score long): each query's k best documents with a score above 0, from rank 1.

    Equal scores are ranked by ascending id, null ids last. Rows that share an id are documents of their own, and repeated
    queries have results of their own. Null texts and those without a word match nothing and count nowhere; queries
    without a word, or of words that no document has, have no rows. An empty table on either side gives no rows.
    Texts of any length are read whole, and only what queries ask for is kept of them. Queries are taken in blocks
    of BLOCK_BYTES, one pass over the texts each. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, query_type = rows.schema["id"].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    out = None
    for block in query_blocks(queries, query_id, query_text):
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, own in block for w in own}))}
        counted = rows.where("text is not null").mapInArrow(_looked_up(vocabulary), f"id {id_type}, n long, terms binary, counts binary")
        counted = scratch_table(counted.where("n > 0"), "counted")
        n_docs, n_words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        parts = counted.select("terms").mapInArrow(_document_counts(len(vocabulary)), "term int, df long")
        weights = np.zeros(len(vocabulary), np.int64)
        for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each word of the block at most
            weights[r["term"]] = weight(n_docs, r["df"])
        numbers = [[vocabulary[w] for w in own] for _, own in block]
        arrow_type = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
        found = counted.mapInArrow(_searched(numbers, weights, n_docs, n_words, k, arrow_type), f"query int, id {id_type}, score long")
        found = scratch_table(found.withColumn("some", F.floor(F.spark_partition_id() / MERGED)), "found")
        names = spark.createDataFrame([(i, id) for i, (id, _) in enumerate(block)], f"query int, name {query_type}")
        best = _merged(found, k).join(F.broadcast(names), "query").select(F.col("name").alias(query_id), "rank", F.col("id").alias(id_col), "score")
        best = scratch_table(best, "best")
        drop_scratch(counted, found)
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], f"`{query_id}` {query_type}, rank int, `{id_col}` {id_type}, score long")
    return out
