"""Pages into chunks, and the tokens that terms are made of."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_chunks(pages: DataFrame, pieces: Column) -> DataFrame:
    """Chunks of pages(doc_id, page, text): one per element of pieces (array of string) that isn't blank.

    chunk_id is {doc_id}_p{page}_c{i} with i the number within the page; chunk_index counts through the document.
    """
    texts = F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")
    each = pages.select("doc_id", "page", F.posexplode(texts).alias("at", "text"))
    through = Window.partitionBy("doc_id").orderBy("page", "at")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.col("page").cast("string"), F.lit("_c"), F.col("at").cast("string"))
    return each.select("doc_id", name.alias("chunk_id"), (F.row_number().over(through) - 1).cast("long").alias("chunk_index"), "page", "text")


def document_chunks(documents: DataFrame) -> DataFrame:
    """Chunks of one-page documents(doc_id, text): their lines that aren't blank. No shuffle: a row holds a document."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    each = documents.select("doc_id", F.posexplode(lines).alias("at", "text"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_p1_c"), F.col("at").cast("string"))
    return each.select("doc_id", name.alias("chunk_id"), F.col("at").cast("long").alias("chunk_index"), F.lit(1).alias("page"), "text")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores where it would be read in fewer tasks, as one small file is; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


#: A word of any alphabet: a run of letters, marks, digits and connecting punctuation.
WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]+"


def _words_of(text: str):
    """The pattern of words: for texts in Latin-1 the standard library's quicker one, which finds the same."""
    try:
        text.encode("latin-1")
        return _LATIN_WORD
    except UnicodeEncodeError:
        return _ANY_WORD


_LATIN_WORD, _ANY_WORD = re.compile(r"\w+"), regex.compile(WORD)


#: Texts whose words are grouped at once.
TEXTS_AT_ONCE = 512
#: The characters of words in Latin-1.
_IN_WORD = np.array([bool(_LATIN_WORD.match(chr(i))) for i in range(256)])


def _latin_tokens(texts: list[bytes], least: int) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """The tokens of texts in Latin-1, each once a text: the numbers of their texts, the tokens, and their places."""
    chars = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)  # each text between two line ends
    word = _IN_WORD[chars]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    row = np.searchsorted(begin, start, "right") - 1
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(chars[word])]).dictionary_encode()
    code, start = found.indices.to_numpy().astype(np.int64), start - begin[row]
    if least > 1:
        row, code, start = (x[size >= least] for x in (row, code, start))
    key = row * max(1, len(found.dictionary)) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    groups = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    places = pa.ListArray.from_arrays(pa.array(np.append(groups, len(key)).astype(np.int32)), pa.array(start[order].astype(np.int32)))
    return row[order][groups], _in_utf8(found.dictionary).take(pa.array(code[order][groups])), places


def _in_utf8(words: pa.Array) -> pa.Array:
    """Words in Latin-1 as strings."""
    if not len(words):
        return pa.array([], pa.string())
    at, latin = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
    at = np.append(0, np.cumsum(1 + (latin >= 0x80)))[at].astype(np.int32)  # such characters are two bytes
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(at), pa.py_buffer(latin.tobytes().decode("latin-1").encode())])


def _other_tokens(texts: list[str], least: int) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """_latin_tokens of texts in any alphabet."""
    rows, tokens, sizes, places = [], [], [], []
    for i, text in enumerate(texts):
        found: dict[str, list[int]] = {}
        for m in _ANY_WORD.finditer(text):
            found.setdefault(m.group(), []).append(m.start())
        if least > 1:
            found = {k: v for k, v in found.items() if len(k) >= least}
        rows.extend([i] * len(found))
        tokens.extend(found)
        for at in found.values():
            sizes.append(len(at))
            places.extend(at)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return np.array(rows, np.int64), pa.array(tokens, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32()))


def _in_latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def _tokens_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TEXTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, TEXTS_AT_ONCE)):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            latin = [_in_latin(t) for t in texts]
            for tokens_of, some in ((_latin_tokens, [i for i, t in enumerate(latin) if t is not None]), (_other_tokens, [i for i, t in enumerate(latin) if t is None])):
                if some:
                    rows, tokens, places = tokens_of([(latin if tokens_of is _latin_tokens else texts)[i] for i in some], least)
                    index = pa.array(np.array(some)[rows])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in range(3)), tokens, places], names=[*batch.schema.names[:3], "token", "positions"])

    return run


def _counts_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, tokens, counts = [], [], []
            for text in batch.column(3).to_pylist():
                found = Counter(_words_of(text or "").findall(text or ""))
                if least > 1:
                    found = {k: v for k, v in found.items() if len(k) >= least}
                sizes.append(len(found))
                tokens.extend(found)
                counts.extend(found.values())
            index = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            names = [*batch.schema.names[:3], "token", "n"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in range(3)), pa.array(tokens, pa.string()), pa.array(counts, pa.int32())], names=names)

    return run


def _of_texts(chunks: DataFrame, f, columns: str) -> DataFrame:
    rows = chunks.select("doc_id", "page", "chunk_index", F.lower("text").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return rows.mapInArrow(f, f"{kept}, {columns}")


def token_occurrences(chunks: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, page, chunk_index, token, positions): a row per chunk and token, found in one pass over each text.

    Tokens are the WORDs of at least so many characters of the lower-cased text; positions are where they start, from 0.
    """
    return _of_texts(chunks, _tokens_of(least), "token string, positions array<int>")


def token_counts(chunks: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, page, chunk_index, token, n): the rows of token_occurrences with the number of their positions only."""
    return _of_texts(chunks, _counts_of(least), "token string, n int")


def frequent_tokens(occurrences: DataFrame, share: float) -> DataFrame:
    """(token, df): tokens in at least that share of the documents that have tokens.

    As many as the mean number of tokens of a document over the share, at most: a bound that the corpus doesn't move.
    """
    of_doc = occurrences.select("doc_id", "token").distinct()
    n = of_doc.agg(F.count_distinct("doc_id").alias("n"))
    df = of_doc.groupBy("token").agg(F.count("*").alias("df"))
    least = n.select((F.col("n") * share).alias("least"))
    return df.join(F.broadcast(least), F.col("df") >= F.col("least")).select("token", "df")  # least: one row


def upper_tokens(chunks: DataFrame) -> DataFrame:
    """(doc_id, page, chunk_index, term): acronym candidates, words of two to six capitals A-Z; repeats are kept."""
    found = F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9])[A-Z]{2,6}(?![A-Za-z0-9])"), F.lit(0))
    return chunks.select("doc_id", "page", "chunk_index", F.explode(found).alias("term"))


def word_totals(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_words) of chunks: words between white space."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return chunks.groupBy("doc_id").agg(F.sum(words).cast("long").alias("n_words"))
