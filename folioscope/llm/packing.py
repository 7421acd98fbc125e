"""Packing of tokenised documents into fixed windows: concatenate and cut.

First pass: each document's token ids are written once, with the number of ids that stand before it in its
partition. The partitions' totals (one row each) give their global offsets. Second pass: a document's global
offset is the sum of both, and it is cut where windows of ``window`` ids end; a cut document gives a piece for
each window. No ids are moved between partitions, and no pass depends on the order in which tasks run.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import DOCS_AT_ONCE, scratch_table, slices, unused_name

WINDOW = 2048
#: Words whose ids a worker remembers for sure; as many more, used less lately, may be kept too.
CACHED = 400_000


class _Recent:
    """A mapping that forgets what hasn't been asked for in a while; fill gives the values of missing keys."""

    def __init__(self, fill: Callable[[list], list], size: int):
        self.fill, self.size, self.now, self.before = fill, size, {}, {}

    def of(self, keys: list) -> list:
        """The values of keys, which are different from one another."""
        if len(self.now) > self.size:
            self.now, self.before = {}, self.now
        values = list(map(self.now.get, keys))
        missing = []
        for i in (i for i, v in enumerate(values) if v is None):
            values[i] = self.before.get(keys[i])
            if values[i] is None:
                missing.append(i)
            else:
                self.now[keys[i]] = values[i]
        for i, v in zip(missing, self.fill([keys[i] for i in missing]) if missing else []):
            values[i] = self.now[keys[i]] = v
        return values


#: Bytes that part words, the marks that a word may end in, and the bytes that end a letter or digit before them: a-z and 0-9, or the second byte of a Latin-1 letter.
_SPACE, _MARK, _PLAIN, _LATIN = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\v\f\r", b".,;:!?#%$*&", b"abcdefghijklmnopqrstuvwxyz0123456789", {*range(0x80, 0xC0)} - {0x97, 0xB7}))
#: Words of a-z and lower-case Latin-1 letters: one piece of text for a tokenizer that parts it at what is no letter.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Such words that are tokenised as one text.
WORDS_TOGETHER = 256


def _parts(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The parts between white space, marks at words' ends set apart, of all texts, and how many of them stand before each text's end."""
    special = [t is not None and b"<|" in t for t in texts]
    raw = [t or b"" if kept else (t or b"").lower() for t, kept in zip(texts, special)]
    sizes = np.array([len(t) + 1 for t in raw], np.int64)
    ends = np.cumsum(sizes)
    # a blank before, so that the two bytes before each one can be looked at, and one behind each text
    chars = np.frombuffer(b"".join((b"  ", b" ".join(raw), b" ")), np.uint8)
    now, last = chars[2:], chars[1:-1]
    word, mark = ~_SPACE[now], _MARK[now]
    starts = word & _SPACE[last]
    runs = np.flatnonzero(mark & ~_MARK[last])
    if len(runs):
        until = np.flatnonzero(~mark & _MARK[last])  # the first byte behind each run
        before = chars[runs + 1]
        apart = (_PLAIN[before] | (_LATIN[before] & (chars[runs] == 0xC3))) & _SPACE[now[until]]
        if any(special):
            apart &= ~np.array(special)[np.searchsorted(ends, runs, "right")]
        starts[runs[apart]] = True
    first = np.flatnonzero(starts)
    letters = now[word]
    places = np.cumsum(word, dtype=np.int32)[first] - 1
    offsets = np.append(places, len(letters)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return found, np.searchsorted(first, ends)


def _cells(values: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls that begins with its buffers."""
    if not len(values):
        return []
    at, raw = np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1].tolist(), values.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _ids_of(tokenizer_file: str) -> Callable[[list[bytes]], list[bytes]]:
    """A function from parts of texts to the ids of each; words of letters go to the tokenizer many at once, where its pieces show where a word ends."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; threads of its own only cost
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    if suffix:
        last[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True

    def encoded(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for i in range(0, len(texts), 4096) for e in tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]

    def alone(parts: list[bytes]) -> list[bytes]:
        return [ids.tobytes() for ids in encoded([p.decode("utf-8", "replace") for p in parts])]

    def ids_of(parts: list[bytes]) -> list[bytes]:
        if not suffix:
            return alone(parts)
        words = [p for p in parts if _LETTERS.fullmatch(p)]
        blocks = [words[i : i + WORDS_TOGETHER] for i in range(0, len(words), WORDS_TOGETHER)]
        found: dict[bytes, bytes] = {}
        for block, ids in zip(blocks, encoded([b" ".join(b).decode() for b in blocks])):
            ends = 4 * (np.flatnonzero(last[ids]) + 1)
            if len(ends) == len(block) and ends[-1] == 4 * len(ids):
                raw, ends = ids.tobytes(), ends.tolist()
                found.update(zip(block, (raw[a:b] for a, b in zip([0, *ends], ends))))
        rest = [p for p in parts if p not in found]
        found.update(zip(rest, alone(rest)))
        return [found[p] for p in parts]

    return ids_of


def batch_encoder(tokenizer_file: str, end_id: int | None = 1, cached: int = CACHED) -> Callable[[list[bytes | None]], pa.Array]:
    """A function from texts (UTF-8) to their ids as little-endian 32-bit numbers, followed by end_id.

    For tokenizers that lower-case, and whose pieces reach neither across ASCII white space nor from a letter to a
    mark: A-Z are lower-cased, marks at words' ends are set apart, and a text's ids are those of its parts between
    white space, one after the other. The ids of each part are found once. Texts with `<|`, where special tokens
    begin, are only cut at white space.
    """
    words = _Recent(_ids_of(tokenizer_file), cached)
    end = b"" if end_id is None else np.uint32(end_id).tobytes()

    def encode(texts: list[bytes | None]) -> pa.Array:
        parts, ends = _parts(texts)
        coded = parts.dictionary_encode()
        ids = pa.array([*words.of(_cells(coded.dictionary)), end], pa.binary())
        order = np.insert(coded.indices.to_numpy(), ends, len(coded.dictionary))  # the end behind each text's parts
        all_ids = ids.take(pa.array(order))
        at = np.frombuffer(all_ids.buffers()[1], np.int32)[np.append(0, ends + np.arange(1, len(texts) + 1))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), all_ids.buffers()[2]])

    return encode


def _encoded(tokenizer_file: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(tokenizer_file, end_id)
        part_no, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                ids = encode(part.column(part.num_columns - 1).cast(pa.binary()).to_pylist())
                counts = pc.binary_length(ids).to_numpy().astype(np.int64) // 4
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                columns = [*part.columns[:-1], pa.array(np.full(len(ids), part_no, np.int32)), pa.array(starts), pa.array(counts), ids]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "part_no", "before", "doc_tokens", "ids"])

    return run


def _cut(window: int, n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, DOCS_AT_ONCE) for b in batches for i in range(0, b.num_rows, DOCS_AT_ONCE)):
            kept, (at, ids) = batch.columns[:n_keep], batch.columns[n_keep:]
            rows, starts, lengths, cuts = [], [], [], []
            for row, (g, raw) in enumerate(zip(at.to_pylist(), ids.to_pylist())):
                n, start = len(raw) // 4, 0
                while start < n:
                    length = min(n - start, window - (g + start) % window)
                    rows.append(row)
                    starts.append(start)
                    lengths.append(length)
                    cuts.append(raw[4 * start : 4 * (start + length)])
                    start += length
            index = pa.array(rows, pa.int64())
            start = pa.array(starts, pa.int64())
            place = np.asarray(at.to_numpy(zero_copy_only=False), np.int64)[rows] + np.array(starts, np.int64) if rows else np.empty(0, np.int64)
            crc = pa.array([zlib.crc32(c) for c in cuts], pa.int64())
            columns = [*(c.take(index) for c in kept), start, pa.array(lengths, pa.int64()), crc, pa.array(place // window), pa.array(place % window), pa.array(cuts, pa.binary())]
            names = [*batch.schema.names[:n_keep], "start", "length", "ids_crc32", "sequence_id", "offset", "piece_ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack_documents(docs: DataFrame, tokenizer_file: str, text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, end_id: int | None = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece: docs' columns keep (all but the text), doc_tokens, start, length, ids_crc32, sequence_id, offset, piece_ids.

    A document's ids end with end_id, so null and empty texts have one. Sequence s holds the ids from s * window of
    the concatenation; only the last is shorter than window. piece_ids are little-endian unsigned 32-bit numbers
    (left out if with_ids is false). Documents are concatenated in the order of partitions, and of rows in them:
    any order is valid. Repeated rows are packed each time; an empty table gives no pieces. A kept column that is
    named like a new one is left out.
    """
    new = {"start", "length", "ids_crc32", "sequence_id", "offset", "piece_ids", "doc_tokens", "part_no", "before", "ids", "global_at", "part_at"}
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text_col and c.lower() not in new]
    words = unused_name(docs, "text_")
    rows = docs.select(*keep, F.col(text_col).alias(words))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    encoded = scratch_table(rows.mapInArrow(_encoded(tokenizer_file, end_id), f"{kept}part_no int, before long, doc_tokens long, ids binary"), "encoded")
    totals = encoded.groupBy("part_no").agg(F.sum("doc_tokens").alias("total"))
    # one row per partition of the first pass: a table of counts, not of documents
    offsets = totals.select("part_no", (F.sum("total").over(Window.orderBy("part_no")) - F.col("total")).alias("part_at"))
    placed = encoded.join(F.broadcast(offsets), "part_no").withColumn("global_at", F.col("part_at") + F.col("before"))
    pieces = placed.select(*keep, "doc_tokens", "global_at", "ids").mapInArrow(
        _cut(window, len(keep) + 1), f"{kept}doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long, piece_ids binary"
    )
    return pieces if with_ids else pieces.drop("piece_ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_pieces, ids binary): the packed windows of pack_documents' pieces, each at most window ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "piece_ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    return grouped.select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"),
        F.size("p").cast("long").alias("n_pieces"),
        F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["piece_ids"])).alias("ids"),
    )
