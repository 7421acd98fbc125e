"""Vectors as array columns: cosine, hashed text embeddings, log bins."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from folioscope.functions.text import let

DIMENSIONS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero; an error if their lengths differ."""
    lengths = norm(a) * norm(b)
    value = let(lengths, lambda n: F.when(n == 0, 0.0).otherwise(dot(a, b) / n))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths"))).otherwise(value)


def literal_vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _places(word: str, dimensions: int) -> list[int]:
    """Where a word counts: a place, or, behind the places, one that counts down."""
    marked = f"<{word}>"
    hashes = [zlib.crc32(g.encode()) for g in {marked, *(marked[i : i + 3] for i in range(len(marked) - 2))}]
    return [h % dimensions + dimensions * (h >> 31) for h in hashes]


#: Words whose places a worker remembers; it begins anew with more.
KNOWN = 300_000
#: Texts whose words are counted at once: a few MB of counts.
TEXTS_AT_ONCE = 512


class _Places:
    """The places of words, one word's after the other's: each word's grams are hashed once."""

    def __init__(self, dimensions: int):
        self.dimensions, self.number, self.places, self.ends = dimensions, {}, np.empty(0, np.int32), np.zeros(1, np.int64)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all the words, and how many are each one's."""
        if len(self.number) > KNOWN:
            self.__init__(self.dimensions)
        if new := [w for w in dict.fromkeys(words) if w not in self.number]:
            found = [_places(w, self.dimensions) for w in new]
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.places = np.append(self.places, np.fromiter(chain.from_iterable(found), np.int32))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(f) for f in found]))
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        first, sizes = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        return self.places[np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)], sizes


_known = lru_cache(4)(_Places)


def _counted(texts: Sequence[str | None], dimensions: int) -> np.ndarray:
    found = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    places, sizes = _known(dimensions).of(list(chain.from_iterable(found)))
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    counts = np.bincount(np.repeat(rows * (2 * dimensions), sizes) + places, minlength=len(found) * 2 * dimensions).reshape(len(found), 2, dimensions)
    sums = (counts[:, 0] - counts[:, 1]).astype(np.float64)
    lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return sums / np.where(lengths == 0, 1, lengths)


def hashed_vector(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A deterministic unit vector of a text's words and their trigrams, counted at hashed places with hashed signs.

    Stands in for a trained encoder, whose vectors can be given instead wherever one is asked for. A word's grams are
    hashed once per worker.
    """
    return _counted([text], dimensions)[0]


def hashed_vectors(texts: Sequence[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """hashed_vector of each text, as rows of 32-bit numbers: all words of a block of texts are counted at once."""
    out = np.empty((len(texts), dimensions), np.float32)
    for i in range(0, len(texts), TEXTS_AT_ONCE):
        out[i : i + TEXTS_AT_ONCE] = _counted(texts[i : i + TEXTS_AT_ONCE], dimensions)
    return out


@F.pandas_udf(ArrayType(FloatType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    return pd.Series(list(hashed_vectors(texts.tolist())))


def text_cosine(text: Column, query: list[float], encode: Callable[[Sequence[str | None]], np.ndarray] = hashed_vectors) -> Column:
    """Cosine similarity of query and the vectors that encode gives to texts; 0 if either vector is zero. A number leaves the Python worker for each text, no vector."""
    wanted = np.array(query, np.float64)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        some = (encode(texts.iloc[i : i + TEXTS_AT_ONCE].tolist()).astype(np.float64) for i in range(0, len(texts), TEXTS_AT_ONCE))
        parts = [np.divide(v @ wanted, n, out=np.zeros(len(v)), where=n != 0) for v in some for n in [np.sqrt((v * v).sum(axis=1)) * np.sqrt(wanted @ wanted)]]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return score(text)


def static_embedding(texts: DataFrame, vectors: DataFrame, id_col: str, text_col: str, dimensions: int) -> DataFrame:
    """(id, vector) of texts(id, text): the mean of the vectors of a text's words, scaled to length 1.

    vectors(token, vector): static token vectors, of lower-cased words (runs of letters and digits). Words without one
    don't count; a text without any has a zero vector. Words are joined to their vectors; sums of a text's are formed
    before they are shuffled.
    """
    words = F.explode_outer(F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    found = texts.select(F.col(id_col).alias("id"), words.alias("token")).join(vectors.select("token", "vector"), "token", "left")
    sums = [F.coalesce(F.avg(F.col("vector")[i].cast("double")), F.lit(0.0)) for i in range(dimensions)]
    means = found.groupBy("id").agg(F.array(*sums).alias("m"))
    return means.select("id", let(norm(F.col("m")), lambda n: F.transform("m", lambda x: F.when(n > 0, x / n).otherwise(0.0))).alias("vector"))


def log_bin(value: Column, tolerance: float) -> Column:
    """`range_log_bin_k` with k the whole part of ln|v| / ln(1 + tolerance), negated for v < 0; `range_zero` for 0."""
    k = (F.log(F.abs(value)) / F.lit(math.log(1 + tolerance))).cast("int")
    signed = F.when(value < 0, -k).otherwise(k)
    return F.when(value == 0, F.lit("range_zero")).otherwise(F.concat(F.lit("range_log_bin_"), signed.cast("string")))


def semantic_bucket(vector: Column, threshold: float = 0.8) -> Column:
    """Eight hex digits shared by vectors that are equal when scaled by int(10 / threshold) and rounded."""
    scale = int(10 / threshold)
    return F.substring(F.md5(F.array_join(F.transform(vector, lambda x: F.bround(x.cast("double") * scale).cast("int").cast("string")), ",").cast("binary")), 1, 8)
