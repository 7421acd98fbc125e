"""Product codes of vectors: each quarter of a vector is replaced by the number of its nearest codebook entry.

Components become integers, so that distances, ties and means are exact. The nearest entry is found by a ball tree over
each part position's entries: branch and bound with radii rounded up and distances to centres rounded down, a ball
being visited if it might hold an entry as near as the best one so far (equal ones count: the lower index wins), and
every entry that is reached is measured in integers. A round of training is one pass over the vectors, in which each
task sums up its parts by entry; only those sums are shuffled, and only the codebooks come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import drop_scratch, scratch_table, unused_name
from folioscope.llm.components import join_hot

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries that a ball compares one by one, and vectors that are searched for at once.
LEAF, AT_ONCE = 16, 4096
#: Components below this are exact in sums of squares of doubles; larger ones are computed as Python's integers.
EXACT = 1 << 21
#: Larger components can't be summed up in a decimal(38).
LARGEST = 2.0**80
MOST_LONG = (1 << 63) - 1

_root = np.frompyfunc(math.isqrt, 1, 1)


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): doubles holding integers if all are small enough to be exact in what follows, else Python's integers."""
    whole = np.floor(values * scale)
    if np.abs(whole).max(initial=0) < EXACT:
        return whole
    exact = [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in values.ravel().tolist()]  # a power of two: x * scale is exact
    return np.array(exact, object).reshape(values.shape)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, exact."""
    if a.dtype == object or b.dtype == object:
        return ((a.astype(object)[:, None, :] - b.astype(object)[None]) ** 2).sum(axis=2)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]


def _root_below(squared: np.ndarray) -> np.ndarray:
    """An integer not above the root."""
    if squared.dtype == object:
        return _root(squared)
    return np.maximum(np.floor(np.sqrt(squared)) - 1, 0)


class BallTree:
    """Balls over the rows of entries (integers). A ball: centre, radius (not below the true one), two balls or a leaf's rows."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        self.centres: list[np.ndarray] = []
        self.radii: list = []
        self.inside: list = []
        self.compared = 0
        self._ball(np.arange(len(entries)))

    def _ball(self, rows: np.ndarray) -> int:
        points = self.entries[rows]
        centre = points.sum(axis=0) // len(rows)
        apart = _squared(points, centre[None])[:, 0]
        at = len(self.centres)
        self.centres.append(centre)
        self.radii.append(math.isqrt(int(apart.max())) + 1)
        self.inside.append(rows)
        if len(rows) > self.leaf:
            one = points[int(np.argmax(apart))]
            far = _squared(points, one[None])[:, 0]
            other = points[int(np.argmax(far))]
            nearer = np.asarray(far <= _squared(points, other[None])[:, 0], bool)
            if nearer.any() and not nearer.all():
                self.inside[at] = (self._ball(rows[nearer]), self._ball(rows[~nearer]))
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the nearest entry, squared distance) of each point; of equally near entries the first."""
        kind = object if object in (points.dtype, self.entries.dtype) else float
        self.points = points.astype(kind)
        self.best = np.full(len(points), np.inf if kind is float else 1 << 400, kind)
        self.row = np.full(len(points), len(self.entries))
        self._visit(0, np.arange(len(points)))
        return self.row, self.best

    def _visit(self, ball: int, rows: np.ndarray) -> None:
        inside = self.inside[ball]
        if isinstance(inside, np.ndarray):
            self.compared += len(rows) * len(inside)
            apart = _squared(self.points[rows], self.entries[inside])
            at = apart.argmin(axis=1)  # the first of equal ones, and rows ascend
            apart, found = apart[np.arange(len(rows)), at], inside[at]
            better = np.asarray((apart < self.best[rows]) | ((apart == self.best[rows]) & (found < self.row[rows])), bool)
            self.best[rows[better]], self.row[rows[better]] = apart[better], found[better]
            return
        centres = np.array([self.centres[b] for b in inside], self.entries.dtype)
        apart = _squared(self.points[rows], centres)
        bound = np.maximum(_root_below(apart) - np.array([self.radii[b] for b in inside], apart.dtype)[None], 0) ** 2
        first = np.asarray(apart[:, 1] < apart[:, 0], bool).astype(int)
        for turn in (0, 1):  # each point goes to its nearer ball first
            for side in (0, 1):
                chosen = (first ^ turn) == side
                chosen &= np.asarray(bound[:, side] <= self.best[rows], bool)
                if chosen.any():
                    self._visit(inside[side], rows[chosen])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(start, AT_ONCE)
            yield part, integers(part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width))


def _sums(books: np.ndarray, width: int):
    """Vectors -> for each part and entry the number and sums of the parts nearest to it, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, size = books.shape
        trees = [BallTree(book) for book in books]
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), object)
        for _, block in _blocks(batches, width):
            for p, tree in enumerate(trees):
                own = block[:, p * size : (p + 1) * size]
                row, _ = tree.nearest(own)
                counts[p] += np.bincount(row, minlength=entries)
                if own.dtype == object:
                    np.add.at(sums[p], row, own)
                else:
                    for c in range(size):
                        sums[p, :, c] += np.bincount(row, weights=own[:, c], minlength=entries).astype(np.int64)
        p, e = np.nonzero(counts)
        text = [[str(x) for x in s] for s in sums[p, e]]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(text, pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, size = books.shape
        trees = [BallTree(book) for book in books]
        for part, block in _blocks(batches, width):
            found = [tree.nearest(block[:, p * size : (p + 1) * size]) for p, tree in enumerate(trees)]
            codes = ["".join(f"{x:02x}" for x in row) for row in np.stack([f[0] for f in found], axis=1).tolist()]
            errors = [min(int(x), MOST_LONG) for x in sum(f[1].astype(object) for f in found)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*part.schema.names[:-1], "code", "error"])

    return run


def train_codebooks(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """[parts, entries, width / parts] integers, learned from kept(vec_id, vector) of that width.

    A part's codebook starts as that part of the vectors of the least ids (equal ids in order of their vectors, null
    ids last). Each round assigns all parts to the nearest entries and moves an entry to the floor of its parts' mean.
    """
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    whole = integers(np.array([r["vector"] for r in first], float))
    size = width // parts
    books = np.ascontiguousarray(whole.reshape(len(whole), parts, size).transpose(1, 0, 2))
    for _ in range(rounds):
        part = kept.select("vector").mapInArrow(_sums(books, width), "part int, entry int, n long, sums array<string>")
        total = part.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(size))).alias("sums"))
        moved = [[list(map(int, entry)) for entry in book] for book in books.tolist()]
        for r in total.collect():  # a row for each entry at most
            moved[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        exact = np.array(moved, object)
        books = exact.astype(float) if np.abs(exact).max() < EXACT else exact
    return books


def codebooks_text(books: np.ndarray) -> str:
    """All entries' integers by part, entry and position, with commas between."""
    return ",".join(str(int(x)) for x in books.ravel().tolist())


def code_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector that is kept: (vec_id, label, code, error, label_error, codebooks_sha256).

    Null vectors and those with a null or non-finite component are dropped. Repeated rows are kept; equal ids and null
    ids are fine, null labels are one label. Vectors whose length isn't that of the vector of the least id or isn't a positive
    multiple of parts, or with a component of 2 ** 80 or more, can't be coded: they stay, with a null code and error. An
    error beyond a long is the largest long. Fewer vectors than entries give smaller codebooks; an empty table
    gives an empty table. Other columns, whatever their names, aren't read. Each label's rows may be very many:
    they are summed up before the shuffle, and a frequent label's rows are dealt to many tasks.
    """
    if not 1 <= entries <= 256:
        raise ValueError(f"a code has two hexadecimal digits for each part: 1 to 256 entries, not {entries}")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # not so for NaN
    kept = scratch_table(rows.where(F.col("vector").isNotNull() & finite), "vectors")
    least = kept.where(F.size("vector") > 0).orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    width = least["n"] if least and least["n"] % parts == 0 else 0
    ids, labels = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    fits = (F.size("vector") == width) & F.forall("vector", lambda x: F.abs(x) < LARGEST) if width else F.lit(False)
    good = kept.where(fits)
    books = train_codebooks(good, width, parts, entries, rounds) if width and not good.isEmpty() else None
    empty = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = empty if books is None else good.mapInArrow(_codes(books, width), f"vec_id {ids}, label {labels}, code string, error long").unionByName(empty)
    coded = scratch_table(coded, "codes")
    drop_scratch(kept)
    key = unused_name(coded, "label_key")
    keyed = coded.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")
    summed = keyed.groupBy(key).agg(total.alias("label_error"))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest() if books is not None else None
    joined = join_hot(keyed, summed, key, "code")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
