"""Nearest vectors by cosine for many queries at once: block products over all rows, and an index of cells that prunes exactly.

The index holds unit vectors' cells: each row lies in the cell of its nearest centroid, and a cell knows its radius. A query's
cosine with a row of a cell is at most what the distance to the centroid less the radius allows, so cells that can't reach
the k-th best score found in the nearest cells aren't read. Scores are always those of the cosine expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.vectors import cosine
from folioscope.sources.scratch import written

#: Queries in a block; rows of a cell that one task compares; the most cells; rounds that move the centroids.
QUERIES, CELL_ROWS, CELLS, ROUNDS = 2048, 4096, 1024, 2
#: Scores are compared to nine digits; sums in another order stay well within this.
MARGIN = 1e-8


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _units(vectors: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def _promising(cosines: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k best by rounded cosine, then name: at most k of each score that counts."""
    if len(cosines) <= k:
        return np.arange(len(cosines))
    least = np.partition(cosines, len(cosines) - k)[-k] - MARGIN
    near = np.nonzero(cosines >= least)[0]
    if len(near) <= 2 * k:
        return near
    score = np.round(cosines[near], 9)
    order = np.lexsort((names[near], -score))
    first = np.concatenate([[True], score[order][1:] != score[order][:-1]])
    starts = np.nonzero(first)[0]
    return near[order[np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)])) < k]]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """found(query_id, query_vector, name, vector) -> (query_id, name, score, rank) of the k best of each query."""
    scored = found.select("query_id", "name", F.round(cosine(F.col("vector"), F.col("query_vector")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "name")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_of_rows(numbers: list, vectors: np.ndarray, k: int):
    """Rows (name, vector) -> those that may be among a query's k best of this task, as (query, name, vector)."""
    units = _units(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[pa.Array, pa.Array, np.ndarray]] = [None] * len(numbers)
        for batch in batches:
            if not batch.num_rows:
                continue
            names, rows = batch.column(0), batch.column(1)
            sizes = np.unique(rows.value_lengths().to_numpy())
            if len(sizes) != 1 or sizes[0] != vectors.shape[1]:
                raise ValueError("vectors of different lengths")
            for start in range(0, batch.num_rows, 4096):
                part_names, part_rows = names.slice(start, 4096), rows.slice(start, 4096)
                cosines = _units(_matrix(part_rows)) @ units.T
                for q in range(len(numbers)):
                    at = _promising(cosines[:, q], part_names.to_numpy(zero_copy_only=False), k)
                    old = kept[q]
                    both = (part_names.take(pa.array(at)), part_rows.take(pa.array(at)), cosines[at, q])
                    if old is not None:
                        both = (pa.concat_arrays([old[0], both[0]]), pa.concat_arrays([old[1], both[1]]), np.concatenate([old[2], both[2]]))
                        again = _promising(both[2], both[0].to_numpy(zero_copy_only=False), k)
                        both = (both[0].take(pa.array(again)), both[1].take(pa.array(again)), both[2][again])
                    kept[q] = both
        for q, own in zip(numbers, kept):
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(own[0]), pa.int32()), own[0], own[1]], names=["query", "name", "vector"])

    return run


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """queries(query_id, query_vector) -> (query_id, id, score, rank): the k best rows of vectors for each, ties by id.

    The stated queries are taken in blocks of QUERIES; one pass over the rows each, in which a task multiplies its rows with the block and keeps
    what may be among a query's k best. Rows below the threshold are then left out. Null vectors and queries have no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("name"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null")
    name_type = rows.schema["name"].dataType.simpleString()
    kind = queries.schema["query_id"].dataType.simpleString()
    out, block = None, []

    def searched(block: list) -> DataFrame:
        stated = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(block)], f"query int, query_id {kind}, query_vector array<double>")
        found = rows.mapInArrow(_best_of_rows(list(range(len(block))), np.array([r[1] for r in block], float), k), f"query int, name {name_type}, vector array<double>")
        return _ranked(found.join(F.broadcast(stated), "query"), k)

    stated = queries.select("query_id", F.col("query_vector").cast("array<double>")).where("query_vector is not null")
    for r in stated.toLocalIterator() if k > 0 else ():
        block.append(tuple(r))
        if len(block) == QUERIES:
            out, block = searched(block) if out is None else out.unionByName(searched(block)), []
    if block:
        out = searched(block) if out is None else out.unionByName(searched(block))
    if out is None:
        out = spark.createDataFrame([], f"query_id {kind}, name {name_type}, score double, rank int")
    out = out.select("query_id", F.col("name").alias(id_col), "score", "rank")
    return out if threshold is None else out.where(F.col("score") >= threshold)


def _assigned(centroids: np.ndarray):
    """Rows (name, vector) -> with the number of their cell and their unit vector's distance to its centroid; -1 for zero vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                units = _units(_matrix(part.column(1)))
                apart = np.maximum((units * units).sum(axis=1)[:, None] - 2 * units @ centroids.T + (centroids * centroids).sum(axis=1)[None], 0)
                cell = apart.argmin(axis=1)
                # measured again by differences: the expanded form loses digits where a row is near its centroid
                far = np.sqrt(((units - centroids[cell]) ** 2).sum(axis=1))
                zero = ~units.any(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.where(zero, -1, cell), pa.int32()), pa.array(np.where(zero, 0.0, far))], names=["name", "vector", "cell", "far"])

    return run


def _cell_sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids))
        for batch in _assigned(centroids)(batches):
            cell = batch.column(2).to_numpy()
            own = cell >= 0
            np.add.at(total, cell[own], _units(_matrix(batch.column(1)))[own])
            n += np.bincount(cell[own], minlength=len(centroids))
        at = np.nonzero(n)[0]
        i = np.arange(centroids.shape[1])
        for c in at.tolist():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), c), pa.int32()), pa.array(i, pa.int32()), pa.array(total[c] / 1.0)], names=["cell", "i", "s"])

    return run


def _bounded(centroids: np.ndarray, cells: list[tuple[int, float]]):
    """Queries (query_id, query_vector) -> with each cell and the greatest cosine that one of its rows can have."""
    at = np.array([c for c, _ in cells])
    radii = np.array([r for _, r in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                units = _units(_matrix(part.column(1)))
                apart = np.sqrt(((units[:, None, :] - centroids[np.maximum(at, 0)][None]) ** 2).sum(axis=2))
                most = 1 - np.maximum(apart - radii[None], 0) ** 2 / 2
                most[:, at < 0] = 0.0
                most[~units.any(axis=1)] = 0.0
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(at)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.tile(at, part.num_rows), pa.int32()), pa.array(most.ravel() + MARGIN)], names=["query_id", "query_vector", "cell", "most"])

    return run


def _best_of_cells(k: int):
    """The rows of one part of a cell and the queries that visit it -> what may be among a query's k best, and reaches its least."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        names = rows["name"].combine_chunks() if rows.num_rows else None
        units = _units(_matrix(rows["vector"])) if rows.num_rows and asked.num_rows else None
        for start in range(0, asked.num_rows if rows.num_rows else 0, 256):
            part = asked.slice(start, 256)
            cosines = _units(_matrix(part["query_vector"])) @ units.T
            # most cells have no row that reaches what a query has found in its nearest ones
            reached = cosines >= part["least"].to_numpy()[:, None] - MARGIN
            queries, at = [], []
            for q in np.nonzero(reached.any(axis=1))[0]:
                own = np.nonzero(reached[q])[0]
                own = own[_promising(cosines[q, own], names.take(pa.array(own)).to_numpy(zero_copy_only=False), k)]
                queries.append(np.full(len(own), q))
                at.append(own)
            if at:
                same, found = pa.array(np.concatenate(queries)), pa.array(np.concatenate(at))
                out.append(pa.table({"query_id": part["query_id"].take(same), "query_vector": part["query_vector"].take(same), "name": names.take(found), "vector": rows["vector"].take(found)}))
        return pa.concat_tables(out) if out else pa.table({"query_id": asked["query_id"].slice(0, 0), "query_vector": asked["query_vector"].slice(0, 0), "name": rows["name"].slice(0, 0), "vector": rows["vector"].slice(0, 0)})

    return run


@dataclass
class VectorIndex:
    """rows(cell, part, name, vector); cells(cell, n, radius, parts): one row for each cell that isn't empty; centroids."""

    rows: DataFrame
    cells: list
    centroids: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "chunk_id", vector_col: str = "vector", n_cells: int | None = None, rounds: int = ROUNDS, save=written) -> VectorIndex:
        """An index of all rows whose vector isn't null. Centroids begin as some rows chosen by a hash and are moved to their cells' means.

        A cell of many rows (of equal vectors, perhaps) is in several parts of about CELL_ROWS rows. save(df, name) writes a table.
        """
        rows = vectors.select(F.col(id_col).alias("name"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null")
        name_type = rows.schema["name"].dataType.simpleString()
        wanted = n_cells or min(CELLS, math.isqrt(rows.count()) + 1)
        chosen = rows.orderBy(F.xxhash64("vector"), "name").select("vector").limit(wanted).collect()
        units = _units(np.array([r[0] for r in chosen], float)) if chosen else np.zeros((0, 1))
        centroids = np.unique(units[units.any(axis=1)], axis=0) if len(units) else units
        if not len(centroids):
            centroids = np.zeros((1, units.shape[1]))
        for _ in range(rounds):
            sums = rows.mapInArrow(_cell_sums(centroids), "cell int, i int, s double").groupBy("cell", "i").agg(F.sum("s").alias("s"))
            moved = centroids.copy()
            for r in sums.collect():  # cells x dimensions
                moved[r["cell"], r["i"]] = r["s"]
            centroids = np.where(_units(moved).any(axis=1, keepdims=True), _units(moved), centroids)
        placed = rows.mapInArrow(_assigned(centroids), f"name {name_type}, vector array<double>, cell int, far double")
        placed = save(placed, "placed")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row for each cell
        cells = [(r["cell"], r["n"], r["radius"] + MARGIN, -(-r["n"] // CELL_ROWS)) for r in sorted(sizes, key=lambda r: r["cell"])]
        parts = F.broadcast(rows.sparkSession.createDataFrame([(c, p) for c, _, _, p in cells], "cell int, parts int"))
        dealt = placed.join(parts, "cell").select("cell", F.pmod(F.xxhash64("name", "vector"), F.col("parts")).cast("int").alias("part"), "name", "vector")
        return cls(save(dealt, "cells"), cells, centroids)

    def _cell_table(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(self.cells, "cell int, n long, radius double, parts int")

    def _candidates(self, visits: DataFrame, k: int, kind: str, deals: int) -> DataFrame:
        """visits(query_id, query_vector, cell, least): the rows that may be among the k best of a query, in the cells it visits, of that score at least."""
        deal = F.pmod(F.xxhash64("query_id"), F.lit(deals)).cast("int")
        asked = visits.join(F.broadcast(self._cell_table().select("cell", "parts")), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", deal.alias("deal"), "query_id", "query_vector", "least")
        rows = self.rows.join(F.broadcast(visits.select("cell").distinct()), "cell", "left_semi").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))  # at most CELLS cells
        keys = ["cell", "part", "deal"]
        schema = f"query_id {kind}, query_vector array<double>, name {self.rows.schema['name'].dataType.simpleString()}, vector array<double>"
        return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_best_of_cells(k), schema)

    def visits(self, queries: DataFrame, k: int, save=written) -> tuple[DataFrame, DataFrame]:
        """(visits(query_id, query_vector, cell), candidates) of queries(query_id, query_vector): all cells that may hold one of the k best."""
        kind = queries.schema["query_id"].dataType.simpleString()
        stated = queries.select("query_id", F.col("query_vector").cast("array<double>")).where("query_vector is not null")
        deals = max(1, -(-stated.count() // QUERIES))
        bounds = stated.mapInArrow(_bounded(self.centroids, [(c, r) for c, _, r, _ in self.cells]), f"query_id {kind}, query_vector array<double>, cell int, most double")
        bounds = bounds.join(F.broadcast(self._cell_table().select("cell", "n")), "cell")
        order = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "cell")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bounds = save(bounds.withColumn("first", before < k), "bounds")
        first = save(self._candidates(bounds.where("first").select("query_id", "query_vector", "cell", F.lit(-2.0).alias("least")), k, kind, deals), "first")
        reached = _ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        more = bounds.where("not first").join(reached, "query_id", "left").where((F.col("most") + MARGIN >= F.coalesce("reached", F.lit(-2.0))))
        more = save(more.select("query_id", "query_vector", "cell", F.coalesce("reached", F.lit(-2.0)).alias("least")), "more")
        rest = self._candidates(more, k, kind, deals)
        return bounds.where("first").select("query_id", "query_vector", "cell").unionByName(more.drop("least")), first.unionByName(rest)

    def search(self, queries: DataFrame, k: int, threshold: float | None = None, id_col: str = "chunk_id") -> DataFrame:
        """queries(query_id, query_vector), distinct ids -> (query_id, id, score, rank): the same rows as batch_top_k over all rows."""
        if not self.cells or k <= 0:
            kind, name = queries.schema["query_id"].dataType.simpleString(), self.rows.schema["name"].dataType.simpleString()
            return self.rows.sparkSession.createDataFrame([], f"query_id {kind}, `{id_col}` {name}, score double, rank int")
        out = _ranked(self.visits(queries, k)[1], k).select("query_id", F.col("name").alias(id_col), "score", "rank")
        return out if threshold is None else out.where(F.col("score") >= threshold)

    def visited_shares(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, share): the share of all rows that lie in the cells a query visits."""
        total = sum(n for _, n, _, _ in self.cells)
        found = self.visits(queries, k)[0].join(F.broadcast(self._cell_table()), "cell")
        return found.groupBy("query_id").agg((F.sum("n") / F.lit(total)).alias("share"))

    def save(self, path: str) -> None:
        """Write the index as tables under path: rows by cell, cells and centroids."""
        spark = self.rows.sparkSession
        self.rows.write.partitionBy("cell").parquet(f"{path}/rows")
        self._cell_table().coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark, path: str) -> VectorIndex:
        cells = sorted(tuple(r) for r in spark.read.parquet(f"{path}/cells").select("cell", "n", "radius", "parts").collect())
        centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()], float)
        return cls(spark.read.parquet(f"{path}/rows").select("cell", "part", "name", "vector"), cells, centroids)
