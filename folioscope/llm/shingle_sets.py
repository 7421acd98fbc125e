"""Sets of word shingles: minwise sketches that find likely pairs, and exact Jaccard likeness of given pairs.

A text's set holds the XXH64 hashes of its shingles. For each of ``BANDS`` bands, ``ROWS`` minima of the set under
fixed permutations are hashed together: sets of likeness s share a band with chance s ** ROWS, so at 0.8 a pair shares
none of 24 bands of 4 with chance 3e-6. The low bytes of 64 minima estimate likeness; pairs estimated more than
``SLACK`` below the threshold aren't compared (a pair at the threshold falls there with chance 1e-6).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import drop_scratch, release_shuffles, scratch_table, text_key, text_slices
from folioscope.llm.components import join_hot

THRESHOLD = 0.8
BANDS, ROWS, SKETCH, SLACK = 24, 4, 64, 0.26
#: Up to so many texts' hashes are sent to all tasks, which pick out their texts; more are joined by a shuffle.
SENT = 2_000_000

_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles, in order, repeats included; of the whole sequence if it is shorter. A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only ASCII space splits
    if not words:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(whole, seed)], np.uint64)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    return np.array([digest(whole[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :])], np.uint64)


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """([sets, BANDS] hashes of bands, SKETCH low bytes of minima) of sets of hashes; empty sets have those of one number."""
    sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    minima = np.empty((len(sets), BANDS * ROWS), np.uint64)
    at, group, size = 0, [], 0
    for i, s in enumerate(sets):
        group.append(s)
        size += len(s)
        if size > 1 << 16 or i == len(sets) - 1:  # so much at once stays in the cache
            every = np.concatenate(group)
            starts = np.cumsum([0, *map(len, group[:-1])])
            for k in range(BANDS * ROWS):
                minima[at : i + 1, k] = np.minimum.reduceat((every ^ _SEEDS[0, k]) * _SEEDS[1, k], starts)
            at, group, size = i + 1, [], 0
    mixed = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        mixed = (mixed ^ minima[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    low = np.ascontiguousarray((minima[:, :SKETCH] >> np.uint64(48)).astype(np.uint8))
    return mixed.view(np.int64), [row.tobytes() for row in low]


def _estimated(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, SKETCH) for c in (2, 3))
            keep = (a == b).sum(axis=1) >= SKETCH * (threshold - SLACK)
            yield batch.select([0, 1]).filter(keep)

    return run


def _verified(threshold: float):
    """Rows (u, v, a, b) -> the (u, v) whose sets a and b have at least that likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(x[i].as_py(), np.int64) for x in (us, vs))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = common >= threshold * (len(a) + len(b) - common) - 1e-9
            yield batch.select([0, 1]).filter(keep)

    return run


def _sets(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                found = [np.unique(shingle_hashes(t, width, seed)).view(np.int64).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["key", "hashes"])

    return run


def both_sides(rows: DataFrame, of_node: DataFrame, column: str) -> DataFrame:
    """rows(u, v, ...) with that column of both nodes, as a and b; a node in very many pairs is dealt to many tasks."""
    pairs = rows
    for side, name, other in (("v", "b", "u"), ("u", "a", "v")):
        named = of_node.select(F.col("node").alias(side), F.col(column).alias(name), *([F.col("n").alias(f"n{side}")] if column == "sketch" else []))
        rows = join_hot(rows, named, side, other, counted=pairs)
    return rows


def sets_of(asked: DataFrame, docs: DataFrame, text_col: str, width: int, seed: int) -> DataFrame:
    """asked(node, key) -> (node, hashes) as a scratch table: the set of each node, read from one text of docs with that key."""
    asked = scratch_table(asked.select("node", "key"), "asked")
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    wanted = asked.select("key")
    texts = texts.join(F.broadcast(wanted) if asked.count() <= SENT else wanted, "key", "left_semi")
    texts = texts.groupBy("key").agg(F.min("text").alias("text"))  # of copies, one; copies meet in the task that reads them
    return scratch_table(asked.join(texts.mapInArrow(_sets(width, seed), "key long, hashes binary"), "key").select("node", "hashes"), "sets")


def likely_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (u, v) of nodes(node, n, sketch), once each, that sizes and sketches don't rule out, as a scratch table."""
    near = pairs.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sized = both_sides(scratch_table(near, "pairs"), nodes, "sketch").where((F.least("nu", "nv") >= F.greatest("nu", "nv") * threshold - 1e-9))
    return scratch_table(sized.select("u", "v", "a", "b").mapInArrow(_estimated(threshold), "u long, v long"), "likely")


def verified_pairs(likely: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets(node, hashes) have at least that likeness, as a scratch table."""
    return scratch_table(both_sides(likely, sets, "hashes").select("u", "v", "a", "b").mapInArrow(_verified(threshold), "u long, v long"), "similar")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, width: int, seed: int, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the pairs (u, v) of nodes(node, key, n, sketch) whose sets have at least that likeness, as a scratch table.

    key: the hash of a text of docs with the node's set. Repeated pairs are compared once.
    """
    likely = likely_pairs(pairs, nodes, threshold)
    asked = likely.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "key"), "node")
    return verified_pairs(likely, sets_of(asked, docs, text_col, width, seed), threshold)


def banded(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of nodes(node, bands): a bucket is a band and its hash."""
    return nodes.select("node", F.explode(F.transform("bands", lambda h, i: F.xxhash64(i, h))).alias("bucket"))


def least_pairs(rows: DataFrame) -> DataFrame:
    """rows(bucket, node): each node with the least of its bucket."""
    least = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return join_hot(rows, least, "bucket", "node").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))


def open_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, root) of rows(bucket, node): the buckets whose nodes have several roots, as a scratch table."""
    placed = rows.join(roots.select("node", "root"), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return scratch_table(join_hot(placed, several, "bucket", "node"), "open")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, hashes) -> (node, n, hash) for each hash of the set."""
    for batch in batches:
        for node, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(hashes, np.int64)
            for start in range(0, len(own), 1 << 16):
                part = own[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(np.full(len(part), len(own))), pa.array(part)], names=["node", "n", "hash"])


def rare_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, node): nodes by the rarest shingles of their sets, as a scratch table.

    Of n shingles the n - ceil(threshold * n) + 1 rarest ones: two sets of that likeness share one of these. Passages that many
    sets share are their commonest shingles, and so bring no two together unless they make up nearly all of both.
    """
    every = scratch_table(sets.select("node", "hashes").mapInArrow(_hashes, "node long, n long, hash long"), "hashes")
    shared = join_hot(every, every.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1"), "hash", "node")
    of_node = Window.partitionBy("node")  # the shingles of one text
    ranked = shared.withColumns({"nth": F.row_number().over(of_node.orderBy("df", "hash")), "n_shared": F.count("*").over(of_node)})
    rarest = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.col("n_shared"))  # the unshared ones are the rarest
    keys = scratch_table(ranked.where(F.col("nth") <= rarest).select(F.col("hash").alias("bucket"), "node"), "keys")
    drop_scratch(every)
    return keys


def _linked(threshold: float):
    """A block of rows (node, root, left, hashes) -> links (u, v) that join the roots of alike sets, one on the left: a forest, never all pairs."""

    def run(table: pa.Table) -> pa.Table:
        nodes, roots, left = (table[c].to_numpy() for c in ("node", "root", "left"))
        sets = [np.frombuffer(x.as_py(), np.int64) for x in table["hashes"]]
        sizes, at = np.array(list(map(len, sets))), np.nonzero(left)[0]
        values, owner = np.concatenate([sets[i] for i in at] or [np.empty(0, np.int64)]), np.repeat(np.arange(len(at)), sizes[at])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        found, us, vs = roots.copy(), [], []
        for b in np.nonzero(~left)[0].tolist():
            low, high = np.searchsorted(values, sets[b], "left"), np.searchsorted(values, sets[b], "right")
            counts = high - low
            rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            common = np.bincount(owner[rows], minlength=len(at))
            alike = common >= threshold * (sizes[at] + sizes[b] - common) - 1e-9
            for a in at[alike].tolist():
                if found[a] != found[b]:
                    us.append(nodes[a])
                    vs.append(nodes[b])
                    found[found == found[a]] = found[b]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


#: Buckets of up to PAIRED nodes give their pairs; larger ones are compared in blocks of about BLOCK_NODES sets and BLOCK_HASHES hashes.
PAIRED, BLOCK_NODES, BLOCK_HASHES = 8, 2048, 1 << 21


def links_of_open(open_: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """open_(bucket, node, root) -> links (u, v) that join whatever is alike within a bucket, exactly.

    In a large bucket the nodes outside its commonest root (the left side) meet all of its nodes, in blocks; so rows are
    repeated once for each block of the left side, and only links leave a block. Buckets of the same nodes count once.
    """
    per = open_.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("same"))
    per = scratch_table(per.groupBy("same", "m").agg(F.min("bucket").alias("bucket")), "buckets")
    small = open_.join(per.where(F.col("m") <= PAIRED).select("bucket"), "bucket")
    a, b = (small.select("bucket", F.col("node").alias(n), F.col("root").alias(f"r{n}")) for n in "uv")
    pairs = likely_pairs(a.join(b, "bucket").where("u < v and ru <> rv").select("u", "v"), nodes, threshold)
    links = verified_pairs(pairs, sets, threshold)
    large = per.where(F.col("m") > PAIRED).select("bucket")
    if large.isEmpty():
        return links
    rows = scratch_table(join_hot(open_, large, "bucket", "node").join(nodes.select("node", "n"), "node"), "large")
    major = rows.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("p"))
    rows = scratch_table(join_hot(rows, major.select("bucket", F.col("p.root").alias("major")), "bucket", "node").withColumn("minor", F.col("root") != F.col("major")).drop("major"), "sided")
    blocks = lambda ok: F.greatest(F.lit(1), F.ceil(F.sum(F.when(ok, 1)) / BLOCK_NODES), F.ceil(F.sum(F.when(ok, F.col("n"))) / BLOCK_HASHES)).cast("int")
    dealt = rows.groupBy("bucket").agg(blocks(F.col("minor")).alias("n_left"), blocks(F.lit(True)).alias("n_right"))
    rows = scratch_table(join_hot(rows, dealt, "bucket", "node"), "dealt")
    own = lambda n: F.pmod(F.hash("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("minor").select("bucket", "node", "root", F.lit(True).alias("left"), own("n_left").alias("i"), every("n_right").alias("j"))
    right = rows.select("bucket", "node", "root", F.lit(False).alias("left"), every("n_left").alias("i"), own("n_right").alias("j"))
    met = join_hot(scratch_table(left.unionByName(right), "sides"), sets, "node", "bucket")
    return links.unionByName(scratch_table(met.groupBy("bucket", "i", "j").applyInArrow(_linked(threshold), "u long, v long"), "met"))


def remaining_links(open_: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, width: int, seed: int, threshold: float = THRESHOLD) -> DataFrame:
    """open_(bucket, node, root): buckets that aren't one component yet; roots(node, root) -> the links (u, v) still missing."""
    asked = open_.select("node").distinct().join(nodes.select("node", "key"), "node")
    sets = sets_of(asked, docs, text_col, width, seed)
    keys = rare_keys(sets, threshold)
    release_shuffles(docs.sparkSession)
    found = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v")
    return found.unionByName(links_of_open(open_rows(keys, roots), nodes, sets, threshold))
