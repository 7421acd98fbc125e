"""Near-duplicate groups from 64-bit SimHash fingerprints, found through Golay-code fuzzy keys.

A fingerprint is cut into three segments (22, 21 and 21 bits, each read as a 23-bit word). The perfect binary
Golay code [23, 12, 7] maps every word to one codeword within three bits. The *ring* of a word is the set of
12-bit codeword indices of the word and its 23 neighbours (one index, or six), so words at distance two or less
share a ring index; the *home* of a word is its own index, which lies in the ring of every neighbour.

Two fingerprints with at most four differing bits, e1 + e2 + e3 <= 4, fall under one of two cases:

* some segment is equal and one of the others differs in at most two bits: keys (equal segment, ring index of the
  other) for the six ordered pairs of segments;
* no segment is equal, so two segments differ in exactly one bit each. Words at distance one differ in parity:
  the even one gives its home, the odd one its ring. Keys are pairs of these for the three pairs of segments.

Rows that share a key are compared bit by bit, so the links are exact. A key shared by more rows than
``group_limit`` is cut into blocks that are compared pair by pair in tasks of their own; each comparison gives a
spanning forest of the links it finds, never all pairs. Equal fingerprints are one node, joined before any key.

Likeness of shingle sets of 0.8 leaves about ten of 64 bits different, which no keys of a 64-bit fingerprint can reach.
``drop_near_duplicates(likeness=...)`` therefore takes the links as one source of candidates and minwise bands (see
shingle_sets) as a second one, and verifies every candidate by the exact Jaccard likeness of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import shingle_sets
from folioscope.llm.common import drop_scratch, release_shuffles, scratch_table, text_key, text_slices, unused_name
from folioscope.llm.components import connected_components, join_hot
from folioscope.llm.shingle_sets import shingle_hashes

#: First bit and width of the three segments; generator polynomial of the Golay code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101

MAX_BITS = 4
#: Rows of one key that are compared in one task.
GROUP_LIMIT = 4096
#: Groups up to this size are compared all at once by shifted arrays.
SMALL_GROUP = 16


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of unsigned 64-bit hashes, as an unsigned number; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the XXH64 hashes of a text's word shingles; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text, width, seed))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte at its three places, and the error pattern of each syndrome."""

    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    places = np.array([[rest(byte << shift & 0x7FFFFF) for byte in range(256)] for shift in (0, 8, 16)], np.int32)
    errors = np.zeros(2048, np.int32)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            errors[rest(pattern)] = pattern
    return places, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit word."""
    places, errors = _golay()
    syndrome = places[0][words & 255] ^ places[1][words >> 8 & 255] ^ places[2][words >> 16]
    return (words ^ errors[syndrome]) >> 11


def ring(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices of each word and its neighbours: (row of the word, index)."""
    around = np.concatenate([np.zeros(1, np.int32), (1 << np.arange(23)).astype(np.int32)])
    found = np.sort(decode(words[:, None] ^ around[None, :]), axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, columns = np.nonzero(fresh)
    return rows, found[rows, columns]


def _crossed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row, x, y) with (row, x) in a and (row, y) in b; both sorted by row."""
    per = np.bincount(b[0], minlength=n)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    times = per[a[0]]
    rows = np.repeat(a[0], times)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    return rows, np.repeat(a[1], times), b[1][first[rows] + within]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each unsigned 64-bit fingerprint; any two at distance four or less share a key."""
    n = len(prints)
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int32) for at, width in SEGMENTS]
    rings = [ring(p) for p in parts]
    near = []
    for part, (rows, index) in zip(parts, rings):
        odd = np.bitwise_count(part) & 1 == 1
        of_odd = odd[rows]
        even = np.nonzero(~odd)[0]
        r = np.concatenate([even, rows[of_odd]])
        order = np.argsort(r, kind="stable")
        near.append((r[order], np.concatenate([decode(part[even]), index[of_odd]])[order]))
    rows_out, keys = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                rows, index = rings[j]
                keys.append(np.int64(i * 3 + j) << 40 | parts[i][rows].astype(np.int64) << 12 | index)
                rows_out.append(rows)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        rows, x, y = _crossed(near[i], near[j], n)
        keys.append(np.int64(9 + i + j) << 40 | x.astype(np.int64) << 12 | y)
        rows_out.append(rows)
    return np.concatenate(rows_out), np.concatenate(keys)


def forest(a: np.ndarray, b: np.ndarray | None = None, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected by distance <= bits within a, or between a and b (then only such)."""
    us, vs = [], []
    if b is None:
        left = a
        while len(left):
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                at = reached.pop()
                close = np.bitwise_count(left ^ at) <= bits
                if close.any():
                    new = left[close]
                    us.append(np.full(len(new), at))
                    vs.append(new)
                    reached.extend(new)
                    left = left[~close]
    else:
        sides = [a, b]
        while len(sides[0]) and len(sides[1]):
            reached, sides[0] = [(0, sides[0][0])], sides[0][1:]
            while reached:
                side, at = reached.pop()
                other = 1 - side
                close = np.bitwise_count(sides[other] ^ at) <= bits
                if close.any():
                    new = sides[other][close]
                    us.append(np.full(len(new), at))
                    vs.append(new)
                    reached.extend((other, x) for x in new)
                    sides[other] = sides[other][~close]
    none = np.empty(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _links_of_groups(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys."""
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    us, vs = [], []
    for shift in range(1, min(SMALL_GROUP, int(sizes.max(initial=1)))):
        same = (keys[shift:] == keys[:-shift]) & (np.bitwise_count(prints[shift:] ^ prints[:-shift]) <= bits)
        us.append(prints[:-shift][same])
        vs.append(prints[shift:][same])
    for g in np.nonzero(sizes > SMALL_GROUP)[0]:
        u, v = forest(prints[starts[g] : starts[g] + sizes[g]], bits=bits)
        us.append(u)
        vs.append(v)
    if not us:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    u, v = np.concatenate(us), np.concatenate(vs)
    low, high = np.minimum(u, v), np.maximum(u, v)
    both = np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.empty((0, 2), np.uint64)
    return both[:, 0], both[:, 1]


_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("block", pa.int64())])


def _found(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), none, none], schema=_FOUND)


def _compare_sorted(limit: int, bits: int):
    """Rows (key, print) in order of key -> links, and the rows of keys with more than limit rows, in numbered blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        block, last_batch = 0, False

        def blocked(k: int, p: np.ndarray, number: int) -> pa.RecordBatch:
            n = len(p)
            return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.full(n, k)), pa.array(np.full(n, number))], schema=_FOUND)

        def step(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            nonlocal keys, prints, block
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                return
            first = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            done = len(keys) if batch is None else first
            begin = 0
            if block and done:  # the rest of a key that is already given out in blocks
                begin = int(np.searchsorted(keys, keys[0], side="right"))
                yield blocked(int(keys[0]), prints[:begin], block)
                block = 0
            k, p = keys[begin:done], prints[begin:done]
            starts = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0] if len(k) else np.empty(0, np.int64)
            sizes = np.diff(np.concatenate([starts, [len(k)]])) if len(k) else starts
            keep = np.repeat(sizes > 1, sizes) & np.repeat(sizes <= limit, sizes)
            if keep.any():
                yield _found(*_links_of_groups(k[keep], p[keep], bits))
            for g in np.nonzero(sizes > limit)[0]:
                group = p[starts[g] : starts[g] + sizes[g]]
                for number, at in enumerate(range(0, len(group), limit)):
                    yield blocked(int(k[starts[g]]), group[at : at + limit], number)
            keys, prints = keys[done:], prints[done:]
            while batch is not None and len(keys) > limit:
                yield blocked(int(keys[0]), prints[:limit], block)
                block += 1
                keys, prints = keys[limit:], prints[limit:]

        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        yield from step(None)

    return run


def _compare_blocks(bits: int):
    """One pair of blocks (key, i, j) -> links."""

    def run(table: pa.Table) -> pa.Table:
        block, p = table["block"].to_numpy(), table["u"].to_numpy().view(np.uint64)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        u, v = forest(p, bits=bits) if i == j else forest(p[block == i], p[block == j], bits=bits)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            prints = batch.column(0).slice(start, 4096).to_numpy().view(np.uint64)
            rows, keys = fuzzy_keys(prints)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows].view(np.int64))], names=["key", "print"])


def fingerprint_links(prints: DataFrame, bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Distinct fingerprints (print long) -> links (u, v) whose components are those of distance <= bits (at most 4)."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys find up to {MAX_BITS} differing bits, not {bits}")
    keyed = prints.select("print").mapInArrow(_keyed, "key long, print long")
    compared = keyed.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_compare_sorted(group_limit, bits), "u long, v long, key long, block long")
    compared = scratch_table(compared, "compared")
    links = compared.where("key is null").select("u", "v")
    hot = compared.where("key is not null")
    if not hot.isEmpty():
        last = hot.groupBy("key").agg(F.max("block").alias("last"))
        paired = hot.join(last, "key").select("key", "u", "block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
        paired = paired.select("key", "u", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        links = links.unionByName(paired.groupBy("key", "i", "j").applyInArrow(_compare_blocks(bits), "u long, v long"))
    out = scratch_table(links.distinct(), "links")
    drop_scratch(compared)
    return out


def _printed(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, batch.num_columns - 1):
                prints = np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(prints)], names=[*part.schema.names[:-1], "print"])

    return run


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per document: (id, key, print, root, component_id).

    key is a hash of the text, which tells apart rows that share an id; root is the least fingerprint reachable,
    component_id the least id reachable. Null and empty texts have fingerprint 0 and link like any other.
    Null ids don't count as the least id; a component of null ids only has a null component_id. Repeated rows are
    kept and get the same component. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    rows = scratch_table(rows.mapInArrow(_printed(width, seed), f"id {id_type}, key long, print long"), "prints")
    nodes = scratch_table(rows.groupBy("print").agg(F.min("id").alias("least")), "nodes")
    links = fingerprint_links(nodes, bits, group_limit)
    roots = connected_components(links)
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch_table(join_hot(rooted.select("print", "root"), least, "root", "print"), "named")
    drop_scratch(links, nodes)
    return rows.join(named, "print").select("id", "key", "print", "root", "component_id")


def _sketched(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, batch.num_columns - 1):
                hashes = [shingle_hashes(t, width, seed) for t in texts]
                prints = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
                sets = [np.unique(h) for h in hashes]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
                bands, sketches = shingle_sets.sketches(sets)
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * shingle_sets.BANDS)
                columns = [pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], "node", "n", "print", "sketch", "bands"])

    return run


def likeness_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42, threshold: float = shingle_sets.THRESHOLD) -> DataFrame:
    """One row per document: (id, key, root), with one root for documents joined by chains of Jaccard likeness >= threshold.

    Equal sets of shingles are one node; all texts without words (null ones too) are one. Candidates are the links of
    fingerprints and the nodes that share a minwise band, each with the least of its bucket. The nodes of buckets that this leaves
    in several components are compared exactly through their rarest shingles (``shingle_sets.remaining_links``), so
    neither a large group of near copies nor a passage that very many texts share gives all its pairs.
    Rows with null or repeated ids and repeated rows are kept, an empty table gives an empty one, texts of any length
    are read whole, and other columns aren't read.
    """
    if threshold < shingle_sets.THRESHOLD:
        raise ValueError(f"the bands find likeness of {shingle_sets.THRESHOLD} or more, not {threshold}")
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(_sketched(width, seed), f"id {id_type}, key long, node long, n long, print long, sketch binary, bands array<long>")
    rows = scratch_table(rows, "sketches")
    nodes = rows.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = scratch_table(nodes, "nodes")
    buckets = scratch_table(shingle_sets.banded(nodes.where("n > 0")), "buckets")
    prints = scratch_table(nodes.groupBy("print").agg(F.min("node").alias("least")), "prints")
    links = fingerprint_links(prints)
    of_links = links.join(prints.select(F.col("print").alias("u"), F.col("least").alias("a")), "u").join(prints.select(F.col("print").alias("v"), F.col("least").alias("b")), "v")
    of_links = of_links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    of_prints = shingle_sets.least_pairs(nodes.select(F.col("print").alias("bucket"), "node"))
    first = shingle_sets.least_pairs(buckets).unionByName(of_prints).unionByName(of_links)
    release_shuffles(docs.sparkSession)
    first = shingle_sets.similar_pairs(first, nodes, docs, text_col, width, seed, threshold)
    roots = scratch_table(connected_components(first), "roots")
    open_ = shingle_sets.open_rows(buckets, roots)
    roots = connected_components(shingle_sets.remaining_links(open_, roots, nodes, docs, text_col, width, seed, threshold)).select(F.col("node").alias("of_node"), "root")
    named = scratch_table(nodes.select("node").join(roots, F.col("node") == F.col("of_node"), "left").select("node", F.coalesce("root", "node").alias("root")), "named")
    drop_scratch(buckets, prints, links, nodes)
    return rows.select("id", "key", "node").join(named, "node").select("id", "key", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float | None = None, **how) -> DataFrame:
    """The rows of docs that stay: one of each group, that with the least id (null ids last, then the least text hash).

    Groups are simhash_groups', or, if a likeness is given, likeness_groups' at that threshold. All columns of docs are
    kept. Of fully repeated rows of the document that stays, one stays.
    """
    groups = simhash_groups(docs, id_col, text_col, **how) if likeness is None else likeness_groups(docs, id_col, text_col, threshold=likeness, **how)
    no_id, name, key, nth = (unused_name(docs, x) for x in ("no_id", "id_name", "text_hash", "nth"))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("b"))
    best = best.select(F.col("b.none").alias(no_id), F.coalesce(F.col("b.id").cast("string"), F.lit("")).alias(name), F.col("b.key").alias(key))
    best = scratch_table(best, "best")
    keyed = docs.withColumns({no_id: F.col(id_col).isNull(), name: F.coalesce(F.col(id_col).cast("string"), F.lit("")), key: text_key(text_col)})
    same = Window.partitionBy(no_id, name, key).orderBy(key)  # the join's partitioning and order: no further exchange
    kept = keyed.join(best, [no_id, name, key]).withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1)
    return kept.select(*(keyed[c] for c in docs.columns))
