"""Language-model scores by context-tree weighting over bytes, beside a unigram base score.

A text is coded as its words (A-Z lower-cased) with a blank between them and a newline at the end. Each byte is
eight binary decisions, bits from the highest; every decision has a context tree, whose nodes are the contexts of 0
to ``DEPTH`` bytes before it, over blanks and words alike. A node holds the Krichevsky-Trofimov estimate of its bits;
its weighted probability of the training data is half the estimate's and half the product of its children's, so all
depths are mixed, and its share of a prediction follows from these. Where training never saw a context, the decision
is even. The trees are static once trained.

Nothing is pruned: the corpus is counted as windows of DEPTH + 1 bytes (a context and its byte, one number), and the
table of distinct windows grows with it. Windows that share their two nearest context bytes form a subtree, which one
task weighs as arrays. What is above the subtrees has at most 256 contexts, and is weighed on the driver. The costs of
the most frequent windows go to all tasks; a text's other windows are joined to the table of costs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import drop_scratch, scratch_table, text_key, text_slices

DEPTH = 5
#: Context bytes that subtrees share.
TOP = 2
#: Windows whose costs are sent to all tasks, at most.
SENT = 1 << 21
#: A word is sent to all tasks with its counts if it is at least one in so many training tokens.
FREQUENT = 1 << 18
#: Distinct words, and bytes, that a task counts before it passes the counts on.
COUNTED = 300_000
AT_ONCE = 1 << 22
#: Windows that a task weighs at once, beyond those of one subtree.
WEIGHED = 1 << 18
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def windows(raw: bytes, depth: int = DEPTH) -> np.ndarray:
    """For each byte a number: the depth bytes before it, nearest highest, and itself lowest. Before the text stand ENDs."""
    padded = np.frombuffer(END * depth + raw, np.uint8).astype(np.int64)
    n = len(raw)
    out = padded[depth:].copy()
    for j in range(1, depth + 1):
        out |= padded[depth - j : depth - j + n] << (8 * (depth - j + 1))
    return out


# --- trees ----------------------------------------------------------------------------------------------------------


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return keys[first], np.add.reduceat(counts, first)


def _shorter(keys: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Keys (depth context bytes, nearest highest, and that many bits) without the farthest byte."""
    return keys >> (8 + bits) << bits | keys & ((1 << bits) - 1)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0 (Stirling's series after shifting x above 8)."""
    shift, y = np.ones_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        shift[small] *= y[small]
        y[small] += 1
    inverse = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + inverse / 12 - inverse**3 / 360 + inverse**5 / 1260 - np.log(shift)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of sequences with these numbers of zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


class Nodes:
    """The decisions of one depth with the same number of bits decided before: sorted keys and what is known of each."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """below: log of the product of the children's weighted probabilities; None at the greatest depth."""
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = _log_kt(zeros, ones)
        if below is None:
            self.weighted, self.stay = own, np.ones(len(keys))
        else:
            self.weighted = np.logaddexp(own, below) - np.log(2)
            self.stay = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))

    def chance(self, keys: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """The mixed chance of a one at these keys, given the deeper contexts'; even where there is no such node."""
        if not len(self.keys):
            return np.full(len(keys), 0.5)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        own = (self.ones[at] + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        stay = self.stay[at]
        return np.where(self.keys[at] == keys, stay * own + (1 - stay) * deeper, 0.5)


def grow(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = TOP) -> dict[int, list[Nodes]]:
    """The nodes of depths depth to top, by depth and bits, of complete subtrees given as windows and their counts."""
    out: dict[int, list[Nodes]] = {}
    for d in range(depth, top - 1, -1):
        keys, counts = _summed(keys if d == depth else _shorter(keys, d + 1, 8), counts)
        out[d] = []
        for bits in range(8):
            children, n = _summed(keys >> (7 - bits), counts)
            nodes, at = np.unique(children >> 1, return_inverse=True)
            zeros, ones = (np.bincount(at, weights=np.where(children & 1 == b, n, 0), minlength=len(nodes)) for b in (0, 1))
            below = None
            if d < depth:
                deeper = out[d + 1][bits]
                below = np.bincount(np.searchsorted(nodes, _shorter(deeper.keys, d + 1, bits)), weights=deeper.weighted, minlength=len(nodes))
            out[d].append(Nodes(nodes, zeros, ones, below))
    return out


def chances(trees: dict[int, list[Nodes]], keys: np.ndarray, depth: int = DEPTH, top: int = TOP) -> np.ndarray:
    """[windows, 8]: the chance of a one at each decision of the windows' bytes, mixed over depths depth to top."""
    out = np.full((len(keys), 8), 0.5)
    for bits in range(8):
        for d in range(depth, top - 1, -1):
            cut = 8 * (depth - d)
            context, byte = keys >> (8 + cut), keys & 0xFF
            out[:, bits] = trees[d][bits].chance(context << bits | byte >> (8 - bits), out[:, bits])
    return out


class Crown:
    """The mixture of the depths above the subtrees, as a + b * (the subtree's chance), for each nearest byte and decision."""

    def __init__(self, byte: np.ndarray, bits: np.ndarray, prefix: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        """Of each context of one byte and each decision: counts, and the log of the product over its longer contexts."""
        self.a, self.b = np.full((256, 256), 0.5), np.zeros((256, 256))  # [nearest byte, 1 << bits | prefix]
        for k in range(8):
            at = bits == k
            keys = byte[at] << k | prefix[at]
            order = np.argsort(keys)
            one = Nodes(keys[order], zeros[at][order], ones[at][order], below[at][order])
            nodes, up = np.unique(one.keys & ((1 << k) - 1), return_inverse=True)
            root = Nodes(nodes, *(np.bincount(up, weights=w, minlength=len(nodes)) for w in (one.zeros, one.ones, one.weighted)))
            row, column = one.keys >> k, 1 << k | one.keys & ((1 << k) - 1)
            of_root = (1 << k) | nodes
            chance = (root.ones + 0.5) / (root.zeros + root.ones + 1)
            self.a[:, of_root] = root.stay * chance + (1 - root.stay) * 0.5
            chance = (one.ones + 0.5) / (one.zeros + one.ones + 1)
            left = 1 - root.stay[up]
            self.a[row, column] = (root.stay * (root.ones + 0.5) / (root.zeros + root.ones + 1))[up] + left * one.stay * chance
            self.b[row, column] = left * (1 - one.stay)

    def costs(self, keys: np.ndarray, inner: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 of the probability of each window's byte."""
        nearest, byte = keys >> (8 * depth), keys & 0xFF
        out = np.zeros(len(keys))
        for k in range(8):
            column = 1 << k | byte >> (8 - k)
            one = np.clip(self.a[nearest, column] + self.b[nearest, column] * inner[:, k], 1e-12, 1 - 1e-12)
            out += np.log10(np.where(byte >> (7 - k) & 1 == 1, one, 1 - one))
        return out


class Lookup:
    """Numbers by key, for arrays of keys: open addressing in arrays of twice the entries or more."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.entries = keys, values
        slots = 1 << max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - slots.bit_length() + 1), slots - 1
        self.keys, self.values = np.full(slots, -1, np.int64), np.zeros(slots, np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.nonzero(self.keys[at] == -1)[0]
            slots, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[slots], self.values[slots] = keys[left[placed]], values[left[placed]]
            stay = np.ones(len(left), bool)
            stay[placed] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    def __reduce__(self):
        return Lookup, self.entries  # a worker lays the entries out once

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 for keys that aren't there; whether each is)."""
        at = self._slot(keys)
        held = self.keys[at]
        found, values = held == keys, self.values[at]
        left = np.nonzero(~found & (held != -1))[0]
        values[~found] = 0
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[left]
            values[left[hit]], found[left[hit]] = self.values[at[hit]], True
            on = ~hit & (held != -1)
            left, at = left[on], at[on]
        return values, found


# --- counting and training ------------------------------------------------------------------------------------------


def _coded(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, window) of each byte, for some MB of texts at a time; long texts are cut without losing contexts."""
    held, numbers, size = [], [], 0

    def together() -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(h) for h in held])
        inner = np.ones(lengths.sum(), bool)
        starts = np.cumsum(lengths) - lengths
        for j in range(DEPTH):
            inner[starts + j] = False  # contexts only
        return np.repeat(numbers, lengths - DEPTH), windows(b"".join(held))[inner]

    for i, text in enumerate(texts):
        for at in range(0, len(text), AT_ONCE):
            held.append(text[at - DEPTH : at + AT_ONCE] if at else END * DEPTH + text[:AT_ONCE])
            numbers.append(i)
            size += len(held[-1])
            if size >= AT_ONCE:
                yield together()
                held, numbers, size = [], [], 0
    if held:
        yield together()


_COUNTS = "word binary, window long, n long, seen long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, learn) -> (word, or window; n: times in texts to learn from, seen: times in all)."""
    words: tuple[Counter[bytes], Counter[bytes]] = Counter(), Counter()  # of the other texts, and of those to learn from
    keys, n, seen = (np.empty(0, np.int64) for _ in range(3))
    held: list[np.ndarray] = []
    schema = pa.schema([("word", pa.binary()), ("window", pa.int64()), ("n", pa.int64()), ("seen", pa.int64())])

    def of_words() -> Iterator[pa.RecordBatch]:
        for times, learned in zip(words, (0, 1)):
            if times:
                of_each = pa.array(list(times.values()), pa.int64())
                none = pa.nulls(len(times), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(times.keys()), pa.binary()), none, of_each if learned else pa.array(np.zeros(len(times), np.int64)), of_each], schema=schema)
            times.clear()

    def merged(keys: np.ndarray, n: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The counts with those of the windows held, each with a bit for learning from its text."""
        if not held:
            return keys, n, seen
        new = np.sort(np.concatenate(held))
        held.clear()
        first = np.nonzero(np.concatenate([[True], new[1:] >> 1 != new[:-1] >> 1]))[0]
        all_keys = np.concatenate([keys, new[first] >> 1])
        n, seen = np.concatenate([n, np.add.reduceat(new & 1, first)]), np.concatenate([seen, np.diff(np.append(first, len(new)))])
        order = np.argsort(all_keys, kind="stable")
        all_keys = all_keys[order]
        first = np.nonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))[0]
        return all_keys[first], np.add.reduceat(n[order], first), np.add.reduceat(seen[order], first)

    def of_windows() -> Iterator[pa.RecordBatch]:
        nonlocal keys, n, seen
        for i in range(0, len(keys), COUNTED):
            some = slice(i, i + COUNTED)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys[some]), pa.binary()), pa.array(keys[some]), pa.array(n[some]), pa.array(seen[some])], schema=schema)
        keys, n, seen = (np.empty(0, np.int64) for _ in range(3))

    for batch in batches:
        for part, texts in text_slices(batch):
            learn = part.column(1).to_pylist()
            split = [tokens(t) for t in texts]
            for ws, learned in zip(split, learn):
                words[bool(learned)].update(ws)
                words[bool(learned)][END] += 1
            if len(words[0]) + len(words[1]) > COUNTED:
                yield from of_words()
            weight = np.array([bool(x) for x in learn], np.int64)
            for owner, found in _pieces([_coded(ws) for ws in split]):
                held.append(found << 1 | weight[owner])
            if sum(map(len, held)) > AT_ONCE:
                keys, n, seen = merged(keys, n, seen)
            if len(keys) > AT_ONCE:
                yield from of_windows()
    keys, n, seen = merged(keys, n, seen)
    yield from of_words()
    yield from of_windows()


def corpus_counts(docs: DataFrame, learn: Column, text_col: str = "text") -> DataFrame:
    """(word, window, n, seen): a row for each distinct word (the end token among them) and each distinct window."""
    found = docs.select(text_col, F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(_counted, _COUNTS)
    return found.groupBy("word", "window").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


_WEIGHED = "window long, seen long, inner binary, byte int, bits int, prefix int, zeros double, ones double, below double"


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, n, seen) in order of windows -> each window's chances within its subtree, and what subtrees add to the crown."""
    held: list[pa.RecordBatch] = []

    def weigh(some: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, n = some["window"].to_numpy(), some["n"].to_numpy()
        known = n > 0
        trees = grow(keys[known], n[known].astype(np.float64))
        inner = chances(trees, keys).astype(np.float32)
        rows = [pa.array(keys), pa.array(some["seen"].to_numpy()), pa.array([r.tobytes() for r in inner], pa.binary())]
        whole = pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(keys), t) for t in (pa.int32(),) * 3 + (pa.float64(),) * 3)], names=names)
        yield whole
        for bits, nodes in enumerate(trees[TOP] if known.any() else []):
            short, at = np.unique(_shorter(nodes.keys, TOP, bits), return_inverse=True)
            sums = [pa.array(np.bincount(at, weights=w, minlength=len(short))) for w in (nodes.zeros, nodes.ones, nodes.weighted)]
            place = [pa.array((short >> bits).astype(np.int32)), pa.array(np.full(len(short), bits, np.int32)), pa.array((short & ((1 << bits) - 1)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(short), pa.int64()), pa.nulls(len(short), pa.int64()), pa.nulls(len(short), pa.binary()), *place, *sums], names=names)

    names = [c.split()[0] for c in _WEIGHED.split(", ")]
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > WEIGHED:
            every = pa.Table.from_batches(held)
            sub = every["window"].to_numpy() >> (8 * (DEPTH + 1 - TOP))
            whole = int(np.searchsorted(sub, sub[-1]))  # the last subtree may go on
            if whole:
                yield from weigh(every.slice(0, whole))
                held = every.slice(whole).combine_chunks().to_batches()
                size = every.num_rows - whole
    if size:
        yield from weigh(pa.Table.from_batches(held))


def _costed(crown):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            inner = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, 8).astype(np.float64)
            costs = crown.value.costs(keys, inner).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs)], names=["window", "seen", "cost"])

    return run


def window_costs(counts: DataFrame) -> DataFrame:
    """(window, n, seen) -> (window, seen, cost): log10 of the probability of each window's byte, as a scratch table.

    The driver gets a row for each byte and decision, 65,280 at most.
    """
    placed = counts.select("window", "n", "seen").repartition(F.shiftrightunsigned("window", 8 * (DEPTH + 1 - TOP))).sortWithinPartitions("window")
    weighed = scratch_table(placed.mapInArrow(_weighed, _WEIGHED), "weighed")
    above = weighed.where("window is null").groupBy("byte", "bits", "prefix").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
    place, sums = ([above[c].to_numpy().astype(kind) for c in names] for kind, names in ((np.int64, ("byte", "bits", "prefix")), (np.float64, ("zeros", "ones", "below"))))
    crown = counts.sparkSession.sparkContext.broadcast(Crown(*place, *sums))
    out = scratch_table(weighed.where("window is not null").select("window", "seen", "inner").mapInArrow(_costed(crown), "window long, seen long, cost float"), "costs")
    drop_scratch(weighed)
    return out


def most_frequent(costs: DataFrame, most: int = SENT) -> tuple[int, Lookup]:
    """(least number of times seen, costs of the windows seen so often): at most `most` windows come to the driver."""
    sizes = costs.groupBy(F.floor(F.log2("seen")).cast("int").alias("e")).count().orderBy(F.desc("e")).collect()  # a row for each power of two
    least, held = 1 << 62, 0
    for r in sizes:
        held += r["count"]
        if held > most:
            break
        least = 1 << r["e"]
    found = costs.where(F.col("seen") >= least).select("window", "cost").toArrow()
    return least, Lookup(found["window"].to_numpy(), found["cost"].to_numpy())


# --- scoring ----------------------------------------------------------------------------------------------------------


def _doc_parts(words, costs):
    """Texts -> a row for each document with its sums over what was sent, and one for each of its other words and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of, counts, base = words.value  # place 0: words that weren't sent
        lookup = costs.value
        for batch in batches:
            for part, texts in text_slices(batch, batch.num_columns - 1):
                split = [tokens(t) for t in texts]
                coded = [_coded(ws) for ws in split]
                n = len(split)
                flat = pa.array(list(chain.from_iterable(chain(ws, (END,)) for ws in split)), pa.binary()).dictionary_encode()
                owner = np.repeat(np.arange(n), [len(ws) + 1 for ws in split])
                number = flat.indices.to_numpy()
                place = np.array([place_of.get(w, 0) for w in flat.dictionary.to_pylist()], np.int32)[number]
                known = np.bincount(owner, weights=counts[place] > 0, minlength=n).astype(np.int64)
                base_sum = np.bincount(owner, weights=base[place], minlength=n)
                other = place == 0
                rare, times = np.unique(owner[other] << 32 | number[other], return_counts=True)
                score, others = np.zeros(n), []
                for of_text, found in _pieces(coded):
                    values, hit = lookup.of(found)
                    score += np.bincount(of_text, weights=values, minlength=n)
                    others.append(of_text[~hit] << 48 | found[~hit])
                left, m = np.unique(np.concatenate(others) if others else np.empty(0, np.int64), return_counts=True)
                r, c = len(rare), len(left)
                take = pa.array(np.concatenate([np.arange(n), rare >> 32, left >> 48]))

                def column(values: np.ndarray) -> pa.Array:
                    return pa.array(np.concatenate([values, np.zeros(r + c, values.dtype)]))

                columns = [x.take(take) for x in part.columns[:-1]]
                of_word = pa.array(np.concatenate([np.zeros(n, np.int64), rare & 0xFFFFFFFF, np.zeros(c, np.int64)]), mask=np.repeat([True, False, True], [n, r, c]))
                columns += [flat.dictionary.take(of_word), pa.array(np.concatenate([np.zeros(n + r, np.int64), left & ((1 << 48) - 1)]), mask=np.arange(n + r + c) < n + r)]
                columns += [pa.array(np.concatenate([np.ones(n, np.int64), times, m]))]
                columns += [column(x) for x in (np.bincount(owner, minlength=n), known, np.array([len(x) for x in coded], np.int64), base_sum, score)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "word", "window", "times", "n_tokens", "n_known", "n_bytes", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", frequent_share: int = FREQUENT, sent: int = SENT) -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    learn: true for the rows of docs to learn from (null: not). base_score sums log10((c + 1) / (N + V + 1)) over a
    text's tokens (c: the token's count in training, N: all training tokens, V: distinct ones); n_known counts tokens
    with c > 0; score is log10 of the model's probability of the text. Null texts count as empty: an end token only.
    Repeated rows count each time, in training and in the result. Nothing to learn from gives even decisions; empty
    docs an empty result. Very long texts are coded whole, a few MB at a time.

    Frequent words (at most frequent_share of them, by the share of tokens that each must have) and windows (at most
    sent) go to all tasks with their scores; a document's others are joined to theirs. What is sent changes no score.
    """
    spark = docs.sparkSession
    counts = scratch_table(corpus_counts(docs, learn, text_col), "counts")
    words, of_windows = counts.where("word is not null").drop("window"), counts.where("window is not null").drop("word")
    sums = words.agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_all, n_distinct = sums["n"] or 0, sums["v"]
    costs = window_costs(of_windows)
    _, lookup = most_frequent(costs, sent)
    known = words.where(F.col("seen") * frequent_share >= (sums["seen"] or 0)).toArrow()
    bottom = float(np.log10(n_all + n_distinct + 1))
    times = np.concatenate([[0], known["n"].to_numpy()])
    base = np.where(np.arange(len(times)) > 0, np.log10(times + 1.0) - bottom, 0)
    of_words = spark.sparkContext.broadcast((dict(zip(known["word"].to_pylist(), range(1, len(times)))), times, base))

    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = rows.mapInArrow(_doc_parts(of_words, spark.sparkContext.broadcast(lookup)), f"id {kind}, key long, word binary, window long, times long, n_tokens long, n_known long, n_bytes long, base_score double, score double")
    parts = scratch_table(parts, "parts")
    added = ("times", "n_tokens", "n_known", "n_bytes", "base_score", "score")
    whole = parts.where("word is null and window is null").select("id", "key", *added)
    none = F.lit(0).cast("long")
    rare = parts.where("word is not null").select("id", "key", "times", "word").join(words, "word")
    rare = rare.select(
        "id", "key", none.alias("times"), none.alias("n_tokens"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"), none.alias("n_bytes"),
        (F.col("times") * (F.log10(F.col("n") + 1) - bottom)).alias("base_score"), F.lit(0.0).alias("score"),
    )
    other = parts.where("window is not null").select("id", "key", "times", "window").join(costs, "window")
    other = other.select("id", "key", none.alias("times"), none.alias("n_tokens"), none.alias("n_known"), none.alias("n_bytes"), F.lit(0.0).alias("base_score"), (F.col("times") * F.col("cost").cast("double")).alias("score"))
    both = whole.unionByName(rare).unionByName(other).groupBy("id", "key").agg(*(F.sum(c).alias(c) for c in added))
    # equal rows have been added up; times counts them
    one = both.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))), *((F.col(c) / F.col("times")).cast("long").alias(c) for c in added[1:4]), *((F.col(c) / F.col("times")).alias(c) for c in added[4:]))
    bits = (F.col("score") * -float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte")
    return one.select("id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits)
