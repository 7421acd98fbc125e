"""Language identification by cross-parsing entropy.

Each language has a sample of labelled text and its suffix automaton, which accepts exactly the sample's
substrings. A text is parsed against it into phrases: each is the longest match from where the last ended (a
character that the sample lacks is a phrase). Phrases times the logarithm of the sample's length, per character,
estimate the cross entropy; the language that needs the fewest so normalised phrases wins.

Greedy parsing only follows transitions and starts anew at the root, so a failed step is the root's step with a
flag. The transitions of an automaton are packed into one comb (each state's row is laid into the holes of others),
so its size follows the sample, not the alphabet. Many stretches of ``BLOCK`` symbols are parsed at once, one array
operation per position: first as if a phrase began with each stretch, then from where the stretch before really
ended, until both parses begin a phrase at the same symbol. So a text's phrases are those of one parse of it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import drop_scratch, scratch_table, text_slices, unused_name

#: The bound of the labelled sample: rows of each language and of all together, and their characters, so that the automata
#: (about 60 bytes a character) don't outgrow a task or the driver: at most 60 MB. The chosen texts are learned from whole.
SAMPLE_DOCS, ALL_DOCS = 100, 1000
SAMPLE_CHARS, ALL_CHARS = 300_000, 1_000_000
#: Symbols that are parsed side by side with others, and in all at once.
BLOCK = 2048
AT_ONCE = 1 << 21
#: Parses that are followed one by one.
FEW = 8
UNKNOWN = "und"
_FLAG = np.int64(1 << 30)
_POINTS = 0x110000


class SuffixAutomaton:
    """Transitions of the minimal automaton of a text's substrings; state 0 is the root."""

    def __init__(self, symbols: np.ndarray):
        length, link, nexts = [0], [-1], [{}]
        last = 0
        for c in symbols.tolist():
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            nexts.append({})
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    nexts.append(dict(nexts[q]))
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.nexts = nexts

    def comb(self, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each state, slots of state << 32 | next state, steps from the root).

        The transition of a state by symbol c lies at its place + c; a slot of another state means there is none.
        The root's row is not in the comb: what follows it begins a phrase.
        """
        places = np.zeros(len(self.nexts), np.int64)
        total = sum(map(len, self.nexts))
        taken, slots = bytearray(2 * total + 2 * n_symbols + 64), {}
        one, rng = 0, np.random.default_rng(7)
        guesses = rng.integers(0, max(1, 2 * total), 1 << 16).tolist()
        at = 0
        rows = sorted(range(1, len(self.nexts)), key=lambda s: -len(self.nexts[s]))
        for s in rows:
            row = self.nexts[s]
            if len(row) > 1:
                while True:
                    place = guesses[at]
                    at = (at + 1) & 0xFFFF
                    if at == 0:
                        taken.extend(bytes(total))
                        guesses = rng.integers(0, len(taken) - n_symbols - 1, 1 << 16).tolist()
                    if not any(taken[place + c] for c in row):
                        break
            elif row:  # in any hole: the place may lie before the first slot
                (c,) = row
                while one < len(taken) and taken[one]:
                    one += 1
                place = one - c
            else:
                continue
            places[s] = place
            for c, t in row.items():
                if place + c >= len(taken):
                    taken.extend(bytes(total + n_symbols))
                taken[place + c] = 1
                slots[place + c] = s << 32 | t
        packed = np.full(len(taken) + 2 * n_symbols, -1, np.int64)
        packed[np.fromiter(slots.keys(), np.int64, len(slots)) + n_symbols] = np.fromiter(slots.values(), np.int64, len(slots))
        root = np.zeros(n_symbols, np.int64)
        for c, t in self.nexts[0].items():
            root[c] = t
        return places + n_symbols, packed, root | _FLAG


class CrossParser:
    """Languages' samples -> phrase counts of texts."""

    def __init__(self, samples: dict[str, str], spark: SparkSession | None = None):
        """With a session the languages' automata are built by its tasks, else here."""
        self.langs = sorted(samples)
        texts = {k: samples[k].lower() for k in self.langs}
        codes = np.unique(np.concatenate([_points(t) for t in texts.values()] or [np.empty(0, np.uint32)]))
        every = "".join(map(chr, range(_POINTS)))
        self.table = np.fromiter(map(str.isalpha, every), bool, _POINTS).astype(np.int32)  # 0: between words, 1: any other letter
        letters = codes[self.table[codes] == 1]
        self.table[letters] = 2 + np.arange(len(letters))
        self.n_symbols = 2 + len(letters)
        places, slots, roots, self.bits, states, at = [], [], [], [], 0, 0
        self.first = []
        every = [np.concatenate(list(self.symbols(texts[k]))) for k in self.langs]
        combs = _combs(spark, every, self.n_symbols) if spark is not None and every else [SuffixAutomaton(s).comb(self.n_symbols) for s in every]
        for symbols, (place, packed, root) in zip(every, combs):
            self.first.append(states)
            packed, known = np.array(packed), packed >= 0
            packed[known] += states * ((1 << 32) + 1)
            places.append(place + at)
            slots.append(packed)
            roots.append(((root & ~_FLAG) + states) | _FLAG)
            self.bits.append(np.log2(max(2, len(symbols))))
            states, at = states + len(place), at + len(packed)
        self.places = np.concatenate(places) if places else np.empty(0, np.int64)
        self.slots = np.concatenate(slots) if slots else np.empty(0, np.int64)
        self.roots = np.stack(roots) if roots else np.empty((0, self.n_symbols), np.int64)

    def symbols(self, lowered: str) -> Iterator[np.ndarray]:
        """Symbols of a lower-cased text, in stretches of at most AT_ONCE; runs between words are one, and it begins with one."""
        before = 1
        for i in range(0, max(1, len(lowered)), AT_ONCE):
            s = self.table[_points(lowered[i : i + AT_ONCE])]
            if i == 0:
                s = np.concatenate([np.zeros(1, np.int32), s])
            kept = s[(s != 0) | (np.concatenate([[before], s[:-1]]) != 0)]
            before = s[-1]
            yield kept

    def _step(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The next states, flagged where a phrase begins at the symbol."""
        found = self.slots[self.places[state] + symbol]
        return np.where(found >> 32 == state, found & 0xFFFFFFFF, self.roots[lang, symbol])

    def _follow(self, state: int, symbols: np.ndarray, starts: np.ndarray, lang: int) -> tuple[int, int | None]:
        """(phrases that a parse from that state has more than the block's own, state at the end; None where they met)."""
        more, places, slots, roots = 0, self.places, self.slots, self.roots[lang].tolist()
        for c, old in zip(symbols.tolist(), starts.tolist()):
            found = int(slots[places[state] + c])
            if found >> 32 == state:
                state = found & 0xFFFFFFFF
                more -= old
            elif old:
                return more, None
            else:
                state = roots[c] & ~int(_FLAG)
                more += 1
        return more, state

    def _parse(self, blocks: list[np.ndarray], before: list[int], carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each block, states at its end) by language.

        before: the number of the block that each one goes on from, -1 where it goes on from the row of carried.
        """
        n, lengths = len(self.langs), np.array([len(b) for b in blocks])
        order = np.argsort(-lengths, kind="stable")
        grid = np.zeros((int(lengths.max()), len(blocks)), np.int32)
        for column, k in enumerate(order):
            grid[: lengths[k], column] = blocks[k]
        column_of = np.empty(len(blocks), np.int64)
        column_of[order] = np.arange(len(blocks))
        long = lengths[order]
        active = np.searchsorted(-long, -np.arange(len(grid)), side="left")  # blocks longer than each position
        langs = np.arange(n)[None, :]
        state = np.repeat(np.array(self.first, np.int64)[None, :], len(blocks), axis=0)
        counts, starts = np.zeros((len(blocks), n), np.int64), np.zeros((len(grid), len(blocks), n), bool)
        for at in range(len(grid)):
            m = active[at]
            step = self._step(state[:m], grid[at, :m, None], langs)
            starts[at, :m] = step & _FLAG
            state[:m] = step & ~_FLAG
        counts += starts.sum(axis=0)
        # now from the states that the blocks before ended in, until the parse meets the first one
        alone = state.copy()
        more, chain, following = np.zeros_like(counts), list(range(len(blocks))), np.full(len(blocks), -1)
        for k, b in enumerate(before):
            if b >= 0:
                chain[k], following[b] = chain[b], k
        chain = np.array(chain)
        back = np.array(before)
        pending, all_at_once = np.ones((len(blocks), n), bool), True
        while pending.any():
            block, lang = np.nonzero(pending)  # in order of the blocks
            if not all_at_once:  # the first of each text: what it goes on from is settled
                first = np.sort(np.unique(chain[block] * n + lang, return_index=True)[1])
                block, lang = block[first], lang[first]
            pending[block, lang] = all_at_once = False
            column, b = column_of[block], back[block]
            now, left = np.where(b >= 0, state[column_of[b], lang], carried[block, lang]), np.arange(len(block))
            end = alone[column, lang]
            more[column, lang] = 0
            if len(block) <= FEW:  # texts that go on and on without meeting their blocks' parses, as periodic ones do
                for i, (c, l) in enumerate(zip(column, lang)):
                    more[c, l], met = self._follow(int(now[i]), grid[: long[c], c], starts[: long[c], c, l], l)
                    end[i] = end[i] if met is None else met
                left = left[:0]
            for at in range(len(grid)):
                over = long[column[left]] <= at
                if over.any():
                    end[left[over]] = now[over]
                    left, now = left[~over], now[~over]
                if not len(left):
                    break
                c, l = column[left], lang[left]
                step = self._step(now, grid[at, c], l)
                flag, old = (step & _FLAG) != 0, starts[at, c, l]
                apart = ~(flag & old)
                more[c[apart], l[apart]] += flag[apart].astype(np.int64) - old[apart]
                left, now = left[apart], (step & ~_FLAG)[apart]
            else:
                end[left] = now
            changed = end != state[column, lang]
            state[column, lang] = end
            after = following[block[changed]]
            pending[after[after >= 0], lang[changed][after >= 0]] = True
        return (counts + more)[column_of], state[column_of]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of each text, phrases of each text and language)."""
        n = len(self.langs)
        sizes, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), n), np.int64)
        if not n:
            return sizes, out
        ends = np.repeat(np.array(self.first, np.int64)[None, :], len(texts), axis=0)
        owner, blocks, before, held = [], [], [], 0

        def parsed() -> None:
            if blocks:
                counts, states = self._parse(blocks, before, ends[owner])
                np.add.at(out, np.array(owner), counts)
                ends[owner] = states  # the last block of a text is written last

        for i, text in enumerate(texts):
            last = -1
            for s in self.symbols(text.lower()):
                sizes[i] += len(s)
                for at in range(0, len(s), BLOCK):
                    before.append(last)
                    last = len(blocks)
                    owner.append(i)
                    blocks.append(s[at : at + BLOCK])
                    held += BLOCK
                if held > AT_ONCE:
                    parsed()
                    owner, blocks, before, held, last = [], [], [], 0, -1
        parsed()
        return sizes, out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text. The score is the winner's share of 2 ** -(entropy gap * min(n, 16))."""
        lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        sizes, counts = self.phrases([t if ok else "" for t, ok in zip(texts, lettered)])
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        entropy = counts * np.array(self.bits) / np.maximum(sizes, 1)[:, None]
        best = entropy.argmin(axis=1)
        gap = entropy - entropy.min(axis=1, keepdims=True)
        score = 1 / (2.0 ** -(gap * np.minimum(sizes, 16)[:, None])).sum(axis=1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], [float(s) if ok else 0.0 for s, ok in zip(score, lettered)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _least_hashes(keys: DataFrame, max_docs: int) -> dict[str, list]:
    """keys(lang, h, size), distinct -> for each language its max_docs least hashes in order, with their sizes.

    Hashes are even, so a cut at four times the share that is wanted leaves some hundred rows; where it left too few, a higher one
    is taken.
    """
    spark = keys.sparkSession
    wanted = {r["lang"]: (r["n"], 4) for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    out: dict[str, list] = {}
    while wanted:
        cuts = [(k, min((1 << 63) - 1, int(min(1.0, times * max_docs / n) * (1 << 64)) - (1 << 63))) for k, (n, times) in wanted.items()]
        low = keys.join(F.broadcast(spark.createDataFrame(cuts, "lang string, cut long")), "lang").where("h <= cut")
        found: dict[str, list] = {k: [] for k in wanted}
        for r in low.collect():
            found[r["lang"]].append((r["h"], r["size"]))
        for k, rows in found.items():
            if len(rows) >= min(max_docs, wanted[k][0]):
                out[k] = sorted(rows)[:max_docs]
        wanted = {k: (n, 8 * times) for k, (n, times) in wanted.items() if k not in out}
    return out


def labelled_samples(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Each language's sample: the whole texts of at most max_docs rows and max_chars characters, one text each a line.

    The rows are those of the least hashes of their text (of copies, one), so a language of fewer distinct texts is learned from all
    of them. A text that the characters left don't hold is passed over for the next; where none is short enough, the shortest of the rows is taken
    whole. ALL_DOCS and ALL_CHARS, divided among the languages, bound what many languages give together.
    Rows without a language or a text don't count; an empty table gives no sample.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    keys = scratch_table(known.groupBy("lang", "h").agg(F.min(F.length("text")).alias("size")), "keys")
    least = _least_hashes(keys, max_docs)
    drop_scratch(keys)
    most, room = max(1, ALL_DOCS // max(1, len(least))), min(max_chars, ALL_CHARS // max(1, len(least)))
    chosen = []
    for lang, rows in least.items():
        left, own = room, []
        for h, size in rows[:most]:
            if size <= left:
                own.append(h)
                left -= size
        chosen += [(lang, h) for h in own or [min(rows[:most], key=lambda r: (r[1], r[0]))[0]]]
    if not chosen:
        return {}
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, h long")
    texts = known.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # at most ALL_DOCS keys
    parts: dict[str, list] = {}
    for r in texts.collect():
        parts.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return {k: "\n".join(t for _, t in sorted(v)) for k, v in parts.items()}


def _combed(n_symbols: int):
    """Rows (i, symbols) -> the comb of each sample's automaton, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, symbols in zip(*(c.to_pylist() for c in batch.columns)):
                parts = SuffixAutomaton(np.frombuffer(symbols, np.int32)).comb(n_symbols)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["i", "places", "slots", "root"])

    return run


def _combs(spark: SparkSession, samples: list[np.ndarray], n_symbols: int) -> list[tuple[np.ndarray, ...]]:
    """The combs of all samples, each built in a task of its own."""
    rows = spark.createDataFrame([(i, bytearray(s.astype(np.int32).tobytes())) for i, s in enumerate(samples)], "i int, symbols binary").repartition(max(1, len(samples)))
    made = rows.mapInArrow(_combed(n_symbols), "i int, places binary, slots binary, root binary")
    found = {r["i"]: tuple(np.frombuffer(r[c], np.int64) for c in ("places", "slots", "root")) for r in made.toLocalIterator()}  # one at a time, without copies
    return [found[i] for i in range(len(samples))]


def _predicted(parser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser.value
        for batch in batches:
            for part, texts in text_slices(batch, batch.num_columns - 1, 1024):
                langs, scores = model.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, samples: dict[str, str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (all but the text) with lang_pred and score (0 to 1).

    lang_pred is a key of samples (ties: the first in alphabetical order), or `und` with score 0 where the text is
    null or has no letter, or samples is empty. Only the text is looked at. Repeated rows get equal results; an
    empty table gives an empty result. Kept columns named like the new ones are left out. Very long texts are parsed
    whole, AT_ONCE symbols at a time. The automata go to the tasks as a broadcast of about 60 bytes for each
    character of the samples, whatever the alphabet.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text_col and c.lower() not in ("lang_pred", "score")]
    parser = docs.sparkSession.sparkContext.broadcast(CrossParser(samples, docs.sparkSession))
    rows = docs.select(*keep, F.col(text_col).alias(unused_name(docs, "text_")))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predicted(parser), f"{kept}lang_pred string, score double")
