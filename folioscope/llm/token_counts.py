"""Numbers of word pieces that greedy longest-match-first tokenisation gives, without building the pieces.

A linear automaton over the vocabulary: a trie of word-initial pieces and one of continuations, where each node
has a failure link (the node reached when the longest pieces of the node's string are taken off) and the number
of pieces taken off then. A word costs one step per character and the failures, which take off characters that
were read, so the work is linear. Each distinct word of a batch is walked once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_slices, unused_name

#: Distinct words whose counts a worker remembers; beyond that it starts anew.
CACHED = 400_000
_DEAD = -1


class PieceCounter:
    """Counts the pieces of words. initial, following: pieces that begin a word, and that continue one.

    An empty initial piece is a bare word mark: a token that begins any word no other initial piece begins, with
    continuations for all its characters. A word that has no pieces throughout counts as one unknown token.
    """

    def __init__(self, initial: Iterable[str], following: Iterable[str]):
        initial = list(initial)
        self.children: list[dict[str, int]] = [{}, {}]  # 0: where a word begins, 1: where a continuation begins
        ends = [False, False]
        for root, pieces in enumerate((initial, following)):
            for piece in pieces:
                at = root
                for c in piece:
                    step = self.children[at].get(c)
                    if step is None:
                        step = self.children[at][c] = len(self.children)
                        self.children.append({})
                        ends.append(False)
                    at = step
                if piece:
                    ends[at] = True
        n = len(self.children)
        self.fails, self.pops = [_DEAD] * n, [0] * n
        if "" in initial:  # the bare mark is taken off where a word begins
            self.fails[0], self.pops[0] = 1, 1
        queue = deque((0, 1))
        while queue:
            at = queue.popleft()
            for c, to in self.children[at].items():
                if ends[to]:
                    self.fails[to], self.pops[to] = 1, 1
                else:
                    popped, back = self.pops[at], self.fails[at]
                    while back != _DEAD and c not in self.children[back]:
                        popped += self.pops[back]
                        back = self.fails[back]
                    if back != _DEAD:
                        self.fails[to], self.pops[to] = self.children[back][c], popped
                queue.append(to)

    def count(self, word: str) -> int:
        children, fails, pops = self.children, self.fails, self.pops
        at, n = 0, 0
        for c in word:
            step = children[at].get(c)
            while step is None:
                n += pops[at]
                at = fails[at]
                if at == _DEAD:
                    return 1
                step = children[at].get(c)
            at = step
        while at != 1 and at != 0:
            n += pops[at]
            at = fails[at]
            if at == _DEAD:
                return 1
        return n


def vocabulary(model_file: str, bare_mark: bool = False) -> tuple[list[str], list[str]]:
    """The (initial, following) pieces of a sentencepiece model file: those after its word mark, and the others.

    bare_mark: the mark alone is a piece too (if the model has it), as the empty initial piece; without it a word
    that no marked piece begins is unknown. Control, unknown and byte
    pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    mark = "▁"
    initial = [p[1:] for p in pieces if p[:1] == mark and (bare_mark or len(p) > 1)]
    following = [p for p in pieces if mark not in p]
    return initial, following


def _counted(pieces: tuple[list[str], list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = PieceCounter(*pieces).count, {}
        for batch in batches:
            for part, texts in text_slices(batch, batch.num_columns - 1):
                words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
                if len(known) > CACHED:
                    known = {}
                for ws in words:
                    for w in ws:
                        if w not in known:
                            known[w] = count(w.decode("utf-8", "replace"))
                get = known.__getitem__
                tokens = [sum(map(get, ws)) for ws in words]
                longest = [max(map(get, ws), default=0) for ws in words]
                columns = [*part.columns[:-1], pa.array([len(ws) for ws in words], pa.int64()), pa.array(tokens, pa.int64()), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "n_words", "n_tokens", "max_word_tokens"])

    return run


def count_tokens(docs: DataFrame, pieces: tuple[list[str], list[str]], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (all but the text) with n_words, n_tokens, max_word_tokens (long).

    Words stand between ASCII white space; each gives its greedy longest-match pieces, or one unknown token. Null
    and empty texts have 0 of each. Repeated rows are counted each time. Kept columns named like new ones are left
    out. pieces is a vocabulary, whose size is fixed; it goes to the tasks with the code.
    """
    new = {"n_words", "n_tokens", "max_word_tokens"}
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text_col and c.lower() not in new]
    rows = docs.select(*keep, F.col(text_col).alias(unused_name(docs, "text_")))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_counted(pieces), f"{kept}n_words long, n_tokens long, max_word_tokens long")
