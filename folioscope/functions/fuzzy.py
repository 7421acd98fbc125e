"""Fuzzy scores of pairs of strings (0 to 100), and the match score of acronym expansions and keywords."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with b's positions as bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    row = (1 << len(b)) - 1
    for c in a:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & (1 << len(b)) - 1
    return len(b) - row.bit_count()


def _distance(a: str, b: str) -> int:
    return len(a) + len(b) - 2 * common_subsequence(a, b)


def ratio(a: str, b: str) -> float:
    whole = len(a) + len(b)
    return 100 * (1 - _distance(a, b) / whole) if whole else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Best likeness among the shared words and the shared words with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = x & y
    if shared and (x <= y or y <= x):
        return 100.0
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    base = len(" ".join(sorted(shared)))
    gap = base > 0
    size_x, size_y = base + gap + len(only_x), base + gap + len(only_y)
    scores = [1 - _distance(only_x, only_y) / (size_x + size_y)]
    if base:
        scores += [1 - (gap + len(only_x)) / (base + size_x), 1 - (gap + len(only_y)) / (base + size_y)]
    return 100 * max(scores)


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a stretch of its length (or less, at the ends) of the longer."""
    if not a or not b:
        return 100.0 if a == b else 0.0

    def best(short: str, long: str) -> float:
        n, m = len(short), len(long)
        spans = {long[max(0, i) : i + n] for i in range(1 - n, m)}
        return max(ratio(short, s) for s in spans if s)

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


def fuzzy_score(full_form: str, keyword: str) -> float:
    return SET_SHARE * token_set_ratio(full_form, keyword) / 100 + PART_SHARE * partial_ratio(full_form, keyword) / 100


# --- what a score needs -----------------------------------------------------------------------------------------------
# With B characters in common (counted with repeats), the longest common subsequence of two strings is at most B. Without a common
# word the set ratio is then at most 2 B / (x + y) for the lengths x and y of the sorted words, and the partial ratio, whose window may be as short as what is
# common, at most 2 B / (s + B) for the shorter length s.

SET_SHARE, PART_SHARE = 0.7, 0.3


def character_elements(text: Column) -> Column:
    """A string's characters, the k-th occurrence of one as the character and k; white space is one character."""
    each = F.filter(F.split(F.regexp_replace(text, r"\s", " "), ""), lambda c: c != "")
    step = lambda seen, c: F.struct(F.map_concat(F.map_filter(seen["n"], lambda k, _: k != c), F.create_map(c, F.coalesce(F.try_element_at(seen["n"], c), F.lit(0)) + 1)).alias("n"), F.array_append(seen["e"], F.concat(c, (F.coalesce(F.try_element_at(seen["n"], c), F.lit(0)) + 1).cast("string"))).alias("e"))
    none = F.struct(F.create_map().cast("map<string,int>").alias("n"), F.array().cast("array<string>").alias("e"))
    return F.aggregate(each, none, step)["e"]


def set_length(text: Column) -> Column:
    """Length of a string's distinct words with blanks between."""
    words = F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.length(F.array_join(words, " "))


def partner_lengths(length: Column, threshold: float) -> Column:
    """The set lengths that a string without a common word must have to reach the threshold (over PART_SHARE) with one of this length."""
    r = (threshold - PART_SHARE) / (2 * SET_SHARE + PART_SHARE - threshold)
    low, high = F.greatest(F.ceil(length * r - 1e-9), F.lit(1)).cast("int"), F.floor(length / r + 1e-9).cast("int")
    return F.when((length > 0) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def characters_needed(x: Column, y: Column, threshold: float) -> Column:
    """The least number of common characters with which strings of set lengths x and y, without a common word, can reach the threshold."""
    least = F.least(x, y)
    p = F.lit(2 * SET_SHARE) / (x + y)
    q = p * least + (2 * PART_SHARE - threshold)
    root = (F.sqrt(q * q + 4 * p * threshold * least) - q) / (2 * p)
    return F.least(F.ceil(root - 1e-6), least).cast("int")


@F.pandas_udf(DoubleType())
def fuzzy_scores(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([fuzzy_score(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def expansion_match(full_form: Column, keyword: Column) -> tuple[Column, Column]:
    """(condition, score) where a built-in expression decides: keywords of one character or none score 0, contained
    ones 0.7 plus 0.3 times their share of the length. Other pairs need fuzzy_scores of the lower-cased strings."""
    full, key = F.lower(full_form), F.lower(keyword)
    short = (F.length(F.trim(keyword)) == 0) | (F.length(keyword) == 1)
    inside = full.contains(key)
    score = F.when(short, 0.0).otherwise(F.lit(0.7) + F.lit(0.3) * F.length(key) / F.length(full))
    return short | inside, score
