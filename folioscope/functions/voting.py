"""Voting keys (what makes two responses one vote) and pairwise comparison of field values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.vectors import log_bin, semantic_bucket

EXACT, SEMANTIC, RANGE, IGNORE, CUSTOM = "exact", "semantic", "range", "ignore", "custom"
DERIVED, ORDERED, UNORDERED = "derived", "sequence_ordered_derived", "sequence_unordered_derived"
ORDERED_ALIKE, UNORDERED_ALIKE = "sequence_ordered_alike", "sequence_unordered_alike"
STRATEGIES = (EXACT, SEMANTIC, RANGE, IGNORE, CUSTOM, DERIVED, ORDERED, UNORDERED, ORDERED_ALIKE, UNORDERED_ALIKE)


@dataclass(frozen=True)
class VotingField:
    """How a field counts: its strategy, the tolerance of RANGE, the threshold of the likes, a comparator of CUSTOM.

    fields: of a struct (or the structs of an array), for the DERIVED strategies.
    """

    strategy: str = EXACT
    tolerance: float = 0.1
    threshold: float = 0.8
    comparator: Callable | None = None
    fields: dict[str, VotingField] = field(default_factory=dict)

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")


def size_bucket(n: Column, threshold: float) -> Column:
    """The coarse size of a sequence: the stricter the threshold, the finer."""
    if threshold > 0.7:
        return F.concat(F.lit("exact_"), n.cast("string"))
    steps = [(2, "small"), (5, "medium")] if threshold <= 0.5 else [(1, "tiny"), (3, "small"), (5, "medium")]
    out = F.lit("large")
    for most, name in reversed(steps):
        out = F.when(n <= most, name).otherwise(out)
    return out


def ordered_key(items: Column) -> Column:
    """Key of an array of strings in its order."""
    return F.concat(F.lit("ordered:"), F.size(items).cast("string"), F.lit(":"), F.array_join(items, ":"))


def unordered_key(items: Column) -> Column:
    """Key of an array of strings as a set, with its size as a list."""
    return F.concat(F.lit("unordered:"), F.size(items).cast("string"), F.lit(":"), F.array_join(F.sort_array(F.array_distinct(items)), ":"))


def alike_key(items: Column, threshold: float, ordered: bool) -> Column:
    """Key of an array of strings that tells apart only its beginning (in its order, or sorted) and its coarse size."""
    n = F.size(items)
    short = F.transform(items, lambda x: F.substring(x, 1, 20))
    if ordered:
        kept = F.slice(short, F.lit(1), F.floor(n * max(threshold, 0.5)).cast("int"))
    else:
        kept = F.slice(F.sort_array(short), F.lit(1), F.greatest(F.floor(n * threshold), F.lit(1)).cast("int"))
    name = "ordered_alike" if ordered else "unordered_alike"
    key = F.concat(F.lit(f"{name}:size_"), size_bucket(n, threshold), F.lit(":content_"), F.array_join(kept, ":"))
    return F.when(n == 0, f"{name}:empty").otherwise(key)


def struct_key(value: Column, spec: VotingField) -> Column:
    """Key of a struct: its fields that count, by name."""
    named = [F.concat(F.lit(f"{k}:"), F.coalesce(value[k].cast("string"), F.lit("null"))) for k in sorted(spec.fields) if spec.fields[k].strategy != IGNORE]
    return F.concat_ws(":", F.lit("model"), *named)


def item_key(item: Column, fields: list[str]) -> Column:
    """An item of a list of structs as one word: its term, else the first 20 characters of its text, else of its first field."""
    given = item["term"].cast("string") if "term" in fields else item["text" if "text" in fields else fields[0]].cast("string").substr(1, 20)
    return F.coalesce(given, F.lit("null"))


def field_key(value: Column, spec: VotingField, embed: Callable[[Column], Column] | None = None) -> Column | None:
    """A field's part of the voting key (None: it doesn't count). Text is SEMANTIC through embed, else as it is."""
    items = value
    if spec.fields and spec.strategy in (ORDERED_ALIKE, UNORDERED_ALIKE):
        items = F.transform(value, lambda x: item_key(x, list(spec.fields)))
    elif spec.fields and spec.strategy not in (DERIVED, IGNORE):
        items = F.transform(value, lambda x: struct_key(x, spec))
    if spec.strategy == IGNORE:
        return None
    if spec.strategy == SEMANTIC:
        return semantic_bucket(embed(F.lower(F.trim(value))), spec.threshold) if embed else F.lower(F.trim(value))
    if spec.strategy == RANGE:
        return log_bin(value, spec.tolerance)
    if spec.strategy == ORDERED:
        return ordered_key(items)
    if spec.strategy == UNORDERED:
        return unordered_key(items)
    if spec.strategy in (ORDERED_ALIKE, UNORDERED_ALIKE):
        return alike_key(items, spec.threshold, spec.strategy == ORDERED_ALIKE)
    if spec.strategy == DERIVED:
        return struct_key(value, spec)
    return value.cast("string")


def voting_key(response: dict[str, Column], specs: dict[str, VotingField], embed: Callable[[Column], Column] | None = None) -> Column:
    """16 hex digits shared by the responses that count as one vote. Fields without a spec count as they are."""
    parts = {k: field_key(v, specs.get(k, VotingField()), embed) for k, v in response.items()}
    counted = [F.coalesce(parts[k], F.lit("null")).alias(k) for k in sorted(parts) if parts[k] is not None]
    return F.substring(F.sha2(F.to_json(F.struct(*counted) if counted else F.struct(F.lit("").alias("none"))), 256), 1, 16)


# --- pairwise comparison --------------------------------------------------------------------------------------------


def in_range(a: Column, b: Column, tolerance: float | None = None) -> Column:
    return F.abs(a - b) <= F.lit(tolerance or 0.1) * F.greatest(F.abs(a), F.abs(b), F.lit(1))


def items_alike(a: Column, b: Column, spec: VotingField | None = None) -> Column:
    """Whether two items of a list match: structs by their fields, if a spec names any, else equal ones."""
    return struct_matches(a, b, spec) if spec is not None and spec.fields else a.eqNullSafe(b)


def ordered_matches(a: Column, b: Column, threshold: float = 0.8, spec: VotingField | None = None) -> Column:
    """Arrays of one length with enough matching places."""
    hits = F.size(F.filter(F.zip_with(a, b, lambda x, y: items_alike(x, y, spec)), lambda h: h))
    return F.when(F.size(a) != F.size(b), False).when(F.size(a) == 0, True).otherwise(hits / F.size(a) >= threshold)


def matched_items(a: Column, b: Column, spec: VotingField) -> Column:
    """The number of items of a that find a partner in b, one to one: each takes the first item of b that matches and is still free."""
    places = F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0)))

    def step(used: Column, x: Column) -> Column:
        free = F.filter(places, lambda j: ~F.array_contains(used, j) & items_alike(x, F.get(b, j), spec))
        return F.when(F.size(free) > 0, F.array_append(used, F.get(free, F.lit(0)))).otherwise(used)

    return F.when(F.size(b) == 0, 0).otherwise(F.size(F.aggregate(a, F.array().cast("array<int>"), step)))


def by_item_key(items: Column, fields: list[str]) -> Column:
    """An array of structs in the order of their item keys, equal ones as they stand."""
    keyed = F.transform(items, lambda x, i: F.struct(item_key(x, fields).alias("key"), i.alias("i"), x.alias("item")))
    before = lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(x["i"] - y["i"])
    return F.transform(F.array_sort(keyed, before), lambda k: k["item"])


def shared_items(a: Column, b: Column) -> Column:
    """The number of items two arrays share, each as often as in both."""
    each = F.transform(F.array_distinct(a), lambda x: F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.aggregate(each, F.lit(0), lambda s, n: s + n)


def unordered_matches(a: Column, b: Column, threshold: float = 0.8, alike: bool = False, spec: VotingField | None = None) -> Column:
    """Arrays that share enough of the longer one's items; one empty array matches only if alike and the threshold is 0.

    Structs of which a spec names the fields find partners one to one: in their order, or, if alike, the shorter array's in the order of their keys.
    """
    na, nb = F.size(a), F.size(b)
    one_empty = F.lit(alike and threshold <= 0)
    if spec is None or not spec.fields:
        shared = shared_items(a, b)
    elif alike:
        left, right = (by_item_key(x, list(spec.fields)) for x in (a, b))
        shared = matched_items(F.when(na <= nb, left).otherwise(right), F.when(na <= nb, right).otherwise(left), spec)
    else:
        shared = matched_items(a, b, spec)
    return F.when((na == 0) & (nb == 0), True).when((na == 0) | (nb == 0), one_empty).otherwise(shared / F.greatest(na, nb) >= threshold)


def ordered_alike_matches(a: Column, b: Column, threshold: float = 0.8, spec: VotingField | None = None) -> Column:
    """Arrays where the shorter, laid at its best place in the longer, has enough equal places, or the common start
    is enough of the longer."""
    na, nb = F.size(a), F.size(b)
    short, long = F.when(na <= nb, a).otherwise(b), F.when(na <= nb, b).otherwise(a)
    n, m = F.least(na, nb), F.greatest(na, nb)

    def hits(at: Column) -> Column:
        return F.size(F.filter(F.zip_with(short, F.slice(long, at + 1, n), lambda x, y: items_alike(x, y, spec)), lambda h: h)) / n

    best = F.array_max(F.transform(F.sequence(F.lit(0), m - n), hits))
    same = F.zip_with(F.slice(short, F.lit(1), n), F.slice(long, F.lit(1), n), lambda x, y: items_alike(x, y, spec))
    start = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n)
    return F.when((na == 0) & (nb == 0), True).when((na == 0) | (nb == 0), F.lit(threshold <= 0)).otherwise(F.greatest(best, start / m) >= threshold)


def struct_matches(a: Column, b: Column, spec: VotingField) -> Column:
    """Structs of which enough counted fields match, each by its own strategy."""
    found = [compare(a[k], b[k], s) for k, s in spec.fields.items() if s.strategy != IGNORE]
    if not found:
        return F.lit(True)
    return reduce(lambda x, y: x + y, (F.when(f, 1.0).otherwise(0.0) for f in found)) / len(found) >= spec.threshold


def compare(a: Column, b: Column, spec: VotingField) -> Column:
    """Whether two values of a field match under its strategy."""
    if spec.strategy == IGNORE:
        return F.lit(True)
    if spec.strategy == RANGE:
        return in_range(a, b, spec.tolerance)
    if spec.strategy == CUSTOM and spec.comparator:
        return spec.comparator(a, b)
    threshold = spec.threshold or 0.8
    if spec.strategy == ORDERED:
        return ordered_matches(a, b, threshold, spec)
    if spec.strategy in (UNORDERED, UNORDERED_ALIKE):
        return unordered_matches(a, b, threshold, spec.strategy == UNORDERED_ALIKE, spec)
    if spec.strategy == ORDERED_ALIKE:
        return ordered_alike_matches(a, b, threshold, spec)
    if spec.strategy == DERIVED:
        return struct_matches(a, b, spec)
    return a.eqNullSafe(b)


def all_match(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))
