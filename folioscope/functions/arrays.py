"""Array expressions: running sums in linear time, and the places of a pattern's matches in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import let

_BLOCK = 256


def _folded(lengths: Column) -> Column:
    none = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("sums"))
    return F.aggregate(lengths, none, lambda a, x: F.struct((a["total"] + x).alias("total"), F.array_append(a["sums"], a["total"]).alias("sums")))


def sums_before(lengths: Column) -> Column:
    """For each number of an array<long> the sum of those before it. Blocks keep the work nearly linear."""

    def blocked(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / _BLOCK).cast("int"))
        return F.transform(starts, lambda b: _folded(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))

    def joined(blocks: Column) -> Column:
        heads = _folded(F.transform(blocks, lambda b: b["total"]))["sums"]
        return let(heads, lambda h: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["sums"], lambda s: s + h[i]))))

    return let(let(lengths, blocked), joined)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start long, end long, found string, before string>>: the pattern's matches from left to right.

    Positions are code points, the end exclusive; before is the text since the match before. A match mustn't be empty.
    """

    def placed(pieces: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(m) + F.length(pieces[i])).cast("long"))
        at = lambda i, sums: sums[i] + F.length(pieces[i])
        made = lambda m, i, sums: F.struct(at(i, sums).alias("start"), (at(i, sums) + F.length(m)).alias("end"), m.alias("found"), pieces[i].alias("before"))
        return let(sums_before(steps), lambda sums: F.transform(found, lambda m, i: made(m, i, sums)))

    return let(F.split(text, pattern, -1), lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: placed(pieces, found)))
