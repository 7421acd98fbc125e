"""Points where a model can be plugged in, with deterministic rules as defaults, and batches of calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call_with_retries(f: Callable, item, attempts: int = 3, wait_ms: int = 0, most_ms: int = 10_000):
    """f(item), tried up to attempts times with doubling waits; the last error is raised."""
    for n in range(attempts):
        try:
            return f(item)
        except Exception:
            if n == attempts - 1:
                raise
            time.sleep(min(wait_ms * 2**n, most_ms) / 1000)


def flat_map(items: DataFrame, f: Callable[[str], list[str]], column: str = "item", attempts: int = 3, fallback: Callable[[str], list[str]] | None = None, wait_ms: int = 0) -> DataFrame:
    """items with a row for each string that f makes of the column: at (its place) and output.

    Without a fallback one item's failure fails the task; with one it replaces that item's outputs, and error says
    why. The number of calls at once is that of the running tasks.
    """
    names = items.columns
    schema = f"{items.schema.simpleString()[7:-1].replace(':', ' ')}, at int, output string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values in batch.itertuples(index=False, name=None):
                item, error = values[names.index(column)], None
                try:
                    outputs = call_with_retries(f, item, attempts, wait_ms)
                except Exception as e:
                    if fallback is None:
                        raise
                    outputs, error = fallback(item), str(e)
                rows += [(*values, at, o, error) for at, o in enumerate(outputs)]
            yield pd.DataFrame(rows, columns=[*names, "at", "output", "error"])

    return items.mapInPandas(run, schema)


def cycling_responses(seq: Column, responses: list[str]) -> Column:
    """A stand-in for a model that gives fixed responses in turn, by the number of the call."""
    return F.get(F.array(*map(F.lit, responses)), F.pmod(seq, F.lit(len(responses))).cast("int"))


def judged_acronyms(grouped: DataFrame, full_forms: DataFrame) -> DataFrame:
    """Default judge of acronyms: valid where a full form is known."""
    known = full_forms.groupBy("term").agg(F.min("full_form").alias("full_form"))
    return grouped.join(known, "term", "left").withColumn("is_valid", F.col("full_form").isNotNull())


def judged_keywords(grouped: DataFrame, least: int = 2) -> DataFrame:
    """Default judge of keywords: valid if they occur often enough."""
    return grouped.withColumn("is_valid", F.col("total_count") >= least).withColumn("full_form", F.lit(None).cast("string"))


def expansions(chunks: DataFrame) -> DataFrame:
    """(term, full_form) of definitions like `Some Long Name (SLN)`: the words before whose initials are the term."""
    found = F.regexp_extract_all("text", F.lit(r"((?:[A-Z][\w-]*\s+){2,6})\([A-Z]{2,6}\)"), F.lit(0))
    each = chunks.select(F.explode(found).alias("d")).select(F.regexp_extract("d", r"\(([A-Z]+)\)", 1).alias("term"), F.split(F.trim(F.regexp_replace("d", r"\([A-Z]+\)", "")), r"\s+").alias("w"))
    words = F.slice("w", F.greatest(F.size("w") - F.length("term") + 1, F.lit(1)), F.length("term"))
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return each.select("term", F.array_join(words, " ").alias("full_form"), initials.alias("i")).where("i = term").select("term", "full_form").distinct()


def map_reduce(items: DataFrame, ask: Callable[[str], list], aggregate: Callable[[Column], Column], by: str, item_col: str = "item") -> DataFrame:
    """flat_map of items, whose outputs are then aggregated for each value of by -> (by, result)."""
    return flat_map(items, ask, item_col).groupBy(by).agg(aggregate(F.col("output")).alias("result"))
