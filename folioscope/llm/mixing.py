"""Mixing of sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all text over the text it has. Each document's number of
copies inverts the Poisson distribution with that mean at a uniform number hashed from (seed, id, text), or is a
sum of such numbers where the mean is large, so it doesn't depend on partitions or retries. Copies are exploded and shuffled globally by a hash of (seed, id, copy).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import scratch_table, unused_name

SEED = 17
#: Without given weights a source's target share is proportional to its size to this power.
TEMPERATURE = 0.5
#: Chances below this are not told apart: the number of copies stops at the point where less than it is left.
TAIL = 2.0**-53
#: Means above this are drawn as sums.
LARGEST = 500


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the seed and the parts."""
    named = F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return F.conv(F.substring(named, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _least_count(mean: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u for X Poisson with a mean above 0, whose chance of 0 doesn't underflow.

    The sum of chances runs over at most mean + 12 * sqrt(mean) + 40 terms, past which less than TAIL is left.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.lit(0).alias("count"), F.exp(-mean).alias("chance"), F.exp(-mean).alias("upto"))

    def step(s: Column, k: Column) -> Column:
        chance = s["chance"] * mean / k
        return F.struct((s["count"] + F.when(u >= s["upto"], 1).otherwise(0)).alias("count"), chance.alias("chance"), (s["upto"] + chance).alias("upto"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["count"]


def poisson_count(mean: Column, seed: int, *parts: Column) -> Column:
    """A Poisson number with that mean, fixed by the seed and the parts (0 for a null or zero mean).

    Up to LARGEST it inverts the distribution at uniform(seed, *parts). A larger mean is cut into equal ones of at
    most LARGEST, and their numbers, each at a uniform number of its own, are summed, which is Poisson again.
    """
    pieces = F.ceil(mean / LARGEST).cast("int")
    summed = F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0), lambda n, i: n + _least_count(mean / pieces, uniform(seed, *parts, i)))
    return F.when(mean > LARGEST, summed).when(mean > 0, _least_count(mean, uniform(seed, *parts))).otherwise(0)


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float = 1.0) -> DataFrame:
    """(source, size, target, rate): a row per source, sizes in code points of text (null: 0).

    weights: target shares (scaled to sum 1; sources not named get 0); by default proportional to size **
    temperature over the sources with text. total: size of the mixture over that of the input. A source without
    text has rate 1. rate has no upper bound: a source is repeated as often as its share asks.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("long").alias("size"))
    if weights is None:
        raw = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(temperature))).otherwise(0.0)
    else:
        if any(not 0 <= w < math.inf for w in weights.values()) or not sum(weights.values()) > 0:
            raise ValueError("weights must be finite numbers of 0 or more with a sum above 0")
        raw = F.coalesce(F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w))))[F.col("source")], F.lit(0.0))
    raised = sizes.withColumn("raw", raw)
    whole = raised.agg(F.sum("raw").alias("all_raw"), F.sum("size").alias("all_size")).first()
    all_raw, all_size = whole["all_raw"] or 0.0, whole["all_size"] or 0
    target = F.col("raw") / F.lit(all_raw) if all_raw else F.lit(0.0)
    rate = F.when(F.col("size") > 0, F.col("target") * F.lit(total * all_size) / F.col("size")).otherwise(1.0)
    return raised.withColumn("target", target).select("source", "size", "target", F.round(rate.cast("double"), 12).alias("rate"))


def mix_sources(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, **how) -> DataFrame:
    """The mixture: docs' rows, each as often as its count, in global random order, plus rate, replica, shuffle_key.

    replica numbers the copies of a row from 0; shuffle_key (in [0, 1)) is ascending in the result's order.
    Documents of count 0 are left out: that is the sampling. A null source is a source of its own. Null texts have
    size 0 but are sampled like others. Rows with the same id and text get the same count. Columns of docs named
    like a new one are replaced.
    """
    docs = docs.drop("rate", "replica", "shuffle_key")
    spark = docs.sparkSession
    rates = scratch_table(source_rates(docs, source_col, text_col, **how), "rates")  # a row for each source; its size is known: broadcast if small
    name, hashed = unused_name(docs, "rate_source"), unused_name(docs, "text_md5")
    rated = docs.join(rates.select(F.col("source").alias(name), "rate"), docs[source_col].eqNullSafe(F.col(name)), "left")
    rated = rated.withColumn(hashed, F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")))
    count = poisson_count(F.col("rate"), seed, docs[id_col], F.col(hashed))
    copies = rated.withColumn("replica", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    key = uniform(seed + 1, docs[id_col], F.col(hashed), F.col("replica"))
    out = copies.select(*(docs[c] for c in docs.columns), "rate", "replica", key.alias("shuffle_key"))
    # keys are uniform, so equal stretches of [0, 1) are equal partitions: a total order without sampling
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(parts, F.floor(F.col("shuffle_key") * parts).cast("int")).sortWithinPartitions("shuffle_key", id_col)
