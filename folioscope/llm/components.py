"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is a grouped minimum and one join, so no group is ever gathered: a hub's rows stay rows, and are dealt to
many tasks. Every round is written to the shared scratch folder. The number of rounds grows with the logarithm of the
graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import drop_scratch, release_shuffles, scratch_table, unused_name

#: Rows of one key from which on they are dealt to several tasks, and the most keys that are treated so.
HOT_ROWS, HOT_KEYS = 256, 10_000


def join_hot(rows: DataFrame, of_key: DataFrame, key: str, by: str, counted: DataFrame | None = None) -> DataFrame:
    """rows joined to of_key (at most one row per key) by key, where a few keys may have very many rows.

    A key with more than 1 in HOT_KEYS of the rows (and HOT_ROWS) is cut into parts by a hash of the column by, and
    its row of of_key is repeated for each. At most HOT_KEYS keys are so frequent; they are sent to all tasks. counted: a table
    that has rows' keys as often as rows, where rows are dear to compute more than once.
    """
    counted = rows if counted is None else counted
    part, n, share = (unused_name(rows, x) for x in ("part", "n_rows", "n_all"))
    counts = counted.groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > HOT_ROWS)
    total = counted.agg(F.ceil(F.count("*") / HOT_KEYS).alias(share))
    hot = counts.join(F.broadcast(total), F.col(n) > F.col(share))  # one row
    hot = hot.select(key, F.ceil(F.col(n) / F.greatest(F.lit(HOT_ROWS), F.col(share))).cast("int").alias(n))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(part, F.pmod(F.hash(by), F.coalesce(n, F.lit(1)))).drop(n)
    every = of_key.join(F.broadcast(hot), key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))).drop(n)
    return dealt.join(every, [key, part]).drop(part)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_hot(both.where("v > u"), least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_hot(down, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges(u, v) of one orderable type -> (node, root): root is the least node that node can reach.

    Every node of an edge appears once. Loops are dropped, repeated edges and either direction are fine, nulls
    are dropped. An empty table gives an empty table.
    """
    now = scratch_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        large = scratch_table(_large_star(now), "edges")
        new = scratch_table(_small_star(large), "edges")
        drop_scratch(now, large)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    release_shuffles(now.sparkSession)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
