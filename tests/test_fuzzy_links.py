"""Fuzzy links by keys against all pairs, and the bounds behind the keys."""

import random

import pytest

from folioscope.functions import fuzzy
from folioscope.operators import terms


def score(full, key):
    full, low = full.lower(), key.lower()
    if not key.strip() or len(key) == 1:
        return 0.0
    return 0.7 + 0.3 * len(low) / len(full) if low in full else fuzzy.fuzzy_score(full, low)


def words(n, seed):
    rng = random.Random(seed)
    stems = ["application", "interface", "machine", "learning", "natural", "language", "process", "network", "protocol", "transfer", "über", "straße", "data"]
    out = []
    for _ in range(n):
        w = [rng.choice(stems) for _ in range(rng.randint(1, 3))]
        text = list(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(text))
            text[i : i + 1] = rng.choice([[], [rng.choice("abcxyz ")], [text[i], text[i]]])
        out.append("".join(text).strip() or "x")
    return out


@pytest.mark.parametrize("threshold", [0.65, 0.5, 0.8, 0.95])
def test_same_as_all_pairs(spark, threshold):
    full = words(50, 1) + ["Application  Programming\tInterface", "NASA nasa nasa", "ab", "Of the people"]
    keys = words(90, 2) + ["interface programming", "of", "x", "", "  ", "nasa agency", "Applications", "ba", "machin learn", "learning learning machine"]
    a = spark.createDataFrame([(f"A{i}", f) for i, f in enumerate(full)] + [("none", ""), ("null", None), ("A0", full[0])], "term string, full_form string")
    k = spark.createDataFrame([(x,) for x in keys] + [(keys[0],)], "term string")
    want = sorted((f"A{i}", x, round(s, 9)) for i, f in [*enumerate(full), (0, full[0])] for x in [*keys, keys[0]] if (s := score(f, x)) >= threshold)
    got = sorted((r[0], r[1], round(r[2], 9)) for r in terms.link_terms(a, k, threshold).collect())
    assert got == want and len(want) > 20


def test_no_nested_loop(spark):
    a = spark.createDataFrame([("A", "alpha beta")], "term string, full_form string")
    k = spark.createDataFrame([("beta alpha",)], "term string")
    plan = terms.link_terms(a, k)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_low_thresholds_and_empty_sides(spark):
    a = spark.createDataFrame([("A", "alpha"), ("B", "beta")], "term string, full_form string")
    k = spark.createDataFrame([("x",), ("gamma",), ("",)], "term string")
    assert terms.link_terms(a, k, 0).count() == 6
    assert sorted(r[1] for r in terms.link_terms(a, k, 0.2).collect()) == sorted(x for f in ("alpha", "beta") for x in ("x", "gamma", "") if score(f, x) >= 0.2)
    for left, right in ((a.limit(0), k), (a, k.limit(0))):
        assert terms.link_terms(left, right).count() == 0


def test_bounds_hold(spark):
    pairs = [(x, y) for x in words(40, 5) for y in words(40, 6) if not set(x.split()) & set(y.split())]
    df = spark.createDataFrame(pairs, "a string, b string")
    from pyspark.sql import functions as F

    common = F.size(F.array_intersect(fuzzy.character_elements(F.col("a")), fuzzy.character_elements(F.col("b"))))
    x, y = fuzzy.set_length(F.col("a")), fuzzy.set_length(F.col("b"))
    rows = df.select("a", "b", common.alias("common"), fuzzy.characters_needed(x, y, 0.65).alias("needed"), F.array_contains(fuzzy.partner_lengths(x, 0.65), y).alias("fits")).collect()
    reached = [r for r in rows if fuzzy.fuzzy_score(r["a"], r["b"]) >= 0.65]
    assert reached and all(r["fits"] and r["common"] >= r["needed"] for r in reached)
    assert sum(r["fits"] and r["common"] >= r["needed"] for r in rows) < 0.6 * len(rows)
