"""Near copies by exact likeness, where many texts share most of their words: same groups as all pairs give, and few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import shingle_sets, simhash_golay
from tests.llm import brute


def family(n, words, edits, start, seed):
    """n texts of one template, each with that many words replaced."""
    rng = np.random.default_rng(seed)
    template = [f"t{start}_{i}" for i in range(words)]
    out = []
    for k in range(n):
        own = list(template)
        for at in rng.choice(words, edits, replace=False):
            own[at] = f"e{start}_{k}_{at}"
        out.append((start + k, " ".join(own)))
    return out


def groups_of(spark, rows, **how):
    got = simhash_golay.likeness_groups(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], []).append(r["id"])
    return sorted(map(sorted, groups.values()))


def plain_groups(rows):
    groups = {}
    for (i, _), g in zip(rows, brute.similar_groups([t for _, t in rows])):
        groups.setdefault(g, []).append(i)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("limits", [None, (1, 8, 1 << 21), (2, 64, 900)])
def test_families(spark, monkeypatch, limits):
    if limits:
        for name, value in zip(("PAIRED", "BLOCK_NODES", "BLOCK_HASHES"), limits):
            monkeypatch.setattr(shingle_sets, name, value)
    rows = family(40, 200, 2, 0, 1) + family(40, 200, 4, 1000, 2) + family(30, 200, 5, 2000, 3) + family(20, 100, 9, 3000, 4)
    passage = " ".join(f"p{i}" for i in range(130))
    rows += [(5000 + k, passage + " " + " ".join(f"q{k}_{i}" for i in range(60))) for k in range(40)]
    rows += [(6000, passage), (6001, passage), (6002, ""), (6003, None), (None, passage + " x")]
    got = groups_of(spark, [r for r in rows if r[0] is not None])
    assert got == plain_groups([r for r in rows if r[0] is not None])
    assert any(1 < len(g) < 40 for g in got) and any(len(g) == 40 for g in got)  # some families hold together by chains only


def test_common_passages_give_few_rows(spark, monkeypatch):
    seen = {}
    keep = shingle_sets.scratch_table

    def counted(df, name):
        out = keep(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(shingle_sets, "scratch_table", counted)
    most = []
    for n in (150, 300):
        seen.clear()
        passage = " ".join(f"p{i}" for i in range(130))
        rows = [(k, passage + " " + " ".join(f"q{k}_{i}" for i in range(60))) for k in range(n)]
        assert len(groups_of(spark, rows)) == n
        most.append({name: seen.get(name, 0) for name in ("pairs", "dealt", "met")})
    assert all(most[1][name] <= 2.5 * max(most[0][name], 40) for name in most[0]), most


def test_rarest_shingles_meet(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 400, (30, 60))
    sets = [np.unique(b[rng.random(60) < 0.9]) for b in base for _ in range(4)]
    df = spark.createDataFrame([(i, s.astype(np.int64).tobytes()) for i, s in enumerate(sets)], "node long, hashes binary")
    keys = {}
    for r in shingle_sets.rare_keys(df, 0.8).collect():
        keys.setdefault(r["node"], set()).add(r["bucket"])
    alike = [(a, b) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    assert len(alike) > 20 and all(keys[a] & keys[b] for a, b in alike)
    assert sum(map(len, keys.values())) < 0.5 * sum(map(len, sets))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_golay.likeness_groups(empty).count() == 0
    assert simhash_golay.likeness_groups(empty.withColumn("node", F.lit(1)).withColumn("root", F.lit(2))).count() == 0
