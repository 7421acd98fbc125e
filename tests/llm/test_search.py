"""Ranked lexical search and vector codes against plain versions and their SQL, and on odd rows."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import queries, vector_codes, wand_search
from tests.llm.test_operators import ODD, SCHEMA


@pytest.mark.parametrize("name", ["op12_wand", "op13_vector_codes"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want, got = con.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and list(map(str, got[columns].dtypes)) == list(map(str, want[columns].dtypes))
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))


# --- 12 ---


def plain_search(docs, queries, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(split(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for q, text in queries:
        scored = []
        for (i, c), n in zip(counted, sizes):
            m = 50 + (50 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(split(text)) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(q, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("shard, cells, k", [(4096, 1 << 14, 50), (7, 40, 3)])
def test_wand(spark, monkeypatch, shard, cells, k):
    monkeypatch.setattr(wand_search, "CELLS", cells)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünïcode", "ﬁ😀", "A"]
    chances = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=chances / chances.sum()))
    docs = [(int(i // 2), text(int(rng.integers(0, 60)))) for i in range(400)] + [(None, "w1 w50"), (900, None), (901, ""), (902, "a,A.a")]
    asked = [(i, text(int(rng.integers(1, 12)))) for i in range(20)] + [(20, "unheard"), (21, None), (22, "..."), (3, "w1"), (None, "w1")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string")
    size, wand_search.SHARD_DOCS = wand_search.SHARD_DOCS, shard
    try:
        got = wand_search.search(d, q, k=k).collect()
    finally:
        wand_search.SHARD_DOCS = size
    assert plain(got) == plain(plain_search(docs, asked, k))


def test_wand_skips():
    rng = np.random.default_rng(2)
    docs = [np.unique(np.concatenate([rng.integers(0, 5, 4), rng.integers(5, 300, 6)])).astype(np.int32) for _ in range(4000)]
    weights = np.array([3] * 5 + [900] * 295, np.int64)
    gained = weights[np.concatenate(docs)] * 1000
    shard = wand_search.Shard(list(range(4000)), docs, gained, 300)
    query, heap = [0, 1, 2, 3, 4, 7, 9, 11], wand_search.Heap(10)
    scored = shard.search(np.array([query]), [heap])
    heap.cut()
    want = sorted((-sum(int(weights[t]) * 1000 for t in d.tolist() if t in query), False, i) for i, d in enumerate(docs))[:10]
    assert heap.rows == want and scored < 1000  # nearly all hold one of the five common terms


def test_wand_blocks(spark, monkeypatch):
    docs = [(1, "a b"), (2, "b c")]
    asked = [(i, w) for i, w in enumerate(["a", "b", "c", "d", "b c"])]
    monkeypatch.setattr(wand_search, "BLOCK_BYTES", 2)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    assert plain(wand_search.search(d, q).collect()) == plain(plain_search(docs, asked, 50))


def test_wand_odd(spark):
    odd = spark.createDataFrame([(*r, "extra", 0.5) for r in ODD], SCHEMA + ", score string, `rank` double")
    asked = [(1, "the five WORD of"), (1, "the five WORD of"), (2, "")]
    q = spark.createDataFrame([(*r, 1) for r in asked], "item_id long, text string, doc_id int")
    assert plain(wand_search.search(odd, q).collect()) == plain(plain_search([r[:2] for r in ODD], asked, 50))
    for d, x in ((odd.limit(0), q), (odd, q.limit(0)), (odd.limit(0), q.limit(0))):
        got = wand_search.search(d, x)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_wand_long_text(spark):
    docs = [(1, "x" * 1_000_000 + " needle"), (2, "needle " + "hay " * 300_000), (3, "hay\n" * 15_000)]
    asked = [(1, "needle hay")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    assert plain(wand_search.search(d, q).collect()) == plain(plain_search(docs, asked, 50))


# --- 13 ---


def plain_codes(vectors, parts=4, entries=256, rounds=4):
    whole = sorted((i, v, [math.floor(1024 * x) for x in v], label) for i, v, label in vectors)
    size = len(whole[0][2]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, _, v, _ in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, xs in own.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for (*_, label), e in zip(whole, errors):
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, total[label], digest) for (i, _, _, label), f, e in zip(whole, found, errors)]


def coded(spark, vectors, **how):
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, label int, code int")
    return vector_codes.code_vectors(df, **how).drop("label").collect()


def test_ball_tree():
    rng = np.random.default_rng(1)
    for kind, size in ((float, 300), (float, 3), (object, 3e12)):
        centres = rng.normal(size=(40, 6)) * size * 4
        entries = np.floor(centres[rng.integers(0, 40, 200)] + rng.normal(size=(200, 6)) * size)
        points = np.floor(centres[rng.integers(0, 40, 300)] + rng.normal(size=(300, 6)) * size)
        entries[150:] = entries[:50]  # ties
        points[:50] = (entries[50:100] + entries[100:150]) // 2
        exact = [np.array([[int(x) for x in r] for r in a], object) for a in (entries, points)]
        tree = vector_codes.BallTree(exact[0].astype(kind))
        row, best = tree.nearest(exact[1].astype(kind))
        apart = ((exact[1][:, None] - exact[0][None]) ** 2).sum(axis=2)
        assert (row == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
        assert tree.compared < 0.6 * apart.size or size == 3


@pytest.mark.parametrize("entries, scale", [(256, 0.2), (8, 0.01), (5, 1e5)])
def test_vector_codes(spark, entries, scale):
    rng = np.random.default_rng(7)
    values = (rng.normal(size=(120, 8)) * scale).astype(np.float32)
    values[60:80] = values[:20]
    vectors = [(int(i // 2), [float(x) for x in v], [None, 1, 2][i % 3]) for i, v in enumerate(values)]
    assert plain(coded(spark, vectors, entries=entries)) == plain(plain_codes(vectors, entries=entries))


def test_vector_codes_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.25, 3e38, 1.0], 1), (1, [0.5, -0.25, 3.0, 1.0], None), (2, [-1.0, -2.0, -3.0, -4.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1)]
    bad = [(3, None, 1), (4, [1.0, None, 1.0, 1.0], 1), (5, [nan, 0.0, 0.0, 0.0], 1), (6, [0.0, -inf, 0.0, 0.0], 1)]
    got = {(r["vec_id"], r["code"] is None): r for r in coded(spark, good + bad + [(7, [1.0] * 5, 2), (8, [], 2)])}
    assert sorted(map(str, got)) == sorted(map(str, [(1, True), (1, False), (2, False), (None, False), (7, True), (8, True)]))
    want = {r[0]: r for r in plain_codes([v if v[0] is not None else (9, *v[1:]) for v in good if 3e38 not in v[1]])}
    assert tuple(got[1, False])[1:3] == want[1][1:3] and tuple(got[None, False])[1:] == want[9][1:]
    assert coded(spark, bad) == [] and coded(spark, []) == []
    assert [r["code"] for r in coded(spark, [(1, [1.0] * 6, 1)])] == [None]
    huge = [(i, [1e20 * (i + 1), 2.0**70, -(2.0**79), 1.0], 1) for i in range(3)]
    assert {r["error"] for r in coded(spark, huge, entries=1)} <= {vector_codes.MOST_LONG, 0} | {e for _, _, e, _, _ in plain_codes(huge, entries=1)}


def test_vector_codes_label_sums(spark):
    vectors = [(i, [float(i % 7), 1.0, 2.0, float(i % 3)], i % 2) for i in range(50)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    out = vector_codes.code_vectors(df, entries=2)
    sums = {r[0]: r[1] for r in out.groupBy("label").agg(F.sum("error")).collect()}
    assert sums == {r[0]: r[1] for r in out.select("label", "label_error").distinct().collect()}
