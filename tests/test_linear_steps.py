"""Steps that made a row for each pair of votes, words or places: they no longer do, and their results are the same."""

import pytest

from pyspark.sql import functions as F

from folioscope.operators import consensus, postings, search, terms


def most_rows(df):
    """The most rows that an operator of the plan of df gave."""

    def walk(plan):
        found = plan.metrics().get("numOutputRows")
        n = found.get().value() if found.isDefined() else 0
        children = plan.children()
        return max([n, *(walk(children.apply(i)) for i in range(children.size()))])

    query = df.select("*")._jdf.queryExecution()  # metrics of this run only
    query.executedPlan().executeCollect()
    return walk(query.executedPlan())


@pytest.fixture
def plain(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def votes_of(spark, n):
    """n models vote in two rounds on one item; the odd ones change their vote from a to b, of which some voted before."""
    v = spark.range(n).crossJoin(spark.range(2).withColumnRenamed("id", "r"))
    return v.selectExpr("'x' item", "cast(r as int) round", "lpad(cast(id as string), 4, '0') model_id", "cast(id as int) seq", "if(id % 4 = 0 or (r = 1 and id % 2 = 1), 'b', 'a') key", "concat('c', id) content")


def test_flow_has_no_row_for_each_pair(plain):
    v = votes_of(plain, 200)
    flow = consensus.information_flow(v)
    rows = {r["model_id"]: r["peers"] for r in flow.collect()}
    assert len(rows) == 200 and all(p == [f"{i:04}" for i in range(200) if f"{i:04}" != m] for m, p in rows.items())
    assert most_rows(flow) <= 1600


def test_influence_has_no_row_for_each_pair(plain):
    moved = consensus.evolution(votes_of(plain, 200))
    before = [f"{i:04}" for i in range(0, 200, 4)]
    for r in moved.collect():
        assert r["influenced_by"] == (before if r["changed"] else [])
    assert most_rows(moved) <= 1600


def test_gossip_has_no_row_for_each_pair(plain):
    told = consensus.gossip_context(votes_of(plain, 200), 0)
    for r in told.collect():
        assert r["peers"] == [f"c{i}" for i in range(200) if i != int(r["model_id"])]
    assert most_rows(told) <= 1600
    alone = consensus.gossip_context(votes_of(plain, 1), 0).collect()
    assert [tuple(r) for r in alone] == [("x", "0000", "c0", [])]


def test_results_count_refinements_without_pairs(plain):
    v = votes_of(plain, 200)
    out = consensus.results(v)
    assert out.first()["total_refinements"] == 200
    assert most_rows(out) <= 1200  # three counts of distinct values over 400 votes
    # a model that follows only itself was shown nothing
    lone = plain.createDataFrame([("x", 0, "m", 0, "a"), ("x", 1, "m", 0, "a"), ("y", 0, "m", 0, "a"), ("y", 1, "m", 0, "a"), ("y", 1, "n", 1, "a")], "item string, round int, model_id string, seq int, key string")
    assert {r["item"]: r["total_refinements"] for r in consensus.results(lone).collect()} == {"x": 0, "y": 1}


def test_contexts_join_texts_once(plain):
    chunks = plain.createDataFrame([(1, 0, "a b"), (1, 1, "b c"), (2, 0, "c"), (2, 3, "a c")], "doc_id int, chunk_index long, text string")
    found = chunks.select(F.explode(F.split("text", " ")).alias("term"), "doc_id", "chunk_index")
    out = terms.term_contexts(found, chunks)
    assert sorted(map(tuple, out.collect())) == sorted([("a", 1, 0, "a b"), ("b", 1, 0, "a b"), ("b", 1, 1, "a b"), ("c", 1, 1, "b c"), ("c", 2, 0, "c"), ("c", 2, 3, "c"), ("a", 2, 3, "a c")])
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1


def test_whole_words_make_rows_of_wanted_words_only(plain):
    chunks = plain.range(3).selectExpr("id doc_id", "0L chunk_index", "concat('api ', repeat('word other ', 100), 'API') text")
    out = postings.whole_word_positions(plain.createDataFrame([("api", 1)], "term string, doc_id long"), chunks)
    assert [(r["doc_id"], list(r["positions"])) for r in out.collect()] == [(1, [0, 1104])]
    assert most_rows(out) <= 3


def test_word_keys_go_to_no_automaton(spark, monkeypatch):
    monkeypatch.setattr(search, "_found_terms", lambda names: pytest.fail(f"an automaton of {names.value}"))
    long = "x" * 70
    results = spark.createDataFrame([(1, "Éclairs, eclair"), (2, f"a{long}y b"), (3, "x" * 69), (4, None), (5, "")], "result_id int, text string")
    keys = spark.createDataFrame([(k,) for k in ("éclair", "CLAIR", long, "b", "", "zz")], "term_key string")
    got = sorted(map(tuple, search.primary_terms(results, keys).select("result_id", "term_key").collect()))
    assert got == [(1, "CLAIR"), (1, "éclair"), (2, "b"), (2, long)]


def test_keys_of_texts_cross_as_lists(spark):
    results = spark.createDataFrame([(1, "The pineapple, Apple c++"), (2, "pear"), (2, "ear_ring"), (None, "apple"), (3, None)], "result_id int, text string")
    keys = spark.createDataFrame([("Apple",), ("apple",), ("apple",), ("ear",), ("c++",), ("ring",), ("",), (None,)], "term_key string")
    found = search.primary_terms(results, keys)
    got = sorted(found.collect(), key=str)
    want = [(1, "Apple"), (1, "apple"), (1, "apple"), (1, "c++"), (2, "ear"), (2, "ring"), (None, "Apple"), (None, "apple"), (None, "apple")]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: f"Row(result_id={r[0]}, term_key={r[1]!r})")
    words = search.primary_terms(results, keys.where("term_key <> 'c++'"))
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [result_id" in plan and not [x for x in plan.splitlines() if "Aggregate [result_id" in x and "folded" in x]  # no row for each key of a word of a text
    kinds = keys.withColumn("kind", F.lit("k"))
    assert sorted(map(tuple, search.primary_terms(results, kinds).where("result_id = 1").collect())) == [(1, k, "k") for k in ("Apple", "apple", "apple", "c++")]


def test_occurrences_and_texts_meet_by_document(plain):
    chunks = plain.createDataFrame([(1, 0, "a b"), (1, 7, "b c"), (2, 3, "c"), (2, 3, "c d"), (2, 9, "c"), (None, 0, "a"), (3, 1, "z")], "doc_id int, chunk_index long, text string")
    found = plain.createDataFrame([("a", 1, 0, 5), ("b", 1, 7, 6), ("b", 1, 7, 6), ("c", 2, 9, 7), ("c", 2, 3, 8), ("x", 2, 4, 9), ("a", None, 0, 1), ("y", 4, 0, 1), (None, 1, 0, 2)], "term string, doc_id int, chunk_index long, n int")
    out = terms.term_contexts(found, chunks)
    want = [("a", 1, 0, 5, "a b"), ("b", 1, 7, 6, "b c"), ("b", 1, 7, 6, "b c"), (None, 1, 0, 2, "a b"), *(("c", 2, c, n, said) for c, n in ((9, 7), (3, 8)) for said in ("c", "c d"))]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = terms.term_contexts(found, chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 2 == plan.count("Exchange")  # occurrences once, texts once
