"""Counts of terms without lists of their occurrences, against the operators that list them."""

import re

import pytest
import regex
from pyspark.sql import functions as F

from folioscope.operators import chunks as C
from folioscope.operators import terms
from folioscope.plans import catalogue, corpus

TEXTS = ["Ab ab (x) AB ABC-a Ünï", "ABC ab\n\nAB abc ÅB", "", "zz Ä ΩΩ ab ab ab", "² a\u0301b _x ‿"]


@pytest.fixture(scope="module")
def chunks(spark):
    return C.document_chunks(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).cache()


def test_latin_words_are_words():
    assert [c for c in map(chr, range(256)) if bool(re.match(r"\w", c)) != bool(regex.match(C.WORD, c))] == []


def test_counts_are_those_of_occurrences(chunks):
    keys = ["doc_id", "page", "chunk_index", "token"]
    listed = C.token_occurrences(chunks).select(*keys, F.size("positions"))
    assert sorted(C.token_counts(chunks).collect()) == sorted(listed.collect())
    assert {r["token"] for r in C.token_counts(chunks, 3).collect()} == {"abc", "ünï", "a\u0301b"}


def test_group_totals(chunks):
    found, totals = C.token_occurrences(chunks), C.word_totals(chunks)
    placed = found.withColumnRenamed("token", "term").join(corpus.keyword_scores(found, totals), ["term", "doc_id"])
    want = {(r["term"], r["total_count"], round(r["mean_score"], 9)) for r in terms.group_keywords(placed).collect()}
    assert {(r["term"], r["total_count"], round(r["mean_score"], 9)) for r in corpus.keyword_totals(C.token_counts(chunks), totals).collect()} == want


@pytest.mark.parametrize("ma,mb", [(0.5, 0.25), (0.0, 0.25), (0.5, 0.0)])
def test_merged_totals(chunks, ma, mb):
    place = F.struct("doc_id", "page", "chunk_index")
    words = C.token_counts(chunks).withColumnRenamed("token", "term").where("term <> 'abc'").withColumn("mean_score", F.lit(ma))
    upper = C.upper_tokens(chunks).withColumn("term", F.lower("term")).withColumn("mean_score", F.lit(mb))
    lists = [d.groupBy("term", "mean_score").agg(F.collect_list(place).alias("occurrences")) for d in (words, upper)]
    want = {(r["term"], r["total_count"], round(r["mean_score"], 9)) for r in terms.merge_rejected(*lists).collect()}
    assert {(r["term"], r["total_count"], round(r["mean_score"], 9)) for r in terms.merged_totals(words, upper).collect()} == want


@pytest.mark.parametrize("name", ["keyword_groups", "merge_rejected_terms"])
def test_no_lists_of_occurrences(spark, sf_dir, name):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "positions" not in plan


def test_upper_tokens(spark):
    text = "AB-CDE aBC ABx 9AB ÄAB ABCDEFG X ABCDEF,AB"
    rows = C.upper_tokens(C.document_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert [r["term"] for r in rows] == ["AB", "CDE", "AB", "ABCDEF", "AB"]
