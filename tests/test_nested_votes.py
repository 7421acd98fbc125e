"""Lists of structs compared item by item: the truth table of orders, overlaps, lengths and nested strategies, and a plain greedy matching."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import voting
from folioscope.functions.voting import VotingField as Field

TERM = {"term": Field()}
CHUNK = {"text": Field(), "start": Field(), "end": Field()}
SCHEMAS = {"term": "array<struct<term:string>>", "chunk": "array<struct<text:string,start:int,end:int>>"}


def terms(*names):
    return [(n,) for n in names]


CASES = [
    # strategy, threshold, a, b, match
    (voting.UNORDERED, 0.8, terms("API", "REST"), terms("API", "REST"), True),
    (voting.UNORDERED, 0.8, terms("API", "REST"), terms("REST", "API"), True),
    (voting.UNORDERED, 0.5, terms("API", "REST"), terms("API", "SOAP"), True),
    (voting.UNORDERED, 0.4, terms("API", "REST"), terms("API", "SOAP"), True),
    (voting.UNORDERED, 0.6, terms("API", "REST"), terms("API", "SOAP"), False),
    (voting.UNORDERED, 0.8, terms("API", "REST"), terms("API", "SOAP"), False),
    (voting.UNORDERED, 0.8, [], [], True),
    (voting.UNORDERED, 0.8, terms("API"), [], False),
    (voting.UNORDERED, 0.0, terms("API"), [], False),
    (voting.UNORDERED, 0.5, terms("API", "API"), terms("API", "REST"), True),
    (voting.UNORDERED, 0.6, terms("API", "API"), terms("API", "REST"), False),  # one to one
    (voting.ORDERED, 0.8, terms("API", "REST"), terms("API", "REST"), True),
    (voting.ORDERED, 0.8, terms("API", "REST"), terms("REST", "API"), False),
    (voting.ORDERED, 0.5, terms("API", "REST"), terms("API", "SOAP"), True),
    (voting.ORDERED, 0.5, terms("API", "REST"), terms("API"), False),
    (voting.ORDERED, 0.8, [], [], True),
    (voting.ORDERED_ALIKE, 0.8, terms("b", "c"), terms("a", "b", "c"), True),
    (voting.ORDERED_ALIKE, 0.8, terms("c", "b"), terms("a", "b", "c"), False),
    (voting.ORDERED_ALIKE, 0.0, [], terms("a"), True),
    (voting.UNORDERED_ALIKE, 0.6, terms("c", "b"), terms("a", "b", "c"), True),
    (voting.UNORDERED_ALIKE, 0.8, terms("c", "b"), terms("a", "b", "c"), False),
    (voting.UNORDERED_ALIKE, 0.0, [], terms("a"), True),
]


@pytest.mark.parametrize("strategy, threshold, a, b, want", CASES)
def test_truth_table(spark, strategy, threshold, a, b, want):
    df = spark.createDataFrame([(a, b)], f"a {SCHEMAS['term']}, b {SCHEMAS['term']}")
    spec = Field(strategy, threshold=threshold, fields=TERM)
    match = {voting.UNORDERED: voting.unordered_matches, voting.ORDERED: voting.ordered_matches, voting.ORDERED_ALIKE: voting.ordered_alike_matches}.get(strategy)
    x, y = F.col("a"), F.col("b")
    got = match(x, y, threshold, spec=spec) if match else voting.unordered_matches(x, y, threshold, True, spec)
    assert df.select(got).first()[0] is want


def test_each_field_by_its_own_strategy(spark):
    fields = {"text": Field(), "start": Field(voting.RANGE, tolerance=0.1), "end": Field(voting.IGNORE)}
    a = [("one", 100, 5), ("two", 200, 6)]
    rows = [([("two", 210, 0), ("one", 95, 0)], 0.8, True), ([("two", 300, 0), ("one", 95, 0)], 0.8, False), ([("two", 300, 0), ("one", 300, 0)], 0.5, True), ([("x", 300, 5), ("y", 400, 6)], 0.5, False)]
    for b, threshold, want in rows:
        df = spark.createDataFrame([(a, b)], f"a {SCHEMAS['chunk']}, b {SCHEMAS['chunk']}")
        assert df.select(voting.compare(F.col("a"), F.col("b"), Field(voting.UNORDERED, threshold=threshold, fields=fields))).first()[0] is want


def test_lists_within_structs(spark):
    inner = Field(voting.UNORDERED, threshold=1.0, fields=TERM)
    outer = Field(voting.DERIVED, threshold=1.0, fields={"name": Field(voting.IGNORE), "terms": inner})
    schema = f"struct<name:string,terms:{SCHEMAS['term']}>"
    rows = [(("x", terms("a", "b")), ("y", terms("b", "a"))), (("x", terms("a", "b")), ("x", terms("a", "c"))), (("x", []), ("y", []))]
    df = spark.createDataFrame(rows, f"a {schema}, b {schema}")
    assert [r[0] for r in df.select(voting.compare(F.col("a"), F.col("b"), outer)).collect()] == [True, False, True]


def test_keys_follow_the_order_only_of_chunks(spark):
    df = spark.createDataFrame([(terms("a", "b"), terms("b", "a"), [("t", 0, 1), ("u", 1, 2)], [("u", 1, 2), ("t", 0, 1)])], f"a {SCHEMAS['term']}, b {SCHEMAS['term']}, c {SCHEMAS['chunk']}, d {SCHEMAS['chunk']}")
    key = lambda c, strategy, fields: voting.field_key(F.col(c), Field(strategy, fields=fields))
    r = df.select(key("a", voting.UNORDERED, TERM), key("b", voting.UNORDERED, TERM), key("c", voting.ORDERED, CHUNK), key("d", voting.ORDERED, CHUNK)).first()
    assert r[0] == r[1] and r[2] != r[3]


def test_greedy_matching(spark):
    rng = random.Random(4)
    spec = Field(voting.UNORDERED, threshold=0.5, fields={"text": Field(), "start": Field(voting.RANGE, tolerance=0.2), "end": Field()})

    def alike(x, y):
        hits = (x[0] == y[0]) + (abs(x[1] - y[1]) <= 0.2 * max(abs(x[1]), abs(y[1]), 1)) + (x[2] == y[2])
        return hits / 3 >= 0.5

    made = lambda: [(rng.choice("abc"), rng.randint(1, 9), rng.randint(0, 2)) for _ in range(rng.randint(0, 6))]
    rows, want = [(made(), made()) for _ in range(150)], []
    for a, b in rows:
        free = list(range(len(b)))
        for x in a:
            at = next((j for j in free if alike(x, b[j])), None)
            if at is not None:
                free.remove(at)
        want.append(len(b) - len(free))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, a {SCHEMAS['chunk']}, b {SCHEMAS['chunk']}")
    got = df.orderBy("i").select(voting.matched_items(F.col("a"), F.col("b"), spec)).collect()
    assert [r[0] for r in got] == want
    assert "Python" not in df.select(voting.matched_items(F.col("a"), F.col("b"), spec))._jdf.queryExecution().toString()
