"""Text functions against plain Python and exact strings."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import fuzzy
from folioscope.functions import text as T
from folioscope.functions import vectors as V

EMOJI = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), T.EMOJI))


def plain_normalize(term):
    out = re.sub(r"\s*\([^)]*\)", "", EMOJI.sub("", term.lower()))
    while True:
        new = re.sub(rf"^\s*{T.LIST_MARKS}\s*", "", out)
        if new == out:
            break
        out = new
    return re.sub(r"\s+", " ", out).strip("-").strip()


def column(spark, values, f, name="x"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(f(F.col(name))).collect()]


def test_normalize_term_examples(spark):
    cases = ["ROI (Return on Investment)", "1. • Text", "a) b. iv. item", "  Multi   space\n x ", "--API-KEY--", "x -", "x - ", "😀 Smile", "•", "", "mix. it", "ﬁ- x"]
    assert column(spark, cases, T.normalize_term) == [plain_normalize(c) for c in cases]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abiv1.)(- •*\n éX😀", max_size=12), min_size=1, max_size=60))
def test_normalize_term_random(spark, values):
    assert column(spark, values, T.normalize_term) == [plain_normalize(v) for v in values]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "ab", "é", "c++", "na", "a b", "\\E"]), st.text(alphabet="ab é+cn\\E-", max_size=20)), min_size=1, max_size=40))
def test_term_positions(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, term string, text string")
    got = [r[0] for r in df.orderBy("i").select(T.term_positions(F.col("term"), F.col("text"))).collect()]
    assert got == [[m.start() for m in re.finditer(r"\b" + re.escape(t.lower()) + r"\b", x.lower())] for t, x in pairs]


def test_count_substring(spark):
    rows = [("aaaa", "aa"), ("abc", ""), ("", "x"), ("xyxyx", "xyx")]
    df = spark.createDataFrame(rows, "t string, s string")
    assert [r[0] for r in df.select(T.count_substring(F.col("t"), F.col("s"))).collect()] == [t.count(s) for t, s in rows]


def test_hyphens_and_contents(spark):
    assert column(spark, ["policy devia-\ntion and x-\n1"], T.join_hyphen_breaks) == ["policy deviation and x-\n1"]
    text = "keep me\n1.2 Title ....... 17\n6.5 Title    17\n6.5 Title 17\n..... 9\nPage 3 of 9\npage 4\n3/9\n- 17 -\n[17]\n1 a...\nend"
    assert column(spark, [text], T.drop_contents_lines) == ["keep me\n6.5 Title 17\nend"]


def test_markdown(spark):
    text = "# One\n## Two\n### Three\n\n\n\ntext  \n| a |  \n```py  \n \n"
    assert column(spark, [text], T.tidy_markdown) == ["# One\n## Two\n### Three\n\ntext\n| a |  \n```py  "]
    assert column(spark, [text], T.contents_summary) == ["Sections: One;   - Two"]
    assert column(spark, ["none"], T.contents_summary) == [""]
    assert column(spark, ["x" * 30], lambda c: T.truncate(c, 6)) == ["x" * 4 + T.TRUNCATED]


def table(spark, data, columns, f):
    df = spark.createDataFrame([(data, columns)], "d array<array<string>>, n int")
    return df.select(f(F.col("d"), F.col("n"))).first()[0]


def test_tables(spark):
    data = [["Name", "Age"], ["A<b", None], ["C|d", "7", "extra"], ["<table>x</table>"]]
    assert table(spark, data, 2, lambda d, n: T.markdown_table(d)) == "| Name | Age |\n| --- | --- |\n| A<b |  |\n| C\\|d | 7 |\n| <table>x</table> |  |"
    html = table(spark, data, 2, lambda d, n: T.html_table(d))
    assert html.startswith('<table border="1" cellpadding="4" cellspacing="0">\n  <thead>\n    <tr>\n      <th>Name</th>\n      <th>Age</th>\n    </tr>\n  </thead>\n  <tbody>\n    <tr>\n      <td>A&lt;b</td>\n      <td></td>')
    assert "      <td><table>x</table></td>\n      <td></td>\n    </tr>\n  </tbody>\n</table>" in html and "extra" not in html
    assert table(spark, [["Id", "Name"], ["1", None], ["100", "Bob"]], 2, T.ascii_table) == "Id   Name\n\n1        \n100  Bob "
    assert table(spark, [], 0, T.ascii_table) == "" and table(spark, [], 0, lambda d, n: T.html_table(d)) == "" and table(spark, [], 0, lambda d, n: T.markdown_table(d)) == ""


def test_slices_and_excerpt(spark):
    assert column(spark, ["", "abcde"], lambda c: T.fixed_slices(c, 2)) == [[], ["ab", "cd", "e"]]
    assert column(spark, ["abc", "ab"], lambda c: T.excerpt(c, 2)) == ["ab...", "ab"]


def test_fuzzy_scores():
    assert fuzzy.ratio("abc", "abc") == 100 and fuzzy.ratio("", "") == 100
    assert fuzzy.common_subsequence("programming", "gaming") == 6
    assert fuzzy.token_set_ratio("application programming interface", "programming") == 100
    assert fuzzy.token_set_ratio("", "x") == 0
    assert fuzzy.partial_ratio("abcd", "XabcdX") == 100
    assert math.isclose(fuzzy.partial_ratio("this is a test", "this is a test!"), 100)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=9))
def test_common_subsequence(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        rows = [0, *(0 for _ in b)] if not rows else rows
        new = [0]
        for j, y in enumerate(b):
            new.append(rows[j] + 1 if x == y else max(new[-1], rows[j + 1]))
        rows = new
    assert fuzzy.common_subsequence(a, b) == rows[-1]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], math.sqrt(0.5)) and got[1] == 0.0
    nums = spark.createDataFrame([(90.0,), (88.0,), (70.0,), (0.0,), (-90.0,)], "v double")
    assert [r[0] for r in nums.select(V.log_bin(F.col("v"), 0.2)).collect()] == ["range_log_bin_24", "range_log_bin_24", "range_log_bin_23", "range_zero", "range_log_bin_-24"]
    a, b, c = (V.hashed_vector(t) for t in ("machine learning model", "learning machine models", "fish soup"))
    assert abs((a * a).sum() - 1) < 1e-9 and (a * b).sum() > (a * c).sum()
    assert not V.hashed_vector("").any()
