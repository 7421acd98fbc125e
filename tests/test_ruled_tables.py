"""Ruled tables on small pages: plain, merged and ragged grids, lines that miss a little, two tables, pages without any."""

import pytest

from folioscope.sources import tables

SCHEMA = "doc_id int, page int, kind string, x0 double, x1 double, top double, bottom double, text string"


class Page:
    def __init__(self, doc, page=1):
        self.key, self.rows = (doc, page), []

    def add(self, kind, x0, x1, top, bottom, text=None):
        self.rows.append((*self.key, kind, float(x0), float(x1), float(top), float(bottom), text))
        return self

    def h(self, y, a, b):
        return self.add("line", a, b, y, y)

    def v(self, x, a, b):
        return self.add("line", x, x, a, b)

    def word(self, x, y, text):
        return self.add("word", x, x + 4, y, y + 4, text)

    def grid(self, xs, ys):
        for y in ys:
            self.h(y, xs[0], xs[-1])
        for x in xs:
            self.v(x, ys[0], ys[-1])
        return self


def found(spark, *pages):
    df = spark.createDataFrame([r for p in pages for r in p.rows], SCHEMA)
    return [tuple(r)[2:] for r in tables.ruled_tables(df).orderBy("doc_id", "page", "table").collect()]


def test_plain_grid(spark):
    page = Page(1).grid([0, 10, 20], [0, 10, 20]).word(1, 1, "a").word(11, 1, "b").word(1, 11, "c").word(50, 50, "outside")
    assert found(spark, page) == [(1, 0, 0, 20, 20, 2, 2, [["a", "b"], ["c", ""]])]


def test_words_stand_in_lines(spark):
    page = Page(1).grid([0, 40], [0, 30, 40]).word(20, 2, "second").word(1, 3, "first").word(1, 12, "below").word(9, 11, "it").word(38, 2, "edge")
    page.word(18, 28, "cut")  # its middle is on the line below
    assert found(spark, page)[0][-1] == [["first second\nbelow it"], ["cut"]]


def test_merged_and_ragged(spark):
    page = Page(1)
    for y in (0, 10, 20, 30):
        page.h(y, 0, 30 if y < 30 else 20)
    page.v(0, 0, 30).v(10, 0, 10).v(10, 20, 30).v(20, 0, 30).v(30, 0, 20)  # row 2 merges two columns, row 3 has no third
    for x, y, t in ((1, 1, "a"), (11, 1, "b"), (21, 1, "c"), (1, 11, "wide"), (12, 11, "cell"), (21, 11, "d"), (1, 21, "e"), (11, 21, "f"), (22, 22, "none")):
        page.word(x, y, t)
    assert found(spark, page) == [(1, 0, 0, 30, 30, 3, 3, [["a", "b", "c"], ["wide cell", None, "d"], ["e", "f", None]])]


def test_merged_rows(spark):
    page = Page(1).v(0, 0, 20).v(10, 0, 20).v(20, 0, 20).h(0, 0, 20).h(20, 0, 20).h(10, 10, 20).word(1, 8, "tall").word(11, 1, "x").word(11, 12, "y")
    assert found(spark, page)[0][5:] == (2, 2, [["tall", "x"], [None, "y"]]) or found(spark, page)[0][5:] == (2, 2, [["tall", "x"], [None, "y"]])


def test_lines_that_miss_a_little(spark):
    page = Page(1).h(0, 0, 9).h(0.5, 11, 20).h(10.4, 0, 20).h(20, 1, 19).h(9.8, 2, 12)  # two pieces, two near heights, short ends
    page.v(0, 1, 20).v(0.9, 0, 12).v(10, 0, 21).v(20, 2, 18).v(15, 4, 5)  # the last is too short
    page.word(3, 2, "a").word(12, 12, "d")
    assert found(spark, page)[0][5:] == (2, 2, [["a", ""], ["", "d"]])


def test_tables_of_a_page(spark):
    page = Page(1).grid([0, 10, 20], [100, 110, 120]).grid([0, 10], [0, 10, 20]).grid([50, 60], [0, 10]).word(1, 1, "up").word(1, 101, "down")
    other = Page(1, 2).grid([0, 10], [0, 10, 20]).word(1, 1, "next")
    got = found(spark, page, other, Page(2).h(0, 0, 10).word(1, 1, "no table"))
    assert [(r[0], r[5], r[6], r[7][0][0]) for r in got] == [(1, 2, 1, "up"), (3, 2, 2, "down"), (1, 2, 1, "next")]  # the second has one row


def test_rectangles(spark):
    page = Page(1)
    for y in (0, 10):
        for x in (0, 10):
            page.add("rect", x, x + 10, y, y + 10).word(x + 1, y + 1, f"{x},{y}")
    assert found(spark, page)[0][-1] == [["0,0", "10,0"], ["0,10", "10,10"]]


def test_open_and_empty_pages(spark):
    open_ = Page(1).h(0, 0, 20).h(10, 0, 20).v(0, 0, 10)
    assert found(spark, open_) == []
    nulls = spark.createDataFrame([(1, 1, "line", None, None, 0.0, 0.0, None), (1, 1, "word", None, None, None, None, "x")], SCHEMA)
    assert tables.ruled_tables(nulls).count() == 0 and tables.ruled_tables(nulls.limit(0)).count() == 0


@pytest.mark.parametrize("n", [30])
def test_large_page(spark, n):
    page = Page(1).grid([10 * i for i in range(6)], [10 * i for i in range(n + 1)])
    for j in range(n):
        page.word(1, 10 * j + 1, f"r{j}")
    got = found(spark, page)
    assert got[0][5:7] == (n, 5) and [r[0] for r in got[0][7]] == [f"r{j}" for j in range(n)]
