"""Source files by names, and tables of contents over several pages."""

import pytest

from folioscope.operators import views
from folioscope.sources import layout


def test_source_files(spark):
    docs = spark.createDataFrame([(1, "a.pdf"), (2, "A.pdf"), (3, ""), (4, None), (5, "zz"), (6, "a.pdf")], "doc_id int, filename string")
    files = spark.createDataFrame([("/x/b_a.pdf",), ("/x/a.pdf.bak",), ("/y/A.pdf",)], "path string")
    got = {r["doc_id"]: r["path"] for r in views.source_files(docs, files).collect()}
    assert got == {1: "/x/a.pdf.bak", 2: "/y/A.pdf", 3: "/x/a.pdf.bak", 4: None, 5: None, 6: "/x/a.pdf.bak"}


HEAD, ENTRY, BODY = "Table of contents", "1.2 Title .... 7", "plain words"


@pytest.mark.parametrize(
    "pages, spans",
    [
        ({1: [HEAD, ENTRY, ENTRY, BODY], 2: [BODY]}, {1: (0, 30)}),
        ({1: [HEAD, ENTRY, BODY, ENTRY], 2: [ENTRY, BODY]}, {1: (0, 40), 2: (0, 10)}),  # no room between: it goes on
        ({1: [HEAD, ENTRY, BODY, BODY], 2: [BODY, BODY, BODY, ENTRY]}, {1: (0, 20)}),  # too much room
        ({1: [HEAD, ENTRY, ENTRY, ENTRY], 3: [ENTRY]}, {1: (0, 40)}),  # a page between
        ({1: [HEAD, BODY], 2: [ENTRY]}, {}),  # a heading without entries
        ({1: [ENTRY, HEAD, ENTRY], 2: [BODY, HEAD, BODY, ENTRY]}, {1: (10, 30), 2: (10, 40)}),
        ({1: [ENTRY, ENTRY]}, {}),
    ],
)
def test_contents_over_pages(spark, pages, spans):
    rows = [(1, p, 10.0 * i, 10.0 * i + 10, t) for p, ts in pages.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id int, page int, top double, bottom double, text string")
    got = {r["page"]: (r["begin"], r["end"]) for r in layout.contents_spans(df, 40.0).collect()}
    assert got == spans
    kept = [r for r in rows if r[1] not in spans or r[3] <= spans[r[1]][0] or r[2] >= spans[r[1]][1]]
    assert sorted(tuple(r) for r in layout.outside_contents(df, 40.0).collect()) == sorted(kept)
    assert "Python" not in layout.outside_contents(df, 40.0)._jdf.queryExecution().toString()
