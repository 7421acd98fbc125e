"""Personal data: base patterns against plain ones, discovery by contexts against the SQL, odd and long texts."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.functions import arrays
from folioscope.llm import personal_data, personal_data_sql, queries
from tests.llm.test_operators import ODD, SCHEMA

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(n):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(n))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "") if kind != "email" or "@" in (text or "") else ():  # plain ones take quadratic time
            n = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def found_in(df):
    out = personal_data.find_personal_data(df)
    return out.select("id", personal_data.span_list(F.col("base")).alias("base"), personal_data.span_list(F.transform("found", lambda s: s.dropFields("score"))).alias("found")).collect()


SPANS = [
    "a@b.c_d@e.f x@y z@w@v.u ..@-.- a@b..c a@b.c.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.000 1.2.3.4 00.0.0.0x 1.1.1.1111111111111111111111",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 1234 5678 4111 1111 1111 1111  4111  1111",
    "+1 (743) 555-3824 +12 +1 2 3 4 5 6 7 8 +1 +1(555)5551234). +123456789012345678",
    "😀 a.b@c.de é+1 (743) 555-3824😀",
    "", None, "x" * 50, "@" * 50, "+1" * 30, "1.1." * 30, "a.b@" * 30,
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(SPANS)), "doc_id long, text string")
    for r in found_in(df):
        assert r["base"] == plain_spans(SPANS[r["id"]]), SPANS[r["id"]]


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1 " * 100_000, "1." * 100_000, "a." * 100_000 + "@b", "+1" + " " * 300_000, "a@" + "b." * 100_000, "( " * 100_000, ".,-" * 100_000, "a1@b.c " * 20_000])
def test_long_texts(spark, text):
    got = found_in(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert got[0]["base"] == (plain_spans(text) if len(set(text)) > 1 and "@b" != text[-2:] else "")


def test_sums_before(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        df = spark.range(1).select(F.when(F.lit(n) > 0, F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda i: i.cast("long"))).otherwise(F.array().cast("array<long>")).alias("x"))
        assert df.select(arrays.sums_before(F.col("x"))).first()[0] == [i * (i + 1) // 2 for i in range(n)]


def contexts():
    """Contexts that only identifiers follow, with unseen ones among them; the same strings in common contexts, and lookalikes."""
    rows = [f"some words come first, my direct line: +1 (555) 555-{1000 + i} is open and the river ran" for i in range(8)]
    rows += [f"we sent it; my direct line: 0{i}555/98{i}7 today" for i in range(3)]
    rows += [f"billing contact is user{i}@mail.example.com for now" for i in range(6)]
    rows += ["the billing contact is root@localhost1 for now", "so the billing contact is the person here", "call root@localhost1 later"]
    rows += [f"office badge 0{i}555/98{i}7 was lost" for i in range(2, 6)]  # a second round: badges known by their direct lines
    rows += ["office badge QX-99120 was lost"]
    rows += [f"in the year {1990 + i} the {word} ran and the 10{i}.77.{i}.9 too" for i, word in enumerate("river stone cloud table green water".split())]
    rows += ["order number 4111111111111112 of the year 20011", "the +1 (555) 555-1001", "the 55512345 is big", "(my direct line: \"77x88y99\")"]
    return [(i, t) for i, t in enumerate(rows)]


def test_contexts(spark):
    rows = contexts()
    got = {r["id"]: r for r in found_in(spark.createDataFrame(rows, "doc_id long, text string"))}
    said = {rows[i][1][int(a) : int(b)]: kind for i, r in got.items() for kind, a, b in (s.split(":") for s in r["found"].split(",") if s)}
    assert said["00555/9807"] == "phone" and said["root@localhost1"] == "email" and said["77x88y99"] == "phone"
    assert any(r["found"] and rows[i][1].startswith("call root@localhost1") for i, r in got.items())
    assert not {"1993", "20011", "55512345", "4111111111111112"} & set(said)


@pytest.mark.parametrize("case", ["tables", "contexts", "odd"])
def test_sql(spark, sf_dir, case, tmp_path, monkeypatch):
    folder = sf_dir
    if case != "tables":
        rows = [(i, t, "en", "a", 1) for i, t in contexts()] if case == "contexts" else [r for r in ODD if not r[1] or "\x00" not in r[1]]
        spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", base string").write.parquet(str(tmp_path / "documents.parquet"))
        folder = str(tmp_path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet{'' if case == 'tables' else '/*.parquet'}')")
    want, got = con.execute(personal_data_sql.personal_data_sql()).df(), queries.op11_personal_data(spark, folder).toPandas()
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert list(got.columns) == list(want.columns) == columns
    got, want = got.astype({"doc_id": "Int64"}), want.astype({"doc_id": "Int64"})
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_odd(spark):
    odd = spark.createDataFrame([(*r, "extra", 0.5) for r in ODD], SCHEMA + ", base string, row double")
    got = personal_data.find_personal_data(odd)
    assert got.columns == ["id", "base", "found"] and got.count() == len(ODD)
    assert personal_data.find_personal_data(odd.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_patterns_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(personal_data, "SENT", 0)
    df = spark.createDataFrame(contexts(), "doc_id long, text string")
    first = sorted(map(str, found_in(df)))
    monkeypatch.undo()
    assert first == sorted(map(str, found_in(df)))


def test_no_python(spark, sf_dir):
    plan = queries.op11_personal_data(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
