"""The corpus operators against plain versions, on whole small tables and on odd rows."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import context_tree, language_id, line_dedup, mixing, packing, quality_rules, queries, simhash_golay, spotsigs, token_counts, toxicity
from folioscope.llm.common import read_table
from folioscope.llm.components import connected_components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINES = "one two three\nfour five six\nseven eight nine"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, LINES, "en", "a", 5),
    (4, LINES, "en", "a", 5),
    (5, LINES + "\n\nten " + "word " * 3000, "de", None, 5),
    (None, LINES, None, "b", 5),
    (6, "x", "fr", "b", 1),
    (7, "Ünïcode ﬁ 😀 \x00 the a <|endoftext|> the of and", "es", "b", 1),
    (8, LINES.upper(), "en", "a", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "extra", 0.5) for r in ODD], SCHEMA + ", score string, n_words double").cache()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(docs.collect(), key=lambda r: r["doc_id"])


@pytest.mark.parametrize("name", ["op2_line_dedup", "op7_mixing", "op10_quality_rules"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))


# --- 1 ---


def test_signatures(spark, rows):
    anchors = set(spotsigs.ANCHORS)
    texts = [r["text"] for r in rows[:60]] + ["", "the", "the of and", "word", "a b the c d", "ÜBER die Straße_und weg"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", spotsigs.signatures(F.col("t")).alias("s"), spotsigs.digest(spotsigs.signatures(F.col("t"))).alias("d")).orderBy("i").collect()
    plain = [brute.signatures(t, anchors) for t in texts]
    assert [len(g["s"]) for g in got] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert (got[i]["d"] == got[j]["d"]) == (plain[i] == plain[j])
            assert len(set(got[i]["s"]) & set(got[j]["s"])) == len(plain[i] & plain[j])


def test_fingerprint_edits(docs, rows):
    got = {r["id"]: r for r in spotsigs.fingerprint_edits(docs).collect()}
    down = rows[::-1]
    anchors = set(spotsigs.ANCHORS)
    assert len(got) == len(rows)
    for i, r in enumerate(down):
        text, after = r["text"], down[(i + 1) % len(down)]["text"]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (brute.signatures(t, anchors) for t in (text, edited, after))
        assert abs(g["near_edited"] - len(a & b) / len(a | b)) < 1e-12 and abs(g["near_next"] - len(a & c) / len(a | c)) < 1e-12


def test_next_document_over_blocks(spark):
    ids = [5, 9, 1, 400, 401, 7777, 10**12, 8]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["id"]: r["next_text"] for r in spotsigs.with_next(df, rows_per_block=2).collect()}
    down = sorted(ids, reverse=True)
    assert got == {d: f"t{down[(k + 1) % len(down)]}" for k, d in enumerate(down)}
    for kind, many in (("long", [10**15, *range(3000)]), ("string", [f"id{i:04}" for i in range(300)]), ("double", [i / 7 for i in range(500)])):  # skewed ids, and others than whole numbers
        df = spark.createDataFrame([(i, f"t{i}") for i in many], f"doc_id {kind}, text string")
        down = sorted(many, reverse=True)
        assert {r["id"]: r["next_text"] for r in spotsigs.with_next(df, rows_per_block=16).collect()} == {d: f"t{down[(k + 1) % len(down)]}" for k, d in enumerate(down)}
    cell, block = spotsigs._block_of(df := spark.createDataFrame([(i,) for i in [10**15, *range(3000)]], "id long"), "id", 16)
    assert max(r["count"] for r in df.withColumn("cell", cell).withColumn("block", block).groupBy("block").count().collect()) < 100


def test_spotsigs_groups(docs, rows):
    got = {r["id"]: r["group"] for r in spotsigs.near_duplicate_groups(docs).collect()}
    sets = [brute.signatures(r["text"], set(spotsigs.ANCHORS)) for r in rows]
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = want[i], want[j]
                want = [min(a, b) if w in (a, b) else w for w in want]
    first = {}
    for w, r in zip(want, rows):
        assert first.setdefault(w, got[r["doc_id"]]) == got[r["doc_id"]]
    assert len(set(got.values())) == len(set(want))


def test_spotsigs_odd(odd):
    got = spotsigs.fingerprint_edits(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert spotsigs.fingerprint_edits(odd.limit(0)).count() == 0 and spotsigs.near_duplicate_groups(odd.limit(0)).count() == 0
    assert spotsigs.near_duplicate_groups(odd).count() == len(ODD)


# --- 2 ---


def test_line_dedup(docs, rows):
    extra = [r["doc_id"] for r in rows]
    assert len(set(extra)) == len(extra)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute.dedup_lines([(r["doc_id"], r["text"]) for r in rows])


def test_line_dedup_overlaps(spark):
    made = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\na\na\na"), (4, "b\n\n c \nd"), (5, None), (6, "")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute.dedup_lines(made)
    assert got[2][0] == "x\ny" and got[3][0] == "a" and got[4] == ("", 4, 3)


def test_line_dedup_odd(odd):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == len(ODD) and line_dedup.dedup_lines(odd.limit(0)).count() == 0
    kept = {(r["doc_id"], r["n_removed"]) for r in got.where("text is not null").collect()}
    assert (None, 0) in kept and (4, 3) in kept  # null ids come first


# --- 3 ---


def test_golay_code():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500).astype(np.int32)
    errors = simhash_golay._golay()[1]
    assert len(set(errors.tolist())) == 2048 and max(int(e).bit_count() for e in errors) == 3
    for w in words:
        v = w ^ (1 << int(rng.integers(23))) ^ (1 << int(rng.integers(23)))
        rings = [set(simhash_golay.ring(np.array([x], np.int32))[1].tolist()) for x in (w, v)]
        assert rings[0] & rings[1] and len(rings[0]) in (1, 6)


def near_prints(n=300, seed=3):
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, n)]
    for _ in range(n):
        x = out[int(rng.integers(len(out)))]
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("limit", [2, 7, 4096])
def test_links_of_near_prints(spark, limit):
    prints = near_prints()
    dense = [0xABCDEF << 30 | i for i in range(64)]  # many rows share each key
    prints = sorted(set(prints + dense))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash_golay.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "print long"), group_limit=limit)
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 4 for r in links.collect())
    root = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = brute.groups(prints)
    names = {}
    for s, w in zip(signed, want):
        assert names.setdefault(w, root.get(s, s)) == root.get(s, s)
    assert len(set(names.values())) == len(names)


def test_components_of_a_path_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000), (500, 501), (501, 500), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_query(spark, sf_dir, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash_golay(spark, sf_dir).collect()}
    prints = [brute.simhash(r["text"]) for r in rows]
    roots = brute.groups(prints)
    assert got == {r["doc_id"]: (format(p, "016x"), rows[g]["doc_id"]) for r, p, g in zip(rows, prints, roots)}


def test_simhash_odd(odd):
    got = [(r["id"], r["component_id"], r["print"]) for r in simhash_golay.simhash_groups(odd).collect()]
    assert len(got) == len(ODD)
    assert {c for i, c, p in got if p == 0} == {1}
    kept = simhash_golay.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "7"]
    assert simhash_golay.simhash_groups(odd.limit(0)).count() == 0 and simhash_golay.drop_near_duplicates(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash_golay.fingerprint_links(odd.select(F.lit(1).cast("long").alias("print")), bits=5)


# --- 4 ---


def toy_texts(n, seed):
    rng = np.random.default_rng(seed)
    neutral = ["water", "stone", "green", "river", "walk", "table", "seven", "cloud", "under", "light"]
    bad = ["stupidity", "stupid", "stupidly", "idiotic", "idiots"]
    out = []
    for k in range(n):
        ws = [neutral[i] for i in rng.integers(0, 10, int(rng.integers(5, 200)))]
        if k % 3 == 0:
            ws.insert(int(rng.integers(len(ws))), bad[int(rng.integers(len(bad)))])
        out.append((" ".join(ws), int(k % 3 == 0)))
    return out


def test_toxicity_learns_words_and_misspellings():
    made = toy_texts(300, 1)
    model = toxicity.train([t for t, _ in made], [y for _, y in made])
    fresh = toy_texts(90, 2)
    right = [(s >= 0.5) == y for s, (_, y) in zip(model.score([t for t, _ in fresh]), fresh)]
    assert np.mean(right) > 0.95
    clean, odd_spelling = model.score(["the river under green light " * 5, "the river under stupiddly green light " * 5])
    assert clean < 0.5 < odd_spelling
    assert model.score(["", None])[0] < 0.5


def test_toxicity_query_against_brute_force(spark, sf_dir, rows):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(*toxicity.labelled_sample(docs, labels.where(~held_out)))
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows[:80]:
        want = brute.toxicity(r["text"], model.rows.tolist(), model.bias)
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(want, abs=1e-5) and g["predicted"] == int(g["score"] >= 0.5) and g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert brute.toxicity("", model.rows.tolist(), model.bias) == pytest.approx(model.score([None])[0], abs=1e-9)


def test_toxicity_sample_is_bounded_by_rows(spark):
    many = spark.range(500).selectExpr("7L doc_id", "concat('text ', id) text").unionByName(spark.createDataFrame([(8, "a\u00a0b\u3000c")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(many, labels) == (["text 0", "a\u00a0b\u3000c"], [1, 0])
    assert toxicity.words_of("a\u00a0b\u3000c d") == ["a\u00a0b\u3000c".encode(), b"d"]


def test_toxicity_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    got = queries.op4_toxicity(spark, big).where("held_out").join(read_table(spark, big, "labels"), "doc_id").select("predicted", "toxic").collect()
    hits = Counter((r["predicted"], r["toxic"]) for r in got)
    assert hits[1, 1] / (hits[1, 1] + hits[0, 1]) > 0.78 and hits[1, 0] / (hits[1, 0] + hits[0, 0]) < 0.07


def test_toxicity_odd(odd, spark):
    for labels in ([], [0, 0]):
        model = toxicity.train(["a b", "c d"][: len(labels)], labels)
        got = toxicity.score_toxicity(odd, model).collect()
        assert len(got) == len(ODD) and all(r["predicted"] == 0 for r in got)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.labelled_sample(odd, empty) == ([], [])
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, 0), (6, None), (99, 1)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(odd, labels) == ([LINES, "x"], [1, 0])
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


# --- 5 ---


def test_piece_counts(spark, docs, rows):
    pieces = token_counts.vocabulary(queries.vocabulary_file("piece_bpe_32k.model"))
    initial, following = map(set, pieces)

    def count(word):
        n = at = 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (following if at else initial)), None)
            if end is None:
                return 1
            n, at = n + 1, end
        return n

    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(docs, pieces, keep=["doc_id"]).collect()}
    for r in rows:
        per = [count(w) for w in brute.words(r["text"])]
        assert got[r["doc_id"]] == (len(per), sum(per), max(per, default=0))


def test_piece_counts_with_bare_mark(spark, sf_dir, rows):
    initial, following = map(set, token_counts.vocabulary(queries.vocabulary_file("piece_bpe_32k.model"), bare_mark=True))

    def count(word):
        n = at = 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (following if n else initial)), None)
            if end is None and (n or "" not in initial):
                return 1
            n, at = n + 1, at if end is None else end
        return n

    assert count("4734663219866878$$$") > 10 and count("ßheit") > 1
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_token_counts(spark, sf_dir).collect()}
    for r in rows:
        per = [count(w) for w in brute.words(r["text"])]
        assert got[r["doc_id"]] == (len(per), sum(per), max(per, default=0))
    counter = token_counts.PieceCounter(["a", "ab", ""], ["b", "c"])
    assert [counter.count(w) for w in ("abc", "b", "cbc", "xa", "bx")] == [2, 2, 4, 1, 1]


def test_piece_counts_against_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = ["a", "ab", "abcd", "##b", "##bc", "##c", "##cdx", "##d", "##z", "[UNK]"]
    plain = Tokenizer(models.WordPiece({v: i for i, v in enumerate(vocab)}, unk_token="[UNK]", max_input_chars_per_word=1000))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    counter = token_counts.PieceCounter([v for v in vocab if v[0] not in "#["], [v[2:] for v in vocab if v[0] == "#"])
    rng = np.random.default_rng(0)
    for _ in range(2000):
        word = "".join("abcdxz"[i] for i in rng.integers(0, 6, int(rng.integers(1, 9))))
        assert counter.count(word) == len(plain.encode(word).ids), word


def test_piece_counts_odd(odd):
    got = token_counts.count_tokens(odd, (["o", "w"], ["n", "e"])).collect()
    assert len(got) == len(ODD) and all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert token_counts.count_tokens(odd.limit(0), ([], [])).count() == 0


# --- 6 ---


def test_cross_parsing(monkeypatch):
    samples = {"x": "abracadabra arbor", "y": "zebra fizz buzz"}
    parser = language_id.CrossParser(samples)
    rng = np.random.default_rng(0)
    texts = ["abra cab", "buzz zebra", "q?? ab", "", "\U00010330\U00010331 abra"]
    texts += ["".join(rng.choice(list("abrcdoz é\U00010330"), int(rng.integers(0, 300)))) for _ in range(60)]
    want = [brute.cross_parse(t, samples) for t in texts]
    for block, at_once, few in ((2048, 1 << 21, 8), (5, 40, 0), (1, 10, 100)):  # where texts are cut doesn't change their phrases
        for name, value in (("BLOCK", block), ("AT_ONCE", at_once), ("FEW", few)):
            monkeypatch.setattr(language_id, name, value)
        assert parser.phrases(texts)[1].tolist() == [[w[0][k] for k in parser.langs] for w in want]


def test_language_held_out(spark, sf_dir, rows):
    want = {r["doc_id"]: r["lang"] for r in rows}
    got = queries.op6_language_id(spark, sf_dir).where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    big = sf_dir.replace("sf0.001", "sf0.1")
    known = read_table(spark, big, "documents").select("doc_id", "lang")
    got = queries.op6_language_id(spark, big).where("held_out").join(known, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert got > 0.95


def test_language_query_against_brute_force(spark, sf_dir, rows):
    learned = read_table(spark, sf_dir, "documents").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    samples = language_id.labelled_samples(learned)
    for lang, sample in samples.items():
        known = {r["text"] for r in rows if r["lang"] == lang and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
        parts = [t for t in known if t in sample]
        assert len(known) <= language_id.SAMPLE_DOCS and sorted(parts) == sorted(known)  # fewer than the bound: all are learned from
        assert len(sample) == sum(map(len, parts)) + len(parts) - 1
    short = [r for r in rows if len(r["text"]) < 1000]
    got = {r["doc_id"]: r["lang_pred"] for r in queries.op6_language_id(spark, sf_dir).collect()}
    sets = {k: brute.substrings(v.lower(), 12) for k, v in samples.items()}
    for r in short:
        if any(map(str.isalpha, r["text"])):
            counts, bits = brute.cross_parse(r["text"], samples, sets)
            assert counts[got[r["doc_id"]]] * bits[got[r["doc_id"]]] == min(counts[k] * bits[k] for k in counts), r["doc_id"]


def test_language_odd(spark, odd):
    model = language_id.labelled_samples(odd)
    assert set(model) == {"en", "de", "fr", "es"}
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify_languages(odd, model, keep=["doc_id"]).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and (8, "en") in got
    assert {r["lang_pred"] for r in language_id.identify_languages(odd, {}).collect()} == {"und"}
    assert language_id.labelled_samples(odd.limit(0)) == {} and language_id.identify_languages(odd.limit(0), model).count() == 0
    long_text = "abc " * 600_000  # more symbols than are parsed at once
    parser = language_id.CrossParser({"x": "abc abc abc"})
    sizes, counts = parser.phrases([long_text, long_text + "q"])
    assert sizes.tolist() == [2_400_001, 2_400_002] and counts[1, 0] == counts[0, 0] + 1
    many = spark.createDataFrame([(i, f"text {i}", f"l{i % 7}") for i in range(700)], "doc_id long, text string, lang string")
    assert {len(v.split("\n")) for v in language_id.labelled_samples(many, max_docs=30).values()} == {30}
    assert {len(v.split("\n")) for v in language_id.labelled_samples(many.unionByName(many)).values()} == {100}  # copies count once
    assert {len(v.split("\n")) for v in language_id.labelled_samples(many, max_chars=50).values()} <= {5, 6, 7}
    assert {len(v.split("\n")) for v in language_id.labelled_samples(many, max_chars=3).values()} == {1}
    long_rows = language_id.labelled_samples(many.withColumn("text", F.repeat("text", 2000)), max_docs=2)
    assert long_rows.keys() == {f"l{i}" for i in range(7)} and all(len(v) > 10_000 for v in long_rows.values())


# --- 7 ---


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).select("doc_id", "replica", "shuffle_key").collect()
    assert sorted((r["doc_id"], r["replica"]) for r in got) == sorted(brute.mixture([(r["doc_id"], r["text"], r["source"]) for r in rows]))
    keys = [r["shuffle_key"] for r in got]
    assert keys == sorted(keys)
    at = [r["doc_id"] for r in got]
    assert abs(np.corrcoef(at, range(len(at)))[0, 1]) < 0.3


def test_mixing_weights(spark):
    df = spark.range(4000).selectExpr("id doc_id", "concat('text ', id) text", "if(id % 4 = 0, 'a', 'b') source")
    shares = {r["source"]: r["n"] for r in mixing.mix_sources(df, weights={"a": 3, "b": 1}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["a"] / (shares["a"] + shares["b"]) - 0.75) < 0.03
    assert {r["source"] for r in mixing.mix_sources(df, weights={"a": 1}).collect()} == {"a"}
    with pytest.raises(ValueError):
        mixing.mix_sources(df, weights={"a": -1})


def test_mixing_of_a_tiny_source(spark):
    df = spark.range(200).selectExpr("id doc_id", "if(id < 3, 'x', repeat('long text ', 600)) text", "if(id < 3, 'tiny', 'large') source")
    got = mixing.mix_sources(df, weights={"tiny": 1, "large": 3}).groupBy("doc_id", "rate").agg(F.count("*").alias("n"), F.countDistinct("replica").alias("replicas"), F.max("replica").alias("last")).collect()
    tiny = {r["doc_id"]: r["n"] for r in got if r["doc_id"] < 3}
    rate = next(r["rate"] for r in got if r["doc_id"] == 0)
    assert rate == pytest.approx(0.25 * (197 * 6000 + 3) / 3) and rate > 90_000
    assert len(set(tiny.values())) == 3 and all(abs(n - rate) < 6 * rate**0.5 for n in tiny.values())
    assert all(r["replicas"] == r["n"] == r["last"] + 1 for r in got)
    counts = spark.range(3000).select(mixing.poisson_count(F.lit(1200.5), 17, F.col("id")).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(counts[0] - 1200.5) < 3 and abs(counts[1] / 1200.5 - 1) < 0.12


def test_mixing_odd(odd):
    got = mixing.mix_sources(odd)
    assert got.columns == [*odd.columns, "rate", "replica", "shuffle_key"]
    counts = Counter(str(r["doc_id"]) for r in got.collect())
    assert all(n % 2 == 0 for i, n in counts.items() if i == "4")
    assert mixing.mix_sources(odd.limit(0)).count() == 0


# --- 8 ---


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    file = queries.vocabulary_file("word_bpe_49k.json")
    plain = Tokenizer.from_file(file)
    pieces = packing.pack_documents(docs.repartition(3), file, keep=["doc_id"]).collect()
    of_doc, of_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["piece_ids"], "<u4")
        assert len(ids) == p["length"] > 0 and zlib.crc32(p["piece_ids"]) == p["ids_crc32"]
        of_doc.setdefault(p["doc_id"], []).append((p["start"], ids))
        of_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for r in rows:
        whole = np.concatenate([x for _, x in sorted(of_doc[r["doc_id"]], key=lambda s: s[0])])
        assert whole.tolist() == [*plain.encode(r["text"], add_special_tokens=False).ids, 1]
    assert sorted(of_sequence) == list(range(len(of_sequence)))
    for s, parts in of_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or s == max(of_sequence)


def test_packing_odd(odd):
    file = queries.vocabulary_file("word_bpe_49k.json")
    pieces = packing.pack_documents(odd, file, window=64)
    assert pieces.where("doc_tokens = 1").count() == 3 and "score" in pieces.columns
    got = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert all(r["n_tokens"] == 64 == len(r["ids"]) // 4 for r in got[:-1]) and sum(r["n_tokens"] for r in got) == pieces.agg(F.sum("length")).first()[0]
    assert packing.pack_documents(odd.limit(0), file).count() == 0


def test_packing_words_together(monkeypatch):
    import tokenizers

    file = queries.vocabulary_file("word_bpe_49k.json")
    plain, given = tokenizers.Tokenizer.from_file(file), []

    class Counting:
        def __init__(self):
            self.model, self.get_vocab, self.get_vocab_size = plain.model, plain.get_vocab, plain.get_vocab_size

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", type("Stub", (), {"from_file": staticmethod(lambda path: Counting())}))
    encode = packing.batch_encoder(file)
    odd = [None, "", ".", "A.. b", "\u00c9, \u00e9! \u00d7. \u00f7.", "<|endoftext|> a. B.", "<|ENDOFTEXT|> X, y", "x.!?", "\n\n", "it's 12,5\x0b.\t", "\u0130\u03a3. e\u0301 \u4e2d\u6587.", "a" * 300 + " b", "\u00df\u00b5 \u00aa."]
    many = [" ".join(f"wort{a}{b}{c}" for c in "abcdefghijklmn") for a in "abcdefghijklmn" for b in "abcdefghijklmn"]
    for texts in (odd, [None], [""], many, many):
        got = encode([None if t is None else t.encode() for t in texts]).to_pylist()
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert len(given) < 60  # of 2,744 words once, and the odd ones
    assert packing.batch_encoder(file, None)([b"", None]).to_pylist() == [b"", b""]


# --- 9 ---


def test_context_tree_against_brute_force(spark, monkeypatch):
    learned = ["The cat, the hat. The CAT", "tin then in", "\u00e9t\u00e9 the", "", None, "the cat the hat the cat"]
    asked = [*learned, "the then", "zzz \U0001f600", "x" * 40, "the cat"]
    df = spark.createDataFrame([(i, t, i < len(learned)) for i, t in enumerate(asked)], "doc_id long, text string, learn boolean")
    plain = brute.ContextTree(learned, context_tree.DEPTH)
    for sent in (0, 5, 10**6):
        got = {r["id"]: r["score"] for r in context_tree.score_texts(df, F.col("learn"), sent=sent).collect()}
        assert all(got[i] == pytest.approx(plain.score(t), rel=1e-5) for i, t in enumerate(asked)), sent
    windows = np.concatenate([w for _, w in context_tree._pieces([context_tree._coded(context_tree.tokens(t)) for t in asked])])
    monkeypatch.setattr(context_tree, "AT_ONCE", 7)  # where texts are cut changes no window
    assert np.concatenate([w for _, w in context_tree._pieces([context_tree._coded(context_tree.tokens(t)) for t in asked])]).tolist() == windows.tolist()


def test_predictions_sum_to_one():
    rng = np.random.default_rng(0)
    raw = bytes(rng.choice(list(b"abc \n"), 3000).tolist())
    found, n = np.unique(context_tree.windows(raw), return_counts=True)
    trees = context_tree.grow(found, n.astype(float))
    rows = []
    for bits, t in enumerate(trees[2]):
        short, at = np.unique(context_tree._shorter(t.keys, 2, bits), return_inverse=True)
        rows.append((short >> bits, np.full(len(short), bits), short & ((1 << bits) - 1), *(np.bincount(at, weights=w) for w in (t.zeros, t.ones, t.weighted))))
    crown = context_tree.Crown(*(np.concatenate(c) for c in zip(*rows)))
    for context in (*found[:20] >> 8, 0, 97 << 32):
        keys = (int(context) << 8) + np.arange(256)
        assert (10 ** crown.costs(keys, context_tree.chances(trees, keys))).sum() == pytest.approx(1, abs=1e-6)


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 5000))
    table = context_tree.Lookup(keys[::2], np.arange(len(keys[::2]), dtype=np.float32))
    values, found = table.of(keys)
    assert found.tolist() == [i % 2 == 0 for i in range(len(keys))] and values[::2].tolist() == list(range(len(keys[::2]))) and not values[1::2].any()
    assert not context_tree.Lookup(keys[:0], np.empty(0, np.float32)).of(keys)[1].any()


def test_scores_of_the_table(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in queries.op9_context_tree(spark, sf_dir).collect()}
    plain = brute.ContextTree([r["text"] for r in rows if not got[r["doc_id"]]["held_out"]], context_tree.DEPTH)
    some = [r for r in rows if len(r["text"]) < 1500]
    assert len(some) > 20 and all(got[r["doc_id"]]["score"] == pytest.approx(plain.score(r["text"]), rel=1e-5) for r in some)
    assert np.mean([r["bits_per_byte"] for r in got.values() if r["held_out"]]) < 2.4


def test_base_scores(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in queries.op9_context_tree(spark, sf_dir).collect()}
    bags = {r["doc_id"]: [*brute.words(brute.lower_ascii(r["text"])), None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in bags}
    counts = Counter(t for i, b in bags.items() if not held[i] for t in b)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, b in bags.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(b), sum(counts[t] > 0 for t in b), n)
        assert abs(r["base_score"] - sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in b)) < 1e-6 * len(b)
        assert r["score"] < 0


def test_scores_do_not_depend_on_what_is_sent(odd):
    a = context_tree.score_texts(odd, F.lit(True), frequent_share=1, sent=0)
    b = context_tree.score_texts(odd, F.lit(True))
    key = lambda r: (str(r["id"]), r["n_tokens"], round(r["score"], 4), round(r["base_score"], 6), r["n_known"])
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect())) and a.count() == len(ODD)
    assert context_tree.score_texts(odd.limit(0), F.lit(True)).count() == 0
    none = context_tree.score_texts(odd, F.lit(None).cast("boolean")).collect()
    assert len(none) == len(ODD) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)
    assert all(r["score"] == pytest.approx(-8 * np.log10(2) * r["n_bytes"], rel=1e-5) for r in none)


# --- 10 ---


def test_quality_measures(rows):
    kinds = quality_rules._letter_table()
    texts = [r["text"] for r in rows] + ["", None, "a b a b a b", "x\nx\n \nx", "# $ %& é|\x0b", "a a a a", "\U00010400\U00010428 \u24b6 \u01c5"]
    for t in texts:
        assert quality_rules.measure(t, kinds)[:5] == brute.quality(t)
    assert quality_rules.measure(texts[-1], kinds)[6:8] == (3, 1)  # letters beyond U+FFFF, and what is no letter


def test_quantile_sketch(spark):
    values = list(range(0, 70)) + [100, 1000, 5000, 65535, 10**9]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select("v", quality_rules.bin_of(F.col("v")).alias("b")).withColumn("top", quality_rules.bin_top(F.col("b"))).orderBy("v").collect()
    assert all(r["v"] <= r["top"] <= r["v"] * (1 + 1 / 32) for r in got)
    assert [r["b"] for r in got] == sorted(r["b"] for r in got)
    sk = spark.createDataFrame([("g", "r", b, n) for b, n in ((1, 10), (2, 5), (9, 5))], "k string, rule string, bin long, n long")
    q = quality_rules.quantiles(sk, ["k"]).first()
    assert [q[f"q{p}"] for p in quality_rules.PERCENTILES] == [1, 1, 1, 2, 9, 9]


def test_fences_follow_the_groups(spark):
    """Languages with other word lengths and sources with other symbols get other fences; no fence is a constant away from a quartile."""
    rng, rows = np.random.default_rng(0), []
    for lang, source, length, symbols in (("en", "a", 4, 0), ("de", "a", 8, 0), ("en", "b", 4, 30)):
        for k in range(300):
            words = ["x" * int(n) for n in rng.integers(length - 1, length + 2, 120)]
            for i in rng.integers(0, 120, int(rng.integers(symbols, symbols + symbols // 3 + 1))):
                words[i] += "#"
            rows.append((len(rows), " ".join(words), lang, source))
    extra = [(1000, " ".join(["x" * (4 + i % 3) + "#" * (i % 4 == 0) + str(i) for i in range(120)]), "en", s) for s in ("a", "b")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string")
    measured = quality_rules.quality_verdicts(df)
    kinds = quality_rules._letter_table()
    m = spark.createDataFrame([(r[2], r[3], *quality_rules.measure(r[1], kinds)) for r in rows], "lang string, source string, " + quality_rules._SCHEMA)
    fences = {(r["lang"], r["source"]): r["fences"] for r in quality_rules.thresholds(m, "lang", "source").collect()}
    assert fences["de", "a"]["word_length"]["low"] > fences["en", "a"]["word_length"]["low"] and fences["de", "a"]["word_length"]["high"] > fences["en", "a"]["word_length"]["high"] + 200
    assert fences["en", "b"]["symbols"]["high"] > 2 * fences["en", "a"]["symbols"]["high"]
    verdict = {r["source"]: "symbols" in r["failed_rules"] for r in measured.where("doc_id = 1000").collect()}
    assert verdict == {"a": True, "b": False}


def test_every_rule_has_a_fence_of_its_own_that_can_be_crossed(spark):
    """Two sources that differ in some documents' measure alone have other fences for its rule, and each fence can be crossed."""
    usual = dict(zip(quality_rules.MEASURES, (200, 1000, 0, 0, 0, 40, 950, 20, 0)))
    counted = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "capitals": "n_capitals", "shouts": "n_shouts", "marks": "word_chars", "word_length": "word_chars"}
    more = {"symbols": 3, "dup_lines": 4, "repeats": 20, "capitals": 40, "shouts": 3, "marks": 60, "word_length": 60}
    rows = []
    for rule, of in counted.items():
        for source in "ab":
            for share, name in ((0.3, "some"), (0.15, "few")):
                for k in range(400):
                    m = usual | ({of: usual[of] + more[rule]} if source == "b" and k < share * 400 else {})
                    rows.append((f"{rule} {name}", source, *m.values()))
    df = spark.createDataFrame(rows, "lang string, source string, " + quality_rules._SCHEMA)
    fences = {(r["lang"], r["source"]): r["fences"] for r in quality_rules.thresholds(df, "lang", "source").collect()}
    for rule in counted:
        a, b = (fences[f"{rule} some", s][rule] for s in "ab")
        assert a["high"] < b["high"], (rule, a, b)
        if rule in ("symbols", "dup_lines", "repeats", "shouts"):  # quartiles coincide: the tail's percentiles decide
            a, b = (fences[f"{rule} few", s][rule] for s in "ab")
            assert a["high"] < b["high"], (rule, a, b)
        if rule in quality_rules.SHARES:
            assert all(f[rule]["high"] < 1000 for f in fences.values())
        if rule in ("capitals", "marks", "word_length"):
            assert all(f[rule]["low"] > 0 for f in fences.values())


def test_quality_keeps_clean_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    labels = read_table(spark, big, "labels")
    got = queries.op10_quality_rules(spark, big).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in got}
    assert share[1] > 0.99 and share[0] < 0.1


def test_quality_odd(odd):
    got = quality_rules.quality_verdicts(odd)
    assert got.count() == len(ODD) and {r["kept"] for r in got.where("doc_id < 4").collect()} == {False}
    assert quality_rules.quality_verdicts(odd.limit(0)).count() == 0
    assert quality_rules.kept_documents(odd).columns == odd.columns
    assert quality_rules.kept_documents(odd.limit(0)).count() == 0
