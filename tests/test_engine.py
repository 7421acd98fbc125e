"""Consensus, comparison, search, knowledge base, prompts, layout and sources on hand-made rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from folioscope.functions import voting
from folioscope.functions.vectors import hashed_embedding, hashed_vector
from folioscope.operators import consensus, prompts, providers, search, terms, views
from folioscope.plans import corpus
from folioscope.sources import files, layout, store
from folioscope.streaming import ingest


def votes(spark, *lists):
    rows = [(f"i{i}", 0, f"m{m}", m, str(v), str(v)) for i, vs in enumerate(lists) for m, v in enumerate(vs)]
    return spark.createDataFrame(rows, "item string, round int, model_id string, seq int, key string, content string")


def test_decisions(spark):
    got = {r["item"]: r for r in consensus.decide(votes(spark, [1, 1, 2], [1, 2], [3, 3, 3, 1, 2], [1, 2, 3], [5])).collect()}
    assert [got[f"i{i}"]["achieved"] for i in range(5)] == [True, False, True, False, True]
    assert [got[f"i{i}"]["tie"] for i in range(5)] == [False, True, False, True, False]
    plural = consensus.decide(votes(spark, [1, 1, 2, 3]), threshold=0.5).first()
    assert plural["achieved"] and plural["winner"] == "1"
    judged = {r["item"]: r["chosen"] for r in consensus.majority(votes(spark, [1, 2], [1, 2, 2]), judge=lambda a, b: F.lit("42")).collect()}
    assert judged == {"i0": "42", "i1": "2"}


def test_outliers_and_agreement(spark):
    v = votes(spark, [1, 1, 1, 2], [1, 2, 3], [1, 1])
    assert [(r["item"], r["key"]) for r in consensus.outliers(v).collect()] == [("i0", "2")]
    assert {r["item"]: round(r["agreement"], 3) for r in consensus.agreement(v).collect()} == {"i0": 0.667, "i1": 0.0, "i2": 1.0}


def test_rounds_until_consensus(spark):
    items = spark.createDataFrame([("a", "q", f"m{m}", m) for m in range(3)], "item string, prompt string, model_id string, seq int")

    def respond(asked, r):
        told = F.when(F.size("peers") > 0, F.lit("same")).otherwise(F.col("model_id"))
        return asked.select("item", "model_id", "seq", told.alias("content"))

    out = consensus.run_rounds(items, respond, F.col("content"))
    assert out.count() == 6 and out.where("round = 1").select("key").distinct().count() == 1
    moved = consensus.evolution(out).collect()
    assert len(moved) == 3 and all(r["changed"] and r["influenced_by"] == [] for r in moved)
    with pytest.raises(ValueError):
        consensus.run_rounds(items, respond, F.col("content"), max_rounds=21)


def test_voting_keys(spark):
    spec = {"confidence": voting.VotingField(voting.IGNORE), "score": voting.VotingField(voting.RANGE, tolerance=0.2), "category": voting.VotingField(voting.SEMANTIC), "tags": voting.VotingField(voting.UNORDERED_ALIKE)}
    rows = [(1, 0.1, 90.0, "Tech", ["a", "b"]), (1, 0.9, 88.0, " tech", ["b", "a"]), (1, 0.1, 70.0, "tech", ["a", "b"]), (2, 0.1, 90.0, "tech", ["a", "b"])]
    df = spark.createDataFrame(rows, "answer int, confidence double, score double, category string, tags array<string>")
    keys = [r[0] for r in df.select(voting.voting_key({c: F.col(c) for c in df.columns}, spec)).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3
    with pytest.raises(ValueError):
        voting.VotingField("other")


@pytest.mark.parametrize(
    ("a", "b", "f", "want"),
    [
        (["x", "y"], ["y", "x"], lambda a, b: voting.unordered_matches(a, b, 0.8), True),
        (["x", "y"], ["y", "x"], lambda a, b: voting.ordered_matches(a, b, 0.8), False),
        (["x", "y"], ["x", "z"], lambda a, b: voting.unordered_matches(a, b, 0.5), True),
        (["x", "y"], ["x", "z"], lambda a, b: voting.unordered_matches(a, b, 0.6), False),
        ([], [], lambda a, b: voting.unordered_matches(a, b, 0.8), True),
        (["x"], [], lambda a, b: voting.unordered_matches(a, b, 0.8), False),
        (["x"], ["x", "y"], lambda a, b: voting.ordered_matches(a, b, 0.1), False),
        (["y", "z"], ["x", "y", "z"], lambda a, b: voting.ordered_alike_matches(a, b, 1.0), True),
        (["x", "x"], ["x", "y"], lambda a, b: voting.unordered_matches(a, b, 0.6, alike=True), False),
        ([], ["x"], lambda a, b: voting.ordered_alike_matches(a, b, 0.8), False),
    ],
)
def test_sequences(spark, a, b, f, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(f(F.col("a"), F.col("b"))).first()[0] is want


def test_struct_comparison(spark):
    inner = voting.VotingField(voting.DERIVED, threshold=0.5, fields={"term": voting.VotingField(), "n": voting.VotingField(voting.RANGE), "note": voting.VotingField(voting.IGNORE)})
    df = spark.createDataFrame([((("a", 100.0, "x")), (("a", 200.0, "y"))), ((("a", 100.0, "x")), (("b", 200.0, "x")))], "a struct<term:string,n:double,note:string>, b struct<term:string,n:double,note:string>")
    assert [r[0] for r in df.select(voting.compare(F.col("a"), F.col("b"), inner)).collect()] == [True, False]


DOCS = [
    (1, "The Application Programming Interface (API) helps.\nThe interface of the API is stable.\nAPI interface interface", "a.pdf"),
    (2, "Machine Learning (ML) needs the interface.\nLearning needs machine power.", "b.txt"),
    (3, "", "c.txt"),
]


@pytest.fixture(scope="module")
def base(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, filename string")
    return corpus.build(docs, share=0.0, save=lambda df, name: df.cache())


def test_knowledge_base(base, spark, tmp_path):
    t = {r["term_key"]: r for r in base.terms.collect()}
    assert t["api"]["term_type"] == "acronym" and t["api"]["full_form"] == "Application Programming Interface"
    assert t["interface"]["total_count"] == 4 and t["interface"]["term_type"] == "keyword"
    links = {(r["acronym"], r["keyword"]) for r in base.links.collect()}
    assert ("API", "interface") in links and ("ML", "machine") in links
    base.save(str(tmp_path / "kb"))
    again = store.KnowledgeBase.load(spark, str(tmp_path / "kb"))
    assert sorted(map(tuple, again.terms.collect())) == sorted(map(tuple, base.terms.collect()))
    with pytest.raises(ValueError):
        store.KnowledgeBase.load(spark, "")
    with pytest.raises(FileNotFoundError):
        store.KnowledgeBase.load(spark, str(tmp_path / "none"))


def engine(base):
    chunks = base.chunks.join(base.vectors, "chunk_id")
    return search.SearchEngine(chunks, base.terms, base.links, base.cooccurrences, base.pages, lambda q: hashed_vector(q).tolist())


def test_search(base):
    e = engine(base)
    best = e.similar("the API is stable", k=2, threshold=0.0).collect()
    assert len(best) == 2 and best[0]["text"] == "The interface of the API is stable." and best[0]["score"] >= best[1]["score"]
    assert e.similar("  ").count() == 0 and e.similar("x", k=0).count() == 0
    assert e.similar("interface", k=5, threshold=0.9).count() <= e.similar("interface", k=5, threshold=0.1).count()
    found = e.enhanced("the api interface", k=3, threshold=0.0).collect()
    assert {"API", "interface"} <= set(found[0]["primary_terms"]) and found[0]["relevance"] > 0
    assert [r["combined"] for r in found] == sorted((r["combined"] for r in found), reverse=True)


def test_one_minus_mode_keeps_order(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, vector array<double>")
    rows = search.top_k(v, [1.0, 0.0], 1, score_mode="one_minus").collect()
    assert [(r["chunk_id"], r["score"]) for r in rows] == [("a", 0.0)]


def test_page_media(spark):
    pages = spark.createDataFrame([(1, 1, ["img"], ["t"])], "doc_id long, page int, images array<string>, tables array<string>")
    results = spark.createDataFrame([(1, 1), (1, 0), (1, None), (2, 1)], "doc_id long, page int")
    got = sorted((str(r["page"]), r["images"]) for r in search.page_media(results, pages).collect() if r["doc_id"] == 1)
    assert got == [("0", []), ("1", ["img"]), ("None", [])]


def test_linking_threshold(spark):
    a = spark.createDataFrame([("API", "Application Programming Interface"), ("X", None), ("Y", "")], "term string, full_form string")
    k = spark.createDataFrame([("programming",), ("p",), (" ",), ("interface application",), ("fish",)], "term string")
    got = {r["keyword"]: r["match_score"] for r in terms.link_terms(a, k).collect()}
    assert set(got) == {"programming", "interface application"} and abs(got["programming"] - (0.7 + 0.3 * 11 / 33)) < 1e-9
    with pytest.raises(ValueError):
        terms.link_terms(a, k, 2)


def test_merge_cooccurrences(spark):
    schema = "term string, other string, frequency long, confidence double"
    a, b = spark.createDataFrame([("t", "x", 2, 0.5)], schema), spark.createDataFrame([("t", "x", 3, 0.9), ("t", "y", 1, 0.95)], schema)
    got = [(r["other"], r["frequency"], r["confidence"]) for r in terms.merge_cooccurrences(a, b, 1).collect()]
    assert got == [("y", 1, 0.95)]


def test_prompt_rules(spark):
    df = spark.createDataFrame([("lacks detail here",), ("Missing context",), ("nothing of note",), ("too long",)], "t string")
    assert [r[0] for r in df.select(prompts.issue_principle(F.col("t"))).collect()] == ["should include detail here", "should include context", "Ensure: hing of e", "Keep prompts concise while maintaining clarity"]
    one = spark.createDataFrame([("It might  be the the best best. What is it? yes",)], "p string")
    p = F.col("p")
    got = one.select(prompts.clarify(p), prompts.simplify(p), prompts.break_down(F.lit("a, b and c;")), prompts.restructure(p), prompts.capitalise_sentences(F.lit("ab. cd!ef")), prompts.core_request(p), prompts.make_specific(p)).first()
    assert got[0] == "It be the the best best. What is it? yes"
    assert got[1] == "It might be the the best best. What is it? yes"
    assert got[2] == "Please address the following:\n1. a\n2. b\n3. c"
    assert got[3] == "Main request: What is it\n\nContext: It might  be the the best best. yes"
    assert got[4] == "Ab. cd!Ef" and got[5] == "What is it?" and got[6].endswith("What is it with specific details and examples? yes")


def test_principles_and_metrics(spark):
    fb = spark.createDataFrame([(1, [("too short", 0.5), ("Use clear examples", 0.7)], ["You should add x", "fine"], ["lacks y"])], "feedback_id int, principles array<struct<principle:string,importance:double>>, suggestions array<string>, issues array<string>")
    got = [(r["principle"], r["importance"]) for r in prompts.extract_principles(fb).orderBy("place").collect()]
    assert got == [("Use clear examples", 0.7), ("You should add x", 0.8), ("should include y", 0.9)]
    ev = spark.createDataFrame([(1, 0, 0.3), (1, 1, 0.5), (1, 2, 0.7)], "prompt_id int, iteration int, score double")
    m = prompts.alignment_metrics(ev, spark.createDataFrame([(1, 0.85)], "prompt_id int, final_score double")).first()
    assert abs(m["convergence_rate"] - (0.85 - 0.3) / 3) < 1e-8 and m["stability"] == 1.0
    ps = spark.createDataFrame([([("be specific", 0.5), ("add a date", 0.9)],)], "ps array<struct<principle:string,importance:double>>")
    assert ps.select(prompts.apply_principles(F.lit("Say it now."), F.col("ps"))).first()[0] == "Say it now.\n\na date\n\nSpecifically: [Add concrete details]"


def test_align_loop(spark):
    start = spark.createDataFrame([(1, "Explain the thing"), (2, "Explain it (done)")], "prompt_id int, prompt string")
    evaluate = lambda df: df.withColumn("score", F.when(F.col("prompt").contains("done"), 0.9).otherwise(0.2))
    feedback = lambda df: df.select(F.col("prompt_id").alias("feedback_id"), F.array().cast("array<struct<principle:string,importance:double>>").alias("principles"), F.array(F.lit("You should include (done)")).alias("suggestions"), F.array().cast("array<string>").alias("issues"))
    final, history = prompts.align(start, evaluate, feedback)
    assert {r["prompt_id"]: r["prompt"] for r in final.collect()} == {1: "Explain the thing\n\n(done)", 2: "Explain it (done)"}
    assert history.count() == 4


def test_views(spark):
    t = spark.createDataFrame([("API", "acronym", None, "Application"), ("db", "keyword", "a store", None)], "term string, term_type string, meaning string, full_form string")
    assert [r["term"] for r in views.filter_terms(t, " APPLI ").collect()] == ["API"]
    assert views.filter_terms(t, acronyms=False).count() == 1 and views.filter_terms(t, acronyms=False, keywords=False).count() == 0
    assert [r["term"] for r in views.page_of(t, ["term"], page=2, size=1).collect()] == ["db"]


def test_layout(spark):
    o = spark.createDataFrame([(1, 1, "char", 0.0, 2.0, 0.0, 2.0, None), (1, 1, "rect", 8.0, 12.0, 8.0, 12.0, 0.0), (1, 1, "rect", 0.0, 1.0, 0.0, 1.0, 1.0)], "doc_id int, page int, kind string, x0 double, x1 double, top double, bottom double, color double")
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0)], "doc_id int, page int, bx0 double, btop double, bx1 double, bbottom double")
    assert layout.outside_tables(o, b).count() == 2 and layout.visible(o).count() == 2 and layout.crop(o, 20, top=5).count() == 1
    lines = [(1, 1, 0.0, 10.0, "Table of Contents"), (1, 1, 10.0, 20.0, "1.1 Intro .... 3"), (1, 1, 20.0, 30.0, "Body"), (1, 2, 0.0, 10.0, "2.1 Next .... 9"), (1, 2, 50.0, 60.0, "More body")]
    df = spark.createDataFrame(lines, "doc_id int, page int, top double, bottom double, text string")
    assert sorted(r["text"] for r in layout.outside_contents(df, 50.0).collect()) == ["Body", "More body"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello")
    (tmp_path / "b.txt").write_text("hello")
    (tmp_path / "c.html").write_text("<html><style>x</style><h1>Hi &amp; you</h1><p>there</p></html>")
    (tmp_path / "d.bin").write_bytes(b"\0")
    found = files.resolve(spark, [str(tmp_path / "*.txt"), str(tmp_path), str(tmp_path / "none")])
    assert len(found) == 5
    scanned = files.scan(spark, sorted(set(found)))
    docs = {r["filename"]: r["text"] for r in files.read_documents(scanned).collect()}
    assert docs == {"a.TXT": "hello", "b.txt": "hello", "c.html": "Hi & you\nthere"}
    assert sorted(r["n_copies"] for r in files.distinct_documents(scanned).collect()) == [1, 1, 2]
    assert store.copied_name("/x/y.pdf") == store.copied_name("/x/y.pdf") != store.copied_name("/z/y.pdf")
    store.export_principles(spark.createDataFrame([("p", 0.5)], "principle string, importance double"), str(tmp_path / "ps"))
    (tmp_path / "ps" / "more.json").write_text('{"principle": "q"}\n')
    assert {tuple(r) for r in store.import_principles(spark, str(tmp_path / "ps")).collect()} == {("p", 0.5), ("q", 0.8)}


def test_providers(spark):
    items = spark.createDataFrame([("a b",), ("bad",)], "item string")

    def split(x):
        if x == "bad":
            raise RuntimeError("no")
        return x.split()

    got = providers.flat_map(items, split, attempts=2, fallback=lambda x: ["?"]).collect()
    assert [(r["output"], r["error"]) for r in got] == [("a", None), ("b", None), ("?", "no")]
    calls = []
    with pytest.raises(RuntimeError):
        providers.call_with_retries(lambda x: calls.append(x) or split("bad"), 1, attempts=3)
    assert len(calls) == 3
    said = spark.range(4).select(providers.cycling_responses(F.col("id"), ["x", "y", "z"])).collect()
    assert [r[0] for r in said] == ["x", "y", "z", "x"]


def test_streamed_counts(spark, tmp_path):
    spark.createDataFrame([(1, "planet planet orbits"), (2, "planet")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    ingest.keep_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r["token"]: (r["n_documents"], r["n_occurrences"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"planet": (2, 3), "orbits": (1, 1)}


def test_encoder_column(spark):
    v = spark.createDataFrame([("a",), (None,)], "t string").select(hashed_embedding("t")).collect()
    assert len(v[0][0]) == 256 and not any(v[1][0])


def test_token_estimates_and_prompts(spark, tmp_path):
    import base64

    from folioscope.functions import text as T
    from folioscope.operators import prompts
    from folioscope.sources import store

    file = tmp_path / "ranks"
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"abc", b" a"]
    file.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    df = spark.createDataFrame([("abcab abc x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.estimate_tokens(str(file))("t")).collect()] == [6, 0, 0]  # abc ab, blank abc, blank x
    with pytest.raises(ValueError):
        prompts.fill_prompt("{a} {b}", {"a": F.lit(1)})
    paths = store.export_refined(spark.createDataFrame([("p", "q")], "prompt string, refined string"), spark.createDataFrame([("x", 0.5)], "principle string, importance double"), str(tmp_path), "run")
    assert [spark.read.json(p).count() for p in paths] == [1, 1] and paths[0].endswith("run_refined_prompts")
    said = []
    store.timed(lambda df, name: df, said.append)(df, "chunks")
    assert said[0].startswith("chunks: ")


def test_terms_that_differ_in_case(spark):
    from folioscope.operators import search

    results = spark.createDataFrame([(1, "An APPLE a day"), (2, "pear")], "result_id long, text string")
    keys = spark.createDataFrame([("Apple",), ("apple",), ("ear",), ("",), ("plum",)], "term_key string")
    for at_once in (1, 2, 1000):
        assert sorted(tuple(r) for r in search.primary_terms(results, keys, at_once).collect()) == [(1, "Apple"), (1, "apple"), (2, "ear")]


def test_nearest_positions(spark):
    from folioscope.functions import text as T

    cases = [([1, 50, 300], [260, 20]), ([5], [5]), ([], [3]), ([0, 9], [400])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<int>, b array<int>")
    got = [r[0] for r in df.orderBy("i").select(T.proximity_weight(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(max(math.exp(-min(abs(x - y) for x in a for y in b) / 100), 0.1)) if a and b else 0 for a, b in cases]
