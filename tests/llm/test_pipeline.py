"""The corpus pipeline against its stages' plain versions, and its contract."""

from collections import Counter

import numpy as np

import corpus_pipeline
from folioscope.llm import quality_rules
from folioscope.llm.common import read_table, scratch_table
from folioscope.llm.queries import vocabulary_file
from tests.llm import brute


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = read_table(spark, sf_dir, "documents")
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(docs, keep=["doc_id"]).collect()}
    rows = [r for r in sorted(docs.collect(), key=lambda r: r["doc_id"]) if verdicts[r["doc_id"]]]
    cleaned = brute.dedup_lines([(r["doc_id"], r["text"]) for r in rows])
    texts = [cleaned[r["doc_id"]][0] for r in rows]
    roots = brute.similar_groups(texts)
    kept = [(r["doc_id"], t, r["source"]) for i, (r, t, g) in enumerate(zip(rows, texts, roots)) if g == i]
    mixed = Counter(i for i, _ in brute.mixture(kept))

    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = scratch_table(stage(spark, now, sf_dir), name)
        seen[name] = now
        assert now.columns == docs.columns
    assert {r["doc_id"] for r in seen["quality"].collect()} == {r["doc_id"] for r in rows}
    assert {r["doc_id"]: r["text"] for r in seen["lines"].collect()} == {r["doc_id"]: t for r, t in zip(rows, texts)}
    assert sorted(r["doc_id"] for r in seen["near_duplicates"].collect()) == [k[0] for k in kept]
    assert Counter(r["doc_id"] for r in seen["mixture"].collect()) == mixed

    plain, ids = Tokenizer.from_file(vocabulary_file("word_bpe_49k.json")), {i: t for i, t, _ in kept}
    want = Counter()
    for i, n in mixed.items():
        want[tuple([*plain.encode(ids[i], add_special_tokens=False).ids, 1])] += n
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    stream = np.concatenate([np.frombuffer(p["piece_ids"], "<u4") for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))])
    docs_of, got = [], Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        if p["start"] == 0:
            docs_of.append([])
        docs_of[-1] += np.frombuffer(p["piece_ids"], "<u4").tolist()
    for d in docs_of:
        got[tuple(d)] += 1
    assert got == want and len(stream) == sum(len(k) * n for k, n in want.items())


def test_contract(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "packed"]
    empty = read_table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_near_duplicates_by_likeness(spark, sf_dir):
    words = [f"w{i}" for i in range(300)]
    made = [(10_000 + k, " ".join(["new", *words[2 * k : 2 * k + 200], "end"])) for k in range(40)]  # chains of near copies
    made += [(20_000 + k, " ".join([*words[:60], *(f"x{k}_{i}" for i in range(40))])) for k in range(30)]  # a common passage
    made += [(30_000, None), (30_001, ""), (30_002, "one two"), (30_003, "One two")]
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(i, t, "en", "made", 0) for i, t in made], docs.schema)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect()) + made
    got = corpus_pipeline.near_duplicates(spark, docs.unionByName(more), sf_dir)
    assert sorted(r["doc_id"] for r in got.collect()) == [r[0] for i, (r, g) in enumerate(zip(rows, brute.similar_groups([t for _, t in rows]))) if i == g]
    assert not {145, 177} & {r["doc_id"] for r in got.collect()}  # 11 and 17 bits from 6 and 1, likeness 0.83
