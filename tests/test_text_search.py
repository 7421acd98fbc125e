"""Search of texts that have no vectors yet: encoded in blocks and scored in the same pass."""

import numpy as np
from pyspark.sql import functions as F

from folioscope.functions import vectors as V
from folioscope.operators import search

TEXTS = ["the end of that", None, "", "_ -", "The END, of that!", "ein Ende İΣ ß", *(f"word{i} of that w{i % 7}" for i in range(1500))]


def test_blocks_of_texts_give_each_text_its_vector():
    for _ in range(2):  # with new words, and with known ones
        found = V.hashed_vectors(TEXTS)
        assert found.shape == (len(TEXTS), V.DIMENSIONS) and all((v == V.hashed_vector(t).astype(np.float32)).all() for v, t in zip(found, TEXTS))
    assert V.hashed_vectors([]).shape == (0, V.DIMENSIONS)


def test_words_are_forgotten(monkeypatch):
    wanted = V.hashed_vectors(TEXTS)
    monkeypatch.setattr(V, "KNOWN", 10)
    assert all((V.hashed_vectors([t])[0] == v).all() for v, t in zip(wanted, TEXTS))


def test_texts_are_scored_without_vectors_as_rows(spark):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string").repartition(3)
    query = V.hashed_vector("the of that").tolist()
    for mode in ("cosine", "one_minus"):
        plain = search.top_k(chunks.withColumn("vector", V.hashed_embedding("text")), query, 40, 0.1, score_mode=mode).drop("vector")
        found = search.top_k_texts(chunks, query, 40, 0.1, score_mode=mode)
        assert found.columns == plain.columns and found.collect() == plain.collect() != []
        assert "array" not in found._jdf.queryExecution().executedPlan().treeString().lower()
    assert {r["score"] for r in search.top_k_texts(chunks.where("chunk_id in (1, 2, 3)"), query, 5).collect()} == {0.0}
    assert search.top_k_texts(chunks.where(F.lit(False)), query, 5).count() == 0
