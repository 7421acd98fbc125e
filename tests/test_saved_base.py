"""Saved knowledge bases: versions that are published whole or not at all, saves that go on, and what may be removed."""

import pytest
from pyspark.sql import functions as F

from folioscope.sources.store import KnowledgeBase


def base(spark, mark, broken=False):
    rows = spark.range(3).select(F.col("id").alias("chunk_id"), F.lit(mark).alias("text"))
    terms = spark.range(2).select(F.col("id").alias("term_key"), F.lit(mark).alias("term"))
    if broken:
        terms = terms.withColumn("term", F.raise_error(F.lit("lost")).cast("string"))
    return KnowledgeBase(chunks=rows, terms=terms)


def marks(spark, path):
    found = KnowledgeBase.load(spark, path)
    return {found.chunks.first()["text"], found.terms.first()["term"]}


def test_a_failed_save_leaves_the_old_base(spark, tmp_path):
    path = str(tmp_path / "kb")
    base(spark, "old").save(path)
    with pytest.raises(Exception, match="lost"):
        base(spark, "new", broken=True).save(path)  # chunks are written, terms fail
    assert marks(spark, path) == {"old"}
    base(spark, "new").save(path)
    assert marks(spark, path) == {"new"}


def test_an_unfinished_save_goes_on(spark, tmp_path):
    path = str(tmp_path / "kb")
    with pytest.raises(Exception, match="lost"):
        base(spark, "first", broken=True).save(path, "v1")
    with pytest.raises(ValueError):
        KnowledgeBase.load(spark, path)  # nothing is published yet
    base(spark, "second").save(path, "v1")
    assert marks(spark, path) == {"first", "second"}  # the chunks of the first try stay
    with pytest.raises(ValueError):
        base(spark, "third").save(path, "v1")


def test_pruning(spark, tmp_path):
    path = str(tmp_path / "kb")
    for v in "abc":
        base(spark, v).save(path, v)
    with pytest.raises(Exception, match="lost"):
        base(spark, "d", broken=True).save(path, "d")
    assert KnowledgeBase.prune(spark, path, keep=2) == ["a", "d"]
    assert marks(spark, path) == {"c"} and KnowledgeBase.prune(spark, path, keep=2) == []


def test_absent_relations_and_paths(spark, tmp_path):
    path = str(tmp_path / "kb")
    base(spark, "x").save(path)
    assert KnowledgeBase.load(spark, path).links is None
    for wrong, error in (("", ValueError), (str(tmp_path / "missing"), FileNotFoundError), (str(tmp_path), ValueError)):
        with pytest.raises(error):
            KnowledgeBase.load(spark, wrong)
    for f in (lambda: base(spark, "x").save(""), lambda: KnowledgeBase().save(path)):
        with pytest.raises(ValueError):
            f()
