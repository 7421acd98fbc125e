"""A knowledge base as a folder of Parquet tables: saving, loading, stages, principles."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RELATIONS = ("documents", "pages", "chunks", "terms", "cooccurrences", "links", "vectors")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    """The manifests under a path, in the order of their publication."""
    fs, folder = _file_system(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))
    return [json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifests/{n}").collect())) for n in names]


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write a manifest aside and give it the next number: it is there whole, or not at all."""
    fs, folder = _file_system(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    aside = f"{path}/manifests/{uuid.uuid4().hex}.unpublished"
    out = fs.create(_file_system(spark, aside)[1])
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    number = 1 + max((int(n.split(".")[0]) for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json")), default=0)
    if not fs.rename(_file_system(spark, aside)[1], _file_system(spark, f"{path}/manifests/{number:08d}.json")[1]):
        raise RuntimeError(f"another save was published as number {number} in {path}")


@dataclass
class KnowledgeBase:
    """The relations of a linked knowledge base; absent ones are None."""

    documents: DataFrame | None = None
    pages: DataFrame | None = None
    chunks: DataFrame | None = None
    terms: DataFrame | None = None
    cooccurrences: DataFrame | None = None
    links: DataFrame | None = None
    vectors: DataFrame | None = None

    def save(self, path: str, version: str | None = None) -> None:
        """Each relation as Parquet in a version's folder under the path, published by a manifest that is written last.

        Until then, and if a table fails, load() gives what was published before. A save with the name of an unfinished version goes on
        with it: tables that it has completed aren't written again. Earlier versions stay; prune() removes them.
        """
        if not path:
            raise ValueError("a path is needed")
        present = [name for name in RELATIONS if getattr(self, name) is not None]
        if not present:
            raise ValueError("there is no relation to save")
        spark = getattr(self, present[0]).sparkSession
        version = version or uuid.uuid4().hex
        if any(m["version"] == version for m in _manifests(spark, path)):
            raise ValueError(f"version {version} is published already")
        for name in present:
            if not _exists(spark, f"{path}/versions/{version}/{name}/_SUCCESS"):
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/versions/{version}/{name}")
        _publish(spark, path, {"version": version, "relations": present})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KnowledgeBase:
        """What was published last. ValueError without a path, or if no base is there; FileNotFoundError if there is nothing."""
        if not path:
            raise ValueError("a path is needed")
        if not _exists(spark, path):
            raise FileNotFoundError(path)
        published = _manifests(spark, path)
        if not published:
            raise ValueError(f"no knowledge base in {path}")
        last = published[-1]
        return cls(**{name: spark.read.parquet(f"{path}/versions/{last['version']}/{name}") for name in last["relations"]})

    @staticmethod
    def prune(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
        """Remove all versions but the last keep published ones, unfinished ones too; nobody may be writing or reading those. Their names."""
        kept = {m["version"] for m in _manifests(spark, path)[-max(1, keep) :]}
        fs, folder = _file_system(spark, f"{path}/versions")
        gone = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in kept] if fs.exists(folder) else []
        for name in gone:
            fs.delete(_file_system(spark, f"{path}/versions/{name}")[1], True)
        return sorted(gone)

    def with_vectors(self, encode) -> KnowledgeBase:
        """With vectors(chunk_id, vector) made from the chunks' texts, where there are none."""
        if self.vectors is None and self.chunks is not None:
            self.vectors = self.chunks.select("chunk_id", encode(F.col("text")).alias("vector"))
        return self


def save_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """A pipeline's stage as JSON lines, read back with its schema: later stages start from the files."""
    path = f"{folder}/{stage}"
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def export_principles(principles: DataFrame, path: str) -> None:
    principles.select("principle", "importance").write.mode("overwrite").json(path)


def import_principles(spark: SparkSession, path: str, importance: float = 0.8) -> DataFrame:
    """(principle, importance) of a JSON file, each text once; a missing importance is the given one."""
    raw = spark.read.schema("principle string, importance double").json(path)
    known = raw.where(F.col("principle").isNotNull()).withColumn("importance", F.coalesce("importance", F.lit(importance)))
    return known.groupBy("principle").agg(F.max("importance").alias("importance"))


def copied_name(path: str) -> str:
    """A stable name for a source document's copy: its stem, a hash of its path, its extension."""
    import zlib

    name = path.rsplit("/", 1)[-1]
    stem, dot, ending = name.rpartition(".")
    return f"{stem if dot else name}_{zlib.crc32(path.encode()):08x}{dot + ending if dot else ''}"


def export_refined(prompts: DataFrame, principles: DataFrame, folder: str, stem: str) -> tuple[str, str]:
    """Refined prompts and their principles as JSON, in folders named after the stem."""
    paths = f"{folder}/{stem}_refined_prompts", f"{folder}/{stem}_principles"
    for df, path in zip((prompts, principles), paths):
        df.write.mode("overwrite").json(path)
    return paths


def timed(save: Callable[[DataFrame, str], DataFrame], log: Callable[[str], None] = logging.getLogger(__name__).info) -> Callable[[DataFrame, str], DataFrame]:
    """A build's save function that also logs how long each relation took."""

    def run(df: DataFrame, name: str) -> DataFrame:
        began = time.perf_counter()
        out = save(df, name)
        log(f"{name}: {time.perf_counter() - began:.3f} s")
        return out

    return run


def metered(save: Callable[[DataFrame, str], DataFrame], metrics: list[dict]) -> Callable[[DataFrame, str], DataFrame]:
    """A build's save function that also counts each relation while it is written, once per relation and without another pass.

    Appends {stage, rows, bytes, seconds} to metrics: bytes are those of the text columns. save must write the relation (as written() does), as
    the counts come with the write.
    """

    def run(df: DataFrame, name: str) -> DataFrame:
        texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"]
        size = sum(texts[1:], texts[0]) if texts else F.lit(0)
        seen, began = Observation(), time.perf_counter()
        out = save(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")), name)
        metrics.append({"stage": name, **seen.get, "seconds": time.perf_counter() - began})
        return out

    return run
