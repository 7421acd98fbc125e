"""Helpers shared by the corpus operators: scratch tables, row keys, batches of texts."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents and bytes of text handed to Python code at once, so a worker holds a few MB of text at a time (or one text).
DOCS_AT_ONCE = 512
BYTES_AT_ONCE = 4 << 20

_own_folder: list[str] = []


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a temporary one of this process in local mode, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="folioscope-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


#: Rows and bytes in a batch that a scratch table's Python code gets: with long texts, the usual 10,000 are many megabytes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    usual = {k: spark.conf.get(k) for k in BATCHES}
    for k, most in BATCHES.items():
        spark.conf.set(k, most)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does when the driver's garbage is collected: between the steps of long loops."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_key(text: str = "text") -> Column:
    """64 bits that tell apart rows which share a doc_id."""
    return F.xxhash64(F.lit(7), F.col(text))


def remainder(column: str, by: int) -> Column:
    """crc32 of the id as text, mod by; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % by, F.lit(-1))


def unused_name(df: DataFrame, wish: str) -> str:
    """A column name based on wish that df has not (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def slices(batch: pa.RecordBatch, column: int = 0, at_once: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, with a few MB of the column's texts in each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        full = np.searchsorted(ends, (ends[start - 1] if start else 0) + BYTES_AT_ONCE, side="right")
        size = max(1, min(int(full) - start, at_once or batch.num_rows))
        yield batch.slice(start, size)
        start += size


def text_slices(batch: pa.RecordBatch, column: int = 0, at_once: int = DOCS_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with their texts as Python strings (None: null)."""
    for part in slices(batch, column, at_once):
        yield part, part.column(column).to_pylist()
