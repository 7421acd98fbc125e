"""Tables in the shared folder that cut lineage: they survive lost executors, and what is chosen once stays so."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of this process in local mode, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="folioscope-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there."""
    path = f"{scratch_folder(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
