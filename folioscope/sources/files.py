"""Documents as files: resolving paths, dispatch by extension, content ids, text and HTML readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files that patterns name, in their order, repeats kept: a file itself, a directory's files, or the matches of
    a pattern in the last part. Hadoop's file systems are asked, so any path that Spark reads will do."""
    hadoop, conf, out = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), []
    for pattern in patterns:
        path = hadoop.Path(pattern)
        fs = path.getFileSystem(conf)
        if re.search(r"[*?\[]", pattern.rsplit("/", 1)[-1]):
            found = fs.globStatus(path) or []
        elif fs.exists(path):
            found = fs.listStatus(path)
        else:
            found = []
        out += sorted(s.getPath().toString() for s in found if s.isFile())
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, filename, extension, document_id, content): document_id is the SHA-256 of the content."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", file_name(F.col("path")).alias("filename"), extension(F.col("path")).alias("extension"), F.sha2("content", 256).alias("document_id"), "content")


def by_extension(paths: DataFrame) -> DataFrame:
    """paths(path) grouped by extension."""
    return paths.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n_files"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block ends become line ends, tags go, entities are read."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</(?:p|div|li|h[1-6]|tr|title|section|article)>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


#: Extension -> a function from content (binary) to text. PDF needs a library that isn't part of this package: add
#: a reader under ".pdf" to read them.
READERS = {
    ".txt": lambda content: content.cast("string"),
    ".md": lambda content: content.cast("string"),
    ".html": lambda content: html_text(content.cast("string")),
}


def read_documents(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """scan()'s rows with the text that their extension's reader gives; those without a reader are left out."""
    readers = READERS if readers is None else readers
    text = F.lit(None).cast("string")
    for ending, reader in readers.items():
        text = F.when(F.col("extension") == ending, reader(F.col("content"))).otherwise(text)
    return files.where(F.col("extension").isin(*readers)).select("document_id", "filename", "extension", text.alias("text"))


def distinct_documents(files: DataFrame) -> DataFrame:
    """One row per content: that of the last path."""
    return files.groupBy("document_id").agg(F.max("path").alias("path"), F.count("*").alias("n_copies"))
