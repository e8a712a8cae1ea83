"""File listings as DataFrames, by any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def qualified(spark: SparkSession, path: str) -> str:
    system, p = _hadoop(spark, path)
    return system.makeQualified(p).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _hadoop(spark, path)
    return system.exists(p)


def globbed(spark: SparkSession, pattern: str) -> list[str]:
    system, p = _hadoop(spark, pattern)
    return sorted(s.getPath().toString() for s in (system.globStatus(p) or []))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if there is none."""
    if not exists(spark, path):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def image_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, size): files below root with one of the suffixes, by their place below it. Only names are read."""
    base = qualified(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    found = files.select(F.substring("path", len(base) + 2, 1 << 30).alias("path"), F.col("length").alias("size"))
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
