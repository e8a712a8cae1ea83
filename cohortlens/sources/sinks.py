"""Writing manifests, predictions, tables and documents."""

from __future__ import annotations

import hashlib
import json
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.schema import serialised
from cohortlens.sources.listing import _hadoop, exists

VERSION = 1


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A JSON object with sorted keys per record."""
    serialised(manifest).write.text(path)


def write_predictions(rows: DataFrame, classes: tuple[str, ...], path: str) -> None:
    """path, source if there is one, target, prediction and a probability per class, with a header."""
    names = F.array(*map(F.lit, classes))
    given = [F.col("path"), *([F.col("source")] if "source" in rows.columns else [])]
    named = [F.element_at(names, F.col(c) + 1).alias(c) for c in ("target", "prediction")]
    rows.select(*given, *named, *(F.element_at("probs", k + 1).alias(f"probability_{c}") for k, c in enumerate(classes))).write.csv(path, header=True)


def write_rows(tables: list[DataFrame], path: str) -> None:
    """Tables with different columns as one CSV; columns in the order in which they first occur."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).write.csv(path, header=True)


def safe(value):
    """The value without NaN and infinities, which become null, at any depth."""
    if isinstance(value, dict):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [safe(v) for v in (sorted(value) if isinstance(value, set | frozenset) else value)]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value.asDict(recursive=True) if hasattr(value, "asDict") else value


def write_document(spark: SparkSession, value, path: str) -> None:
    """A small value as a JSON file with sorted keys; NaN is an error."""
    system, p = _hadoop(spark, path)
    text = json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n"
    stream = system.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def new_run_directory(spark: SparkSession, root: str, source: str, architecture: str, name: str) -> str:
    """root/source/architecture/name, which must not be there yet."""
    path = f"{root}/{source}/{architecture}/{name}"
    if exists(spark, path):
        raise FileExistsError(path)
    system, p = _hadoop(spark, path)
    system.mkdirs(p)
    return path


def content_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, read by Spark."""
    rows = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"), "path").orderBy("path").collect()
    return rows[0].h if len(rows) == 1 else hashlib.sha256("".join(r.h for r in rows).encode()).hexdigest()


def write_split_definition(spark: SparkSession, path: str, assignments: DataFrame, seed: int, settings: dict, manifests: dict[str, str], audits: dict[str, str]) -> None:
    """Version, seed, settings, sorted assignments (one row per group) and hashes of what they were made from."""
    rows = assignments.orderBy(*assignments.columns).collect()
    told = {"version": VERSION, "seed": seed, "settings": settings, "manifest_sha256": manifests, "audit_sha256": audits, "assignments": [r.asDict() for r in rows]}
    write_document(spark, told, path)


def reused_definition(spark: SparkSession, path: str, manifests: dict[str, str], audits: dict[str, str]) -> DataFrame | None:
    """Assignments of a definition, None if there is none; it must have been made from the same inputs."""
    if not exists(spark, path):
        return None
    told = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if told.get("manifest_sha256") != manifests or told.get("audit_sha256") != audits:
        raise ValueError(f"{path} was made from other inputs")
    return spark.createDataFrame([tuple(a[k] for k in sorted(a)) for a in told["assignments"]], sorted(told["assignments"][0]))
