"""Reading manifests, prediction sets and audit reports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortlens.schema import MANIFEST, deserialised, unit_key
from cohortlens.sources.listing import exists, globbed, read_text
from cohortlens.storage import ship

PREFIX = "probability_"


LINE = "value string, file string, block long, at long"


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at): each line with the file and the first byte of the split that it was read from, and its place
    in that split. A split is read by one task from its first line on, so places are the same in each reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            at = []
            for place in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at.append(seen.get(place, 0))
                seen[place] = at[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["value", "file", "block", "at"])

    ship(spark)
    return spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").mapInArrow(run, LINE)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line) of all lines, numbered from 1 in each file: the place in a split, after the lines of the splits
    before it."""
    placed = _placed(spark, path)
    sizes = placed.groupBy("file", "block").agg(F.count("*").alias("n"))
    since = sizes.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("since"))  # a row for each split
    return placed.join(since, ["file", "block"]).select("value", "file", (F.col("since") + F.col("at") + 1).alias("line"))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of lines that are neither blank nor a JSON object with the keys that a record must have."""
    return numbered_lines(spark, path).where(_malformed()).select("file", "line", "value")


def _malformed() -> Column:
    loose = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in MANIFEST.fields), T.StructField("_corrupt", T.StringType())])
    read = F.from_json("value", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    lacks = reduce(or_, (read[f.name].isNull() for f in MANIFEST.fields if not f.nullable and f.name != "label_unit"))
    return (F.trim("value") != "") & (read.isNull() | read["_corrupt"].isNotNull() | lacks)


def read_manifest(spark: SparkSession, path: str, checked: bool = False, numbered: bool = False) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped, and a malformed one is an error: of the task that meets it, or
    with ``checked`` one that names its file and line before anything else is read. ``numbered`` adds ``seq``, the place of
    a record in its file."""
    if checked and not spark.read.text(path).where(_malformed()).isEmpty():
        bad = malformed_lines(spark, path).orderBy("file", "line").first()
        raise ValueError(f"{bad.file}:{bad.line}: no manifest record")
    if numbered:
        lines = numbered_lines(spark, path).where(F.trim("value") != "")
        return deserialised(lines, keep=("line",)).withColumnRenamed("line", "seq")
    return deserialised(spark.read.text(path).where(F.trim("value") != ""))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Records of one split; none is an error."""
    rows = read_manifest(spark, path).where(F.col("split") == split)
    if rows.isEmpty():
        raise ValueError(f"{path} has no records of split {split!r}")
    return rows


@dataclass(frozen=True)
class PredictionSet:
    name: str
    source: str
    classes: tuple[str, ...]
    label_unit: str
    rows: DataFrame
    full_source: bool = False
    reference: dict | None = None


def read_predictions(spark: SparkSession, path: str, manifest: DataFrame, name: str, source: str, **more) -> PredictionSet:
    """Predictions of a CSV file joined to the manifest.

    Every column ``probability_<class>`` names a class, in the order of the header; fewer than two are an error, as are an
    empty file, paths that the manifest doesn't have, targets other than its labels, and mixed label units. Of records that
    share a path the last one counts, if the manifest tells by ``seq``, else the greatest one."""
    table = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    classes = tuple(c.removeprefix(PREFIX) for c in table.columns if c.startswith(PREFIX))
    if len(classes) < 2:
        raise ValueError(f"{path} has fewer than two probability columns")
    record = F.struct(*(F.col(f.name) for f in MANIFEST.fields if f.name != "path"))
    known = manifest.groupBy("path").agg((F.max_by(record, "seq") if "seq" in manifest.columns else F.max(record)).alias("m"))
    given = table.withColumn("seq", F.monotonically_increasing_id())
    joined = given.join(known, "path", "left")
    bad = F.when(F.col("m").isNull(), F.concat(F.lit("a path isn't in the manifest: "), "path")).when(F.col("target") != F.col("m.label"), F.concat(F.lit("a target isn't the manifest's label: "), "path"))
    checks = joined.agg(F.count("*").alias("n"), F.min(bad).alias("bad"), F.min("m.label_unit").alias("low"), F.max("m.label_unit").alias("high")).first()
    if not checks.n:
        raise ValueError(f"{path} has no rows")
    if checks.bad:
        raise ValueError(f"{path}: {checks.bad}")
    if checks.low != checks.high:
        raise ValueError(f"{path} mixes label units: {checks.low}, {checks.high}")
    index = F.array_position(F.array(*map(F.lit, classes)), F.col("target")) - 1
    rows = joined.select("seq", "path", "m.source", index.cast("int").alias("target"), F.array(*(F.col(f"{PREFIX}{c}").cast("double") for c in classes)).alias("probs"), "m.group_id", "m.eye_id", "m.cohort", "m.raw_label")
    return PredictionSet(name, source, classes, checks.low, rows.withColumn("group_key", unit_key()).drop("group_id"), **more)


def discover_predictions(spark: SparkSession, run_dir: str, manifests_dir: str) -> list[PredictionSet]:
    """All prediction files of a run: its test set, test sets by source, and evaluations. None is an error."""
    load = lambda p: json.loads(t) if (t := read_text(spark, p)) else None
    tested = load(f"{run_dir}/metrics-test.json")
    found: list[PredictionSet] = []

    def add(name: str, path: str, source: str, reference: dict | None, full: bool = False) -> None:
        manifest = read_manifest(spark, f"{manifests_dir}/{source}.jsonl", checked=True, numbered=True)
        found.append(read_predictions(spark, path, manifest, name, source, full_source=full, reference=reference))

    if exists(spark, f"{run_dir}/predictions-test.csv"):
        source = (load(f"{run_dir}/dataset.json") or {}).get("source")
        if not source:
            raise ValueError(f"{run_dir}/dataset.json names no source")
        add(f"test-{source}", f"{run_dir}/predictions-test.csv", source, tested)
    for path in globbed(spark, f"{run_dir}/predictions-test/*.csv"):
        source = path.rsplit("/", 1)[1].removesuffix(".csv")
        add(f"test-{source}", path, source, (tested or {}).get("by_source", {}).get(source))
    for path in globbed(spark, f"{run_dir}/evaluations/*/predictions.csv"):
        folder = path.rsplit("/", 1)[0]
        told = load(f"{folder}/metrics.json") or {}
        if not told.get("target_source"):
            raise ValueError(f"{folder}/metrics.json names no target source")
        add(f"eval-{folder.rsplit('/', 1)[1]}", path, told["target_source"], told, bool(told.get("full_source", False)))
    if not found:
        raise FileNotFoundError(f"no predictions below {run_dir}")
    return found


def duplicate_keys(spark: SparkSession, audits_dir: str, source: str) -> DataFrame:
    """(key): source:path of everything in a duplicate cluster of the source's audit; empty without an audit."""
    path = f"{audits_dir}/{source}.json"
    cluster = T.ArrayType(T.StructType([T.StructField("paths", T.ArrayType(T.StringType()))]))
    shape = T.StructType([T.StructField("exact_duplicates", cluster), T.StructField("near_duplicates", cluster)])
    if not exists(spark, path):
        return spark.createDataFrame([], "key string")
    report = spark.read.schema(shape).json(path, multiLine=True)
    both = F.concat(F.coalesce("exact_duplicates", F.array()), F.coalesce("near_duplicates", F.array()))
    return report.select(F.explode(both).alias("c")).select(F.explode("c.paths").alias("key")).distinct()


def audit_listing(spark: SparkSession, audits_dir: str) -> list[str]:
    return globbed(spark, f"{audits_dir}/*.json")
