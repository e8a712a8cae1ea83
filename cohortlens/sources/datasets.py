"""Dataset descriptions and the readers of source layouts, each giving manifest records."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.schema import MANIFEST, checked_labels, parse_labels
from cohortlens.sources.listing import exists, image_files, read_text


@dataclass(frozen=True)
class Dataset:
    name: str
    source: str
    root: str
    available_labels: tuple[str, ...]
    enabled: bool = True


Reader = Callable[[SparkSession, Dataset], DataFrame]
READERS: dict[str, Reader] = {}


def reader(name: str) -> Callable[[Reader], Reader]:
    def register(f: Reader) -> Reader:
        READERS[name] = f
        return f

    return register


def reader_of(name: str) -> Reader:
    if name not in READERS:
        raise ValueError(f"unknown source {name!r}; known are {', '.join(sorted(READERS))}")
    return READERS[name]


def read_datasets(spark: SparkSession, path: str) -> list[Dataset]:
    """The ``[[datasets]]`` entries of a TOML file; a malformed or empty one is an error."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    entries = tomllib.loads(text).get("datasets")
    if not isinstance(entries, list) or not entries:
        raise ValueError(f"{path} has no [[datasets]]")
    try:
        return [Dataset(str(e["name"]), str(e["source"]), str(e["root"]), tuple(parse_labels(e["available_labels"])), bool(e.get("enabled", True))) for e in entries]
    except (KeyError, TypeError) as error:
        raise ValueError(f"{path}: malformed dataset entry ({error})") from error


def records(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """Records of one dataset; a missing root is an error."""
    if not exists(spark, dataset.root):
        raise FileNotFoundError(dataset.root)
    return checked_labels(reader_of(dataset.source)(spark, dataset))


def all_records(spark: SparkSession, datasets: list[Dataset]) -> DataFrame:
    """Records of all enabled datasets."""
    parts = [records(spark, d) for d in datasets if d.enabled]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], MANIFEST))


def mapped(raw: Column, labels: dict[str, str]) -> Column:
    """The label of a raw label in upper case, null for unknown ones."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), raw)


def _manifest(rows: DataFrame, dataset: Dataset, **columns: Column) -> DataFrame:
    given = {"source": F.lit(dataset.name), "available_labels": F.array(*map(F.lit, dataset.available_labels)), "label_unit": F.lit("image")} | columns
    return rows.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MANIFEST.fields))


def _part(i: int) -> Column:
    return F.get(F.split("path", "/"), i)


# Raw labels of each layout.
DUKE = {"AMD": "amd", "DME": "dme", "NORMAL": "normal"}
KERMANY = {"CNV": "amd", "DME": "dme", "DRUSEN": "amd", "NORMAL": "normal"}
OCTDL = {"AMD": "amd", "DME": "dme", "NO": "normal"}
OCTID = {"AMRD": "amd", "NORMAL": "normal"}
PAIMA = {"CNV": "amd", "DRUSEN": "amd", "NORMAL": "normal"}


@reader("duke")
def duke(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """A folder per eye, named by label and number."""
    files = image_files(spark, dataset.root, ("bmp", "jpeg", "jpg", "png", "tif", "tiff")).where(F.size(F.split("path", "/")) > 1)
    rows = files.withColumns({"dir": _part(0), "prefix": F.regexp_replace(_part(0), r"[^\p{L}]", "")})
    rows = rows.withColumn("found", mapped(F.upper("prefix"), DUKE)).where("found is not null")
    return _manifest(rows, dataset, path=F.col("path"), raw_label=F.col("prefix"), label=F.col("found"), group_id=F.col("dir"), eye_id=F.col("dir"), label_unit=F.lit("eye"))


@reader("kermany")
def kermany(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """split/class/CLASS-group-scan files; another name, or another class than the folder's, is an error."""
    files = image_files(spark, dataset.root, ("jpeg", "jpg", "png")).where(F.size(F.split("path", "/")) > 2)
    rows = files.withColumns({"split_dir": _part(0), "raw": F.upper(_part(1)), "stem": F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)})
    rows = rows.withColumn("found", mapped(F.col("raw"), KERMANY)).where("found is not null")
    pattern = r"^([^-]+)-(.+)-(\d+)$"
    fits = F.upper(F.regexp_extract("stem", pattern, 1)) == F.col("raw")
    bad = F.raise_error(F.concat(F.lit("unexpected file name: "), "path")).cast("string")
    rows = rows.withColumn("group", F.when(fits, F.regexp_extract("stem", pattern, 2)).otherwise(bad))
    return _manifest(rows, dataset, path=F.col("path"), raw_label=F.col("raw"), label=F.col("found"), group_id=F.col("group"), supplied_split=F.col("split_dir"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', mode="FAILFAST")


@reader("octdl")
def octdl(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """labels.csv with files in a folder per label; a listed file that isn't there is an error."""
    table = _csv(spark, f"{dataset.root}/labels.csv").withColumn("raw", F.upper("disease"))
    table = table.withColumn("found", mapped(F.col("raw"), OCTDL)).where("found is not null").withColumn("path", F.concat("raw", F.lit("/"), "file_name", F.lit(".jpg")))
    files = image_files(spark, dataset.root, ("jpg",)).select("path", F.lit(True).alias("there"))
    missing = F.raise_error(F.concat(F.lit("metadata names a missing image: "), "path")).cast("string")
    rows = table.join(files, "path", "left").withColumn("path", F.when(F.col("there"), F.col("path")).otherwise(missing))
    return _manifest(rows, dataset, path=F.col("path"), raw_label=F.col("raw"), label=F.col("found"), group_id=F.nullif(F.col("patient_id"), F.lit("")))


@reader("octid")
def octid(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """A folder per class, without groups."""
    files = image_files(spark, dataset.root, ("jpeg", "jpg", "png")).where(F.size(F.split("path", "/")) > 1)
    rows = files.withColumn("found", mapped(_part(0), OCTID)).where("found is not null")
    return _manifest(rows, dataset, path=F.col("path"), raw_label=_part(0), label=F.col("found"))


@reader("paima")
def paima(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """data_information.csv; a file name may differ in case from the one on disk."""
    table = _csv(spark, f"{dataset.root}/data_information.csv").withColumn("raw", F.upper("Label"))
    table = table.withColumn("found", mapped(F.col("raw"), PAIMA)).where("found is not null").withColumn("asked", F.col("Directory"))
    files = image_files(spark, dataset.root, ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")).select(F.col("path").alias("on_disk"))
    folder, name = (lambda c: F.regexp_extract(c, r"^(.*/)?[^/]*$", 1)), (lambda c: F.lower(F.regexp_extract(c, r"([^/]*)$", 1)))
    loose = files.groupBy(folder("on_disk").alias("folder"), name("on_disk").alias("name")).agg(F.min("on_disk").alias("near"))
    rows = table.join(files, table.asked == files.on_disk, "left").withColumns({"folder": folder("asked"), "name": name("asked")}).join(loose, ["folder", "name"], "left")
    missing = F.raise_error(F.concat(F.lit("metadata names a missing image: "), "asked")).cast("string")
    patient, eye = F.nullif(F.col("Patient ID"), F.lit("")), F.nullif(F.col("Eye"), F.lit(""))
    group = F.concat("Class", F.lit("/"), patient)
    return _manifest(rows, dataset, path=F.coalesce("on_disk", "near", missing), raw_label=F.col("raw"), label=F.col("found"), group_id=group, eye_id=F.concat(group, F.lit("/"), eye), cohort=F.col("Class"))
