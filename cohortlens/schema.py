"""Record schemas and the label taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels in canonical order.
LABELS = ("normal", "amd", "dme")
IMAGE_SUFFIXES = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("raw_label", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("available_labels", T.ArrayType(T.StringType()), False),
        T.StructField("group_id", T.StringType()),
        T.StructField("label_unit", T.StringType()),
        T.StructField("eye_id", T.StringType()),
        T.StructField("cohort", T.StringType()),
        T.StructField("supplied_split", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)


def parse_labels(values: list[str]) -> list[str]:
    """Sorted distinct labels, in lower case; unknown ones and an empty list are errors."""
    found = sorted({str(v).lower() for v in values})
    if not found or not set(found) <= set(LABELS):
        raise ValueError(f"labels must be some of {LABELS}: {values}")
    return found


def canonical_labels(available: list[str]) -> tuple[str, ...]:
    """The available labels in canonical order; fewer than two are an error."""
    found = tuple(name for name in LABELS if name in set(available))
    if len(found) < 2:
        raise ValueError("classification needs at least two available labels")
    return found


def group_key(source: str = "source", group: str = "group_id") -> Column:
    """``source:group``, null without a group."""
    return F.concat(F.col(source), F.lit(":"), F.col(group))


def unit_key() -> Column:
    """The group, or else the record itself, as the unit of resampling."""
    return F.coalesce(group_key(), F.concat("source", F.lit(":path:"), "path"))


def label_violations(manifest: DataFrame) -> DataFrame:
    """Records whose label their source doesn't offer."""
    return manifest.where(~F.array_contains("available_labels", F.col("label")))


def checked_labels(manifest: DataFrame) -> DataFrame:
    """The manifest, failing on the first record whose label isn't available."""
    bad = ~F.array_contains("available_labels", F.col("label"))
    message = F.concat(F.lit("label isn't available: "), "source", F.lit(":"), "path")
    return manifest.withColumn("label", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("label")))


def serialised(manifest: DataFrame) -> DataFrame:
    """One column ``value``: each record as a JSON object with sorted keys, nulls kept."""
    columns = sorted(f.name for f in MANIFEST.fields)
    given = manifest.withColumn("available_labels", F.array_sort("available_labels"))
    return given.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def deserialised(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records from JSON objects; missing keys are null, a missing unit is ``image``. ``keep`` names further columns."""
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in MANIFEST.fields])
    return lines.select(F.from_json(column, loose, {"mode": "FAILFAST"}).alias("r"), *keep).select("r.*", *keep).withColumn("label_unit", F.coalesce("label_unit", F.lit("image")))
