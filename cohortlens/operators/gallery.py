"""Capped selections of rows: error galleries, control samples, worst rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.arrays import true_probability
from cohortlens.functions.scalars import hashed
from cohortlens.operators.calibration import with_correct


def take_capped(df: DataFrame, cell: tuple[str, ...], group: str, order: list[Column], size: int, per_group: int) -> DataFrame:
    """The first ``size`` rows of each cell in the given order, at most ``per_group`` of a group; ``rank`` from 0.

    Both limits are row numbers that Spark applies before the shuffle as well."""
    inside = Window.partitionBy(*cell, group).orderBy(*order)
    capped = df.withColumn("__g", F.row_number().over(inside)).where(F.col("__g") <= per_group)
    ranked = capped.withColumn("__r", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    return ranked.where(F.col("__r") <= size).withColumn("rank", F.col("__r") - 1).drop("__g", "__r")


def _rows(taken: DataFrame, classes: tuple[str, ...], kind: str) -> DataFrame:
    names = F.array(*map(F.lit, classes))
    number = F.row_number().over(Window.orderBy("target", "prediction", "rank")) - 1  # cells x size rows
    return taken.withColumn("__n", number).select(
        F.format_string(f"{kind[0]}%04d", "__n").alias("row_id"), F.lit(kind).alias("kind"), "rank", "path", "source", "group_key", "cohort", "raw_label",
        F.element_at(names, F.col("target") + 1).alias("target"), F.element_at(names, F.col("prediction") + 1).alias("prediction"),
        "confidence", true_probability().alias("true_probability"), *(F.element_at("probs", k + 1).alias(f"probability_{c}") for k, c in enumerate(classes)),
    )


def error_gallery(df: DataFrame, classes: tuple[str, ...], size: int = 24, per_group: int = 3, order: str = "seq") -> DataFrame:
    """The most confidently wrong rows of each pair of target and another prediction."""
    wrong = with_correct(df).where("correct = 0")
    return _rows(take_capped(wrong, ("target", "prediction"), "group_key", [F.desc("confidence"), F.asc(order)], size, per_group), classes, "error")


def control_sample(df: DataFrame, classes: tuple[str, ...], size: int = 24, per_group: int = 3, seed: int = 20260927, order: str = "seq") -> DataFrame:
    """Right rows of each class in the order of a seeded hash of their path (in place of a random permutation)."""
    right = with_correct(df).where("correct = 1").withColumn("__h", hashed(F.concat(F.lit(f"{seed}:"), "path"), 12))
    return _rows(take_capped(right, ("target", "prediction"), "group_key", [F.asc("__h"), F.asc(order)], size, per_group), classes, "control")


def worst_of_each(df: DataFrame, by: tuple[str, ...], order: list[Column], n: int = 8) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
