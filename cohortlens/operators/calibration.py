"""Calibration of predicted probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.metrics import by_class, with_prediction


def bin_index(value: Column, bins: int) -> Column:
    """Bins are closed on the left; one is in the last."""
    return F.least(F.greatest(F.floor(value * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, bins: int = 15, score: str = "confidence", correct: str = "correct", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bin, bin_low, bin_high, count, mean_confidence, accuracy) of every bin, empty ones with null means."""
    sums = df.groupBy(*by, bin_index(F.col(score), bins).alias("bin")).agg(F.count("*").alias("count"), F.avg(score).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    packed = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("count", "mean_confidence", "accuracy")))).alias("m"))  # bins rows
    grid = packed.select(*by, "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    found = grid.withColumn("r", F.try_element_at("m", F.col("bin")))
    return found.select(*by, "bin", (F.col("bin") / bins).alias("bin_low"), ((F.col("bin") + 1) / bins).alias("bin_high"), F.coalesce("r.count", F.lit(0)).alias("count"), "r.mean_confidence", "r.accuracy")


def calibration_error(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected and maximum calibration error of a reliability table."""
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return table.groupBy(*by).agg((F.sum(gap * F.col("count")) / F.sum("count")).alias("ece"), F.max(gap).alias("mce"))


def with_correct(df: DataFrame) -> DataFrame:
    return with_prediction(df).withColumn("correct", (F.col("target") == F.col("prediction")).cast("int"))


def classwise_error(df: DataFrame, bins: int = 15, by: tuple[str, ...] = ()) -> DataFrame:
    """Calibration error of each class's probability against being the target."""
    keys = (*by, "class")
    return calibration_error(reliability(by_class(df, by), bins, "score", "positive", keys), keys)


def brier(probs: str = "probs", target: str = "target") -> Column:
    """Sum over the classes of the squared differences."""
    return F.aggregate(F.transform(F.col(probs), lambda p, i: F.pow(p - (i == F.col(target)).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)


def log_loss(probs: str = "probs", target: str = "target") -> Column:
    p = F.element_at(F.col(probs), F.col(target).cast("int") + 1)
    return -F.ln(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0)))


def summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Brier score, log loss, and mean confidence overall, when right and when wrong (null if never)."""
    c, right = F.col("confidence"), F.col("correct") == 1
    return with_correct(df).groupBy(*by).agg(F.avg(brier()).alias("brier"), F.avg(log_loss()).alias("nll"), F.avg(c).alias("mean_confidence"), F.avg(F.when(right, c)).alias("mean_confidence_correct"), F.avg(F.when(~right, c)).alias("mean_confidence_wrong"))


def confidence_histogram(df: DataFrame, bins: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bin, correct, wrong) counts over equal bins of 0 to 1, the last closed on both sides; values outside are left out."""
    rows = with_correct(df).where(F.col("confidence").between(0, 1))
    sums = rows.groupBy(*by, bin_index(F.col("confidence"), bins).alias("bin")).agg(F.count_if(F.col("correct") == 1).alias("correct"), F.count_if(F.col("correct") == 0).alias("wrong"))
    packed = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("correct", "wrong")))).alias("m"))  # bins rows
    grid = packed.select(*by, "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("r", F.try_element_at("m", F.col("bin")))
    return grid.select(*by, "bin", F.coalesce("r.correct", F.lit(0)).alias("correct"), F.coalesce("r.wrong", F.lit(0)).alias("wrong"))
