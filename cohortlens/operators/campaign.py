"""Several runs on the same set: mode, per-run metrics, spread, and the campaign table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap, calibration, metrics

POINT = ("accuracy", "balanced_accuracy", "macro_f1", "macro_auroc", "ece")


def mode(df: DataFrame, by: tuple[str, ...] = ("set",)) -> DataFrame:
    """(by, mode): shared if every path is in all runs, pooled if each is in one run, else overlapping; one run is shared."""
    runs = df.groupBy(*by).agg(F.count_distinct("run").alias("runs"))
    paths = df.groupBy(*by, "path").agg(F.count_distinct("run").alias("in_runs"))
    span = paths.groupBy(*by).agg(F.min("in_runs").alias("low"), F.max("in_runs").alias("high"))
    kind = F.when(F.col("low") == F.col("runs"), "shared").when(F.col("high") == 1, "pooled").otherwise("overlapping")
    return runs.join(span, list(by)).select(*by, "runs", kind.alias("mode"))


def per_run(df: DataFrame, classes: int, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Rows, the four point metrics and the calibration error of each run."""
    rows = calibration.with_correct(df)
    points = metrics.point_metrics(rows, classes, by)
    ece = calibration.calibration_error(calibration.reliability(rows, by=by), by).drop("mce")
    return points.join(metrics.macro_auroc(df, by), list(by)).join(ece, list(by))


def by_eye(df: DataFrame, classes: int) -> DataFrame:
    """A row for each run and eye, with its mean vector; the eye is its path. An eye belongs to one group."""
    return metrics.grouped(df, "eye_id", classes, ("run", "group_key")).withColumn("path", F.col("eye_id"))


def spread(runs: DataFrame, by: tuple[str, ...] = (), names: tuple[str, ...] = POINT) -> DataFrame:
    """(by, metric, mean, sd) over the runs where a metric is defined; sample SD, null for fewer than two."""
    long = metrics.long_metrics(runs, list(names), by)
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def campaign_table(name: str, set_name: str, df: DataFrame, weights: DataFrame, classes: tuple[str, ...], level: str = "image", auroc_replicates: int = 500) -> DataFrame:
    """One row per metric of a set. Runs on the same rows are averaged over shared draws; runs on disjoint rows are pooled
    into one; overlapping runs give no rows."""
    kind = mode(df.withColumn("set", F.lit(set_name))).first()
    empty = "campaign string, set string, level string, mode string, runs int, rows bigint, units bigint, metric string, point double, ci_low double, ci_high double, run_sd double"
    if kind is None or kind.mode == "overlapping":
        return df.sparkSession.createDataFrame([], empty)
    rows = df if kind.mode == "shared" else df.withColumn("run", F.lit("pooled"))
    size = rows.groupBy("run").agg(F.count("*").alias("rows"), F.count_distinct("group_key").alias("units")).agg(F.max("rows").alias("rows"), F.max("units").alias("units"))
    table = bootstrap.bootstrap(rows, weights, classes, auroc_replicates).join(spread(per_run(df, len(classes))).select("metric", F.col("sd").alias("run_sd")), "metric", "left")
    head = [F.lit(v).alias(n) for n, v in (("campaign", name), ("set", set_name), ("level", level), ("mode", kind.mode))]
    return table.crossJoin(F.broadcast(size)).select(*head, F.lit(int(kind.runs)).alias("runs"), "rows", "units", "metric", "point", "ci_low", "ci_high", "run_sd")  # one row
