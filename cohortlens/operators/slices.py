"""Metrics on slices of the metadata, error tables by group, and how concentrated errors are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.operators.calibration import with_correct
from cohortlens.operators.metrics import accuracy, class_counts, macro_f1


def flagged(df: DataFrame, members: DataFrame, key: str, name: str = "in_duplicate_cluster") -> DataFrame:
    """df with whether its key is among the members."""
    known = members.select(F.col(key).alias("__k")).where("__k is not null").distinct().withColumn("__in", F.lit(True))
    return df.join(known, df[key] == F.col("__k"), "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("__k", "__in")


def slice_metrics(df: DataFrame, classes: tuple[str, ...], columns: tuple[str, ...] = ("cohort", "raw_label", "in_duplicate_cluster")) -> DataFrame:
    """One row for all, then one for each value of each column; a null value is 'None', a column of nulls is left out.

    All slices come from one pass over the rows."""
    text = {c: F.initcap(F.col(c).cast("string")) if dict(df.dtypes)[c] == "boolean" else F.col(c).cast("string") for c in columns}
    parts = [F.struct(F.lit("all").alias("slice_type"), F.lit("all").alias("slice_value"), F.lit(1).alias("known"))]
    parts += [F.struct(F.lit(c).alias("slice_type"), F.coalesce(text[c], F.lit("None")).alias("slice_value"), text[c].isNotNull().cast("int").alias("known")) for c in columns]
    rows = with_correct(df).select("target", "prediction", "confidence", "group_key", F.explode(F.array(*parts)).alias("s")).select("*", "s.*")
    by = ("slice_type", "slice_value")
    sums = class_counts(rows, len(classes), by)
    more = rows.groupBy(*by).agg(F.count_distinct("group_key").alias("groups"), F.avg("confidence").alias("mean_confidence"), F.max("known").alias("known"))
    known = more.groupBy("slice_type").agg(F.max("known").alias("any_known")).where("any_known = 1").select("slice_type")
    out = sums.join(more, list(by)).join(known, "slice_type")
    shares = [c for k, name in enumerate(classes) for c in (F.col(f"s_{k}").alias(f"true_{name}"), (F.col(f"p_{k}") / F.col("n")).alias(f"predicted_{name}"))]
    return out.select(*by, F.col("n").alias("images"), "groups", accuracy(len(classes)).alias("accuracy"), macro_f1(len(classes)).alias("macro_f1"), "mean_confidence", *shares)


def group_table(df: DataFrame, classes: tuple[str, ...], order: str = "seq") -> DataFrame:
    """One row per group: its eyes, the cohort of its first row, targets as name:count, images, errors and shares."""
    rows = with_correct(df)
    counts = [F.count_if(F.col("target") == k).alias(f"s_{k}") for k in range(len(classes))]
    shares = [F.avg((F.col("prediction") == k).cast("double")).alias(f"predicted_{name}") for k, name in enumerate(classes)]
    wrong = 1 - F.col("correct")
    eyes = F.array_join(F.sort_array(F.collect_set(F.coalesce(F.col("eye_id").cast("string"), F.lit("None")))), ";")
    out = rows.groupBy("group_key").agg(eyes.alias("eye_ids"), F.min_by("cohort", order).alias("cohort"), F.count("*").alias("images"), F.sum(wrong).alias("errors"), F.avg(wrong.cast("double")).alias("error_rate"), F.avg("confidence").alias("mean_confidence"), *counts, *shares)
    names = sorted(range(len(classes)), key=lambda k: classes[k])
    told = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"s_{k}") > 0, F.concat(F.lit(f"{classes[k]}:"), F.col(f"s_{k}").cast("string"))) for k in names))), ";")
    return out.select("group_key", "eye_ids", "cohort", told.alias("targets"), "images", "errors", "error_rate", "mean_confidence", *(f"predicted_{c}" for c in classes))


def error_concentration(groups: DataFrame, shares: tuple[float, ...] = (0.05, 0.10, 0.25)) -> DataFrame:
    """Groups, groups with errors, errors, and what share of them the worst groups hold (null without errors).

    Groups are counted by their number of errors first, so only that small table is ranked."""
    sizes = groups.groupBy("errors").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("errors")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    total = sizes.agg(F.sum("n").alias("groups"), F.coalesce(F.sum(F.when(F.col("errors") > 0, F.col("n"))), F.lit(0)).alias("groups_with_errors"), F.sum(F.col("errors") * F.col("n")).alias("total_errors"))
    joined = ranked.crossJoin(F.broadcast(total))  # one row
    out = []
    for share in shares:
        top = F.greatest(F.lit(1), F.ceil(F.col("groups") * F.lit(share)))
        taken = F.greatest(F.lit(0), F.least(F.col("n"), top - F.col("before")))
        out.append(F.sum(taken * F.col("errors")).alias(f"top_{round(100 * share)}"))
    sums = joined.groupBy("groups", "groups_with_errors", "total_errors").agg(*out)
    part = [F.when(F.col("total_errors") > 0, F.col(f"top_{round(100 * s)}") / F.col("total_errors")).alias(f"error_share_top_{round(100 * s)}pct_groups") for s in shares]
    return sums.select("groups", "groups_with_errors", "total_errors", *part)
