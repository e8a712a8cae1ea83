"""Exploratory aggregates: shares, tails, quantiles by group, histograms and long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHITE, BLACK = 0.005, 0.005


def group_counts(df: DataFrame, by: tuple[str, ...], missing: str = "none") -> DataFrame:
    """Counts by keys; a null key is a category of its own."""
    return df.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in by)).agg(F.count("*").alias("n"))


def share_within(counts: DataFrame, within: tuple[str, ...], n: str = "n", name: str = "share") -> DataFrame:
    """Each row's share of its class. The counts are aggregated already, so the window holds a row for each key."""
    return counts.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(*within)))


def tail_bucketed(df: DataFrame, column: str, least: int, by: tuple[str, ...] = (), other: str = "other") -> DataFrame:
    """df with rare values of a column (fewer than ``least`` rows per key) replaced."""
    keys = [*by, column]
    kept = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*keys, F.lit(True).alias("__kept"))
    out = df.join(kept, keys, "left")
    return out.withColumn(column, F.when(F.col("__kept"), F.col(column).cast("string")).otherwise(F.lit(other))).drop("__kept").select(df.columns)


def outer_shares(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(key, share in left, share in right) over the keys of either, zero where a side has none."""
    sides = [share_within(group_counts(df, (key,)), ()).select(key, F.col("share").alias(name)) for df, name in zip((left, right), names, strict=True)]
    return sides[0].join(sides[1], key, "full_outer").na.fill(0.0, list(names))


def rate(df: DataFrame, condition: Column, by: tuple[str, ...], name: str = "share") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(condition.cast("double")).alias(name))


def quantiles(df: DataFrame, column: str, by: tuple[str, ...], points: dict[str, float], least: int = 1) -> DataFrame:
    """Exact quantiles by key, for keys with at least ``least`` rows."""
    counted = df.groupBy(*by, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    q = ", ".join(str(p) for p in points.values())
    out = counted.groupBy(*by).agg(F.sum("n").alias("n"), F.expr(f"percentile(v, array({q}), n)").alias("q"))
    return out.where(F.col("n") >= least).select(*by, "n", *(F.col("q")[i].alias(name) for i, name in enumerate(points)))


def fixed_histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: tuple[str, ...]) -> DataFrame:
    """(by, bin, bin_low, n, share) over equal bins; the last is closed, values outside are left out, shares are of those inside."""
    v = F.col(column)
    at = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(v.between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    return share_within(counts, by).withColumn("bin_low", low + F.col("bin") * (high - low) / bins)


def prevalence_long(df: DataFrame, flags: dict[str, Column], by: tuple[str, ...]) -> DataFrame:
    """(by, artifact, prevalence): the mean of each flag, one row each."""
    means = df.groupBy(*by).agg(*(F.avg(c.cast("double")).alias(name) for name, c in flags.items()))
    return means.unpivot(list(by), list(flags), "artifact", "prevalence")


def at_least(df: DataFrame, by: tuple[str, ...], n: int) -> DataFrame:
    """Rows of the keys that have at least n of them, with that count."""
    counts = df.groupBy(*by).agg(F.count("*").alias("group_rows")).where(F.col("group_rows") >= n)
    return df.join(counts, list(by))


def most_frequent(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(n)


def artifact_columns(features: DataFrame) -> DataFrame:
    """Image features with size text, fill flags, canvas fill and how much of the height content leaves below a ceiling."""
    tall = F.greatest(F.col("height") - F.col("white_top") - F.col("white_bottom"), F.lit(1))
    return features.withColumns(
        {
            "size": F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")),
            "has_white": F.col("white_frac") > WHITE,
            "has_black": F.col("black_frac") > BLACK,
            "canvas_fill": F.least("width", "height") / F.greatest("width", "height"),
            "content_ceiling": F.least(F.col("p99_content") / F.greatest(F.col("p99_all"), F.lit(1.0)), F.lit(1.0)),
            "content_height": tall,
        }
    )


def gallery_filter(features: DataFrame, kind: str) -> DataFrame:
    """Rows with much white fill, with fill that touches the top, or without any fill."""
    rules = {"white": F.col("white_frac") > 0.05, "top": F.col("white_touch_top") & (F.col("white_frac") > 0.03), "none": (F.col("white_frac") == 0) & (F.col("black_frac") == 0)}
    return features.where(rules[kind])


def attention_summary(records: DataFrame) -> DataFrame:
    """(kind, layer, role): rows, means and medians of two masses, over each kind and each kind:target->prediction; the mass
    outside the band only from plausible masks."""
    cell = F.concat("kind", F.lit(":"), "target", F.lit("->"), "prediction")
    rows = records.withColumn("group", F.explode(F.array(F.col("kind"), cell)))
    inside = F.col("fill_mass")
    outside = F.when(F.col("plausible"), F.col("outside_mass"))
    return rows.groupBy("group", "layer", "role").agg(F.count("*").alias("n"), F.avg(inside).alias("fill_mean"), F.expr("percentile(fill_mass, 0.5)").alias("fill_median"), F.avg(outside).alias("outside_mean"), F.expr("percentile(case when plausible then outside_mass end, 0.5)").alias("outside_median"))
