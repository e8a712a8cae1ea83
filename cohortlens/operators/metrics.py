"""Classification metrics over predictions: (target, probs, ...) rows, optionally by key columns.

Everything is a sum of partial aggregates by class, so one shuffle of at most keys x classes rows; ranks for AUROC come
from cumulative sums over score buckets, never from one sorted partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortlens.functions.arrays import argmax, confidence

#: Scores from 0 to 1 are ranked in so many buckets.
BUCKETS = 4096


def with_prediction(df: DataFrame, probs: str = "probs") -> DataFrame:
    return df.withColumns({"prediction": argmax(probs), "confidence": confidence(probs)})


def confusion(df: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, target, prediction, n) over all pairs of classes, zero counts included."""
    cells = [(t, p) for t in range(classes) for p in range(classes)]
    sums = df.groupBy(*by).agg(*(F.count_if((F.col("target") == t) & (F.col("prediction") == p)).alias(f"n{t}_{p}") for t, p in cells))
    grid = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(p).alias("prediction"), F.col(f"n{t}_{p}").alias("n")) for t, p in cells)))
    return sums.select(*by, grid.alias("c")).select(*by, "c.*")


def class_counts(df: DataFrame, classes: int, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Per key: n, and of each class k support s_k, predictions p_k and hits t_k, weighted if asked."""
    w = F.lit(1) if weight is None else weight
    out = [F.sum(w).alias("n")]
    for k in range(classes):
        is_target, is_predicted = F.col("target") == k, F.col("prediction") == k
        out += [F.sum(F.when(c, w).otherwise(w * 0)).alias(f"{name}_{k}") for name, c in (("s", is_target), ("p", is_predicted), ("t", is_target & is_predicted))]
    return df.groupBy(*by).agg(*out)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b)


def recall(k: int) -> Column:
    return _ratio(F.col(f"t_{k}"), F.col(f"s_{k}"))


def _mean_known(values: list[Column]) -> Column:
    known = F.array_compact(F.array(*values))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def accuracy(classes: int) -> Column:
    return _ratio(reduce(lambda a, b: a + b, (F.col(f"t_{k}") for k in range(classes))), F.col("n"))


def balanced_accuracy(classes: int) -> Column:
    """Mean recall of the classes that are among the targets."""
    return _mean_known([recall(k) for k in range(classes)])


def macro_f1(classes: int) -> Column:
    """Mean F1 of the classes that are among targets or predictions."""
    return _mean_known([_ratio(2 * F.col(f"t_{k}"), F.col(f"s_{k}") + F.col(f"p_{k}")) for k in range(classes)])


def point_metrics(df: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    return class_counts(df, classes, by).select(*by, F.col("n").alias("rows"), accuracy(classes).alias("accuracy"), balanced_accuracy(classes).alias("balanced_accuracy"), macro_f1(classes).alias("macro_f1"))


def recall_by_class(df: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("class"), F.col(f"s_{k}").alias("support"), recall(k).alias("recall")) for k in range(classes))))
    return class_counts(df, classes, by).select(*by, rows.alias("r")).select(*by, "r.*")


def by_class(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each class of each prediction: class, score, and whether it is the target."""
    return df.select(*keep, "target", F.posexplode("probs").alias("class", "score")).withColumn("positive", (F.col("target") == F.col("class")).cast("int"))


def ranked_scores(scores: DataFrame, keys: tuple[str, ...], sums: tuple[str, ...], score: str = "score") -> DataFrame:
    """Of rows that are distinct in (keys, score): for each summed column x, ``x_above``, the sum over higher scores.

    Scores are dealt to buckets; a bucket is ranked by itself and gets what the buckets above it hold, which is a table
    of at most keys x BUCKETS rows."""
    dealt = scores.withColumn("bucket", F.least(F.greatest(F.floor(F.col(score) * BUCKETS), F.lit(-1)), F.lit(BUCKETS)).cast("int"))
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "bucket").agg(*(F.sum(c).alias(f"{c}__t") for c in sums))
    totals = totals.select(*keys, "bucket", *(F.coalesce(F.sum(f"{c}__t").over(above), F.lit(0)).alias(f"{c}__o") for c in sums))
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(totals, [*keys, "bucket"])
    out = out.withColumns({f"{c}_above": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{c}__o") for c in sums})
    return out.drop("bucket", *(f"{c}__o" for c in sums))


def auroc_by_class(df: DataFrame, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(by, class, positives, negatives, auroc), one-vs-rest; null where a side is empty. Ties count half."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = by_class(df, (*by, *((weight,) if weight else ())))
    groups = rows.groupBy(*by, "class", "score").agg(F.sum(w * F.col("positive")).alias("pos"), F.sum(w * (1 - F.col("positive"))).alias("neg"))
    ranked = ranked_scores(groups, (*by, "class"), ("neg",))
    out = ranked.groupBy(*by, "class").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("pos") * (F.col("neg_above") + 0.5 * F.col("neg"))).alias("lost"))
    whole = F.col("positives") * F.col("negatives")
    return out.select(*by, "class", "positives", "negatives", F.when(whole > 0, 1 - F.col("lost") / whole).alias("auroc"))


def macro_auroc(df: DataFrame, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Mean AUROC over the classes; null if it is undefined for any of them."""
    one = auroc_by_class(df, by, weight)
    return one.groupBy(*by).agg(F.when(F.count("auroc") == F.count("*"), F.avg("auroc")).alias("macro_auroc"))


def rank_correlation(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, rows, spearman): the correlation of mid-ranks, ties sharing theirs; null without spread. Rows with a null in
    either column don't count. Values are counted and ranked by ranges, so no key is sorted in one task."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x__"), F.col(y).cast("double").alias("y__"))

    def ranks(c: str) -> DataFrame:
        counted = known.groupBy(*by, c).agg(F.count("*").alias("n__"))
        return ranked_scores(counted, by, ("n__",), c).select(*by, c, (F.col("n___above") + (F.col("n__") + 1) / 2).alias(f"{c}r"))

    both = known.join(ranks("x__"), [*by, "x__"]).join(ranks("y__"), [*by, "y__"])
    spread = F.stddev_pop("x__r") * F.stddev_pop("y__r")
    return both.groupBy(*by).agg(F.count("*").alias("rows"), (F.covar_pop("x__r", "y__r") / F.nullif(spread, F.lit(0.0))).alias("spearman"))


def rates_by_class(df: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One-vs-rest sensitivity, specificity, ppv, npv and f1 of the decisions; null on an empty denominator."""
    rows = []
    for k in range(classes):
        tp, fp, fn = F.col(f"t_{k}"), F.col(f"p_{k}") - F.col(f"t_{k}"), F.col(f"s_{k}") - F.col(f"t_{k}")
        rows.append(F.struct(F.lit(k).alias("class"), *binary_rates(tp, fp, fn, F.col("n") - tp - fp - fn)))
    return class_counts(df, classes, by).select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def binary_rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    return [_ratio(tp, tp + fn).alias("sensitivity"), _ratio(tn, tn + fp).alias("specificity"), _ratio(tp, tp + fp).alias("ppv"), _ratio(tn, tn + fn).alias("npv"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def grouped(df: DataFrame, unit: str, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per unit: mean probability vector, its decision, and the unit's target; an error if it has several, or if
    a unit is null."""
    known = df.withColumn(unit, F.when(F.col(unit).isNull(), F.raise_error(F.lit(f"a row has no {unit}")).cast(df.schema[unit].dataType)).otherwise(F.col(unit)))
    means = [F.avg(F.element_at("probs", k + 1)).alias(f"__{k}") for k in range(classes)]
    out = known.groupBy(*by, unit).agg(F.min("target").alias("target"), F.max("target").alias("__most"), F.count("*").alias("images"), *means)
    several = F.raise_error(F.concat(F.lit(f"{unit} has several targets: "), F.col(unit).cast("string"))).cast("int")
    out = out.withColumns({"target": F.when(F.col("target") == F.col("__most"), F.col("target")).otherwise(several), "probs": F.array(*(f"__{k}" for k in range(classes)))})
    return with_prediction(out.select(*by, unit, "target", "images", "probs"))


def class_weights(df: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """N / (classes x count) for each target class."""
    counts = df.groupBy(*by, "target").agg(F.count("*").alias("n"))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(whole, list(by)) if by else counts.crossJoin(F.broadcast(whole))  # one row
    return joined.select(*by, "target", "n", (F.col("total") / (classes * F.col("n"))).alias("weight"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    total = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return df.groupBy(*by).agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).alias(value))


def compare_metrics(computed: DataFrame, saved: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(metric, computed, saved, matches) of two (metric, value) tables; both null is a match, one null is none."""
    a, b = computed.select("metric", F.col("value").alias("computed")), saved.select("metric", F.col("value").alias("saved"))
    near = F.abs(F.col("computed") - F.col("saved")) < tolerance
    both = F.col("computed").isNull() & F.col("saved").isNull()
    return a.join(b, "metric", "left").withColumn("matches", F.when(both, True).otherwise(F.coalesce(near, F.lit(False))))


def long_metrics(row: DataFrame, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, metric, value) rows of metric columns."""
    return row.select(*by, *(F.col(n).cast(T.DoubleType()) for n in names)).unpivot(list(by), names, "metric", "value")
