"""ROC and precision-recall curves, and operating points of a disease score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.operators.metrics import BUCKETS, binary_rates, by_class, ranked_scores


def score_steps(df: DataFrame, by: tuple[str, ...] = ("class",), score: str = "score", positive: str = "positive") -> DataFrame:
    """A row for each distinct score as a threshold (>=): tp, fp, and the totals of positives and negatives."""
    groups = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(positive).cast("bigint").alias("pos"), F.sum(1 - F.col(positive)).cast("bigint").alias("neg"))
    ranked = ranked_scores(groups, by, ("pos", "neg"))
    totals = groups.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    joined = ranked.join(totals, list(by)) if by else ranked.crossJoin(F.broadcast(totals))  # one row
    return joined.select(*by, F.col("score").alias("threshold"), "pos", "neg", (F.col("pos_above") + F.col("pos")).alias("tp"), (F.col("neg_above") + F.col("neg")).alias("fp"), "positives", "negatives")


def curve_steps(df: DataFrame) -> DataFrame:
    """Steps of each class, without the classes that have one side only."""
    return score_steps(by_class(df)).where("positives > 0 and negatives > 0")


def roc_points(steps: DataFrame, by: tuple[str, ...] = ("class",), drop_collinear: bool = True) -> DataFrame:
    """(by, threshold, fpr, tpr), without points on a straight line between their neighbours unless told otherwise; and
    the point (0, 0) with a null threshold."""
    rows = steps
    if drop_collinear:
        # A step is a corner unless the next one goes on in the same direction. The next step of a bucket's last one is the
        # first of the next bucket, from a table of at most keys x BUCKETS rows.
        dealt = steps.withColumn("bucket", F.floor(F.col("threshold") * BUCKETS))
        first = dealt.groupBy(*by, "bucket").agg(F.max_by(F.struct("pos", "neg"), "threshold").alias("first"))
        first = first.select(*by, "bucket", F.lead("first").over(Window.partitionBy(*by).orderBy(F.desc("bucket"))).alias("below"))
        inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("threshold"))
        after = F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("below"))
        found = dealt.join(first, [*by, "bucket"]).withColumn("after", after)
        rows = found.where(F.col("after").isNull() | (F.col("pos") * F.col("after.neg") != F.col("neg") * F.col("after.pos")))
    points = rows.select(*by, "threshold", (F.col("fp") / F.col("negatives")).alias("fpr"), (F.col("tp") / F.col("positives")).alias("tpr"))
    start = steps.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_points(steps: DataFrame, by: tuple[str, ...] = ("class",)) -> DataFrame:
    """(by, threshold, precision, recall); the anchor at recall zero isn't among them."""
    return steps.select(*by, "threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("positives")).alias("recall"))


def average_precision(steps: DataFrame, by: tuple[str, ...] = ("class",)) -> DataFrame:
    """Sum of precision times the growth of recall, and the prevalence."""
    part = F.col("pos") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return steps.groupBy(*by).agg(F.sum(part).alias("average_precision"), F.max(F.col("positives") / (F.col("positives") + F.col("negatives"))).alias("prevalence"))


def downsampled(points: DataFrame, by: tuple[str, ...], order: str, most: int = 200) -> DataFrame:
    """At most ``most`` rows of each curve, evenly spread over its order, both ends included; nulls come first.

    The places that stay follow from the number of points. Points are counted by ranges of the order (a number, mostly from 0
    to 1), which tells what range a place is in; only ranges that hold one are sorted, each by itself."""
    place = F.coalesce(F.least(F.greatest(F.floor(F.col(order) * BUCKETS), F.lit(-1)), F.lit(BUCKETS)), F.lit(-2)).cast("int")
    dealt = points.withColumn("b__", place)
    sizes = dealt.groupBy(*by, "b__").agg(F.count("*").alias("c__"))
    curve = Window.partitionBy(*by)  # BUCKETS rows a curve
    ranges = sizes.withColumns({"s__": F.sum("c__").over(curve.orderBy("b__")) - F.col("c__"), "n__": F.sum("c__").over(curve)})
    step = (F.col("n__") - 1) / F.lit(most - 1)
    stays = lambda k, low, high: k.between(0, most - 1) & (F.bround(k * step, 0) >= low) & (F.bround(k * step, 0) < high)
    first = F.ceil((F.col("s__") - 0.5) / step)
    visited = ranges.where((F.col("n__") <= most) | F.exists(F.array(*(first + k for k in (-1, 0, 1))), lambda k: stays(k, F.col("s__"), F.col("s__") + F.col("c__")))).drop("c__")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "b__")]
    ranked = dealt.alias("x").join(visited.alias("y"), same).select("x.*", "s__", "n__")
    ranked = ranked.withColumn("i__", F.col("s__") + F.row_number().over(Window.partitionBy(*by, "b__").orderBy(order)) - 1)
    near = F.floor(F.col("i__") / step + 0.5)
    kept = F.exists(F.array(near - 1, near, near + 1), lambda k: stays(k, F.col("i__"), F.col("i__") + 1))
    return ranked.where((F.col("n__") <= most) | kept).drop("i__", "n__", "s__", "b__")


def disease_scores(df: DataFrame, normal: int = 0) -> DataFrame:
    """score = 1 - p(normal), positive = another target, and whether the decision is positive."""
    return df.select((1 - F.element_at("probs", normal + 1)).alias("score"), (F.col("target") != normal).cast("int").alias("positive"), (F.col("prediction") != normal).cast("int").alias("decided"))


def _rates(tp: Column, fp: Column) -> list[Column]:
    return binary_rates(tp, fp, F.col("positives") - tp, F.col("negatives") - fp)


def operating_points(df: DataFrame, normal: int = 0, targets: tuple[float, ...] = (0.90, 0.95)) -> DataFrame:
    """(point, threshold, rates): the decisions; of each sensitivity target the highest threshold that reaches it; and the
    threshold of best F1, the strictest of equals. No rows if a side is empty."""
    scores = disease_scores(df, normal)
    steps = score_steps(scores, ()).where("positives > 0 and negatives > 0")
    tp, fp = F.col("tp"), F.col("fp")
    best = [F.max(F.when(tp / F.col("positives") >= t, F.struct("threshold", "tp", "fp"))).alias(f"t{i}") for i, t in enumerate(targets)]
    f1 = 2 * tp / (tp + fp + F.col("positives"))
    picked = steps.agg(*best, F.max(F.struct(f1.alias("f1"), F.col("threshold"), tp, fp)).alias("f"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives")).where("positives is not null")
    names = [f"sensitivity_{round(100 * t)}" for t in targets]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("point"), F.col(f"t{i}.threshold"), F.col(f"t{i}.tp"), F.col(f"t{i}.fp")) for i, n in enumerate(names)), F.struct(F.lit("best_f1").alias("point"), F.col("f.threshold"), F.col("f.tp"), F.col("f.fp"))))
    tuned = picked.select("positives", "negatives", rows.alias("r")).select("positives", "negatives", "r.*")
    decided = scores.agg(F.sum(F.col("decided") * F.col("positive")).alias("tp"), F.sum(F.col("decided") * (1 - F.col("positive"))).alias("fp"), F.sum("positive").alias("positives"), F.sum(1 - F.col("positive")).alias("negatives"))
    decided = decided.where("positives > 0 and negatives > 0").select("positives", "negatives", F.lit("argmax").alias("point"), F.lit(None).cast("double").alias("threshold"), "tp", "fp")
    return decided.unionByName(tuned).select("point", "threshold", *_rates(tp, fp))
