"""Queries on predictions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import arrays
from cohortlens.operators import calibration, curves, gallery, metrics, slices
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.views import CLASSES, predictions, table


def p_sql(run: int = 1, name: str = "p") -> str:
    """The predictions view as common table expressions."""
    salt = "" if run == 1 else f"-r{run}"
    w = ", ".join(f"1 + ('0x' || substr(md5(event_id::VARCHAR || '-{k}{salt}'), 1, 4))::BIGINT % 1000 + CASE WHEN user_id % 3 = {k} THEN 600 ELSE 0 END" for k in range(3))
    return f"""{name}_w AS (SELECT event_id, user_id, event_type, (user_id % 3)::INT AS target, [{w}] AS w FROM events),
{name}_s AS (SELECT event_id, event_id::VARCHAR AS path, user_id::VARCHAR AS g, event_type, target, list_transform(w, lambda x: x::DOUBLE / list_sum(w)) AS p FROM {name}_w),
{name} AS (SELECT *, list_position(p, list_max(p))::INT - 1 AS pred, list_max(p) AS conf FROM {name}_s)"""


P = p_sql()
K = "(SELECT unnest([0, 1, 2])::INT AS k)"
PER_CLASS = f"c AS (SELECT k, count(*) FILTER (target = k) AS s, count(*) FILTER (pred = k) AS d, count(*) FILTER (target = k AND pred = k) AS t, count(*) AS n FROM p, {K} GROUP BY k)"


@query("q01_confusion", f"WITH {P} SELECT a.k AS target, b.k AS prediction, (SELECT count(*) FROM p WHERE target = a.k AND pred = b.k) AS n FROM {K} a, {K} b")
def _(spark, d) -> DataFrame:
    return metrics.confusion(metrics.with_prediction(predictions(spark, d)), 3)


@query("q02_point_metrics", f"WITH {P}, {PER_CLASS} SELECT max(n) AS rows, round(sum(t) / max(n), 9) AS accuracy, round(avg(t / nullif(s, 0)), 9) AS balanced_accuracy, round(avg(2 * t / nullif(s + d, 0)), 9) AS macro_f1 FROM c")
def _(spark, d) -> DataFrame:
    return rounded(metrics.point_metrics(metrics.with_prediction(predictions(spark, d)), 3))


@query("q03_recall_by_class", f"WITH {P}, {PER_CLASS} SELECT k AS class, s AS support, round(t / nullif(s, 0), 9) AS recall FROM c")
def _(spark, d) -> DataFrame:
    return rounded(metrics.recall_by_class(metrics.with_prediction(predictions(spark, d)), 3))


@query(
    "q04_metrics_by_cohort",
    f"""WITH {P}, u AS (SELECT 'all' AS slice_type, 'all' AS slice_value, * FROM p UNION ALL SELECT 'cohort', event_type, * FROM p UNION ALL SELECT 'raw_label', event_type, * FROM p
UNION ALL SELECT 'in_duplicate_cluster', CASE WHEN g IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal < 0) THEN 'True' ELSE 'False' END, * FROM p),
c AS (SELECT slice_type, slice_value, k, count(*) FILTER (target = k) AS s, count(*) FILTER (pred = k) AS d, count(*) FILTER (target = k AND pred = k) AS t, count(*) AS n FROM u, {K} GROUP BY ALL),
m AS (SELECT slice_type, slice_value, sum(t) / max(n) AS accuracy, avg(2 * t / nullif(s + d, 0)) AS macro_f1, {", ".join(f"max(s) FILTER (k = {k}) AS true_{c}, max(d / n) FILTER (k = {k}) AS predicted_{c}" for k, c in enumerate(CLASSES))} FROM c GROUP BY ALL)
SELECT slice_type, slice_value, count(*) AS images, count(DISTINCT g) AS groups, round(any_value(accuracy), 9) AS accuracy, round(any_value(macro_f1), 9) AS macro_f1, round(avg(conf), 9) AS mean_confidence,
{", ".join(f"any_value(true_{c}) AS true_{c}, round(any_value(predicted_{c}), 9) AS predicted_{c}" for c in CLASSES)} FROM u JOIN m USING (slice_type, slice_value) GROUP BY slice_type, slice_value""",
)
def _(spark, d) -> DataFrame:
    marked = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("group_key"))
    return rounded(slices.slice_metrics(slices.flagged(predictions(spark, d), marked, "group_key"), CLASSES))


@query(
    "q05_group_table",
    f"""WITH {P}, f AS (SELECT g, arg_min(event_type, event_id) AS cohort FROM p GROUP BY g), t AS (SELECT g, target, count(*) AS n FROM p GROUP BY ALL),
l AS (SELECT g, string_agg(['normal', 'amd', 'dme'][target + 1] || ':' || n, ';' ORDER BY ['normal', 'amd', 'dme'][target + 1]) AS targets FROM t GROUP BY g)
SELECT p.g AS group_key, p.g AS eye_ids, any_value(f.cohort) AS cohort, any_value(l.targets) AS targets, count(*) AS images, count(*) FILTER (target <> pred) AS errors, round(count(*) FILTER (target <> pred) / count(*), 9) AS error_rate, round(avg(conf), 9) AS mean_confidence,
{", ".join(f"round(count(*) FILTER (pred = {k}) / count(*), 9) AS predicted_{c}" for k, c in enumerate(CLASSES))} FROM p JOIN f USING (g) JOIN l USING (g) GROUP BY p.g""",
)
def _(spark, d) -> DataFrame:
    return rounded(slices.group_table(predictions(spark, d), CLASSES))


@query(
    "q06_error_concentration",
    f"""WITH {P}, e AS (SELECT g, count(*) FILTER (target <> pred) AS e FROM p GROUP BY g), r AS (SELECT e, row_number() OVER (ORDER BY e DESC, g) AS rn, count(*) OVER () AS n FROM e)
SELECT count(*) AS groups, count(*) FILTER (e > 0) AS groups_with_errors, sum(e)::BIGINT AS total_errors,
{", ".join(f"round(sum(e) FILTER (rn <= greatest(1, ceil(n * {s}))) / nullif(sum(e), 0), 9) AS error_share_top_{round(100 * s)}pct_groups" for s in (0.05, 0.10, 0.25))} FROM r""",
)
def _(spark, d) -> DataFrame:
    return rounded(slices.error_concentration(slices.group_table(predictions(spark, d), CLASSES)))


BINS = "b AS (SELECT least(floor(conf * 15), 14)::INT AS bin, conf, (target = pred)::INT AS ok FROM p), r AS (SELECT bin, count(*) AS n, avg(conf) AS c, avg(ok) AS a FROM b GROUP BY bin)"


@query("q07_reliability", f"WITH {P}, {BINS} SELECT k::INT AS bin, round(k / 15, 9) AS bin_low, round((k + 1) / 15, 9) AS bin_high, coalesce(n, 0) AS count, round(c, 9) AS mean_confidence, round(a, 9) AS accuracy FROM (SELECT unnest(range(15)) AS k) LEFT JOIN r ON r.bin = k")
def _(spark, d) -> DataFrame:
    return rounded(calibration.reliability(calibration.with_correct(predictions(spark, d))))


@query("q08_ece_mce", f"WITH {P}, {BINS} SELECT round(sum(abs(a - c) * n) / sum(n), 9) AS ece, round(max(abs(a - c)), 9) AS mce FROM r")
def _(spark, d) -> DataFrame:
    return rounded(calibration.calibration_error(calibration.reliability(calibration.with_correct(predictions(spark, d)))))


@query("q09_classwise_ece", f"WITH {P}, b AS (SELECT k, least(floor(p[k + 1] * 15), 14) AS bin, p[k + 1] AS v, (target = k)::INT AS y FROM p, {K}), r AS (SELECT k, bin, count(*) AS n, abs(avg(v) - avg(y)) AS gap FROM b GROUP BY ALL) SELECT k AS class, round(sum(gap * n) / sum(n), 9) AS ece, round(max(gap), 9) AS mce FROM r GROUP BY k")
def _(spark, d) -> DataFrame:
    return rounded(calibration.classwise_error(predictions(spark, d)))


@query("q10_brier_nll", f"WITH {P} SELECT round(avg({' + '.join(f'(p[{k + 1}] - (target = {k})::INT) ** 2' for k in range(3))}), 9) AS brier, round(-avg(ln(least(greatest(p[target + 1], 1e-12), 1))), 9) AS nll, round(avg(conf), 9) AS mean_confidence, round(avg(conf) FILTER (target = pred), 9) AS mean_confidence_correct, round(avg(conf) FILTER (target <> pred), 9) AS mean_confidence_wrong FROM p")
def _(spark, d) -> DataFrame:
    return rounded(calibration.summary(predictions(spark, d)))


@query("q11_confidence_hist", f"WITH {P} SELECT k::INT AS bin, count(path) FILTER (target = pred) AS correct, count(path) FILTER (target <> pred) AS wrong FROM (SELECT unnest(range(20)) AS k) LEFT JOIN p ON conf >= k / 20 AND (conf < (k + 1) / 20 OR k = 19) GROUP BY k")
def _(spark, d) -> DataFrame:
    return calibration.confidence_histogram(predictions(spark, d))


PAIRS = "s AS (SELECT k, p[k + 1] AS v, (target = k) AS y FROM p, {K}), t AS (SELECT k, v, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM s GROUP BY ALL)".replace("{K}", K)


@query("q12_auroc_ovr", f"WITH {P}, {PAIRS}, r AS (SELECT k, pos, neg, coalesce(sum(neg) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t) SELECT k AS class, sum(pos)::DOUBLE AS positives, sum(neg)::DOUBLE AS negatives, round(sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0), 9) AS auroc FROM r GROUP BY k")
def _(spark, d) -> DataFrame:
    return rounded(metrics.auroc_by_class(predictions(spark, d)))


@query(
    "q13_weighted_auroc",
    f"""WITH {P}, s AS (SELECT k, round(p[k + 1], 2) AS v, target = k AS y, (1 + event_id % 3)::DOUBLE AS w FROM p, {K}), t AS (SELECT k, v, coalesce(sum(w) FILTER (y), 0) AS pos, coalesce(sum(w) FILTER (NOT y), 0) AS neg FROM s GROUP BY ALL),
x AS (SELECT a.k, sum(a.pos * b.neg * CASE WHEN a.v > b.v THEN 1 WHEN a.v = b.v THEN 0.5 ELSE 0 END) AS wins FROM t a JOIN t b USING (k) GROUP BY a.k), n AS (SELECT k, sum(pos) * sum(neg) AS pairs FROM t GROUP BY k)
SELECT round(avg(wins / pairs), 9) AS macro_auroc FROM x JOIN n USING (k)""",
)
def _(spark, d) -> DataFrame:
    rows = predictions(spark, d).withColumns({"probs": F.transform("probs", lambda p: F.round(p, 2)), "w": (1 + F.col("seq") % 3).cast("double")})
    return rounded(metrics.macro_auroc(rows, weight="w"))


@query("q14_ovr_rates", f"WITH {P}, {PER_CLASS}, r AS (SELECT k, t AS tp, d - t AS fp, s - t AS fn, n - s - d + t AS tn FROM c) SELECT k AS class, round(tp / nullif(tp + fn, 0), 9) AS sensitivity, round(tn / nullif(tn + fp, 0), 9) AS specificity, round(tp / nullif(tp + fp, 0), 9) AS ppv, round(tn / nullif(tn + fn, 0), 9) AS npv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM r")
def _(spark, d) -> DataFrame:
    return rounded(metrics.rates_by_class(metrics.with_prediction(predictions(spark, d)), 3))


STEPS = f"{PAIRS}, z AS (SELECT k, v, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY k) AS np, sum(neg) OVER (PARTITION BY k) AS nn FROM t WINDOW w AS (PARTITION BY k ORDER BY v DESC))"


@query(
    "q15_roc_points",
    f"""WITH {P}, {STEPS}, a AS (SELECT *, lead(tp) OVER w AS tp2, lead(fp) OVER w AS fp2, coalesce(lag(tp) OVER w, 0) AS tp0, coalesce(lag(fp) OVER w, 0) AS fp0 FROM z WINDOW w AS (PARTITION BY k ORDER BY v DESC))
SELECT k AS class, round(v, 9) AS threshold, round(fp / nn, 9) AS fpr, round(tp / np, 9) AS tpr FROM a WHERE tp2 IS NULL OR (tp - tp0) * (fp2 - fp) <> (fp - fp0) * (tp2 - tp) UNION ALL SELECT DISTINCT k, NULL, 0.0, 0.0 FROM z""",
)
def _(spark, d) -> DataFrame:
    return rounded(curves.roc_points(curves.curve_steps(predictions(spark, d))))


@query("q16_pr_ap", f"WITH {P}, {STEPS} SELECT k AS class, round(sum(pos / np * tp / (tp + fp)), 9) AS average_precision, round(max(np / (np + nn)), 9) AS prevalence FROM z GROUP BY k")
def _(spark, d) -> DataFrame:
    return rounded(curves.average_precision(curves.curve_steps(predictions(spark, d))))


DISEASE = f"{P}, s AS (SELECT 1 - p[1] AS v, target <> 0 AS y, pred <> 0 AS d FROM p), n AS (SELECT count(*) FILTER (y) AS np, count(*) FILTER (NOT y) AS nn FROM s), t AS (SELECT v, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM s GROUP BY v), z AS (SELECT v, sum(pos) OVER (ORDER BY v DESC) AS tp, sum(neg) OVER (ORDER BY v DESC) AS fp, np, nn FROM t, n)"
RATES = "round(tp / nullif(np, 0), 9) AS sensitivity, round((nn - fp) / nullif(nn, 0), 9) AS specificity, round(tp / nullif(tp + fp, 0), 9) AS ppv, round((nn - fp) / nullif(nn - fp + np - tp, 0), 9) AS npv, round(2 * tp / nullif(tp + fp + np, 0), 9) AS f1"


@query(
    "q17_operating_points",
    f"""WITH {DISEASE}, o AS (SELECT 'argmax' AS point, NULL::DOUBLE AS v, (SELECT count(*) FROM s WHERE d AND y) AS tp, (SELECT count(*) FROM s WHERE d AND NOT y) AS fp, np, nn FROM n
UNION ALL (SELECT 'sensitivity_90', v, tp, fp, np, nn FROM z WHERE tp / np >= 0.90 ORDER BY v DESC LIMIT 1) UNION ALL (SELECT 'sensitivity_95', v, tp, fp, np, nn FROM z WHERE tp / np >= 0.95 ORDER BY v DESC LIMIT 1)
UNION ALL (SELECT 'best_f1', v, tp, fp, np, nn FROM z ORDER BY 2 * tp / (tp + fp + np) DESC, v DESC LIMIT 1)) SELECT point, round(v, 9) AS threshold, {RATES} FROM o""",
)
def _(spark, d) -> DataFrame:
    return rounded(curves.operating_points(metrics.with_prediction(predictions(spark, d))))


@query("q18_best_f1", f"WITH {DISEASE} SELECT round(v, 9) AS threshold, round(2 * tp / (tp + fp + np), 9) AS f1 FROM z ORDER BY 2 * tp / (tp + fp + np) DESC, v DESC LIMIT 1")
def _(spark, d) -> DataFrame:
    return rounded(curves.operating_points(metrics.with_prediction(predictions(spark, d))).where("point = 'best_f1'").select("threshold", "f1"))


@query(
    "q19_eye_level_metrics",
    f"""WITH {P}, e AS (SELECT g, min(target) AS target, [avg(p[1]), avg(p[2]), avg(p[3])] AS q FROM p GROUP BY g), f AS (SELECT target, list_position(list_transform(q, lambda x: round(x, 12)), list_max(list_transform(q, lambda x: round(x, 12)))) - 1 AS pred FROM e),
c AS (SELECT k, count(*) FILTER (target = k) AS s, count(*) FILTER (pred = k) AS d, count(*) FILTER (target = k AND pred = k) AS t, count(*) AS n FROM f, {K} GROUP BY k)
SELECT max(n) AS rows, round(sum(t) / max(n), 9) AS accuracy, round(avg(t / nullif(s, 0)), 9) AS balanced_accuracy, round(avg(2 * t / nullif(s + d, 0)), 9) AS macro_f1 FROM c""",
)
def _(spark, d) -> DataFrame:
    return rounded(metrics.point_metrics(metrics.grouped(predictions(spark, d), "eye_id", 3), 3))


@query(
    "q20_error_gallery",
    f"""WITH {P}, a AS (SELECT *, row_number() OVER (PARTITION BY target, pred, g ORDER BY conf DESC, event_id) AS rg FROM p WHERE target <> pred),
b AS (SELECT *, row_number() OVER (PARTITION BY target, pred ORDER BY conf DESC, event_id) - 1 AS rank FROM a WHERE rg <= 3), c AS (SELECT *, row_number() OVER (ORDER BY target, pred, rank) - 1 AS n FROM b WHERE rank < 24)
SELECT printf('e%04d', n) AS row_id, 'error' AS kind, rank, path, 'ev' AS source, g AS group_key, event_type AS cohort, event_type AS raw_label, ['normal', 'amd', 'dme'][target + 1] AS target, ['normal', 'amd', 'dme'][pred + 1] AS prediction,
round(conf, 9) AS confidence, round(p[target + 1], 9) AS true_probability, {", ".join(f"round(p[{k + 1}], 9) AS probability_{c}" for k, c in enumerate(CLASSES))} FROM c""",
)
def _(spark, d) -> DataFrame:
    return rounded(gallery.error_gallery(predictions(spark, d), CLASSES))


@query("q22_label_restrict_renorm", f"WITH {P} SELECT path, CASE target WHEN 0 THEN 0 ELSE 1 END AS target, round(p[1] / (p[1] + p[3]), 9) AS p_normal, round(p[3] / (p[1] + p[3]), 9) AS p_dme FROM p WHERE target IN (0, 2)")
def _(spark, d) -> DataFrame:
    keep = [0, 2]
    rows = predictions(spark, d).select("path", arrays.restricted_target("target", keep).alias("target"), arrays.restricted("probs", keep).alias("p")).where("target is not null")
    return rounded(rows.select("path", "target", F.col("p")[0].alias("p_normal"), F.col("p")[1].alias("p_dme")))


@query(
    "q50_reference_check",
    f"""WITH {P}, {PER_CLASS}, m AS (SELECT sum(t) / max(n) AS a, avg(t / nullif(s, 0)) AS b, avg(2 * t / nullif(s + d, 0)) AS f FROM c)
SELECT metric, round(computed, 9) AS computed, round(saved, 9) AS saved, matches FROM (SELECT 'accuracy' AS metric, a AS computed, a AS saved, TRUE AS matches FROM m UNION ALL SELECT 'balanced_accuracy', b, b + 0.001, FALSE FROM m UNION ALL SELECT 'macro_f1', f, NULL, FALSE FROM m)""",
)
def _(spark, d) -> DataFrame:
    names = ["accuracy", "balanced_accuracy", "macro_f1"]
    computed = metrics.long_metrics(metrics.point_metrics(metrics.with_prediction(predictions(spark, d)), 3), names)
    off = F.when(F.col("metric") == "accuracy", F.col("value")).when(F.col("metric") == "balanced_accuracy", F.col("value") + 0.001)
    return rounded(metrics.compare_metrics(computed, computed.select("metric", off.alias("value"))))


@query("q51_class_weights", f"WITH {P} SELECT target, count(*) AS n, round((SELECT count(*) FROM p) / (3 * count(*)), 9) AS weight FROM p GROUP BY target")
def _(spark, d) -> DataFrame:
    return rounded(metrics.class_weights(predictions(spark, d), 3))


@query(
    "q52_weighted_macro_f1",
    f"""WITH {P}, c AS (SELECT event_type, k, count(*) FILTER (target = k) AS s, count(*) FILTER (pred = k) AS d, count(*) FILTER (target = k AND pred = k) AS t, count(*) AS n FROM p, {K} GROUP BY ALL), m AS (SELECT event_type, max(n) AS n, avg(2 * t / nullif(s + d, 0)) AS f FROM c GROUP BY event_type) SELECT round(sum(f * n) / sum(n), 9) AS macro_f1 FROM m""",
)
def _(spark, d) -> DataFrame:
    return rounded(metrics.weighted_mean(metrics.point_metrics(metrics.with_prediction(predictions(spark, d)), 3, ("cohort",)), "macro_f1", "rows"))
