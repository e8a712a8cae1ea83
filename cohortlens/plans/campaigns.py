"""Queries over several runs, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap, campaign, metrics
from cohortlens.plans.evaluation import K, P, p_sql
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.views import CLASSES, predictions
from cohortlens.storage import written

RUNS = ("r1", "r2", "r3")


def runs(spark, d, names: tuple[str, ...] = RUNS) -> DataFrame:
    """Runs on the same rows, written once: a campaign reads them some ten times, and would hash them each time."""
    parts = [predictions(spark, d, i + 1).withColumn("run", F.lit(r)) for i, r in enumerate(names)]
    return written(metrics.with_prediction(reduce(DataFrame.unionByName, parts)), "runs")


R = ", ".join(p_sql(i + 1, f"p{i + 1}") for i in range(3)) + ", p AS (" + " UNION ALL ".join(f"SELECT '{r}' AS run, * FROM p{i + 1}" for i, r in enumerate(RUNS)) + ")"
ONE = f"{P.replace('p AS (SELECT *', 'q AS (SELECT *')}, p AS (SELECT 'r1' AS run, * FROM q)"


def boot_sql(reps: int, auroc_reps: int) -> str:
    """Bootstrap of p(run, g, target, pred, p) with hash weights, as common table expressions ending in ``boot``."""
    names = ["accuracy", "balanced_accuracy", "macro_f1", *(f"recall_{c}" for c in CLASSES)]
    return f"""wt AS (SELECT g, r, ('0x' || substr(md5(g || '-' || r), 1, 4))::BIGINT % 4 AS w FROM (SELECT DISTINCT g FROM p), (SELECT unnest(range({reps})) AS r)),
wx AS (SELECT * FROM wt UNION ALL SELECT DISTINCT g, -1, 1 FROM p),
cc AS (SELECT run, r, k, sum(w) FILTER (target = k) AS s, sum(w) FILTER (pred = k) AS d, sum(w) FILTER (target = k AND pred = k) AS t, sum(w) AS n FROM p JOIN wx USING (g), {K} WHERE w > 0 GROUP BY ALL),
cm AS (SELECT run, r, sum(coalesce(t, 0)) / max(n) AS accuracy, avg(CASE WHEN s > 0 THEN coalesce(t, 0) / s END) AS balanced_accuracy, avg(CASE WHEN coalesce(s, 0) + coalesce(d, 0) > 0 THEN 2 * coalesce(t, 0) / (coalesce(s, 0) + coalesce(d, 0)) END) AS macro_f1, {", ".join(f"max(CASE WHEN s > 0 THEN coalesce(t, 0) / s END) FILTER (k = {k}) AS recall_{c}" for k, c in enumerate(CLASSES))} FROM cc GROUP BY run, r),
cl AS (UNPIVOT cm ON {", ".join(names)} INTO NAME metric VALUE value),
aq AS (SELECT run, r, k, p[k + 1] AS v, coalesce(sum(w) FILTER (target = k), 0) AS pos, coalesce(sum(w) FILTER (target <> k), 0) AS neg FROM p JOIN wx USING (g), {K} WHERE w > 0 AND r < {auroc_reps} GROUP BY ALL),
ar AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY run, r, k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM aq),
ak AS (SELECT run, r, k, sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS a FROM ar GROUP BY ALL),
al AS (SELECT run, r, 'macro_auroc' AS metric, CASE WHEN count(a) = 3 THEN avg(a) END AS value FROM ak GROUP BY run, r),
av AS (SELECT run, r, metric, value FROM cl UNION ALL SELECT * FROM al),
am AS (SELECT r, metric, CASE WHEN count(value) = (SELECT count(DISTINCT run) FROM p) THEN avg(value) END AS value FROM av GROUP BY r, metric),
boot AS (SELECT metric, max(value) FILTER (r = -1) AS point, avg(value) FILTER (r >= 0) AS mean, quantile_cont(value, 0.025) FILTER (r >= 0) AS ci_low, quantile_cont(value, 0.975) FILTER (r >= 0) AS ci_high, count(value) FILTER (r >= 0) AS n_valid FROM am GROUP BY metric)"""


PER_RUN = f"""rc AS (SELECT run, k, count(*) FILTER (target = k) AS s, count(*) FILTER (pred = k) AS d, count(*) FILTER (target = k AND pred = k) AS t, count(*) AS n FROM p, {K} GROUP BY ALL),
rm AS (SELECT run, max(n) AS rows, sum(t) / max(n) AS accuracy, avg(t / nullif(s, 0)) AS balanced_accuracy, avg(2 * t / nullif(s + d, 0)) AS macro_f1 FROM rc GROUP BY run),
rt AS (SELECT run, k, p[k + 1] AS v, count(*) FILTER (target = k) AS pos, count(*) FILTER (target <> k) AS neg FROM p, {K} GROUP BY ALL), rr AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY run, k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM rt),
rk AS (SELECT run, k, sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS a FROM rr GROUP BY ALL), ra AS (SELECT run, avg(a) AS macro_auroc FROM rk GROUP BY run),
rb AS (SELECT run, least(floor(conf * 15), 14) AS b, count(*) AS n, abs(avg(conf) - avg((target = pred)::INT)) AS gap FROM p GROUP BY ALL), re AS (SELECT run, sum(gap * n) / sum(n) AS ece FROM rb GROUP BY run),
rl AS (UNPIVOT (SELECT * EXCLUDE (rows) FROM rm JOIN ra USING (run) JOIN re USING (run)) ON accuracy, balanced_accuracy, macro_f1, macro_auroc, ece INTO NAME metric VALUE value), rs AS (SELECT metric, avg(value) AS mean, stddev_samp(value) AS sd FROM rl GROUP BY metric)"""


@query("q35_bootstrap_hash", f"WITH {ONE}, {boot_sql(50, 5)} SELECT metric, round(point, 9) AS point, round(mean, 9) AS mean, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, n_valid FROM boot")
def _(spark, d) -> DataFrame:
    rows = runs(spark, d, RUNS[:1])
    return rounded(bootstrap.bootstrap(rows, bootstrap.hash_weights(rows, 50, pack=True), CLASSES, 5))


@query("q36_campaign_shared", f"WITH {R}, {PER_RUN} SELECT 'shared' AS mode, 3 AS runs, metric, round(mean, 9) AS mean, round(sd, 9) AS sd FROM rs")
def _(spark, d) -> DataFrame:
    rows = runs(spark, d)
    kind = campaign.mode(rows.withColumn("set", F.lit("ev"))).select("mode", F.col("runs").cast("int").alias("runs"))
    return rounded(kind.crossJoin(campaign.spread(campaign.per_run(rows, 3))))  # one row


@query("q37_campaign_pooled", f"WITH {P.replace('p AS (SELECT *', 'q AS (SELECT *')}, p AS (SELECT 'f' || (event_id % 3) AS run, * FROM q), {PER_RUN} SELECT 'pooled' AS mode, 3 AS runs, metric, round(mean, 9) AS mean, round(sd, 9) AS sd FROM rs")
def _(spark, d) -> DataFrame:
    rows = predictions(spark, d).withColumn("run", F.concat(F.lit("f"), (F.col("seq") % 3).cast("string")))
    kind = campaign.mode(rows.withColumn("set", F.lit("ev"))).select("mode", F.col("runs").cast("int").alias("runs"))
    return rounded(kind.crossJoin(campaign.spread(campaign.per_run(rows, 3))))  # one row


@query(
    "q38_campaign_table",
    f"""WITH {R}, {PER_RUN}, {boot_sql(2000, 500)} SELECT 'demo' AS campaign, 'test-ev' AS set, 'image' AS level, 'shared' AS mode, 3 AS runs, (SELECT count(*) FROM p WHERE run = 'r1') AS rows, (SELECT count(DISTINCT g) FROM p) AS units, metric, round(point, 9) AS point, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(sd, 9) AS run_sd FROM boot LEFT JOIN rs USING (metric)""",
)
def _(spark, d) -> DataFrame:
    rows = runs(spark, d)
    weights = written(bootstrap.hash_weights(rows, 2000, pack=True), "weights")  # counts and AUROC read them
    return rounded(campaign.campaign_table("demo", "test-ev", rows, weights, CLASSES, auroc_replicates=500))
