"""Further queries, for operators that the first fifty-two don't show by themselves, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import arrays, scalars
from cohortlens.operators import audit, bootstrap, curves, eda, gallery, metrics, splits
from cohortlens.plans.campaigns import R, boot_sql, runs
from cohortlens.plans.evaluation import STEPS, P
from cohortlens.plans.records import CLUSTER, NEAR, SUMMARY, H, M, decided, flat, hashed_manifest, keyed
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.views import CLASSES, manifest, predictions, table

CLASS_NAMES = "['normal', 'amd', 'dme']"


@query(
    "q53_control_sample",
    f"""WITH {P}, h AS (SELECT *, ('0x' || substr(md5('20260927:' || path), 1, 12))::BIGINT AS o FROM p WHERE target = pred), a AS (SELECT *, row_number() OVER (PARTITION BY target, g ORDER BY o, event_id) AS rg FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY o, event_id) - 1 AS rank FROM a WHERE rg <= 3) SELECT printf('c%04d', row_number() OVER (ORDER BY target, rank) - 1) AS row_id, rank, path, {CLASS_NAMES}[target + 1] AS target, round(conf, 9) AS confidence FROM b WHERE rank < 24""",
)
def _(spark, d) -> DataFrame:
    return rounded(gallery.control_sample(predictions(spark, d), CLASSES).select("row_id", "rank", "path", "target", "confidence"))


@query("q54_pr_points", f"WITH {P}, {STEPS} SELECT k AS class, round(v, 9) AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / np, 9) AS recall FROM z")
def _(spark, d) -> DataFrame:
    return rounded(curves.pr_points(curves.curve_steps(predictions(spark, d))))


@query(
    "q55_paired_differences",
    f"""WITH {R}, {boot_sql(30, 0)}, d AS (SELECT metric, r, max(value) FILTER (run = 'r2') - max(value) FILTER (run = 'r1') AS gap FROM cl GROUP BY metric, r)
SELECT metric, round(max(gap) FILTER (r = -1), 9) AS point, round(quantile_cont(gap, 0.025) FILTER (r >= 0), 9) AS ci_low, round(quantile_cont(gap, 0.975) FILTER (r >= 0), 9) AS ci_high FROM d GROUP BY metric""",
)
def _(spark, d) -> DataFrame:
    rows = runs(spark, d)
    return rounded(bootstrap.paired_differences(rows, bootstrap.hash_weights(rows, 30, pack=True), CLASSES, "r1", "r2"))


KINDS = f"""j AS (SELECT m.*, hash, b0, b1, b2, b3 FROM m JOIN h USING (path)), n AS (SELECT DISTINCT source, hash, b0, b1, b2, b3 FROM j),
d AS (SELECT x.source, x.hash AS hash_a, y.hash AS hash_b, (bit_count(xor(x.b0, y.b0)) + bit_count(xor(x.b1, y.b1)) + bit_count(xor(x.b2, y.b2)) + bit_count(xor(x.b3, y.b3)))::INT AS distance FROM n x JOIN n y ON x.source = y.source AND x.hash < y.hash AND (x.b0 = y.b0 OR x.b1 = y.b1 OR x.b2 = y.b2 OR x.b3 = y.b3)),
e AS (SELECT * FROM d WHERE distance <= 5 UNION ALL SELECT source, hash, hash, 0 FROM j GROUP BY source, hash HAVING count(*) > 1),
near AS (SELECT 'near' AS kind, j.source AS in_source, distance, {SUMMARY} FROM e JOIN j ON j.source = e.source AND (j.hash = e.hash_a OR j.hash = e.hash_b) GROUP BY j.source, hash_a, hash_b, distance),
exact AS (SELECT 'exact' AS kind, source AS in_source, NULL::INT AS distance, {SUMMARY} FROM m GROUP BY source, digest HAVING count(*) > 1),
both_kinds AS (SELECT * FROM near UNION ALL SELECT * FROM exact), judged AS (SELECT *, CASE WHEN kind = 'exact' THEN conflicting_labels ELSE distance = 0 AND (conflicting_labels OR crosses_supplied_splits) END AS eligible FROM both_kinds)"""
COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}' AND {c}) AS {k}_{n}" for k in ("exact", "near") for n, c in (("clusters", "TRUE"), ("label_conflicts", "conflicting_labels"), ("cross_split", "crosses_supplied_splits"), ("quarantine", "eligible")))


@query("q56_audit_summary", f"WITH {M}, {H}, {KINDS} SELECT in_source, {COUNTS} FROM judged GROUP BY in_source")
def _(spark, d) -> DataFrame:
    return audit.audit_summary(*decided(spark, d))


@query("q57_distance_shares", f"WITH {M}, {H}, {KINDS} SELECT distance, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM near GROUP BY distance")
def _(spark, d) -> DataFrame:
    return rounded(audit.distance_shares(audit.near_edges(hashed_manifest(spark, d))))


@query("q58_balanced_weights", f"WITH {M}, c AS (SELECT source, label, count(*) AS n FROM m GROUP BY ALL) SELECT source, label, n, round(1 / ((SELECT count(DISTINCT source) FROM c) * count(*) OVER (PARTITION BY source) * n), 9) AS weight FROM c")
def _(spark, d) -> DataFrame:
    return rounded(splits.balanced_weights(manifest(spark, d), target="label"))


@query("q59_masked_loss", f"WITH {P}, x AS (SELECT path, target, list_filter([1, 2, 3], lambda i: i - 1 = target OR (event_id + i) % 2 = 0) AS kept, p FROM p) SELECT path, round(ln(list_sum(list_transform(kept, lambda i: exp(4 * p[i])))) - 4 * p[target + 1], 8) AS loss FROM x")
def _(spark, d) -> DataFrame:
    rows = predictions(spark, d).withColumns({"logits": F.transform("probs", lambda p: p * 4), "mask": F.array(*(((F.col("target") == k) | ((F.col("seq") + k + 1) % 2 == 0)) for k in range(3)))})
    return rows.select("path", F.round(arrays.masked_cross_entropy("logits", "mask", "target"), 8).alias("loss"))


@query(
    "q60_letterbox",
    """WITH s AS (SELECT p_partkey, p_size AS w, (p_partkey % 37 + 1)::INT AS h FROM part), r AS (SELECT *, least(64.0::DOUBLE / w, 64.0::DOUBLE / h) AS k FROM s), b AS (SELECT p_partkey, greatest(1, round_even(w * k, 0))::INT AS width, greatest(1, round_even(h * k, 0))::INT AS height FROM r)
SELECT p_partkey, floor((64 - width) / 2)::INT AS left_, floor((64 - height) / 2)::INT AS top_, width, height FROM b""",
)
def _(spark, d) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_partkey") % 37 + 1).cast("int").alias("h"))
    b = rows.select("p_partkey", scalars.letterbox("w", "h", 64).alias("b"))
    return b.select("p_partkey", F.col("b.left").alias("left_"), F.col("b.top").alias("top_"), "b.width", "b.height")


@query(
    "q61_derived_violations",
    f"""WITH {M}, s AS (SELECT *, CASE WHEN doc_id % 50 = 7 THEN NULL WHEN doc_id % 9 = 0 THEN 'test' ELSE 'train' END AS split FROM m), g AS (SELECT group_key, min(split) AS a, max(split) AS b FROM s WHERE group_key IS NOT NULL AND split IS NOT NULL GROUP BY group_key),
c AS (SELECT left(group_key, 4) AS component, min(a) AS a, max(b) AS b, string_agg(group_key, ', ' ORDER BY group_key) AS gs FROM g GROUP BY left(group_key, 4))
SELECT 'group' AS kind, 'group assigned to multiple splits: ' || group_key AS subject FROM g WHERE a <> b UNION ALL SELECT 'component', 'pHash-zero linked groups cross splits: ' || gs FROM c WHERE a <> b UNION ALL
SELECT 'missing', 'every record must have a group and derived split' FROM s WHERE group_key IS NULL OR split IS NULL HAVING count(*) > 0""",
)
def _(spark, d) -> DataFrame:
    split = F.when(F.col("seq") % 50 == 7, F.lit(None)).when(F.col("seq") % 9 == 0, "test").otherwise("train")
    rows = manifest(spark, d).withColumn("split", split)
    groups = rows.where("group_id is not null").select(F.concat("source", F.lit(":"), "group_id").alias("group_key")).distinct()
    return splits.derived_violations(rows, groups.withColumn("component", F.substring("group_key", 1, 4)))


@query(
    "q62_cross_source_near",
    f"""WITH {M}, {H}, {NEAR}, j AS (SELECT m.* REPLACE (m.source || ':' || path AS path), hash FROM m JOIN h USING (path)), e AS (SELECT * FROM d WHERE distance <= 5 UNION ALL SELECT hash, hash, 0 FROM j GROUP BY hash HAVING count(*) > 1)
SELECT hash_a, hash_b, distance, {SUMMARY} FROM e JOIN j ON j.hash = e.hash_a OR j.hash = e.hash_b GROUP BY hash_a, hash_b, distance HAVING count(DISTINCT source) > 1""",
)
def _(spark, d) -> DataFrame:
    return flat(audit.near_clusters(hashed_manifest(spark, d), across=True), "hash_a", "hash_b", "distance", *CLUSTER)


@query("q63_decision_counts", f"WITH {M}, {H}, x AS (SELECT list(source || ':' || path ORDER BY path) AS paths, count(DISTINCT label) > 1 AS bad FROM m GROUP BY source, digest HAVING count(*) > 1), z AS (SELECT list(m.source || ':' || m.path) AS paths, count(DISTINCT label) > 1 OR count(DISTINCT supplied_split) > 1 AS bad FROM m JOIN h USING (path) GROUP BY m.source, h.hash HAVING count(*) > 1), q AS (SELECT unnest(paths) AS key FROM x WHERE bad UNION SELECT unnest(paths) FROM z WHERE bad), s AS (SELECT paths, unnest(paths) AS key FROM x) SELECT (SELECT count(*) FROM q) AS quarantined, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM s WHERE key NOT IN (SELECT key FROM q) GROUP BY paths)) AS deduplicated")
def _(spark, d) -> DataFrame:
    exact, near = map(keyed, decided(spark, d, 0))
    rows = manifest(spark, d).withColumn("key", F.concat("source", F.lit(":"), "path"))
    return audit.apply_decisions(rows, exact, near)[1]


@query("q64_most_frequent", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def _(spark, d) -> DataFrame:
    return eda.most_frequent(table(spark, d, "part"), "p_type", 10)


@query("q65_frequent_groups", "SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang, source) AS group_rows FROM documents QUALIFY count(*) OVER (PARTITION BY lang, source) >= 15")
def _(spark, d) -> DataFrame:
    return eda.at_least(table(spark, d, "documents").select("doc_id", "lang", "source"), ("lang", "source"), 15)


@query("q66_rate_by_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg((l_tax > 0.04)::INT), 9) AS share FROM lineitem GROUP BY ALL")
def _(spark, d) -> DataFrame:
    return rounded(eda.rate(table(spark, d, "lineitem"), F.col("l_tax") > 0.04, ("l_returnflag", "l_linestatus")))


@query("q67_extents", "SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_linenumber) AS min_l_linenumber, max(l_linenumber) AS max_l_linenumber FROM lineitem")
def _(spark, d) -> DataFrame:
    return audit.extents(table(spark, d, "lineitem"), ("l_quantity", "l_linenumber"))


@query("q68_interval_text", f"WITH {P}, a AS (SELECT event_type, avg((target = pred)::INT) AS m, min(conf) AS lo, max(conf) AS hi FROM p GROUP BY event_type) SELECT event_type AS cohort, printf('%.2f [%.2f, %.2f]', 100 * m, 100 * lo, 100 * hi) AS told FROM a")
def _(spark, d) -> DataFrame:
    rows = metrics.with_prediction(predictions(spark, d)).groupBy("cohort").agg(F.avg((F.col("target") == F.col("prediction")).cast("double")).alias("m"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    return rows.select("cohort", scalars.interval_text("m", "lo", "hi").alias("told"))
