"""Queries that bind file formats, record checks, feature columns and summaries to the test tables, and their SQL.

Queries on files write their whole table to the shared folder and read it again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import arrays
from cohortlens.operators import audit, bootstrap, campaign, curves, eda, metrics, probe, splits
from cohortlens.plans.campaigns import PER_RUN, RUNS, R, boot_sql, runs
from cohortlens.plans.evaluation import STEPS, P
from cohortlens.plans.records import M
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.views import CLASSES, manifest, predictions, table
from cohortlens.schema import MANIFEST, label_violations, unit_key
from cohortlens.sources import manifests, sinks
from cohortlens.storage import new_path

ALL = "['amd', 'dme', 'normal']"


def whole(rows: DataFrame) -> DataFrame:
    """Records with every column of the manifest schema."""
    given = {"label_unit": F.lit("image")}
    return rows.select(*((F.col(f.name) if f.name in rows.columns else given.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in MANIFEST.fields))


@query("q69_fold_metrics", f"WITH {P.replace('p AS (SELECT *', 'q AS (SELECT *')}, p AS (SELECT event_id % 5 AS run, * FROM q), {PER_RUN} SELECT run AS fold, rows, round(accuracy, 9) AS accuracy, round(balanced_accuracy, 9) AS balanced_accuracy, round(macro_f1, 9) AS macro_f1, round(macro_auroc, 9) AS macro_auroc, round(ece, 9) AS ece FROM rm JOIN ra USING (run) JOIN re USING (run)")
def _(spark, d) -> DataFrame:
    return rounded(campaign.per_run(predictions(spark, d).withColumn("fold", F.col("seq") % 5), 3, ("fold",)))


@query(
    "q70_manifest_lines",
    f"""WITH {M} SELECT to_json({{'available_labels': {ALL}, 'cohort': NULL, 'eye_id': NULL, 'group_id': group_id, 'label': label, 'label_unit': 'image', 'path': path, 'raw_label': raw_label, 'source': source, 'split': NULL, 'supplied_split': supplied_split}})::VARCHAR AS value FROM m""",
)
def _(spark, d) -> DataFrame:
    path = new_path(spark, "manifest")
    sinks.write_manifest(whole(manifest(spark, d)), path)
    return spark.read.text(path)


@query("q71_split_records", f"WITH {M} SELECT path, source, label, group_id, {len(CLASSES)} AS labels, 'image' AS label_unit FROM m WHERE supplied_split = 'test'")
def _(spark, d) -> DataFrame:
    path = new_path(spark, "manifest")
    sinks.write_manifest(whole(manifest(spark, d)).withColumn("split", F.col("supplied_split")), path)
    return manifests.read_split(spark, path, "test").select("path", "source", "label", "group_id", F.size("available_labels").alias("labels"), "label_unit")


OFFERED = "CASE WHEN source = 's1' THEN ['normal', 'amd'] WHEN source = 's2' THEN ['dme', 'normal'] ELSE ['amd', 'dme', 'normal'] END"


def offered(rows: DataFrame) -> DataFrame:
    lists = {"s1": ("normal", "amd"), "s2": ("dme", "normal")}
    some = F.when(F.lit(False), F.col("available_labels"))
    for source, names in lists.items():
        some = some.when(F.col("source") == source, F.array(*map(F.lit, names)))
    return rows.withColumn("available_labels", some.otherwise(F.col("available_labels")))


@query("q72_label_violations", f"WITH {M} SELECT path, source, label FROM m WHERE NOT list_contains({OFFERED}, label)")
def _(spark, d) -> DataFrame:
    return label_violations(offered(manifest(spark, d))).select("path", "source", "label")


@query("q73_units", f"WITH {M} SELECT coalesce(group_key, source || ':path:' || path) AS unit, count(*) AS records, count(DISTINCT label) AS labels FROM m GROUP BY unit")
def _(spark, d) -> DataFrame:
    return manifest(spark, d).groupBy(unit_key().alias("unit")).agg(F.count("*").alias("records"), F.count_distinct("label").alias("labels"))


@query("q74_prediction_files", f"WITH {P} SELECT path, 'ev' AS source, target, round(p[1], 9) AS p0, round(p[2], 9) AS p1, round(p[3], 9) AS p2, g AS eye_id, 'ev:' || g AS group_key, event_type AS cohort, event_type AS raw_label FROM p")
def _(spark, d) -> DataFrame:
    given = metrics.with_prediction(predictions(spark, d))
    path = new_path(spark, "predictions")
    sinks.write_predictions(given, CLASSES, path)
    names = F.array(*map(F.lit, CLASSES))
    known = whole(given.select("path", "source", "raw_label", F.element_at(names, F.col("target") + 1).alias("label"), names.alias("available_labels"), F.col("group_key").alias("group_id"), "eye_id", "cohort"))
    rows = manifests.read_predictions(spark, path, known, "test-ev", "ev").rows
    return rounded(rows.select("path", "source", "target", *(F.element_at("probs", k + 1).alias(f"p{k}") for k in range(3)), "eye_id", "group_key", "cohort", "raw_label"))


@query("q75_rows_csv", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name, NULL::VARCHAR AS n_nationkey, NULL::VARCHAR AS n_name FROM region UNION ALL SELECT n_regionkey::VARCHAR, NULL, n_nationkey::VARCHAR, n_name FROM nation")
def _(spark, d) -> DataFrame:
    path = new_path(spark, "rows")
    regions, nations = table(spark, d, "region").select("r_regionkey", "r_name"), table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"), "n_name")
    sinks.write_rows([regions, nations], path)
    return spark.read.csv(path, header=True)


FEATURES = "f AS (SELECT p_partkey, p_size + 10 AS width, (p_partkey % 37 + 10)::INT AS height, (p_partkey % 5)::INT AS white_top, (p_partkey % 70)::INT AS white_bottom, (p_partkey % 11) / 100 AS white_frac, (p_partkey % 7) / 500 AS black_frac, p_partkey % 2 = 0 AS white_touch_top, (p_size % 9)::DOUBLE AS p99_all, (p_partkey % 8)::DOUBLE AS p99_content FROM part)"


def features(spark, d) -> DataFrame:
    """Image features drawn from columns of ``part``."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", (size + 10).alias("width"), (key % 37 + 10).cast("int").alias("height"), (key % 5).cast("int").alias("white_top"), (key % 70).cast("int").alias("white_bottom"),
        ((key % 11) / 100).alias("white_frac"), ((key % 7) / 500).alias("black_frac"), (key % 2 == 0).alias("white_touch_top"), (size % 9).cast("double").alias("p99_all"), (key % 8).cast("double").alias("p99_content"),
    )


@query("q76_artifact_columns", f"WITH {FEATURES} SELECT p_partkey, width || 'x' || height AS size, white_frac > 0.005 AS has_white, black_frac > 0.005 AS has_black, round(least(width, height) / greatest(width, height), 9) AS canvas_fill, round(least(p99_content / greatest(p99_all, 1), 1), 9) AS content_ceiling, greatest(height - white_top - white_bottom, 1)::INT AS content_height FROM f")
def _(spark, d) -> DataFrame:
    return rounded(eda.artifact_columns(features(spark, d)).select("p_partkey", "size", "has_white", "has_black", "canvas_fill", "content_ceiling", "content_height"))


@query("q77_gallery_filters", f"WITH {FEATURES} SELECT 'white' AS kind, p_partkey FROM f WHERE white_frac > 0.05 UNION ALL SELECT 'top', p_partkey FROM f WHERE white_touch_top AND white_frac > 0.03 UNION ALL SELECT 'none', p_partkey FROM f WHERE white_frac = 0 AND black_frac = 0")
def _(spark, d) -> DataFrame:
    rows = features(spark, d)
    white, top, none = (eda.gallery_filter(rows, k).select(F.lit(k).alias("kind"), "p_partkey") for k in ("white", "top", "none"))
    return white.unionByName(top).unionByName(none)


@query(
    "q78_attention_summary",
    f"""WITH {P}, r AS (SELECT event_type AS kind, 'l' || (event_id % 2) AS layer, 'r' || (g::BIGINT % 2) AS role, target || '->' || pred AS cell, p[1] AS fill, CASE WHEN event_id % 3 <> 0 THEN p[2] END AS outside FROM p),
u AS (SELECT kind AS "group", layer, role, fill, outside FROM r UNION ALL SELECT kind || ':' || cell, layer, role, fill, outside FROM r)
SELECT "group", layer, role, count(*) AS n, round(avg(fill), 9) AS fill_mean, round(quantile_cont(fill, 0.5), 9) AS fill_median, round(avg(outside), 9) AS outside_mean, round(quantile_cont(outside, 0.5), 9) AS outside_median FROM u GROUP BY ALL""",
)
def _(spark, d) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = metrics.with_prediction(predictions(spark, d))
    user = F.col("group_key").cast("bigint")
    return rounded(
        eda.attention_summary(
            rows.select(
                F.col("cohort").alias("kind"), F.concat(F.lit("l"), (F.col("seq") % 2).cast("string")).alias("layer"), F.concat(F.lit("r"), (user % 2).cast("string")).alias("role"), text("target"), text("prediction"),
                F.element_at("probs", 1).alias("fill_mass"), F.element_at("probs", 2).alias("outside_mass"), (F.col("seq") % 3 != 0).alias("plausible"),
            )
        )
    )


@query(
    "q79_downsampled_steps",
    f"""WITH {P}, {STEPS}, o AS (SELECT k, v, tp, fp, row_number() OVER (PARTITION BY k ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM z WHERE np > 0 AND nn > 0)
SELECT k AS class, round(v, 9) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp FROM o WHERE n <= 200 OR list_contains(list_transform(range(200), lambda j: round_even(j * ((n - 1) / 199), 0)), i)""",
)
def _(spark, d) -> DataFrame:
    return rounded(curves.downsampled(curves.curve_steps(predictions(spark, d)), ("class",), "threshold").select("class", "threshold", "tp", "fp"))


@query("q80_common_classes", f"WITH {M} SELECT source, list_filter(['normal', 'amd', 'dme'], lambda x: list_contains({OFFERED}, x))::VARCHAR AS classes, count(*) AS n FROM m GROUP BY ALL")
def _(spark, d) -> DataFrame:
    rows = offered(manifest(spark, d)).withColumn("ours", F.array(*map(F.lit, CLASSES)))
    told = F.concat(F.lit("["), F.array_join("classes", ", "), F.lit("]")).alias("classes")
    return rows.select("source", arrays.common_classes("ours", "available_labels").alias("classes")).groupBy("source", told).agg(F.count("*").alias("n"))


@query("q81_applied_splits", f"WITH {M}, s AS (SELECT *, ('0x' || substr(md5(group_key), 1, 8))::BIGINT / 4294967296 AS v FROM m WHERE group_key IS NOT NULL) SELECT path, label, CASE WHEN v < 0.7 THEN 'train' WHEN v < 0.85 THEN 'val' ELSE 'test' END AS split FROM s")
def _(spark, d) -> DataFrame:
    rows = manifest(spark, d).where("group_id is not null")
    return splits.applied(rows, splits.hash_group_splits(rows, {"train": 70, "val": 15, "test": 15})).select("path", "label", "split")


BY_EYE = R.replace(", p AS (", ", q AS (") + """, e AS (SELECT run, g, min(target) AS target, [round(avg(p[1]), 12), round(avg(p[2]), 12), round(avg(p[3]), 12)] AS p FROM q GROUP BY run, g), p AS (SELECT *, list_position(p, list_max(p))::INT - 1 AS pred, list_max(p) AS conf FROM e)"""


@query(
    "q82_campaign_eyes",
    f"""WITH {BY_EYE}, {PER_RUN}, {boot_sql(20, 3)} SELECT 'demo' AS campaign, 'test-ev' AS set, 'eye' AS level, 'shared' AS mode, 3 AS runs, (SELECT count(*) FROM p WHERE run = 'r1') AS rows, (SELECT count(DISTINCT g) FROM p) AS units, metric, round(point, 9) AS point, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(sd, 9) AS run_sd FROM boot LEFT JOIN rs USING (metric)""",
)
def _(spark, d) -> DataFrame:
    eyes = campaign.by_eye(runs(spark, d), 3).withColumn("probs", F.transform("probs", lambda p: F.round(p, 12)))
    rows = metrics.with_prediction(eyes)
    return rounded(campaign.campaign_table("demo", "test-ev", rows, bootstrap.hash_weights(rows, 20, pack=True), CLASSES, "eye", 3))


@query("q83_bootstrap")
def _(spark, d) -> DataFrame:
    """All 2,000 multinomial draws, 500 of them for AUROC. SQL can't follow numpy's generator; a test has a brute-force version."""
    rows = runs(spark, d, RUNS[:1])
    return rounded(bootstrap.bootstrap(rows, bootstrap.multinomial_weights(rows, pack=True), CLASSES))


BATCH = """z AS (SELECT source, label, count(*) AS size FROM m GROUP BY ALL), y AS (SELECT source, label, size, row_number() OVER (PARTITION BY source ORDER BY label) - 1 AS at, count(*) OVER (PARTITION BY source) AS classes FROM z),
x AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS at, count(*) OVER () AS sources FROM (SELECT DISTINCT source FROM z)), o AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5(path)) - 1 AS number FROM m),
d AS (SELECT t.i, x.source, ('0x' || substr(md5('7:2:class:' || t.i), 1, 12))::BIGINT AS c, ('0x' || substr(md5('7:2:row:' || t.i), 1, 12))::BIGINT AS r FROM (SELECT unnest(range(6400)) AS i) t JOIN x ON x.at = t.i % 32 % x.sources)"""


@query("q84_balanced_batches", f"WITH {M}, {BATCH} SELECT d.i // 32 AS batch, d.i % 32 AS position, o.source, o.label, o.path FROM d JOIN y ON y.source = d.source AND y.at = d.c % y.classes JOIN o ON o.source = y.source AND o.label = y.label AND o.number = d.r % y.size")
def _(spark, d) -> DataFrame:
    rows = manifest(spark, d).select("source", "label", "path").repartition("path")
    return splits.balanced_batches(rows, 32, 200, seed=7, epoch=2, target="label", identity=F.col("path"))


@query(
    "q85_repeated_records",
    f"""WITH {M}, r AS (SELECT lang || '-' || (doc_id // 3) AS path, label, n_chars, text FROM m), x AS (SELECT text, list(DISTINCT path ORDER BY path) AS paths FROM r GROUP BY text HAVING count(DISTINCT path) > 1),
l AS (SELECT DISTINCT p.path FROM x, (SELECT text, unnest(paths) AS path FROM x) p WHERE p.text = x.text AND p.path <> x.paths[1]), k AS (SELECT * FROM r WHERE path NOT IN (SELECT path FROM l))
SELECT path, min(n_chars) AS n_chars, (SELECT count(*) FROM l) + (SELECT count(*) FROM k) - (SELECT count(DISTINCT path) FROM k) AS deduplicated FROM k GROUP BY path""".replace("md5(text) AS digest, n_chars, origin FROM m_k", "md5(text) AS digest, n_chars, origin, text, lang FROM m_k"),
)
def _(spark, d) -> DataFrame:
    """Records that share a path: those of one language among each three ids."""
    rows = manifest(spark, d).select(F.expr("concat(raw_label, '-', seq div 3)").alias("key"), "n_chars", "digest")
    several = rows.groupBy("digest").agg(F.sort_array(F.collect_set("key")).alias("paths")).where("size(paths) > 1").select("paths", F.lit(False).alias("quarantine_eligible"))
    kept, counts = audit.apply_decisions(rows, several, several.limit(0), order="n_chars")
    return kept.select(F.col("key").alias("path"), "n_chars").crossJoin(counts.select("deduplicated"))  # one row


@query(
    "q86_group_folds",
    """WITH RECURSIVE g AS (SELECT 'm' || (p_partkey % 3) AS source, p_brand || '-' || (p_size % 7) AS g, count(*) AS n FROM part GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, md5(g)) AS i FROM g),
r AS (SELECT source, 0::BIGINT AS i, NULL::VARCHAR AS g, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load FROM (SELECT DISTINCT source FROM g) UNION ALL
SELECT o.source, o.i, o.g, list_position(r.load, list_min(r.load))::INT - 1, list_transform(r.load, lambda x, k: CASE WHEN k = list_position(r.load, list_min(r.load)) THEN x + o.n ELSE x END) FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1)
SELECT source, g, fold FROM r WHERE i > 0""",
)
def _(spark, d) -> DataFrame:
    rows = table(spark, d, "part").select(F.expr("concat('m', p_partkey % 3)").alias("source"), F.expr("concat(p_brand, '-', p_size % 7)").alias("g"))
    return probe.group_folds(rows, "g", 5, ("source",))


PROBE = probe.Boosting(rounds=5, depth=3, bins=32, rate=0.3)


@query("q87_artifact_probe")
def _(spark, d) -> DataFrame:
    """Trees have no SQL; tests/test_probe.py has a slow version. Five rounds of three levels keep it short."""
    part = table(spark, d, "part").select("p_partkey", F.expr("concat('m', p_partkey % 3)").alias("source"), F.expr("concat('g', p_partkey % 97)").alias("group_id"))
    place = F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") % 3).otherwise((F.col("width") > 27).cast("int") + (F.col("white_bottom") > 35).cast("int"))
    rows = features(spark, d).join(part, "p_partkey").withColumn("label", F.element_at(F.array(*map(F.lit, CLASSES)), place.cast("int") + 1))
    sets = {"geometry": ("width", "height"), "all": ("width", "height", "white_top", "white_bottom", "white_frac", "black_frac")}
    return rounded(probe.probed(rows, sets, "label", "group_id", how=PROBE))


@query("q88_tree_draws", "SELECT unnest(range(200))::INT AS replicate, (SELECT count(DISTINCT user_id) FROM events) AS draws")
def _(spark, d) -> DataFrame:
    """Weights of a bootstrap by a tree of splits add up to the number of groups in each replicate."""
    return bootstrap.tree_weights(predictions(spark, d), 200).groupBy("replicate").agg(F.sum("w").alias("draws"))


@query(
    "q89_splits_by_runs",
    f"""WITH RECURSIVE {M}, u AS (SELECT group_key, count(*) FILTER (label = 'amd') AS a, count(*) FILTER (label = 'dme') AS b, count(*) FILTER (label = 'normal') AS c FROM m WHERE group_key IS NOT NULL GROUP BY group_key),
o AS (SELECT *, row_number() OVER (ORDER BY a + b + c DESC, a, b, c, md5(group_key)) AS i, row_number() OVER (PARTITION BY a, b, c ORDER BY md5(group_key)) - 1 AS place FROM u), t AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c FROM u),
g AS (SELECT list_transform([0.7, 0.15, 0.15], lambda r: [r * a, r * b, r * c]::DOUBLE[]) AS goal FROM t),
r AS (SELECT 0::BIGINT AS i, [[0, 0, 0], [0, 0, 0], [0, 0, 0]]::DOUBLE[][] AS have, 0::BIGINT AS s UNION ALL SELECT n.i, list_transform(n.have, lambda h, k: CASE WHEN k = n.s THEN [h[1] + n.x[1], h[2] + n.x[2], h[3] + n.x[3]] ELSE h END), n.s
FROM (SELECT o.i, r.have, [o.a, o.b, o.c]::DOUBLE[] AS x, list_transform([1, 2, 3], lambda k: list_sum(list_transform([1, 2, 3], lambda l: [o.a, o.b, o.c][l] * ([o.a, o.b, o.c][l] + 2 * (r.have[k][l] - goal[k][l])) / greatest(goal[k][l], 1)))) AS cost,
list_position(list_transform(cost, lambda v: v <= list_min(cost) + 1e-9), true) AS s FROM r JOIN o ON o.i = r.i + 1, g) n),
k AS (SELECT a, b, c, s, count(*) AS n FROM r JOIN o USING (i) GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY a, b, c ORDER BY s) AS until FROM k)
SELECT group_key, ['train', 'val', 'test'][s] AS split FROM o JOIN e USING (a, b, c) WHERE place < until AND place >= until - n""",
)
def _(spark, d) -> DataFrame:
    rows = manifest(spark, d).where("group_id is not null")
    alone = rows.select(F.concat("source", F.lit(":"), "group_id").alias("group_key")).distinct()
    units = splits.unit_table(rows, alone.withColumn("component", F.col("group_key")))
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    return splits.run_splits(units, ratios).select(F.col("component").alias("group_key"), "split")


@query("q90_rank_correlation", f"WITH {P}, a AS (SELECT event_type, count(*) OVER (PARTITION BY event_type, p[1]) AS nx, rank() OVER (PARTITION BY event_type ORDER BY p[1]) AS kx, count(*) OVER (PARTITION BY event_type, p[2]) AS ny, rank() OVER (PARTITION BY event_type ORDER BY p[2]) AS ky FROM p) SELECT event_type AS cohort, count(*) AS rows, round(corr(kx + (nx - 1) / 2, ky + (ny - 1) / 2), 9) AS spearman FROM a GROUP BY event_type")
def _(spark, d) -> DataFrame:
    rows = predictions(spark, d).select("cohort", F.element_at("probs", 1).alias("x"), F.element_at("probs", 2).alias("y"))
    return rounded(metrics.rank_correlation(rows, "x", "y", ("cohort",)))


@query("q91_cluster_members", f"WITH {M}, c AS (SELECT source, digest, min(path) AS representative FROM m GROUP BY source, digest HAVING count(*) > 1) SELECT source AS in_source, representative, path AS member FROM m JOIN c USING (source, digest)")
def _(spark, d) -> DataFrame:
    return audit.memberships(manifest(spark, d))[1].select("in_source", "representative", "member")


@query("q92_cluster_flags", f"WITH {M} SELECT digest, min(source || ':' || path) AS representative, count(*) AS members, count(DISTINCT group_key) > 1 AS crosses_groups, count(DISTINCT supplied_split) > 1 AS crosses_supplied_splits, count(DISTINCT label) > 1 AS conflicting_labels, true AS crosses_sources FROM m GROUP BY digest HAVING count(DISTINCT source) > 1")
def _(spark, d) -> DataFrame:
    return audit.memberships(manifest(spark, d), across=True)[0]


@query("q93_numbered_lines", f"WITH {M} SELECT path, label FROM m WHERE group_id IS NOT NULL")
def _(spark, d) -> DataFrame:
    """Records of a written manifest of many files, read with the check of each line and by their numbers."""
    path = new_path(spark, "manifest")
    sinks.write_manifest(whole(manifest(spark, d)).repartition(5), path)
    rows = manifests.read_manifest(spark, path, checked=True, numbered=True)
    return rows.where("group_id is not null and seq >= 1").select("path", "label")
