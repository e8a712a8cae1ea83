"""Queries on records: duplicates, splits, profiles, shares, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import audit, eda, gallery, slices, splits
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.views import manifest, sketches, table
from cohortlens.storage import written


def _h(text: str, n: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {n}))::BIGINT"


M = f"""m_k AS (SELECT doc_id, text, lang, n_chars, source AS origin, 's' || (regexp_extract(source, '\\d+')::INT % 4) AS source, {_h("doc_id || '-a'", 6)} AS k, {_h("md5(text) || '-l'", 6)} AS l, {_h("doc_id || '-b'", 6)} AS g, {_h("doc_id || '-c'", 6)} AS c FROM documents),
m AS (SELECT doc_id, doc_id::VARCHAR AS path, source, lang AS raw_label, ['normal', 'amd', 'dme'][(CASE WHEN k % 10 < 8 THEN l ELSE k END) % 3 + 1] AS label, CASE WHEN g % 50 <> 0 THEN 'g' || (g % 40) END AS group_id, CASE WHEN g % 50 <> 0 THEN source || ':g' || (g % 40) END AS group_key,
CASE WHEN source <> 's0' THEN CASE WHEN c % 5 = 0 THEN 'test' ELSE 'train' END END AS supplied_split, md5(text) AS digest, n_chars, origin FROM m_k)"""
H = f"""h_t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM documents), h_c AS (SELECT doc_id, {_h("t", 4)} % 64 AS s, count(*) AS n FROM h_t GROUP BY ALL),
h_f AS (SELECT d.doc_id, k.s, coalesce(c.n, 0) AS n FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS s) k LEFT JOIN h_c c ON c.doc_id = d.doc_id AND c.s = k.s), h_m AS (SELECT doc_id, median(n) AS med FROM h_f GROUP BY doc_id),
h_b AS (SELECT doc_id, s // 16 AS band, sum(CASE WHEN n > med THEN (1 << (15 - s % 16)::INT) ELSE 0 END)::BIGINT AS v FROM h_f JOIN h_m USING (doc_id) GROUP BY ALL),
h AS (SELECT doc_id::VARCHAR AS path, max(v) FILTER (band = 0) AS b0, max(v) FILTER (band = 1) AS b1, max(v) FILTER (band = 2) AS b2, max(v) FILTER (band = 3) AS b3, printf('%04x%04x%04x%04x', max(v) FILTER (band = 0), max(v) FILTER (band = 1), max(v) FILTER (band = 2), max(v) FILTER (band = 3)) AS hash FROM h_b GROUP BY doc_id)"""
SUMMARY = """string_agg(path, ',' ORDER BY path) AS paths, coalesce(string_agg(DISTINCT group_key, ',' ORDER BY group_key), '') AS group_keys, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, coalesce(string_agg(DISTINCT supplied_split, ',' ORDER BY supplied_split), '') AS supplied_splits,
count(DISTINCT group_key) > 1 AS crosses_groups, count(DISTINCT supplied_split) > 1 AS crosses_supplied_splits, count(DISTINCT label) > 1 AS conflicting_labels"""
LISTS = ("paths", "group_keys", "labels", "supplied_splits", "quarantine_reasons")
HEX = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Lists as texts, and hashes in hex."""
    kinds = dict(df.dtypes)
    return df.select(*(F.array_join(c, ",").alias(c) if kinds[c].startswith("array") else HEX(F.col(c)).alias(c) if c.startswith("hash_") else F.col(c) for c in columns))


def hashed_manifest(spark, d) -> DataFrame:
    """The manifest with its sketches, which are computed once and written: plans on duplicates read them in several branches."""
    return manifest(spark, d).join(written(sketches(spark, d), "sketches"), "path")


CLUSTER = ("paths", "group_keys", "labels", "supplied_splits", "crosses_groups", "crosses_supplied_splits", "conflicting_labels")


@query("q21_worst_n_per_source", f"WITH {M}, r AS (SELECT source, path, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM m) SELECT * FROM r WHERE rank <= 8")
def _(spark, d) -> DataFrame:
    return gallery.worst_of_each(manifest(spark, d), ("source",), [F.desc("n_chars"), F.asc("seq")]).select("source", "path", "n_chars", "rank")


@query("q23_exact_dup_clusters", f"WITH {M} SELECT source AS in_source, {SUMMARY} FROM m GROUP BY source, digest HAVING count(*) > 1")
def _(spark, d) -> DataFrame:
    return flat(audit.exact_clusters(manifest(spark, d)), "in_source", *CLUSTER)


@query("q24_cross_source_dups", f"WITH {M}, k AS (SELECT * REPLACE (source || ':' || path AS path) FROM m) SELECT digest, {SUMMARY} FROM k GROUP BY digest HAVING count(DISTINCT source) > 1")
def _(spark, d) -> DataFrame:
    return flat(audit.exact_clusters(manifest(spark, d), across=True), "digest", *CLUSTER)


ELIGIBLE = f"""x AS (SELECT source, list(source || ':' || path ORDER BY path) AS paths, count(DISTINCT label) > 1 AS bad FROM m GROUP BY source, digest HAVING count(*) > 1),
z AS (SELECT m.source, list(m.source || ':' || m.path ORDER BY m.path) AS paths, count(DISTINCT label) > 1 AS bad_label, count(DISTINCT supplied_split) > 1 AS bad_split FROM m JOIN h USING (path) GROUP BY m.source, h.hash HAVING count(*) > 1)"""


@query(
    "q25_quarantine",
    f"""WITH {M}, {H}, {ELIGIBLE} SELECT 'exact' AS kind, array_to_string(paths, ',') AS paths, 'exact_label_conflict' AS quarantine_reasons FROM x WHERE bad UNION ALL
SELECT 'near', array_to_string(paths, ','), CASE WHEN bad_label THEN 'phash_zero_label_conflict' ELSE '' END || CASE WHEN bad_label AND bad_split THEN ',' ELSE '' END || CASE WHEN bad_split THEN 'phash_zero_split_crossing' ELSE '' END FROM z WHERE bad_label OR bad_split""",
)
def _(spark, d) -> DataFrame:
    exact, near = (keyed(c).where("quarantine_eligible") for c in decided(spark, d, 0))
    return flat(exact.withColumn("kind", F.lit("exact")), "kind", "paths", "quarantine_reasons").unionByName(flat(near.withColumn("kind", F.lit("near")), "kind", "paths", "quarantine_reasons"))


def decided(spark, d, most: int = 5) -> tuple[DataFrame, DataFrame]:
    rows = hashed_manifest(spark, d)
    return audit.classified(audit.exact_clusters(rows), True), audit.classified(audit.near_clusters(rows, most), False)


def keyed(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("paths", F.transform("paths", lambda p: F.concat("in_source", F.lit(":"), p)))


@query(
    "q26_canonical_manifest",
    f"""WITH {M}, {H}, {ELIGIBLE}, q AS (SELECT unnest(paths) AS key FROM x WHERE bad UNION SELECT unnest(paths) FROM z WHERE bad_label OR bad_split),
s AS (SELECT paths, unnest(paths) AS key FROM x), l AS (SELECT paths, min(key) AS least_key FROM s WHERE key NOT IN (SELECT key FROM q) GROUP BY paths),
c AS (SELECT s.key FROM s JOIN l USING (paths) WHERE s.key <> l.least_key)
SELECT source || ':' || path AS key, label, group_id FROM m WHERE source || ':' || path NOT IN (SELECT key FROM q) AND source || ':' || path NOT IN (SELECT key FROM c)""",
)
def _(spark, d) -> DataFrame:
    exact, near = map(keyed, decided(spark, d, 0))
    rows = manifest(spark, d).withColumn("key", F.concat("source", F.lit(":"), "path"))
    return audit.apply_decisions(rows, exact, near)[0].select("key", "label", "group_id")


NEAR = "n AS (SELECT DISTINCT hash, b0, b1, b2, b3 FROM h), d AS (SELECT x.hash AS hash_a, y.hash AS hash_b, (bit_count(xor(x.b0, y.b0)) + bit_count(xor(x.b1, y.b1)) + bit_count(xor(x.b2, y.b2)) + bit_count(xor(x.b3, y.b3)))::INT AS distance FROM n x JOIN n y ON x.hash < y.hash AND (x.b0 = y.b0 OR x.b1 = y.b1 OR x.b2 = y.b2 OR x.b3 = y.b3))"


@query("q27_near_dup_pairs", f"WITH {H}, {NEAR} SELECT * FROM d WHERE distance <= 5")
def _(spark, d) -> DataFrame:
    return flat(audit.near_pairs(sketches(spark, d)), "hash_a", "hash_b", "distance")


@query(
    "q28_near_dup_clusters",
    f"""WITH {M}, {H}, j AS (SELECT m.*, hash, b0, b1, b2, b3 FROM m JOIN h USING (path)), n AS (SELECT DISTINCT source, hash, b0, b1, b2, b3 FROM j),
d AS (SELECT x.source, x.hash AS hash_a, y.hash AS hash_b, (bit_count(xor(x.b0, y.b0)) + bit_count(xor(x.b1, y.b1)) + bit_count(xor(x.b2, y.b2)) + bit_count(xor(x.b3, y.b3)))::INT AS distance FROM n x JOIN n y ON x.source = y.source AND x.hash < y.hash AND (x.b0 = y.b0 OR x.b1 = y.b1 OR x.b2 = y.b2 OR x.b3 = y.b3)),
e AS (SELECT * FROM d WHERE distance <= 5 UNION ALL SELECT source, hash, hash, 0 FROM j GROUP BY source, hash HAVING count(*) > 1)
SELECT j.source AS in_source, hash_a, hash_b, distance, {SUMMARY} FROM e JOIN j ON j.source = e.source AND (j.hash = e.hash_a OR j.hash = e.hash_b) GROUP BY j.source, hash_a, hash_b, distance""",
)
def _(spark, d) -> DataFrame:
    return flat(audit.near_clusters(hashed_manifest(spark, d)), "in_source", "hash_a", "hash_b", "distance", *CLUSTER)


@query(
    "q29_components",
    f"""WITH RECURSIVE {M}, {H}, j AS (SELECT group_key, source || hash AS hash FROM m JOIN h USING (path) WHERE group_key IS NOT NULL), e AS (SELECT DISTINCT x.group_key AS a, y.group_key AS b FROM j x JOIN j y USING (hash)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS group_key, min(b) AS component FROM r GROUP BY a""",
)
def _(spark, d) -> DataFrame:
    rows = hashed_manifest(spark, d)
    return splits.group_components(rows, keyed(audit.near_clusters(rows, 0)))


@query(
    "q30_validate_splits",
    f"""WITH {M} SELECT 'duplicate_path' AS kind, path AS subject, NULL AS splits FROM m GROUP BY path HAVING count(*) > 1 UNION ALL
SELECT 'leaked_group', group_key, string_agg(DISTINCT supplied_split, ',' ORDER BY supplied_split) FROM m WHERE group_key IS NOT NULL GROUP BY group_key HAVING count(DISTINCT supplied_split) > 1 UNION ALL SELECT 'without_group', (count(*) FILTER (group_id IS NULL))::VARCHAR, NULL FROM m""",
)
def _(spark, d) -> DataFrame:
    return splits.supplied_violations(manifest(spark, d))


@query("q31_split_counts", f"WITH {M} SELECT supplied_split AS split, label, count(*) AS n FROM m GROUP BY ALL")
def _(spark, d) -> DataFrame:
    return splits.split_counts(manifest(spark, d), F.col("supplied_split"))


@query("q32_group_split_hash", f"WITH {M}, g AS (SELECT DISTINCT group_key, {_h('group_key', 8)} / 4294967296 AS v FROM m WHERE group_key IS NOT NULL) SELECT group_key, CASE WHEN v < 0.7 THEN 'train' WHEN v < 0.85 THEN 'val' ELSE 'test' END AS split FROM g")
def _(spark, d) -> DataFrame:
    return splits.hash_group_splits(manifest(spark, d), {"train": 70, "val": 15, "test": 15})


@query("q33_cv_folds_hash", f"WITH {M}, g AS (SELECT group_key, min(label) AS label FROM m WHERE group_key IS NOT NULL GROUP BY group_key) SELECT label, group_key, (row_number() OVER (PARTITION BY label ORDER BY {_h('group_key', 8)}, group_key) - 1) % 5 AS fold FROM g")
def _(spark, d) -> DataFrame:
    return splits.hash_folds(manifest(spark, d), 5)


@query("q34_greedy_split")
def _(spark, d) -> DataFrame:
    rows = hashed_manifest(spark, d).where("group_id is not null")
    return splits.derived_splits(rows, keyed(audit.near_clusters(rows, 0)), {"train": 0.7, "val": 0.15, "test": 0.15}, 20260913)[0]


Q5 = "round(min({c}), 9) AS min, round(quantile_cont({c}, 0.05), 9) AS p05, round(quantile_cont({c}, 0.5), 9) AS median, round(quantile_cont({c}, 0.95), 9) AS p95, round(max({c}), 9) AS max"


@query("q39_distribution", f"WITH {M} SELECT 'n_chars' AS of, source AS key, {Q5.format(c='n_chars::DOUBLE')} FROM m GROUP BY source UNION ALL SELECT 'l_quantity', l_returnflag, {Q5.format(c='l_quantity')} FROM lineitem GROUP BY l_returnflag")
def _(spark, d) -> DataFrame:
    chars = audit.distribution(manifest(spark, d), "n_chars", ("source",)).withColumnRenamed("source", "key").withColumn("of", F.lit("n_chars"))
    return rounded(chars.unionByName(audit.distribution(table(spark, d, "lineitem"), "l_quantity", ("l_returnflag",)).withColumnRenamed("l_returnflag", "key").withColumn("of", F.lit("l_quantity"))))


@query("q40_counters_grouping_sets", f"WITH {M} SELECT counter, value, count(*) AS n FROM (SELECT unnest([{{'counter': 'label', 'value': label}}, {{'counter': 'raw_label', 'value': raw_label}}, {{'counter': 'supplied_split', 'value': supplied_split}}, {{'counter': 'suffix', 'value': '<none>'}}], recursive := true) FROM m) WHERE value IS NOT NULL GROUP BY ALL")
def _(spark, d) -> DataFrame:
    return audit.counters(manifest(spark, d), {"label": F.col("label"), "raw_label": F.col("raw_label"), "supplied_split": F.col("supplied_split"), "suffix": audit.suffix()})


@query("q41_group_sizes", f"WITH {M}, s AS (SELECT count(*)::DOUBLE AS n FROM m WHERE group_key IS NOT NULL GROUP BY group_key) SELECT count(*) AS group_count, (SELECT count(*) FROM m WHERE group_id IS NULL) AS images_without_group, {Q5.format(c='n')} FROM s")
def _(spark, d) -> DataFrame:
    return rounded(audit.group_sizes(manifest(spark, d)))


@query("q42_share_within_class", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(spark, d) -> DataFrame:
    return rounded(eda.share_within(eda.group_counts(table(spark, d, "lineitem"), ("l_returnflag", "l_linestatus")), ("l_returnflag",)))


@query("q43_tail_bucket", "WITH k AS (SELECT p_size FROM part GROUP BY p_size HAVING count(*) >= 40), b AS (SELECT p_brand, CASE WHEN p_size IN (SELECT p_size FROM k) THEN p_size::VARCHAR ELSE 'other' END AS p_size FROM part) SELECT p_brand, p_size, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 9) AS share FROM b GROUP BY p_brand, p_size")
def _(spark, d) -> DataFrame:
    return rounded(eda.share_within(eda.group_counts(eda.tail_bucketed(table(spark, d, "part").select("p_brand", F.col("p_size").cast("string").alias("p_size")), "p_size", 40), ("p_brand", "p_size")), ("p_brand",)))


@query("q44_outer_share", f"WITH {M}, s AS (SELECT source || raw_label AS key, supplied_split, label FROM m WHERE label <> 'amd' OR source = 's1'), a AS (SELECT key, count(*) / sum(count(*)) OVER () AS train FROM s WHERE supplied_split = 'train' AND label = 'normal' GROUP BY key), b AS (SELECT key, count(*) / sum(count(*)) OVER () AS test FROM s WHERE supplied_split = 'test' AND label <> 'normal' GROUP BY key) SELECT key, round(coalesce(train, 0), 9) AS train, round(coalesce(test, 0), 9) AS test FROM a FULL JOIN b USING (key)")
def _(spark, d) -> DataFrame:
    rows = manifest(spark, d).where("label <> 'amd' or source = 's1'").withColumn("key", F.concat("source", "raw_label"))
    return rounded(eda.outer_shares(rows.where("supplied_split = 'train' and label = 'normal'"), rows.where("supplied_split = 'test' and label <> 'normal'"), "key", ("train", "test")))


@query("q45_quartiles", "SELECT source, lang, count(*) AS n, round(quantile_cont(n_chars::DOUBLE, 0.25), 9) AS q1, round(quantile_cont(n_chars::DOUBLE, 0.5), 9) AS q2, round(quantile_cont(n_chars::DOUBLE, 0.75), 9) AS q3 FROM documents GROUP BY ALL HAVING count(*) >= 10")
def _(spark, d) -> DataFrame:
    return rounded(eda.quantiles(table(spark, d, "documents"), "n_chars", ("source", "lang"), {"q1": 0.25, "q2": 0.5, "q3": 0.75}, 10))


@query("q46_fixed_hist", "WITH v AS (SELECT event_type, least(floor((value - 5.0) / (50.0 - 5.0) * 14), 13)::INT AS bin FROM events WHERE value BETWEEN 5 AND 50) SELECT event_type, bin, round(5.0 + bin * 45.0 / 14, 9) AS bin_low, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 9) AS share FROM v GROUP BY event_type, bin")
def _(spark, d) -> DataFrame:
    return rounded(eda.fixed_histogram(table(spark, d, "events"), "value", 5.0, 50.0, 14, ("event_type",)))


@query("q47_prevalence_unpivot", "SELECT l_returnflag, unnest(['large', 'discounted']) AS artifact, round(unnest([avg((l_quantity > 45)::INT), avg((l_discount > 0.05)::INT)]), 9) AS prevalence FROM lineitem GROUP BY l_returnflag")
def _(spark, d) -> DataFrame:
    return rounded(eda.prevalence_long(table(spark, d, "lineitem"), {"large": F.col("l_quantity") > 45, "discounted": F.col("l_discount") > 0.05}, ("l_returnflag",)))


@query("q48_unmanifested_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d) -> DataFrame:
    return audit.unmanifested(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("q49_membership_semi", "SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS in_duplicate_cluster FROM documents d")
def _(spark, d) -> DataFrame:
    return slices.flagged(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("toxic = 1"), "doc_id")
