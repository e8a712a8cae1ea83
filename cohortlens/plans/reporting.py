"""Queries on audit messages, reviews, reports and definitions, bound to the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.operators import audit, splits
from cohortlens.plans.records import ELIGIBLE, H, M, SUMMARY, decided, flat
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.views import manifest, table
from cohortlens.sources import manifests, sinks
from cohortlens.storage import new_path

# Messages of an audit that fails, by reason.
TOLD = [
    (1, "EXISTS (SELECT 1 FROM x WHERE bad)", "exact duplicate components have conflicting labels"),
    (2, "EXISTS (SELECT 1 FROM z WHERE bad_label)", "pHash-distance-zero components have conflicting labels"),
    (3, "EXISTS (SELECT 1 FROM z WHERE bad_split)", "pHash-distance-zero components cross supplied splits"),
]
CLUSTERS = f"""j AS (SELECT m.*, hash, b0, b1, b2, b3 FROM m JOIN h USING (path)), n AS (SELECT DISTINCT source, hash, b0, b1, b2, b3 FROM j),
d AS (SELECT x.source, x.hash AS hash_a, y.hash AS hash_b, (bit_count(xor(x.b0, y.b0)) + bit_count(xor(x.b1, y.b1)) + bit_count(xor(x.b2, y.b2)) + bit_count(xor(x.b3, y.b3)))::INT AS distance FROM n x JOIN n y ON x.source = y.source AND x.hash < y.hash AND (x.b0 = y.b0 OR x.b1 = y.b1 OR x.b2 = y.b2 OR x.b3 = y.b3)),
e AS (SELECT * FROM d WHERE distance <= 5 UNION ALL SELECT source, hash, hash, 0 FROM j GROUP BY source, hash HAVING count(*) > 1),
k AS (SELECT j.source AS in_source, hash_a, hash_b, distance, {SUMMARY} FROM e JOIN j ON j.source = e.source AND (j.hash = e.hash_a OR j.hash = e.hash_b) GROUP BY j.source, hash_a, hash_b, distance)"""


@query("q94_integrity_messages", f"WITH {M}, {H}, {ELIGIBLE} " + " UNION ALL ".join(f"SELECT {i} AS position, '{text}' AS message WHERE {when}" for i, when, text in TOLD))
def _(spark, d) -> DataFrame:
    exact, near = decided(spark, d)
    return audit.integrity_failures(0, exact, near)


@query("q95_review_clusters", f"WITH {M}, {H}, {CLUSTERS} SELECT in_source, hash_a, hash_b, distance, paths FROM k WHERE NOT (distance = 0 AND (conflicting_labels OR crosses_supplied_splits)) AND distance IN (0, 2, 3, 4, 5)")
def _(spark, d) -> DataFrame:
    near = decided(spark, d)[1]
    return flat(audit.review_clusters(near, False, [0, 2, 3, 4, 5]), "in_source", "hash_a", "hash_b", "distance", "paths")


@query("q96_duplicate_keys", f"WITH {M}, {H}, {CLUSTERS}, x AS (SELECT unnest(list(path)) AS path FROM m WHERE source = 's1' GROUP BY digest HAVING count(*) > 1) SELECT 's1:' || path AS key FROM x UNION SELECT 's1:' || unnest(string_split(paths, ',')) FROM k WHERE in_source = 's1'")
def _(spark, d) -> DataFrame:
    """Everything in a duplicate cluster of one source, from its audit written as a document and read again."""
    folder, name = new_path(spark, "audits"), F.transform("paths", lambda p: F.concat("in_source", F.lit(":"), p)).alias("paths")
    own = [df.where("in_source = 's1'").select(F.struct(name).alias("c")) for df in decided(spark, d)]
    parts = [df.agg(F.sort_array(F.collect_list("c")).alias(n)) for df, n in zip(own, ("exact_duplicates", "near_duplicates"), strict=True)]
    parts[0].crossJoin(parts[1]).coalesce(1).write.json(f"{folder}/s1.json")  # one row each
    return manifests.duplicate_keys(spark, folder, "s1")


@query("q97_finite_or_null", "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0) AS known, round(sum(value) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0), 6) AS total FROM events GROUP BY event_type")
def _(spark, d) -> DataFrame:
    odd = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("-inf")).otherwise(F.col("value"))
    rows = table(spark, d, "events").select("event_type", scalars.finite_or_null(odd).alias("v"))
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("v").alias("known"), F.sum("v").alias("total")), 6)


@query("q98_split_definition", f"WITH {M}, g AS (SELECT DISTINCT group_key, ('0x' || substr(md5(group_key), 1, 8))::BIGINT / 4294967296 AS v FROM m WHERE group_key IS NOT NULL) SELECT group_key, CASE WHEN v < 0.7 THEN 'train' WHEN v < 0.85 THEN 'val' ELSE 'test' END AS split FROM g")
def _(spark, d) -> DataFrame:
    """A definition of splits, written with the hash of what it was made from and reused."""
    path = new_path(spark, "definition")
    made = splits.hash_group_splits(manifest(spark, d), {"train": 70, "val": 15, "test": 15})
    hashes = {"manifest": sinks.content_hash(spark, f"{d}/documents.parquet")}, {}
    sinks.write_split_definition(spark, path, made, 0, {"ratios": [70, 15, 15]}, *hashes)
    return sinks.reused_definition(spark, path, *hashes).select("group_key", "split")
