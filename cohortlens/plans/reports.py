"""Whole reports: the audit of a source, and the analysis of a prediction set. Each is a dict of lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import audit, bootstrap, calibration, curves, gallery, metrics, slices


def audit_report(manifest: DataFrame, profiles: DataFrame | None = None, listing: DataFrame | None = None, most: int = 5, sketches: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of one or more sources: counters, groups, extents and distributions of decodable images, invalid paths,
    unmanifested files, and classified exact and near duplicates.

    ``profiles`` has path and the columns of an image profile, null where decoding failed; what couldn't be decoded counts
    in the counters, but in no statistic. ``sketches`` (path, hash) stands in for perceptual hashes."""
    columns = {c: F.col(c) for c in ("label", "raw_label", "supplied_split")} | {"suffix": audit.suffix()}
    rows = manifest
    out: dict[str, DataFrame] = {}
    if profiles is not None:
        rows = manifest.drop("digest", "hash").join(profiles, "path", "left")
        out["invalid_images"] = rows.where("width is null").select("source", "path")
        known = rows.where("width is not null").withColumn("aspect", F.col("width") / F.col("height"))
        out["extents"] = audit.extents(known, ("width", "height"))
        for c in ("width", "height", "aspect", "mean", "stdev", "p01", "p99"):
            out[f"{c}_distribution"] = audit.distribution(known, c)
        columns["mode"] = F.col("mode")
    if sketches is not None:
        rows = rows.drop("hash").join(sketches, "path", "left")
    out["counters"] = audit.counters(rows, columns)
    out["groups"] = audit.group_sizes(manifest)
    if listing is not None:
        out["unmanifested"] = audit.unmanifested(listing, manifest)
    if "digest" in rows.columns:
        out["exact_duplicates"] = audit.classified(audit.exact_clusters(rows), True)
        out["cross_source_exact"] = audit.exact_clusters(rows, across=True)
    if "hash" in rows.columns:
        out["near_duplicates"] = audit.classified(audit.near_clusters(rows, most), False)
        out["cross_source_near"] = audit.near_clusters(rows, most, across=True)
    return out


def analysis_report(rows: DataFrame, classes: tuple[str, ...], duplicates: DataFrame, label_unit: str = "image", replicates: int = 2000, auroc_replicates: int = 500, seed: int = 20260927, gallery_size: int = 24, per_group: int = 3, tree_draws: bool = False) -> dict[str, DataFrame]:
    """Tables of one prediction set. ``duplicates`` has the ``key`` (source:path) of what is in a duplicate cluster.
    With ``tree_draws`` the bootstrap takes any number of groups."""
    n = len(classes)
    given = metrics.with_prediction(rows.withColumns({"run": F.lit("run"), "key": F.concat("source", F.lit(":"), "path")}))
    weights = (bootstrap.tree_weights if tree_draws else bootstrap.multinomial_weights)(given, replicates, seed, True)
    steps = curves.curve_steps(given)
    groups = slices.group_table(given, classes)
    out = {
        "metrics": metrics.point_metrics(given, n).crossJoin(metrics.macro_auroc(given)),  # one row each
        "confusion": metrics.confusion(given, n),
        "bootstrap": bootstrap.bootstrap(given, weights, classes, auroc_replicates),
        "rates": metrics.rates_by_class(given, n),
        "calibration": calibration.summary(given),
        "reliability": calibration.reliability(calibration.with_correct(given)),
        "classwise_error": calibration.classwise_error(given),
        "confidence_histogram": calibration.confidence_histogram(given),
        "roc": curves.roc_points(steps),
        "pr": curves.pr_points(steps),
        "average_precision": curves.average_precision(steps),
        "slices": slices.slice_metrics(slices.flagged(given, duplicates, "key"), classes),
        "groups": groups,
        "concentration": slices.error_concentration(groups),
        "errors": gallery.error_gallery(given, classes, gallery_size, per_group),
        "controls": gallery.control_sample(given, classes, gallery_size, per_group, seed),
    }
    if "normal" in classes:
        out["operating_points"] = curves.operating_points(given, classes.index("normal"))
    if label_unit == "eye":
        eyes = metrics.grouped(given, "eye_id", n)
        out["eye_metrics"] = metrics.point_metrics(eyes, n).crossJoin(metrics.macro_auroc(eyes))  # one row each
    return out
