"""Commands: ``python -m cohortlens.cli <command> ...``. Each reads files, runs operators and writes files.

| Command | Reads | Writes |
|-|-|-|
| audit | dataset configuration | tables of each source's report, and of duplicates across sources; fails if integrity does |
| manifest | dataset configuration | a manifest of each source without quarantined records and copies |
| validate-splits | dataset configuration | violations of supplied splits |
| splits | manifests | assignments, a definition with hashes of its inputs, and manifests with splits |
| folds | a manifest | assignments of all folds, partitioned by fold |
| features | dataset configuration | a feature row for each image |
| analyze | a run's predictions, manifests, audits | all tables of each prediction set |
| campaign | several runs | one table over their sets |
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import audit, bootstrap, campaign, eda, images, metrics, splits
from cohortlens.plans.reports import analysis_report, audit_report
from cohortlens.schema import IMAGE_SUFFIXES
from cohortlens.sources import datasets, manifests, sinks
from cohortlens.sources.listing import image_files, qualified
from cohortlens.storage import ship, written

RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}
RATIOS_WITH_TEST = {"train": 0.85, "val": 0.15}


def _enabled(spark: SparkSession, config: str) -> list[datasets.Dataset]:
    return [d for d in datasets.read_datasets(spark, config) if d.enabled]


def _profiles(spark: SparkSession, dataset: datasets.Dataset) -> DataFrame:
    base = len(qualified(spark, dataset.root)) + 2
    found = images.image_profiles(images.decoded(spark, dataset.root))
    place = F.regexp_replace("origin", "^(file:)//(?=/)", "$1")
    return found.withColumn("path", F.substring(place, base, 1 << 30)).drop("origin")


def _written(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}")


def run_audit(spark: SparkSession, a: argparse.Namespace) -> int:
    failures, parts = [], []
    for d in _enabled(spark, a.config):
        rows, profiles = datasets.records(spark, d), written(_profiles(spark, d), "profiles")
        parts.append(rows.drop("digest", "hash").join(profiles, "path", "left"))
        report = audit_report(rows, profiles, image_files(spark, d.root, IMAGE_SUFFIXES).select("path"), a.max_hash_distance)
        _written({k: v for k, v in report.items() if not k.startswith("cross_source_")}, f"{a.output}/{d.name}")
        invalid = report["invalid_images"].count()
        failures += [f"{d.name}: {r.message}" for r in audit.integrity_failures(invalid, report["exact_duplicates"], report["near_duplicates"]).orderBy("position").collect()]
    if parts:
        both = reduce(DataFrame.unionByName, parts)
        across = {"cross_source_exact": audit.exact_clusters(both, across=True), "cross_source_near": audit.near_clusters(both, a.max_hash_distance, across=True)}
        _written(across, f"{a.output}/cross-source")
    print("\n".join(failures))
    return int(bool(failures))


def run_manifest(spark: SparkSession, a: argparse.Namespace) -> int:
    for d in _enabled(spark, a.config):
        profiles = written(_profiles(spark, d), "profiles")  # several branches of the report read them
        report = audit_report(datasets.records(spark, d), profiles, image_files(spark, d.root, IMAGE_SUFFIXES).select("path"), a.max_hash_distance)
        named = [report[k].withColumn("paths", F.transform("paths", lambda p: F.concat("in_source", F.lit(":"), p))) for k in ("exact_duplicates", "near_duplicates")]
        rows = datasets.records(spark, d).withColumns({"key": F.concat("source", F.lit(":"), "path"), "seq": F.xxhash64("path")})
        kept, counts = audit.apply_decisions(rows, *named)
        sinks.write_manifest(kept.drop("key", "seq"), f"{a.output}/{d.name}.jsonl")
        print(d.name, counts.first().asDict())
    return 0


def run_validate(spark: SparkSession, a: argparse.Namespace) -> int:
    parts = [splits.supplied_violations(datasets.records(spark, d)).withColumn("source", F.lit(d.name)) for d in _enabled(spark, a.config)]
    rows = reduce(DataFrame.unionByName, parts)
    rows.write.json(a.output)
    return int(not rows.where("kind in ('duplicate_path', 'leaked_group')").isEmpty())


def _clusters(spark: SparkSession, path: str | None) -> DataFrame:
    shape = "paths array<string>, distance int"
    if not path:
        return spark.createDataFrame([], shape)
    rows = spark.read.schema("in_source string, paths array<string>, distance int").json(path)
    return rows.select(F.transform("paths", lambda p: F.concat("in_source", F.lit(":"), p)).alias("paths"), "distance")


def run_splits(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = manifests.read_manifest(spark, a.manifest, checked=True)
    hashes = {"manifest": sinks.content_hash(spark, a.manifest)}, {"near": sinks.content_hash(spark, f"{a.near}/*.json")} if a.near else {}
    path = f"{a.output}/definition.json"
    clusters = _clusters(spark, a.near)
    assigned = None if a.replace_definition else sinks.reused_definition(spark, path, *hashes)
    if assigned is None:
        ratios = RATIOS_WITH_TEST if a.keep_supplied_test else RATIOS
        assigned, _ = splits.derived_splits(rows, clusters, ratios, a.seed, a.keep_supplied_test, a.by_runs)
        sinks.write_split_definition(spark, path, assigned, a.seed, {"ratios": ratios, "keep_supplied_test": a.keep_supplied_test} | ({"by_runs": True} if a.by_runs else {}), *hashes)
    done = splits.applied(rows, assigned)
    violations = splits.derived_violations(done, splits.group_components(rows, clusters)).collect()
    if violations:
        raise ValueError("; ".join(r.subject for r in violations))
    sinks.write_manifest(done, f"{a.output}/manifest.jsonl")
    splits.split_counts(done).coalesce(1).write.json(f"{a.output}/counts")
    return 0


def run_folds(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = manifests.read_manifest(spark, a.manifest, checked=True)
    folds = splits.stratified_folds(rows, _clusters(spark, a.near), a.folds, a.validation_groups_per_class, a.seed)
    folds.write.partitionBy("fold").json(f"{a.output}/folds")
    sinks.write_split_definition(spark, f"{a.output}/definition.json", folds, a.seed, {"folds": a.folds, "validation_groups_per_class": a.validation_groups_per_class}, {"manifest": sinks.content_hash(spark, a.manifest)}, {})
    return 0


def run_features(spark: SparkSession, a: argparse.Namespace) -> int:
    tables = []
    for d in _enabled(spark, a.config):
        base = len(qualified(spark, d.root)) + 2
        found = images.image_features(images.decoded(spark, d.root)).withColumn("path", F.substring(F.regexp_replace("origin", "^(file:)//(?=/)", "$1"), base, 1 << 30)).drop("origin")
        meta = datasets.records(spark, d).select("source", "path", "label", "raw_label", "group_id", "supplied_split")
        tables.append(eda.artifact_columns(meta.join(found, "path")))
    sinks.write_rows(tables, a.output)
    return 0


def run_analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    for s in manifests.discover_predictions(spark, a.run, a.manifests):
        known = manifests.duplicate_keys(spark, a.audits, s.source)
        tables = analysis_report(s.rows, s.classes, known, s.label_unit, a.n_boot, a.n_boot_auroc, a.seed, a.gallery, a.max_per_group, a.tree_draws)
        if s.reference:
            names = [n for n in ("accuracy", "balanced_accuracy", "macro_f1", "macro_auroc") if n in s.reference]
            saved = spark.createDataFrame([(n, None if s.reference[n] is None else float(s.reference[n])) for n in names], "metric string, value double")
            tables["reference_check"] = metrics.compare_metrics(metrics.long_metrics(tables["metrics"], ["accuracy", "balanced_accuracy", "macro_f1", "macro_auroc"]), saved)
        _written(tables, f"{a.output}/{s.name}")
    return 0


def run_campaign(spark: SparkSession, a: argparse.Namespace) -> int:
    by_set: dict[str, list[DataFrame]] = {}
    classes: dict[str, set[tuple[str, ...]]] = {}
    units: dict[str, set[str]] = {}
    for i, run in enumerate(a.runs):
        for s in manifests.discover_predictions(spark, run, a.manifests):
            by_set.setdefault(s.name, []).append(metrics.with_prediction(s.rows).withColumn("run", F.lit(f"run{i}")))
            classes.setdefault(s.name, set()).add(s.classes)
            units.setdefault(s.name, set()).add(s.label_unit)
    parts = []
    for name, rows in sorted(by_set.items()):
        if len(classes[name]) == 1:  # sets with other classes in another run are skipped
            both = reduce(DataFrame.unionByName, rows)
            weights = (bootstrap.tree_weights if a.tree_draws else bootstrap.multinomial_weights)(both, a.n_boot, a.seed, True)
            known = next(iter(classes[name]))
            parts.append(campaign.campaign_table(a.name, name, both, weights, known, auroc_replicates=a.n_boot_auroc))
            if a.eye_level and units[name] == {"eye"}:
                parts.append(campaign.campaign_table(a.name, name, campaign.by_eye(both, len(known)), weights, known, "eye", a.n_boot_auroc))
    reduce(DataFrame.unionByName, parts).coalesce(1).write.csv(a.output, header=True)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cohortlens")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *names: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run_command=run)
        for n in names:
            p.add_argument(n)
        p.add_argument("--output", required=True)
        return p

    for name, run in (("audit", run_audit), ("manifest", run_manifest)):
        command(name, run, "config").add_argument("--max-hash-distance", type=int, default=5)
    command("validate-splits", run_validate, "config")
    p = command("splits", run_splits, "manifest")
    p.add_argument("--near")
    p.add_argument("--seed", type=int, default=20260913)
    p.add_argument("--keep-supplied-test", action="store_true")
    p.add_argument("--replace-definition", action="store_true")
    p.add_argument("--by-runs", action="store_true", help="deal units of equal label counts together: for any number of units, without a seed")
    p = command("folds", run_folds, "manifest")
    p.add_argument("--near")
    p.add_argument("--seed", type=int, default=20260913)
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--validation-groups-per-class", type=int, default=3)
    command("features", run_features, "config")
    analyze, many = command("analyze", run_analyze, "run"), command("campaign", run_campaign, "name")
    many.add_argument("--runs", nargs="+", required=True)
    many.add_argument("--eye-level", action="store_true", help="also rows by eye, for sets that are labelled by eye")
    analyze.add_argument("--audits", required=True)
    analyze.add_argument("--gallery", type=int, default=24)
    analyze.add_argument("--max-per-group", type=int, default=3)
    for p in (analyze, many):
        p.add_argument("--manifests", required=True)
        p.add_argument("--n-boot", type=int, default=2000)
        p.add_argument("--tree-draws", action="store_true", help="draw replicates by a tree of splits: for any number of groups")
        p.add_argument("--n-boot-auroc", type=int, default=500)
        p.add_argument("--seed", type=int, default=20260927)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    session = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(session)
    return a.run_command(session, a)


if __name__ == "__main__":
    raise SystemExit(main())
