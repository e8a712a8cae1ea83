import math
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from cohortlens import catalog
from cohortlens.plans import reports, views
from cohortlens.streaming import confusions

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float) or (hasattr(value, "as_tuple")):
        return "nan" if math.isnan(value) else repr(round(float(value), 7) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf_dir, database, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    found = database.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True), key=lambda x: x[0])) for r in found.fetchall())
    assert sorted(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in rows) == want


def test_greedy_split(spark, sf_dir):
    rows = catalog.QUERIES["q34_greedy_split"](spark, sf_dir).collect()
    assert {r.split for r in rows} == {"train", "val", "test"} and len({r.group_key for r in rows}) == len(rows)


def test_contract(spark):
    assert contract.entry(spark).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_works_without_the_optional_parts(tmp_path):
    code = "import sys; sys.modules['cohortlens.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_audit_report(spark, sf_dir):
    rows = views.manifest(spark, sf_dir)
    out = reports.audit_report(rows, sketches=views.sketches(spark, sf_dir), listing=rows.select("path"))
    assert {"counters", "groups", "unmanifested", "exact_duplicates", "near_duplicates", "cross_source_exact", "cross_source_near"} <= set(out)
    assert out["unmanifested"].count() == 0 and out["exact_duplicates"].count() > 0
    assert all(r.crosses_sources for r in out["cross_source_near"].collect())


def test_analysis_report(spark, sf_dir):
    rows = views.predictions(spark, sf_dir)
    out = reports.analysis_report(rows, views.CLASSES, spark.createDataFrame([("ev:1",)], "key string"), "eye", replicates=10, auroc_replicates=2)
    assert {name: df.count() > 0 for name, df in out.items()} == dict.fromkeys(out, True)
    assert out["controls"].count() <= 72 and {r.kind for r in out["controls"].collect()} == {"control"}


def test_stream_totals_equal_batch(spark, sf_dir, tmp_path):
    from cohortlens.operators import metrics

    rows = views.predictions(spark, sf_dir).select("target", "probs", "cohort")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = confusions.stream_of(spark, str(tmp_path / "in"), rows)
    confusions.to_memory(confusions.running_class_counts(stream, 3, ("cohort",)), "running_counts")
    want = metrics.class_counts(metrics.with_prediction(rows), 3, ("cohort",))
    assert sorted(spark.table("running_counts").collect()) == sorted(want.collect())


def test_stream_windows(spark, sf_dir, tmp_path):
    rows = views.predictions(spark, sf_dir).join(views.table(spark, sf_dir, "events").selectExpr("event_id as seq", "cast(ts as timestamp) as ts"), "seq").select("ts", "target", "probs")
    rows.write.parquet(str(tmp_path / "in"))
    stream = confusions.stream_of(spark, str(tmp_path / "in"), rows)
    confusions.to_memory(confusions.windowed_accuracy(stream, "ts", "1 day"), "daily_accuracy")
    assert spark.table("daily_accuracy").selectExpr("sum(rows)").first()[0] == rows.count()


def test_a_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from cohortlens import storage

    def session(master, found=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: found), sparkContext=context)

    assert storage.shared_dir(session("yarn", "hdfs://store/shared/")) == "hdfs://store/shared"
    assert storage.shared_dir(session("local[4]")).startswith("file://") and storage.shared_dir(session("local")).startswith("file://")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            storage.shared_dir(session(master))
