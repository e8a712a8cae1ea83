import json

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.audit import unmanifested
from cohortlens.sources import datasets, manifests, sinks
from cohortlens.sources.listing import image_files

ALL = ("amd", "dme", "normal")


def put(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(b"x")


def read(spark, source, root, labels=ALL):
    return datasets.records(spark, datasets.Dataset(source, source, str(root), labels)).orderBy("path").collect()


def test_duke(spark, tmp_path):
    put(tmp_path, "AMD1/scan.png", "AMD1/deep/er.TIF", "NORMAL2/a.txt", "OTHER3/x.png", "loose.png")
    rows = read(spark, "duke", tmp_path)
    assert [(r.path, r.label, r.group_id, r.eye_id, r.label_unit) for r in rows] == [("AMD1/deep/er.TIF", "amd", "AMD1", "AMD1", "eye"), ("AMD1/scan.png", "amd", "AMD1", "AMD1", "eye")]


def test_kermany(spark, tmp_path):
    put(tmp_path, "train/CNV/CNV-123-1.jpeg", "train/DRUSEN/DRUSEN-456-1.jpeg", "test/NORMAL/NORMAL-9-9-2.jpeg")
    rows = read(spark, "kermany", tmp_path)
    assert [(r.label, r.group_id, r.supplied_split) for r in rows] == [("normal", "9-9", "test"), ("amd", "123", "train"), ("amd", "456", "train")]
    put(tmp_path, "train/CNV/DME-1-1.jpeg")
    with pytest.raises(Exception, match="unexpected file name"):
        read(spark, "kermany", tmp_path)


def test_octdl(spark, tmp_path):
    put(tmp_path, "NO/normal_1.jpg", "AMD/amd_1.jpg")
    (tmp_path / "labels.csv").write_text("file_name,disease,patient_id\nnormal_1,NO,patient-1\namd_1,amd,\nx,ERM,1\n")
    assert [(r.path, r.label, r.group_id) for r in read(spark, "octdl", tmp_path)] == [("AMD/amd_1.jpg", "amd", None), ("NO/normal_1.jpg", "normal", "patient-1")]
    (tmp_path / "labels.csv").write_text("file_name,disease,patient_id\ngone,NO,1\n")
    with pytest.raises(Exception, match="missing image"):
        read(spark, "octdl", tmp_path)


def test_octid(spark, tmp_path):
    put(tmp_path, "AMRD/a.jpeg", "NORMAL/b.jpeg", "CSR/c.jpeg")
    assert [(r.raw_label, r.label, r.group_id) for r in read(spark, "octid", tmp_path)] == [("AMRD", "amd", None), ("NORMAL", "normal", None)]


def test_paima(spark, tmp_path):
    put(tmp_path, "CNV/1/Scan.JPG", "NORMAL/2/b.jpg")
    (tmp_path / "data_information.csv").write_text("Patient ID,Class,Eye,B-scan,Label,Directory\npatient-1,CNV,OD,1,CNV,CNV/1/scan.jpg\n,NORMAL,OS,1,normal,NORMAL/2/b.jpg\n3,X,OD,1,OTHER,none.jpg\n")
    rows = read(spark, "paima", tmp_path)
    assert [(r.path, r.label, r.group_id, r.eye_id, r.cohort) for r in rows] == [("CNV/1/Scan.JPG", "amd", "CNV/patient-1", "CNV/patient-1/OD", "CNV"), ("NORMAL/2/b.jpg", "normal", None, None, "NORMAL")]
    (tmp_path / "data_information.csv").write_text("Patient ID,Class,Eye,B-scan,Label,Directory\n1,CNV,OD,1,CNV,CNV/1/other.jpg\n")
    with pytest.raises(Exception, match="missing image"):
        read(spark, "paima", tmp_path)


def test_config(spark, tmp_path):
    put(tmp_path, "d/AMD1/a.png")
    config = tmp_path / "datasets.toml"
    config.write_text(f'[[datasets]]\nname = "one"\nsource = "duke"\nroot = "{tmp_path}/d"\navailable_labels = ["Normal", "amd"]\n[[datasets]]\nname = "two"\nsource = "octid"\nroot = "/nowhere"\navailable_labels = ["amd"]\nenabled = false\n')
    found = datasets.read_datasets(spark, str(config))
    assert [(d.name, d.available_labels, d.enabled) for d in found] == [("one", ("amd", "normal"), True), ("two", ("amd",), False)]
    assert [(r.source, r.label) for r in datasets.all_records(spark, found).collect()] == [("one", "amd")]
    with pytest.raises(FileNotFoundError):
        datasets.records(spark, found[1])
    with pytest.raises(ValueError, match="known are"):
        datasets.reader_of("other")
    config.write_text("x = 1\n")
    with pytest.raises(ValueError):
        datasets.read_datasets(spark, str(config))
    with pytest.raises(Exception, match="isn't available"):
        read(spark, "duke", tmp_path / "d", ("normal",))


def test_unmanifested(spark, tmp_path):
    put(tmp_path, "a.png", "b/c.jpg", "b/d.txt")
    listing = image_files(spark, str(tmp_path), ("png", "jpg"))
    assert [r.path for r in unmanifested(listing, spark.createDataFrame([("a.png",)], "path string")).collect()] == ["b/c.jpg"]


LINE = {"source": "duke", "raw_label": "AMD", "label": "amd", "available_labels": ["amd", "normal"], "group_id": "1", "label_unit": "eye", "eye_id": "e"}


@pytest.fixture
def run(tmp_path):
    (tmp_path / "manifests").mkdir()
    (tmp_path / "manifests/duke.jsonl").write_text("".join(json.dumps(LINE | {"path": p, "label": t, "group_id": g}) + "\n" for p, t, g in (("a", "amd", "1"), ("b", "normal", None))))
    run = tmp_path / "run"
    (run / "evaluations/x").mkdir(parents=True)
    (run / "predictions-test").mkdir()
    text = "path,target,prediction,probability_normal,probability_amd\na,amd,amd,0.2,0.8\nb,normal,amd,0.4,0.6\n"
    for name in ("predictions-test.csv", "predictions-test/duke.csv", "evaluations/x/predictions.csv"):
        (run / name).write_text(text)
    (run / "dataset.json").write_text('{"source": "duke"}')
    (run / "metrics-test.json").write_text('{"accuracy": 0.5, "by_source": {"duke": {"accuracy": 0.25}}}')
    (run / "evaluations/x/metrics.json").write_text('{"target_source": "duke", "full_source": true}')
    return tmp_path


def test_discovery(spark, run):
    found = manifests.discover_predictions(spark, str(run / "run"), str(run / "manifests"))
    assert [(s.name, s.classes, s.label_unit, s.full_source) for s in found] == [("test-duke", ("normal", "amd"), "eye", False)] * 2 + [("eval-x", ("normal", "amd"), "eye", True)]
    assert found[1].reference == {"accuracy": 0.25}
    assert [(r.path, r.target, r.group_key, r.probs) for r in found[0].rows.orderBy("path").collect()] == [("a", 1, "duke:1", [0.2, 0.8]), ("b", 0, "duke:path:b", [0.4, 0.6])]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("path,target,probability_amd\na,amd,1\n", "fewer than two"),
        ("path,target,probability_amd,probability_normal\n", "no rows"),
        ("path,target,probability_amd,probability_normal\nz,amd,1,0\n", "isn't in the manifest"),
        ("path,target,probability_amd,probability_normal\na,normal,1,0\n", "isn't the manifest's label"),
    ],
)
def test_bad_predictions(spark, run, text, error):
    (run / "run/predictions-test.csv").write_text(text)
    with pytest.raises(ValueError, match=error):
        manifests.discover_predictions(spark, str(run / "run"), str(run / "manifests"))


def test_nothing_to_discover(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        manifests.discover_predictions(spark, str(tmp_path), str(tmp_path))


def test_duplicate_keys(spark, tmp_path):
    (tmp_path / "duke.json").write_text(json.dumps({"exact_duplicates": [{"paths": ["a", "b"], "labels": []}], "near_duplicates": [{"paths": ["b", "c"], "distance": 2}]}, indent=1))
    assert sorted(r.key for r in manifests.duplicate_keys(spark, str(tmp_path), "duke").collect()) == ["a", "b", "c"]
    assert manifests.duplicate_keys(spark, str(tmp_path), "none").collect() == []


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s", 1, 0, [0.75, 0.25])], "path string, source string, target int, prediction int, probs array<double>")
    sinks.write_predictions(rows, ("n", "m"), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).orderBy(F.desc("value")).first().value == "path,source,target,prediction,probability_n,probability_m"
    sinks.write_rows([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "b int, a int")], str(tmp_path / "t"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "t"), header=True).collect()) == [("1", None), ("3", "2")]
    value = sinks.safe({"x": float("nan"), "y": [1.0, float("inf")], "z": (2, {"w": "t"})})
    assert value == {"x": None, "y": [1.0, None], "z": [2, {"w": "t"}]}
    sinks.write_document(spark, value, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == value
    with pytest.raises(ValueError):
        sinks.write_document(spark, {"x": float("nan")}, str(tmp_path / "e.json"))
    path = sinks.new_run_directory(spark, str(tmp_path), "s", "a", "n")
    assert path.endswith("/s/a/n")
    with pytest.raises(FileExistsError):
        sinks.new_run_directory(spark, str(tmp_path), "s", "a", "n")


def test_split_definition(spark, tmp_path):
    (tmp_path / "m").write_text("manifest")
    hashes = {"s": sinks.content_hash(spark, str(tmp_path / "m"))}
    import hashlib

    assert hashes["s"] == hashlib.sha256(b"manifest").hexdigest()
    assignments = spark.createDataFrame([("g2", "test"), ("g1", "train")], "group_key string, split string")
    path = str(tmp_path / "split.json")
    assert sinks.reused_definition(spark, path, hashes, {}) is None
    sinks.write_split_definition(spark, path, assignments, 5, {"ratios": [0.5, 0.5]}, hashes, {})
    assert sorted(map(tuple, sinks.reused_definition(spark, path, hashes, {}).collect())) == [("g1", "train"), ("g2", "test")]
    with pytest.raises(ValueError, match="other inputs"):
        sinks.reused_definition(spark, path, {"s": "0"}, {})
