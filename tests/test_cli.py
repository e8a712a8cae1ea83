import json
import random

import numpy as np

from cohortlens import cli
from tests.test_images import png, speckle


def rows_of(spark, path):
    return [r.asDict() for r in spark.read.json(str(path)).collect()]


def test_from_images_to_splits(spark, tmp_path):
    root = tmp_path / "data"
    for i in range(9):
        folder = root / f"{('AMD', 'DME', 'NORMAL')[i % 3]}{i}"
        folder.mkdir(parents=True)
        for k in range(2):
            (folder / f"{k}.png").write_bytes(png(speckle(24, 20, seed=10 * i + k)))
    (root / "AMD0/copy.png").write_bytes((root / "AMD0/0.png").read_bytes())
    (root / "AMD0/bad.png").write_bytes(b"nothing")
    (root / "loose.png").write_bytes(png(np.zeros((4, 4), np.uint8)))
    config = tmp_path / "datasets.toml"
    config.write_text(f'[[datasets]]\nname = "duke"\nsource = "duke"\nroot = "{root}"\navailable_labels = ["normal", "amd", "dme"]\n')
    assert cli.main(["audit", str(config), "--output", str(tmp_path / "audit")], spark) == 1  # one image is invalid
    assert [r["path"] for r in rows_of(spark, tmp_path / "audit/duke/invalid_images")] == ["AMD0/bad.png"]
    assert [r["path"] for r in rows_of(spark, tmp_path / "audit/duke/unmanifested")] == ["loose.png"]
    assert [r["paths"] for r in rows_of(spark, tmp_path / "audit/duke/exact_duplicates")] == [["AMD0/0.png", "AMD0/copy.png"]]
    assert cli.main(["manifest", str(config), "--output", str(tmp_path / "manifests")], spark) == 0
    kept = rows_of(spark, tmp_path / "manifests/duke.jsonl")
    assert len(kept) == 19 and "AMD0/copy.png" not in {r["path"] for r in kept}
    assert cli.main(["splits", str(tmp_path / "manifests/duke.jsonl"), "--near", str(tmp_path / "audit/duke/near_duplicates"), "--output", str(tmp_path / "splits")], spark) == 0
    done = rows_of(spark, tmp_path / "splits/manifest.jsonl")
    assert len(done) == 19 and {r["split"] for r in done} <= {"train", "val", "test"}
    assert cli.main(["folds", str(tmp_path / "manifests/duke.jsonl"), "--output", str(tmp_path / "cv"), "--folds", "3", "--validation-groups-per-class", "1"], spark) == 0
    assert spark.read.json(str(tmp_path / "cv/folds")).where("split = 'test'").count() == 9
    assert cli.main(["validate-splits", str(config), "--output", str(tmp_path / "valid")], spark) == 0
    assert cli.main(["features", str(config), "--output", str(tmp_path / "features")], spark) == 0
    assert spark.read.csv(str(tmp_path / "features"), header=True).count() == 19


def test_audit_finds_duplicates_across_sources(spark, tmp_path):
    same, text = png(speckle(24, 20, seed=1)), ""
    for name in ("one", "two"):
        (tmp_path / name / "AMD0").mkdir(parents=True)
        (tmp_path / name / "AMD0/0.png").write_bytes(same)
        text += f'[[datasets]]\nname = "{name}"\nsource = "duke"\nroot = "{tmp_path / name}"\navailable_labels = ["normal", "amd", "dme"]\n'
    (tmp_path / "datasets.toml").write_text(text)
    cli.main(["audit", str(tmp_path / "datasets.toml"), "--output", str(tmp_path / "audit")], spark)
    for table in ("cross_source_exact", "cross_source_near"):
        (row,) = rows_of(spark, tmp_path / "audit/cross-source" / table)
        assert row["crosses_sources"] and len(row["paths"]) == 2


def test_analysis_and_campaign(spark, tmp_path):
    rnd = random.Random(1)
    (tmp_path / "manifests").mkdir()
    (tmp_path / "audits").mkdir()
    names = ("normal", "amd", "dme")
    rows = [(f"eye{e}/{i}.tif", names[e % 3], f"{e}") for e in range(6) for i in range(3)]
    (tmp_path / "manifests/duke.jsonl").write_text("".join(json.dumps({"path": p, "source": "duke", "raw_label": t, "label": t, "available_labels": list(names), "group_id": g, "eye_id": g, "label_unit": "eye"}) + "\n" for p, t, g in rows))
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "dataset.json").write_text('{"source": "duke"}')
        lines = ["path,target,prediction," + ",".join(f"probability_{n}" for n in names)]
        right = 0
        for p, t, _ in rows:
            w = [rnd.random() + (0.6 if n == t else 0) for n in names]
            guess = names[w.index(max(w))]
            right += guess == t
            lines.append(",".join([p, t, guess, *(repr(x / sum(w)) for x in w)]))
        (tmp_path / run / "predictions-test.csv").write_text("\n".join(lines) + "\n")
        (tmp_path / run / "metrics-test.json").write_text(json.dumps({"accuracy": right / len(rows)}))
    common = ["--manifests", str(tmp_path / "manifests"), "--n-boot", "20", "--n-boot-auroc", "5"]
    assert cli.main(["analyze", str(tmp_path / "a"), "--audits", str(tmp_path / "audits"), "--output", str(tmp_path / "out"), *common], spark) == 0
    check = {r["metric"]: r["matches"] for r in rows_of(spark, tmp_path / "out/test-duke/reference_check")}
    assert check["accuracy"] is True
    assert rows_of(spark, tmp_path / "out/test-duke/eye_metrics")[0]["rows"] == 6
    assert cli.main(["campaign", "demo", "--runs", str(tmp_path / "a"), str(tmp_path / "b"), "--output", str(tmp_path / "table"), *common], spark) == 0
    table = spark.read.csv(str(tmp_path / "table"), header=True).collect()
    assert {r["mode"] for r in table} == {"shared"} and {r["rows"] for r in table} == {"18"} and {r["units"] for r in table} == {"6"}
    assert len(table) == 7
    assert cli.main(["campaign", "demo", "--runs", str(tmp_path / "a"), str(tmp_path / "b"), "--eye-level", "--output", str(tmp_path / "both"), *common], spark) == 0
    both = spark.read.csv(str(tmp_path / "both"), header=True).collect()
    assert len(both) == 14 and {(r["level"], r["rows"], r["units"]) for r in both} == {("image", "18", "6"), ("eye", "6", "6")}
