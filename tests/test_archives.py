import json
import os

import numpy as np
import pytest

from cohortlens.sources import archives


def rows(n=40):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        shape = [int(x) for x in rng.integers(1, 9, 2)]
        mask = i % 3 == 0
        cells = (rng.random(shape) > 0.5).astype("u1") if mask else rng.random(shape).astype("<f4")
        out.append((f"image/{i}", mask, shape, bytearray(cells.tobytes())))
    return out


def plain(found):
    return sorted((r[0], r[1], list(r[2]), bytes(r[3])) for r in found)


def test_round_trip_and_shards(spark, tmp_path):
    given, path = rows(), str(tmp_path / "a")
    archives.write_arrays(spark.createDataFrame(given, archives.ROWS).repartition(3), path, shard_bytes=600)
    assert plain(archives.read_arrays(spark, path).collect()) == plain(given)
    told = json.loads((tmp_path / "a" / "manifest.json").read_text())
    assert len(told) > 3 and sum(s["arrays"] for s in told) == 40
    assert sorted(os.listdir(path)) == sorted([*(s["file"] for s in told), "manifest.json"])
    with pytest.raises(FileExistsError):
        archives.write_arrays(spark.createDataFrame(given, archives.ROWS), path)


def test_a_task_that_dies_leaves_no_archive(spark, tmp_path):
    """Files of a failed attempt aren't named; the next attempt is whole."""
    given, path = rows(), str(tmp_path / "b")
    df = spark.createDataFrame(given, archives.ROWS).repartition(4)
    dying = df.selectExpr("if(name = 'image/7', raise_error('lost'), name) as name", "mask", "shape", "data")
    with pytest.raises(Exception, match="lost"):
        archives.write_arrays(dying, path, shard_bytes=200)
    assert not os.path.exists(os.path.join(path, "manifest.json"))
    archives.write_arrays(df, path, shard_bytes=200)
    assert plain(archives.read_arrays(spark, path).collect()) == plain(given)


def test_empty_table(spark, tmp_path):
    archives.write_arrays(spark.createDataFrame([], archives.ROWS), str(tmp_path / "c"))
    assert archives.read_arrays(spark, str(tmp_path / "c")).collect() == []


def test_masks_are_bits():
    mask = ("m", True, [50, 40], bytes([1, 0, 0, 1] * 500))
    assert list(archives.unpacked(archives.packed([mask]))) == [mask] and len(archives.packed([mask])) < 700
