"""Arrays in compressed shards: a data source with a two-phase writer, and a reader.

Rows are (name, shape, data): data holds float32 values, or for a mask one byte of 0 or 1 for each cell, which is stored as a
bit. A task writes shards of its own under temporary names; when all tasks are done, the driver renames what successful ones
have told of and writes the manifest last. A lost task leaves files that no manifest names, and another attempt writes its own.
Shards are zip files of arrays that numpy reads. Names within a table should differ; repeated ones are all kept.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cohortlens.storage import ship

ROWS = "name string, mask boolean, shape array<int>, data binary"
MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """Shards of a task: temporary name, final name, and number of arrays."""

    shards: list[tuple[str, str, int]]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def packed(rows: list[tuple[str, bool, list[int], bytes]]) -> bytes:
    """A zip file of arrays; masks as bits, with their names and shapes in an index."""
    index = [{"name": name, "mask": mask, "shape": shape} for name, mask, shape, _ in rows]
    arrays = {f"a{i}": np.packbits(np.frombuffer(data, "u1") != 0) if mask else np.frombuffer(data, "<f4").reshape(shape) for i, (_, mask, shape, data) in enumerate(rows)}
    out = io.BytesIO()
    np.savez_compressed(out, index=np.frombuffer(json.dumps(index).encode(), "u1"), **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> Iterator[tuple[str, bool, list[int], bytes]]:
    with np.load(io.BytesIO(data)) as held:
        for i, told in enumerate(json.loads(held["index"].tobytes())):
            cells = held[f"a{i}"]
            if told["mask"]:
                cells = np.unpackbits(cells, count=int(np.prod(told["shape"])))
            yield told["name"], told["mask"], told["shape"], cells.tobytes()


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, shard_bytes: int):
        self.path, self.shard_bytes = path, shard_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _place(self.path)
        system.create_dir(base, recursive=True)
        attempt, rows, held, shards = uuid.uuid4().hex, [], 0, []

        def flush() -> None:
            name = f"{attempt}-{len(shards):05d}.npz"
            with system.open_output_stream(posixpath.join(base, f"_{name}.part")) as out:
                out.write(packed(rows))
            shards.append((f"_{name}.part", name, len(rows)))

        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "mask", "shape", "data")), strict=True):
                rows.append(row)
                held += len(row[3])
                if held >= self.shard_bytes:
                    flush()
                    rows, held = [], 0
        if rows:
            flush()
        return Written(shards)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _place(self.path)
        shards = sorted(s for m in messages if m for s in m.shards)
        for part, name, _ in shards:
            system.move(posixpath.join(base, part), posixpath.join(base, name))
        with system.open_output_stream(posixpath.join(base, MANIFEST)) as out:
            out.write(json.dumps([{"file": name, "arrays": n} for _, name, n in shards]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _place(self.path)
        for part, _, _ in (s for m in messages if m for s in m.shards):
            system.delete_file(posixpath.join(base, part))


class ArrayArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_archive"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("shard_bytes", 64 << 20)))


def write_arrays(df: DataFrame, path: str, shard_bytes: int = 64 << 20) -> None:
    """Writes the rows (name, mask, shape, data) of df to a folder that must not hold an archive yet."""
    system, base = _place(path)
    if system.get_file_info(posixpath.join(base, MANIFEST)).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} holds an archive")
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(ArrayArchive)
    df.select("name", "mask", "shape", "data").write.format("array_archive").mode("append").option("shard_bytes", shard_bytes).save(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(name, mask, shape, data) of the shards that the manifest names."""
    system, base = _place(path)
    with system.open_input_stream(posixpath.join(base, MANIFEST)) as given:
        files = [s["file"] for s in json.loads(given.read())]
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _place(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(posixpath.join(folder, name)) as given:
                    names, masks, shapes, data = zip(*unpacked(given.read()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(masks, pa.bool_()), pa.array(shapes, pa.list_(pa.int32())), pa.array(data, pa.binary())], ["name", "mask", "shape", "data"])

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(max(1, len(files)), "file").mapInArrow(run, ROWS)
