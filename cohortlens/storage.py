"""Where intermediate tables are kept, and how the package reaches the executors."""

from __future__ import annotations

import gc
import hashlib
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one is set, but only if driver and executors are
    one process: on a cluster they would not see the same folder, and that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cohortlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/cohortlens/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once into the shared folder and reread; this cuts the lineage and survives lost executors."""
    return stored(df, label)[0]


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``written``, and where the table is, for ``erase`` once nothing reads it any more."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def let_go(spark: SparkSession) -> None:
    """Lets the session delete the shuffle files of plans that nothing refers to any more: it does so when the driver
    collects garbage, which between large steps may be long after."""
    for _ in range(2):  # the first one finds the plans, the second what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def erase(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_SHIPPED: set[str] = set()
#: Sizes of Arrow batches: Spark's own value, with which long texts fill tens of MB on both sides of each worker, and ours.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1500"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"))


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application: Python functions in plans are sent by name. Arrow
    batches of rows become smaller, unless the session has chosen a size."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder, out = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(folder.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(f"{folder.name}/{file.relative_to(folder).as_posix()}"), file.read_bytes())
    data = out.getvalue()
    place = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{folder.name}/{folder.name}-{hashlib.sha256(data).hexdigest()[:16]}.zip")
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(place):
        part = place.suffix(f".{uuid.uuid4().hex}")
        stream = system.create(part, True)
        stream.write(bytearray(data))
        stream.close()
        system.rename(part, place)
    context.addPyFile(place.toString())
    for name, own, less in BATCHES:
        if spark.conf.get(name) == own:
            spark.conf.set(name, less)
    _SHIPPED.add(context.applicationId)
