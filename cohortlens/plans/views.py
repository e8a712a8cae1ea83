"""Views that bind the operators to the star-schema, event and text tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.scalars import hashed
from cohortlens.storage import ship

CLASSES = ("normal", "amd", "dme")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str, run: int = 1) -> DataFrame:
    """A prediction for each event, with integer-ratio probabilities; runs after the first salt their hashes."""
    salt = "" if run == 1 else f"-r{run}"
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").withColumn("target", (F.col("user_id") % 3).cast("int"))
    weights = [1 + hashed(F.concat(F.col("event_id").cast("string"), F.lit(f"-{k}{salt}")), 4) % 1000 + F.when(F.col("target") == k, 600).otherwise(0) for k in range(3)]
    # Weights leave a generator, through which no filter is pushed: below it each test of a probability would hash anew.
    rows = rows.select("*", F.inline(F.array(F.struct(*(w.alias(f"w{k}") for k, w in enumerate(weights))))))
    whole = F.col("w0") + F.col("w1") + F.col("w2")
    user = F.col("user_id").cast("string")
    return rows.select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("path"), F.lit("ev").alias("source"), "target",
        F.array(*(F.col(f"w{k}").cast("double") / whole for k in range(3))).alias("probs"),
        user.alias("group_key"), user.alias("eye_id"), F.col("event_type").alias("cohort"), F.col("event_type").alias("raw_label"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest record for each document."""
    doc = F.col("doc_id").cast("string")
    k = hashed(F.concat(doc, F.lit("-a")), 6)
    label = F.when(k % 10 < 8, hashed(F.concat(F.md5("text"), F.lit("-l")), 6)).otherwise(k) % 3
    g = hashed(F.concat(doc, F.lit("-b")), 6)
    source = F.concat(F.lit("s"), (F.regexp_extract("source", r"\d+", 0).cast("int") % 4).cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars").withColumns({"origin": F.col("source"), "source": source})
    return rows.select(
        doc.alias("path"), "source", F.col("lang").alias("raw_label"), F.element_at(F.array(*map(F.lit, CLASSES)), label.cast("int") + 1).alias("label"),
        F.array(*map(F.lit, sorted(CLASSES))).alias("available_labels"), F.when(g % 50 != 0, F.concat(F.lit("g"), (g % 40).cast("string"))).alias("group_id"),
        F.when(F.col("source") != "s0", F.when(hashed(F.concat(doc, F.lit("-c")), 6) % 5 == 0, "test").otherwise("train")).alias("supplied_split"),
        F.lit(None).cast("string").alias("cohort"), F.md5("text").alias("digest"), "n_chars", F.col("doc_id").alias("seq"), "origin",
    )


#: Tokens whose slots a task remembers.
MOST_TOKENS = 1 << 18


class Slots(dict):
    """The slot of each token: the first 4 hex digits of its MD5, modulo 64."""

    def __missing__(self, token: bytes) -> int:
        slot = hashlib.md5(token).digest()[1] % 64
        if len(self) < MOST_TOKENS:
            self[token] = slot
        return slot


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = Slots()
    for batch in batches:
        counts = []
        for text in batch.column("text").to_pylist():
            tokens = (text or b"").split()  # at ASCII white space, which is \s in Spark
            held = np.bincount(np.fromiter(map(slots.__getitem__, tokens), np.int64, len(tokens)), minlength=64)
            counts.append(held.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(counts, pa.binary())], ["path", "counts"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("counts")
        rows = np.frombuffer(b"".join(lists.flatten().to_pylist()), "<i8").reshape(-1, 64)
        offsets = lists.offsets.to_numpy()
        counts = np.add.reduceat(rows, offsets[:-1] - offsets[0], axis=0)
        over = counts > np.median(counts, axis=1, keepdims=True)
        hashes = np.packbits(over, axis=1).view(">i8").ravel().astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(hashes)], ["path", "hash"])


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, hash): a 64-bit sketch of each document's tokens as a long. A token belongs to one of 64 slots; bit s is set if
    slot s holds more tokens than the median slot. Slots 16b to 16b + 15 are band b, the first in its top bit.

    A text becomes 64 counts where it lies; only those meet, for documents that share an id."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lower("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(_slot_counts, "path string, counts binary")
    return counts.groupBy("path").agg(F.collect_list("counts").alias("counts")).mapInArrow(_hashes, "path string, hash long")
