"""Finding keys that occur more than once in a corpus, without a row for each key.

A kernel turns a batch of rows into 64-bit keys, each at a position of its row. Workers gather keys into chunks of a few
million positions, sort them, settle what repeats inside the chunk at once (so a hot key leaves a chunk once, whatever
its count) and send one packed array for each chunk and key range. The worker of a key range sorts what it got and sends
back which positions hold a key that is seen elsewhere; the worker of a chunk turns these into a row for each document.
Both moves are ordinary shuffles of a lazy plan: nothing reaches the driver, and a lost executor costs its own part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import in_arrow, input_bytes, release_caches, shuffle_width, slices

ENTRIES, ROWS, REPEATS = 1, 0, 2
#: A reference that asks for no answer: its key repeats inside its own chunk, which is settled there.
SETTLED = np.uint32(0xFFFFFFFF)
#: Positions of a chunk, at about which it is sent.
CHUNK = 500_000
#: Bytes of stored input for each key range at most: what a worker holds of a range doesn't grow with the table.
RANGE_BYTES = 32 << 20
#: Bytes of it for which a range is worth its rows.
LEAST_BYTES = 256 << 10
PACKED = "bucket long, chunk long, kind int, keys binary, refs binary"


@dataclass
class Keys:
    """Of a batch: keys and their positions in their rows, row by row; how many keys and positions each row has; and
    more numbers for each row, as a matrix."""

    keys: np.ndarray
    position: np.ndarray
    counts: np.ndarray
    span: np.ndarray
    extra: np.ndarray


def key_ranges(df: DataFrame) -> int:
    """Number of ranges that keys are dealt to: four for each shuffle partition of the session, but fewer where the tables
    that df reads are small for so many (every chunk sends a row to each range), and more where they are large."""
    wide, stored = 4 * shuffle_width(df.sparkSession), input_bytes(df)
    if not stored:  # unknown
        return wide
    return max(1, min(wide, stored // LEAST_BYTES), -(-stored // RANGE_BYTES))


def dealt(df: DataFrame, by: str, ranges: int) -> DataFrame:
    """df by a column of up to so many values a quarter of which come to each partition of the session; more ranges get
    more partitions."""
    wide = -(-ranges // 4)
    return df.repartition(by) if wide <= shuffle_width(df.sparkSession) else df.repartition(wide, by)


def repeated(df: DataFrame, kernel: Callable[[pa.RecordBatch], Keys], extras: tuple[str, ...] = (), key_bytes: int = 8, all_rows: bool = False) -> DataFrame:
    """Rows of df with the positions whose key occurs again in df, in the same row or another one.

    df has ``dk`` and ``rk`` (longs that name a row) and ``text``. Returned: dk, rk, the kernel's extra numbers, and
    ``marks`` (positions as little-endian unsigned 32-bit numbers, ascending). Rows without any are left out unless
    ``all_rows``. With ``key_bytes`` 4 keys are cut to 32 bits inside their range: less to move, and a rare false mark.
    """
    buckets = key_ranges(df)
    kind = "<u4" if key_bytes == 4 else "<u8"

    def packed(parts: list[Keys], ids: list[np.ndarray], chunk: int) -> Iterator[pa.RecordBatch]:
        span = np.concatenate([p.span for p in parts]).astype(np.int64)
        counts = np.concatenate([p.counts for p in parts]).astype(np.int64)
        base = np.cumsum(span) - span
        ref = (np.repeat(base, counts) + np.concatenate([p.position for p in parts])).astype(np.uint32)
        keys = np.concatenate([p.keys for p in parts])
        rows = np.column_stack([np.concatenate(ids), span, np.concatenate([p.extra for p in parts])]).astype("<i8")
        home = chunk % buckets
        out: list[tuple] = [(home, chunk, ROWS, None, rows.tobytes())]
        order = np.argsort(keys, kind="stable")
        keys, ref = keys[order], ref[order]
        if len(keys):
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            first = np.flatnonzero(new)
            many = np.diff(first, append=len(keys)) > 1
            here = np.repeat(many, np.diff(first, append=len(keys)))
            if here.any():
                out.append((home, chunk, REPEATS, None, np.sort(ref[here]).tobytes()))
            keys, ref = keys[first], np.where(many, SETTLED, ref[first])
            bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(keys)]
            keys = keys.astype(kind)
            out += [(int(bucket[a]), chunk, ENTRIES, keys[a:b].tobytes(), ref[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
        yield from _batches(out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        task, serial, held, parts, ids = TaskContext.get().partitionId(), 0, 0, [], []
        for whole in batches:
            for batch in slices(whole, "text"):
                parts.append(kernel(batch))
                ids.append(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dk", "rk")]).astype(np.int64).reshape(-1, 2))
                held += int(parts[-1].span.sum())
                if held >= CHUNK:
                    yield from packed(parts, ids, task << 24 | serial)
                    serial, held, parts, ids = serial + 1, 0, [], []
        if parts:
            yield from packed(parts, ids, task << 24 | serial)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, "bucket"):
            out = [(bucket, chunk, kind_, None, refs) for _, chunk, kind_, _, refs in rows if kind_ != ENTRIES]
            rows = [r for r in rows if r[2] == ENTRIES]
            if rows:
                sizes = np.array([len(r[4]) // 4 for r in rows])
                keys = np.frombuffer(b"".join(r[3] for r in rows), kind)
                refs = np.frombuffer(b"".join(r[4] for r in rows), "<u4")
                order = np.argsort(keys, kind="stable")
                same = np.diff(keys[order]) == 0
                again = np.zeros(len(keys), bool)
                again[order[1:][same]] = True
                again[order[:-1][same]] = True
                again &= refs != SETTLED
                ends = np.cumsum(sizes)
                for r, a, b in zip(rows, ends - sizes, ends, strict=True):
                    if again[a:b].any():
                        out.append((bucket, r[1], REPEATS, None, refs[a:b][again[a:b]].tobytes()))
            yield from _batches(out)

    width = 3 + len(extras)
    result = T.StructType([*(T.StructField(c, T.LongType()) for c in ("dk", "rk", *extras)), T.StructField("marks", T.BinaryType())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "chunk"):
            own = np.concatenate([np.frombuffer(r[4], "<i8").reshape(-1, width) for r in rows if r[2] == ROWS])
            refs = np.sort(np.frombuffer(b"".join(r[4] for r in rows if r[2] == REPEATS), "<u4")).astype(np.int64)
            base = np.concatenate([[0], np.cumsum(own[:, 2])])
            edge = np.searchsorted(refs, base)
            keep = np.arange(len(own)) if all_rows else np.flatnonzero(np.diff(edge))
            marks = [(refs[edge[i] : edge[i + 1]] - base[i]).astype("<u4").tobytes() for i in keep]
            columns = [pa.array(own[keep, c], pa.int64()) for c in (0, 1, *range(3, width))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(marks, pa.binary())], [f.name for f in result.fields])

    sent = dealt(in_arrow(df, gather, PACKED), "bucket", buckets).sortWithinPartitions("bucket", "chunk", "kind")
    back = dealt(in_arrow(sent, compare, PACKED), "chunk", buckets).sortWithinPartitions("chunk", "kind")
    return in_arrow(back, answer, result)


_PACKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary())])


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 512], strict=True), _PACKED, strict=True)], schema=_PACKED)


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches in runs of the same value of column ``by``."""
    at, run = None, []
    for batch in batches:
        column = batch.column(by).to_pylist()
        for value, row in zip(column, zip(*(c.to_pylist() for c in batch.columns), strict=True), strict=True):
            if value != at:
                if run:
                    yield at, run
                at, run = value, []
            run.append(row)
    if run:
        yield at, run


def row_name(df: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """The two longs that name a row: rows that agree in both are equal in id and text. The first is a whole-number id
    itself, or the hash of another one."""
    own = F.col(id_col).cast("long") if whole_number(df, id_col) else F.xxhash64(id_col)
    return {"dk": F.coalesce(own, F.lit(0)), "rk": F.xxhash64(id_col, text_col)}


def whole_number(df: DataFrame, id_col: str) -> bool:
    return isinstance(df.schema[id_col].dataType, (T.IntegralType, T.NullType))


def named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the two longs that name a row."""
    out = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out.withColumns(row_name(out, "doc_id", "text"))
