"""Removal of repeated passages: difference-cover anchors.

A window is ``WINDOW`` (35) consecutive words of one text. Short windows of ``ANCHOR`` (15) words are hashed only at
positions whose remainder modulo ``PERIOD`` (21) is in the difference cover {0, 1, 4, 14, 16}: every difference modulo
21 is one of two of its members. So whatever the offsets of two occurrences of a 35-word window, some offset below 21
puts both on cover positions, where they share an anchor that lies inside the window (20 + 15 = 35). Anchors that
repeat then extend: all 35-word windows around them are hashed in full and compared over the whole corpus.

Anchor keys are cut to 32 bits inside their key range, which only adds windows to compare. Windows are compared by the
whole 64-bit hash.

Results for odd input: null or empty text has no words, nothing removed and empty kept text; texts under 35 words
keep everything; repeated rows are copies of one another, so each loses its windows; a null id is kept as null, and ids
may be texts; very long texts are cut whole, a batch of at least one row at a time; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import Windows, Words, in_arrow, slices, text_bytes, window_starts
from cohortlens.llm.exchange import Keys, named, repeated

WINDOW, PERIOD, COVER = 35, 21, (0, 1, 4, 14, 16)


def _cover(period: int, cover: tuple[int, ...]) -> np.ndarray:
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period}")
    at = np.zeros(period, bool)
    at[list(cover)] = True
    return at


def anchor_kernel(window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER):
    """Hashes of window - period + 1 words at cover positions, of texts that have a whole window."""
    at, width = _cover(period, cover), window - period + 1
    if width < 1:
        raise ValueError("the period must not exceed the window")

    def kernel(batch: pa.RecordBatch) -> Keys:
        words = Words(*text_bytes(batch.column("text")))
        start, n = window_starts(words.first, width)
        row = np.repeat(np.arange(len(n)), n)
        position = start - words.first[row]
        keep = at[position % period] & (words.counts[row] >= window)
        return Keys(Windows(words.hash).at(start[keep], width), position[keep], np.bincount(row[keep], minlength=len(n)), words.counts, np.zeros((len(n), 0), np.int64))

    return kernel


def window_kernel(window: int = WINDOW, period: int = PERIOD):
    """Hashes of the windows that hold one of a row's marked anchors."""

    def kernel(batch: pa.RecordBatch) -> Keys:
        words = Words(*text_bytes(batch.column("text")))
        raw, offsets = text_bytes(batch.column("marks"))
        marks, n = raw.view("<u4").astype(np.int64), np.diff(offsets) // 4
        begin = np.repeat(words.first[:-1], n)
        edge = np.zeros(len(words.hash) + 2, np.int64)
        np.add.at(edge, np.maximum(begin, begin + marks - (period - 1)), 1)
        np.add.at(edge, begin + marks + 1, -1)
        start, counts = window_starts(words.first, window)
        row = np.repeat(np.arange(len(counts)), counts)
        keep = np.cumsum(edge)[start] > 0
        start, row = start[keep], row[keep]
        return Keys(Windows(words.hash).at(start, window), start - words.first[row], np.bincount(row, minlength=len(counts)), words.counts, np.zeros((len(counts), 0), np.int64))

    return kernel


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """dk, rk and marks: starts of the windows of each row whose words also start anywhere else."""
    rows = named(df, id_col, text_col)
    anchors = repeated(rows, anchor_kernel(window, period, cover), key_bytes=4)
    # The id is carried along so that this exchange of the texts and the one of remove_repeats are the same, done once.
    near = rows.join(anchors.groupBy("dk", "rk").agg(F.first("marks").alias("marks")), ["dk", "rk"]).select("dk", "rk", "doc_id", "text", "marks")
    found = repeated(near, window_kernel(window, period))
    return found.groupBy("dk", "rk").agg(F.first("marks").alias("marks"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row per input row: the id column, n_words, n_removed and kept_text (kept words joined by one space). A word
    goes if a window that covers it also starts anywhere else; windows are judged on the input."""
    marks = repeated_windows(df, id_col, text_col, window, period, cover)
    rows = named(df, id_col, text_col).join(marks, ["dk", "rk"], "left").select("doc_id", "text", "marks")
    out = T.StructType([T.StructField(id_col, rows.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                total, removed, kept = [], [], []
                for text, starts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    words = (text or b"").split()
                    total.append(len(words))
                    if starts:
                        edge = np.zeros(len(words) + 1, np.int64)
                        at = np.frombuffer(starts, "<u4")
                        edge[at] += 1
                        edge[at + window] -= 1
                        keep = np.cumsum(edge[:-1]) == 0
                        words = list(compress(words, keep.tolist()))
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [f.name for f in out.fields])

    return in_arrow(rows, run, out)
