"""Shared pieces: Arrow text access and vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What empties the caches that operators keep in a Python worker. Workers are used again by other operators, so those
#: that need memory empty them first.
CACHES: list[Callable[[], None]] = []


def release_caches() -> None:
    for clear in CACHES:
        clear()


def _libc():
    try:
        return ctypes.CDLL(None)
    except OSError:
        return None


_LIBC = _libc()


def give_back() -> None:
    """Returns memory that this process has freed but still holds to the machine: a worker waits for its next task, maybe
    of another operator, beside others that need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow``, after which a worker gives back its free memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


#: Bytes that end a word: space and \x09-\x0D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one if a column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_bytes(df: DataFrame) -> int:
    """Stored bytes of the tables that df reads, as far as the plan knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)  # a table of unknown size counts as the session's default, which is larger


# ---- texts as bytes -------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offsets, data = column.buffers()
    step = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=step)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (self._grow(b, n) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        return out[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(0x9E3779B97F4A7C15), _Powers(0xC2B2AE3D27D4EB4F)
_BYTE_VALUES = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and of each row the first word: first[r]:first[r + 1] are those of row r."""
    space, n = (_IS_SPACE if breaks is None else breaks)[data], len(data)
    solid = ~space
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        begins[inner] |= solid[inner]
        ends[inner - 1] |= solid[inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets).astype(np.int64)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts: start, end, 64-bit hash, and first word of each row.

    ``lower`` folds A-Z only. Everything is array arithmetic: a word's hash is a difference of prefix sums of byte
    values times powers of an odd base, moved to the origin with the inverse power and then mixed.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray | None = None):
        n = len(data)
        self.start, self.end, self.first = word_spans(data, offsets, breaks)
        values = _BYTE_VALUES[_LOWER] if lower else _BYTE_VALUES
        up, down = _BYTE_POWERS.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * up[:n], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = splitmix(raw + (self.end - self.start).astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Windows:
    """64-bit hashes of runs of consecutive words, from prefix sums over the words of a batch."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.up, self.down = _WORD_POWERS.upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.up[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, width) -> np.ndarray:
        return splitmix((self.sums[start + width] - self.sums[start]) * self.down[start])


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words that stay inside a row, and the number of them in each row."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    return ragged_arange(first[:-1], n), n


def ragged_arange(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated start[i], start[i]+1, ... of count[i] numbers each."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    where = np.concatenate([[0], np.cumsum(count)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(start - where, count)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes at most (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(block, prepend=-1)) if len(block) else []
    for a, b in zip(edges, [*edges[1:], len(sizes)], strict=True):
        yield batch.slice(a, b - a)
