"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text. Word 5-grams of the
benchmark are seeds; documents are joined with the items they share enough seeds with. Each such pair is tiled: the
longest common run of unmarked words is found by running Karp-Rabin at a search length, marked on both sides, and so on
with ever shorter search lengths down to five words. Tiles don't overlap, and their order doesn't matter, so passages
with reordered parts count in full. A document holds an item if tiles cover at least 80 % of the item's words.

The benchmark is a query set: it is read in blocks of about ``BLOCK_WORDS`` words, one at a time, each sent to the
workers once, and the documents are scanned once for each block. Nothing else moves.

Results for odd input: null or empty texts and items match nothing; items under five words are never reported; repeated
items and repeated documents are each reported; an item id or doc id may be null; very long texts are read whole, a batch
of at least one row at a time; of equally long tiles the first counts; empty tables give no rows, and an empty benchmark
leaves all documents; other columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortlens.llm.common import Windows, Words, free_name, in_arrow, slices, text_bytes, window_starts
from cohortlens.storage import written

SEED, COVERAGE = 5, 0.8
#: Words of the benchmark that are sent to the workers at once.
BLOCK_WORDS = 2_000_000
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(texts: pa.Array) -> Words:
    return Words(*text_bytes(texts), lower=True, breaks=_BREAKS)


def _free_runs(marked: np.ndarray) -> np.ndarray:
    """How many unmarked words follow from each position on."""
    stop = np.flatnonzero(np.append(marked, True))
    return stop[np.searchsorted(stop, np.arange(len(marked)))] - np.arange(len(marked))


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in item, start in doc, length), in order of marking.

    Of the common runs of unmarked words, the longest is taken first; of equally long ones, the one that starts first in
    the item, then in the document."""
    runs_item, runs_doc = Windows(item), Windows(doc)
    taken_item, taken_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while True:
        free_item, free_doc = _free_runs(taken_item), _free_runs(taken_doc)

        def search(n: int, free_item=free_item, free_doc=free_doc) -> tuple[int, int] | None:
            """Karp-Rabin at search length n: the first common run of n unmarked words."""
            a, b = np.flatnonzero(free_item >= n), np.flatnonzero(free_doc >= n)
            hash_a, hash_b = runs_item.at(a, n), runs_doc.at(b, n)
            hit = np.isin(hash_a, hash_b)
            if not hit.any():
                return None
            k = int(np.argmax(hit))
            return int(a[k]), int(b[np.argmax(hash_b == hash_a[k])])

        best, low, high = None, least, most
        step = least
        while low <= high:  # runs of n words imply runs of n - 1
            n = min(step, high)
            if hit := search(n):
                best, low, step = (*hit, n), n + 1, 2 * n
                continue
            high, step = n - 1, (low + n - 1) // 2
            step = max(step, low)
        if best is None:
            return found
        i, j, n = best
        taken_item[i : i + n] = True
        taken_doc[j : j + n] = True
        found.append(best)
        most = n


class Block:
    """Items with their word hashes and, of each seed, where it stands in which item."""

    def __init__(self, rows: list[tuple], least: int = SEED):
        self.ids = [r[0] for r in rows]
        words = word_hashes(pa.array([r[1] or "" for r in rows], pa.string()))
        self.words = [words.hash[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]
        start, n = window_starts(words.first, least)
        seeds = Windows(words.hash).at(start, least)
        item = np.repeat(np.arange(len(n)), n)
        order = np.argsort(seeds, kind="stable")
        self.seeds, edge = np.unique(seeds[order], return_index=True)
        self.edge = np.append(edge, len(order))
        self.item, self.at = item[order], (start - words.first[item])[order]
        self.size = words.counts

    def candidates(self, words: Words, least: int, coverage: float) -> Iterator[tuple[int, int]]:
        """(row, item) pairs that share enough seeds for tiles of ``coverage``."""
        if not len(self.seeds):
            return
        start, n = window_starts(words.first, least)
        keys = Windows(words.hash).at(start, least)
        spot = np.minimum(np.searchsorted(self.seeds, keys), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[spot] == keys)
        if not len(hit):
            return
        row, spot = np.repeat(np.arange(len(n)), n)[hit], spot[hit]
        both = np.unique(np.column_stack([row, spot]), axis=0)
        row, spot = both.T
        count = self.edge[spot + 1] - self.edge[spot]
        where = np.repeat(self.edge[spot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pair, shared = np.unique(np.column_stack([np.repeat(row, count), self.item[where]]), axis=0, return_counts=True)
        enough = shared * least >= coverage * self.size[pair[:, 1]]  # every tile of l words has l - least + 1 >= l / least seeds
        yield from map(tuple, pair[enough].tolist())


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of about ``BLOCK_WORDS``, read one block at a time. Where there are several, items are dealt to
    them row by row, so that repeated ones don't share a block."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.lower(F.col(text_col).cast("string")).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[a-z0-9[^\x00-\x7F]]+")))).first()[0] or 0
    n = -(-total // BLOCK_WORDS)
    if n > 1:
        rows = written(rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))), "benchmark")
    for k in range(n):
        yield [tuple(r) for r in (rows if n == 1 else rows.where(F.col("block") == k).drop("block")).collect()]


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, least: int = SEED) -> DataFrame:
    """One row per document and item that it holds: the id columns, coverage (of the item's words), n_tiles, and tiles
    (start in the item, start in the document, words). Starts count words as above."""
    spark = df.sparkSession
    given = df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    kind = benchmark.schema[item_col].dataType
    tile = T.StructType([T.StructField(c, T.IntegerType()) for c in ("item_start", "doc_start", "words")])
    out = T.StructType([T.StructField(id_col, given.schema[0].dataType), T.StructField(item_col, kind), T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType()), T.StructField("tiles", T.ArrayType(tile))])

    item_type = to_arrow_type(kind)

    def scan(rows: list[tuple]) -> DataFrame:
        block = spark.sparkContext.broadcast(Block(rows, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = block.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    words, found = word_hashes(batch.column(1)), []
                    for row, item in own.candidates(words, least, coverage):
                        cut = tiles(own.words[item], words.hash[words.first[row] : words.first[row + 1]], least)
                        part = sum(n for _, _, n in cut) / int(own.size[item])
                        if part >= coverage:
                            found.append((row, own.ids[item], part, len(cut), [dict(zip(("item_start", "doc_start", "words"), t, strict=True)) for t in cut]))
                    if found:
                        rows_, items, parts, counts, cuts = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_)), pa.array(items, item_type), pa.array(parts, pa.float64()), pa.array(counts, pa.int32()), pa.array(cuts, _TILES)], [f.name for f in out.fields])

        return in_arrow(given, run, out)

    return reduce(DataFrame.unionByName, (scan(rows) for rows in blocks(benchmark, item_col, item_text) if rows), spark.createDataFrame([], out))


_TILES = pa.list_(pa.struct([(c, pa.int32()) for c in ("item_start", "doc_start", "words")]))


def decontaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that hold no item, with all their columns, judged row by row where they are read."""
    text = free_name(df, "lower_text")
    given, passes = df.withColumn(text, F.lower(F.col(text_col).cast("string"))), 0
    for rows in blocks(benchmark, options.get("item_col", "item_id"), options.get("item_text", "text")):
        if rows:
            given = _without(given if passes == 0 else written(given, "rest"), text, rows, options.get("coverage", COVERAGE), options.get("least", SEED))
            passes += 1
    return given.drop(text)


def _without(given: DataFrame, text: str, rows: list[tuple], coverage: float, least: int) -> DataFrame:
    block = given.sparkSession.sparkContext.broadcast(Block(rows, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        for whole in batches:
            for batch in slices(whole, text):
                words, keep = word_hashes(batch.column(text)), np.ones(len(batch), bool)
                for row, item in own.candidates(words, least, coverage):
                    if keep[row]:
                        cut = tiles(own.words[item], words.hash[words.first[row] : words.first[row + 1]], least)
                        keep[row] = sum(n for _, _, n in cut) < coverage * int(own.size[item])
                yield batch.filter(pa.array(keep))

    return in_arrow(given, run, given.schema)
