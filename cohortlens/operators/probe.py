"""How well given features alone tell the class: boosted trees, tested on whole groups that they haven't seen.

All models, one for each source and fold, grow together. A pass over the rows gives histograms of gradients by model, class,
node, feature and bin; Spark adds them up and finds the best cut of each node, and the driver sees a row for each node. Trees
grow level by level, so a round of boosting is as many passes as a tree has levels. Rows lie in blocks of bytes (one bin for
each feature) with the scores reached so far; these are written anew every few rounds, and trees grown since then are added
where the blocks are read. Gradients are rounded to whole numbers, so that sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.operators.metrics import balanced_accuracy, class_counts
from cohortlens.operators.numbering import hash_ranked
from cohortlens.storage import erase, stored

#: A gradient of 1 as a whole number.
ONE = 1 << 20
#: Rows of a block; rounds after which scores are written.
BLOCK, WRITE_EVERY = 1 << 14, 10


@dataclass(frozen=True)
class Boosting:
    rounds: int = 100
    depth: int = 5
    rate: float = 0.1
    bins: int = 64
    least_rows: int = 20
    penalty: float = 1.0


# ---- folds of whole groups


def dealing(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """How groups, taken by size from the largest on, go to the lightest fold each (ties: the first fold), for all groups of
    a size at once: (size, first, last, order) says that the first to last group of that size (counted from 0) go to the
    folds of the order in turn. ``sizes`` are (size, number of groups).

    With equal groups of size u, fold f takes them when it holds load_f, load_f + u, load_f + 2u and so on. In the order of
    these numbers whole turns of u are alike but for folds that join in, so a few rows describe any number of groups."""
    load, out = [0] * folds, []
    for size, number in sorted(sizes, reverse=True):
        turn, rest = zip(*(divmod(x, size) for x in load), strict=True)
        at, level = 0, min(turn)
        while at < number:
            order = sorted((f for f in range(folds) if turn[f] <= level), key=lambda f: (rest[f], f))
            joins = min((t for t in turn if t > level), default=None)
            room = number - at if joins is None else min(number - at, (joins - level) * len(order))
            out.append((size, at, at + room - 1, order))
            for i, f in enumerate(order):
                load[f] += size * (room // len(order) + (i < room % len(order)))
            at, level = at + room, joins if joins is not None else level
    return out


def group_folds(df: DataFrame, group: str, folds: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, group, fold): whole groups, the largest first, each to the fold with fewest rows; equal ones in hash order. The
    driver sees the number of groups of each size, not the groups. Rows without a group are left out."""
    if folds < 2:
        raise ValueError("at least 2 folds")
    sizes = df.where(F.col(group).isNotNull()).groupBy(*by, F.col(group).alias("g")).agg(F.count("*").alias("size"))
    several: dict[tuple, list[tuple[int, int]]] = {}
    for r in sizes.groupBy(*by, "size").agg(F.count("*").alias("n")).collect():
        several.setdefault(tuple(r[c] for c in by), []).append((r["size"], r["n"]))
    plan = [(*key, *row) for key, found in several.items() for row in dealing(found, folds)]
    kinds = [f"`{c}` {dict(df.dtypes)[c]}" for c in by]
    table = df.sparkSession.createDataFrame(plan, ", ".join([*kinds, "size long", "first long", "last long", "turns array<int>"]))
    ranked = hash_ranked(sizes, (*by, "size"), F.col("g"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "size")]
    met = ranked.alias("a").join(table.alias("b"), [*same, F.col("rank").between(F.col("first"), F.col("last"))])
    return met.select(*(F.col(f"a.{c}").alias(c) for c in by), F.col("g").alias(group), F.expr("turns[cast((rank - first) % size(turns) as int)]").alias("fold"))


# ---- blocks of binned rows


def bin_edges(df: DataFrame, features: tuple[str, ...], by: str, bins: int) -> dict[str, np.ndarray]:
    """Of each value of ``by`` a row of bins - 1 edges for each feature: exact quantiles over counted values; nulls and NaN
    don't count. A value's bin is the number of edges below it."""
    long = df.select(by, F.posexplode(F.array(*(F.col(c).cast("double") for c in features))).alias("f", "v")).where("v is not null and not isnan(v)")
    counted = long.groupBy(by, "f", "v").agg(F.count("*").alias("n"))
    at = ", ".join(repr(i / bins) for i in range(1, bins))
    rows = counted.groupBy(by, "f").agg(F.expr(f"percentile(v, array({at}), n)").alias("e")).collect()  # sources x features
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r[by], np.full((len(features), bins - 1), np.inf))[r.f] = r.e
    return out


BLOCKS = "s int, n int, bins binary, target binary, fold binary, score binary"


def blocks(rows: DataFrame, edges: list[np.ndarray], classes: int, folds: int) -> DataFrame:
    """Rows (s, y, fold, x) as blocks of a source: bins (rows x features; the last bin for what is missing), target, fold, and
    a score for each row, fold and class, 0 at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}  # by source: bins, targets and folds, fewer than a block

        def block(source: int, a: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            of, y, fold = (x[a : a + BLOCK] for x in parts)
            cells = [of.tobytes(), y.astype("<i4").tobytes(), fold.astype("<i4").tobytes(), np.zeros((len(y), folds, classes)).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([source], pa.int32()), pa.array([len(y)], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["s", "n", "bins", "target", "fold", "score"])

        for batch in batches:
            s, y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "y", "fold"))
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(len(s), -1)
            for source in np.unique(s).tolist():
                own = np.flatnonzero(s == source)
                of = np.column_stack([np.where(np.isnan(x[own, f]), e.shape[0], np.searchsorted(e, x[own, f], side="left")) for f, e in enumerate(edges[source])]).astype("u1")
                held.setdefault(source, []).append((of, y[own], fold[own]))
                if sum(len(p[1]) for p in held[source]) >= BLOCK:
                    parts = [np.concatenate(p) for p in zip(*held[source], strict=True)]
                    whole = len(parts[1]) // BLOCK * BLOCK
                    yield from (block(source, a, parts) for a in range(0, whole, BLOCK))
                    held[source] = [tuple(p[whole:] for p in parts)] if whole < len(parts[1]) else []
        for source, several in held.items():
            if several:
                yield block(source, 0, [np.concatenate(p) for p in zip(*several, strict=True)])

    return rows.mapInArrow(run, BLOCKS)


#: A tree: of each node the feature and bin it is cut at (rows of a bin up to it go left), or -1, and the value of its rows.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def leaf_of(tree: Tree, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node where each row is after so many levels; nodes are numbered as in a heap."""
    node, (feature, cut, _) = np.zeros(len(bins), np.int64), tree
    for _ in range(levels):
        f = feature[node]
        right = bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[node]
        node = np.where(f < 0, node, 2 * node + 1 + right)
    return node


@dataclass
class Block:
    """A block with the trees that its scores don't hold yet (by source, fold and class)."""

    s: int
    bins: np.ndarray
    target: np.ndarray
    fold: np.ndarray
    score: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, features: int, folds: int, classes: int) -> Iterator[Block]:
        for s, n, bins, target, fold, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield cls(s, np.frombuffer(bins, "u1").reshape(n, features), np.frombuffer(target, "<i4"), np.frombuffer(fold, "<i4"), np.frombuffer(score).reshape(n, folds, classes).copy())

    def add(self, grown: list[dict[tuple[int, int, int], Tree]], depth: int) -> None:
        for trees in grown:
            for (s, f, c), tree in trees.items():
                if s == self.s:
                    self.score[:, f, c] += tree[2][leaf_of(tree, self.bins, depth)]

    def gradients(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the log loss of fold f's model, as whole numbers (rows x classes)."""
        e = np.exp(self.score[:, f] - self.score[:, f].max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        hit = np.arange(p.shape[1]) == self.target[:, None]
        return np.rint((p - hit) * ONE).astype(np.int64), np.rint(p * (1 - p) * ONE).astype(np.int64)


def histograms(table: DataFrame, grown: list, growing: dict, level: int, how: Boosting, features: int, folds: int, classes: int) -> DataFrame:
    """(s, fold, class, node, f, bin, g, h, n) summed over all rows that the fold's model learns from."""
    wide = how.bins + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for block in Block.read(batch, features, folds, classes):
                block.add(grown, how.depth)
                for f in range(folds):
                    learn = block.fold != f
                    if not learn.any():
                        continue
                    g, h = (x[learn] for x in block.gradients(f))
                    bins = block.bins[learn]
                    for c in range(classes):
                        node = leaf_of(growing[block.s, f, c], bins, level) - ((1 << level) - 1)
                        here = node >= 0
                        cell = ((node[here, None] * features + np.arange(features)) * wide + bins[here]).ravel()
                        size = (1 << level) * features * wide
                        part = [np.bincount(cell, weights=np.repeat(w[here], features).astype(float), minlength=size) for w in (g[:, c], h[:, c], np.ones(len(g)))]
                        held = sums.setdefault((block.s, f, c), np.zeros((3, size), np.int64))
                        held += np.array(part).astype(np.int64)  # whole numbers below 2**53 in a block
        for (s, f, c), held in sums.items():
            some = np.flatnonzero(held[2])
            node, rest = np.divmod(some, features * wide)
            feature, place = np.divmod(rest, wide)
            fixed = [np.full(len(some), v, np.int32) for v in (s, f, c)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, fixed), *(pa.array(v.astype(np.int32)) for v in (node, feature, place)), *(pa.array(held[i, some]) for i in range(3))], ["s", "fold", "class", "node", "f", "bin", "g", "h", "n"])

    parts = table.mapInArrow(run, "s int, fold int, class int, node int, f int, bin int, g long, h long, n long")
    return parts.groupBy("s", "fold", "class", "node", "f", "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))


def best_cuts(sums: DataFrame, how: Boosting) -> DataFrame:
    """(s, fold, class, node, g, h, n, f, bin, lg, lh, ln): sums of each node and its best cut, null where no cut gains."""
    keys = ["s", "fold", "class", "node"]
    below = Window.partitionBy(*keys, "f").orderBy("bin")
    every = Window.partitionBy(*keys, "f")
    run = sums.withColumns({f"l{c}": F.sum(c).over(below) for c in "ghn"}).withColumns({f"t{c}": F.sum(c).over(every) for c in "ghn"})
    worth = lambda g, h: F.pow(g / F.lit(float(ONE)), F.lit(2.0)) / (h / F.lit(float(ONE)) + F.lit(how.penalty))
    right = {c: F.col(f"t{c}") - F.col(f"l{c}") for c in "ghn"}
    gain = worth(F.col("lg"), F.col("lh")) + worth(right["g"], right["h"]) - worth(F.col("tg"), F.col("th"))
    fits = (F.col("ln") >= how.least_rows) & (right["n"] >= how.least_rows) & (gain > 1e-9)
    cut = F.when(fits, F.struct((-gain).alias("worse"), "f", "bin", "lg", "lh", "ln"))
    found = run.withColumn("cut", cut).groupBy(*keys).agg(F.min("cut").alias("cut"), *(F.max(f"t{c}").alias(c) for c in "ghn"))
    return found.select(*keys, "g", "h", "n", "cut.f", "cut.bin", "cut.lg", "cut.lh", "cut.ln")


def _value(g: int, h: int, how: Boosting) -> float:
    return -how.rate * (g / ONE) / (h / ONE + how.penalty)


def boosted(df: DataFrame, features: tuple[str, ...], target: str, group: str, source: str = "source", folds: int = 5, how: Boosting | None = None) -> DataFrame:
    """(source, target, prediction, rows): how often the model of a fold, which has learned from the other folds of the
    source, gives each class to rows of each class. Rows without source, group or class are left out; a missing feature has
    a bin of its own, beyond the others. Classes are ranked by name; ties of scores go to the first."""
    how = how or Boosting()
    spark = df.sparkSession
    known = df.where(F.col(source).isNotNull() & F.col(group).isNotNull() & F.col(target).isNotNull())
    known = known.select(F.col(source).alias("source"), F.col(group).cast("string").alias("g"), F.col(target).cast("string").alias("t"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)))
    names = sorted(r.t for r in known.select("t").distinct().collect())
    edges = bin_edges(known, tuple(f"x{i}" for i in range(len(features))), "source", how.bins)
    sources = sorted(r.source for r in known.select("source").distinct().collect())
    shape = f"`{source}` {dict(df.dtypes)[source]}, `{target}` string, prediction string, rows long"
    if not names:
        return spark.createDataFrame([], shape)
    classes, empty = len(names), np.full((len(features), how.bins - 1), np.inf)
    dealt = group_folds(known, "g", folds, ("source",))
    s_of, y_of = (F.array_position(F.array(*map(F.lit, v)), F.col(c)).cast("int") - 1 for v, c in ((sources, "source"), (names, "t")))
    rows = known.join(dealt, ["source", "g"]).select(s_of.alias("s"), y_of.alias("y"), "fold", F.array(*(f"x{i}" for i in range(len(features)))).alias("x"))
    table, path = stored(blocks(rows, [edges.get(s, empty) for s in sources], classes, folds), "probe")
    keys = [(s, f, c) for s in range(len(sources)) for f in range(folds) for c in range(classes)]
    grown: list[dict[tuple[int, int, int], Tree]] = []

    def with_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for block in Block.read(batch, len(features), folds, classes):
                block.add(grown, how.depth)
                scores.append(block.score.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.binary())], batch.schema.names)

    for number in range(how.rounds):
        size = (1 << (how.depth + 1)) - 1
        growing = {k: (np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for k in keys}
        for level in range(how.depth):
            cut = False
            for r in best_cuts(histograms(table, grown, growing, level, how, len(features), folds, classes), how).collect():  # models x nodes
                feature, place, value = growing[r.s, r.fold, r["class"]]
                at = r.node + (1 << level) - 1
                value[at] = _value(r.g, r.h, how)
                if r.f is not None:
                    cut, feature[at], place[at] = True, r.f, r.bin
                    value[2 * at + 1], value[2 * at + 2] = _value(r.lg, r.lh, how), _value(r.g - r.lg, r.h - r.lh, how)
            if not cut:
                break
        grown.append(growing)
        if len(grown) == WRITE_EVERY and number + 1 < how.rounds:
            before = path
            table, path = stored(table.mapInArrow(with_scores, BLOCKS), "probe")
            erase(spark, before)
            grown.clear()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in Block.read(batch, len(features), folds, classes):
                block.add(grown, how.depth)
                best = block.score[np.arange(len(block.fold)), block.fold].argmax(axis=1)
                cells, count = np.unique(np.column_stack([block.target, best]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), block.s, np.int32)), pa.array(cells[:, 0].astype(np.int32)), pa.array(cells[:, 1].astype(np.int32)), pa.array(count.astype(np.int64))], ["s", "t", "p", "n"])

    counts = table.mapInArrow(told, "s int, t int, p int, n long").groupBy("s", "t", "p").agg(F.sum("n").alias("rows")).collect()  # sources x classes x classes
    erase(spark, path)
    return spark.createDataFrame([(sources[r.s], names[r.t], names[r.p], r.rows) for r in counts], shape)


def probed(df: DataFrame, sets: dict[str, tuple[str, ...]], target: str, group: str, source: str = "source", folds: int = 5, how: Boosting | None = None) -> DataFrame:
    """(source, features, rows, balanced_accuracy, chance) of each source and set of features."""
    out = []
    for name, features in sets.items():
        told = boosted(df, features, target, group, source, folds, how)
        if not (names := sorted(r[target] for r in told.select(target).distinct().collect())):
            continue
        place = lambda c: F.array_position(F.array(*map(F.lit, names)), F.col(c)).cast("int") - 1  # noqa: B023, E731
        coded = told.select(source, place(target).alias("target"), place("prediction").alias("prediction"), "rows")
        counts = class_counts(coded, len(names), (source,), F.col("rows"))
        present = sum((F.col(f"s_{k}") > 0).cast("int") for k in range(len(names)))
        out.append(counts.select(source, F.lit(name).alias("features"), F.col("n").alias("rows"), balanced_accuracy(len(names)).alias("balanced_accuracy"), (1 / present).alias("chance")))
    if not out:
        return df.sparkSession.createDataFrame([], f"`{source}` {dict(df.dtypes)[source]}, features string, rows long, balanced_accuracy double, chance double")
    return reduce(DataFrame.unionByName, out)
