"""Centroid clustering by dual-tree Lloyd rounds, in exact integers.

Vectors are cut into blocks of up to ``BLOCK`` distinct ones where they lie; nothing is shuffled. Each block gets a cover
tree once: its points in farthest-first order, where those that came before the radius fell to 2**i are the centres of
level i. Such centres are more than 2**i apart, and every other point is within 2**i of one of them; a centre's parent is the
nearest centre of the level above. Blocks with their trees are written and read again in each round.

A round builds a cover tree over the centroids in the same way and walks both trees at once. A pair of nodes is dropped if
the least distance between their members exceeds what some centroid is away from all members of the vector node at most; a
vector node that is left with one centroid goes to it whole, without a look at its members. The other pairs are opened on
both sides, down to single vectors and centroids, which are compared exactly. Bounds are kept a little wide, so that no tie
is lost to rounding. Tasks return sums for each centroid; Spark adds these up, and the driver sees a row for each centroid
and component, whatever the number of vectors.

Results for odd input: rows whose vector is null, has another number of components, or holds a null or non-finite one are
left out; a null id takes part but is never an initial centroid; repeated rows and rows of one id are vectors of their own
(equal vectors are one point with a weight inside a block); with fewer vectors than centroids each vector with an id starts
one; without any, or without vectors, the result is empty; other columns are not read. Components beyond 2**27 after scaling
are an error, as distances would not fit a long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import in_arrow, ragged_arange, release_caches
from cohortlens.storage import written

#: Vectors of a block: a tree takes time by the square of it.
BLOCK = 1024
#: Pairs of which distances are taken at a time.
PAIRS = 1 << 15
MOST = 1 << 27


def squared(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows a[i] and b[j]."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        gap = a[i[at : at + PAIRS]] - b[j[at : at + PAIRS]]
        out[at : at + PAIRS] = np.einsum("ij,ij->i", gap, gap)
    return out


@dataclass
class Tree:
    """A cover tree over distinct points. Nodes go level by level from the root on: the place of the node's centre among the
    points, the largest distance from it to a point of the node, and its children as a range of nodes. Points are in an
    order in which each node holds a range of them."""

    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray
    first: np.ndarray
    size: np.ndarray
    order: np.ndarray


def farthest_first(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the points, each the farthest from those before it, and its distance to the nearest of them."""
    gap = points - points[0]
    near = np.einsum("ij,ij->i", gap, gap)
    order, fell = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    for k in range(1, len(points)):
        order[k] = at = int(near.argmax())
        fell[k] = math.sqrt(near[at])
        gap = points - points[at]
        np.minimum(near, np.einsum("ij,ij->i", gap, gap), out=near)
    return order, fell


def cover_tree(points: np.ndarray) -> Tree:
    n = len(points)
    order, fell = farthest_first(points)
    level = math.ceil(math.log2(fell[1])) if n > 1 else 0
    sizes, parents = [1], []  # centres of each level are the first so many of the order
    while sizes[-1] < n:
        level -= 1
        now = int((fell > 2.0**level).sum())
        if now > sizes[-1]:
            parents.append(_nearest(points, order, sizes[-1], now))
            sizes.append(now)
    # each point's ancestor of every level, from the leaves up
    own = [np.arange(n)]
    for parent in reversed(parents):
        own.append(parent[own[-1]])
    own.reverse()
    walk = np.lexsort(own[::-1]) if n > 1 else np.zeros(1, np.int64)
    fields: dict[str, list] = {k: [] for k in ("centre", "radius", "first", "size", "child", "children")}
    base, before = 0, None
    for holder in own:
        run = holder[walk]
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        fields["centre"].append(order[run[starts]])
        away = squared(points, points, order[walk], order[run])
        fields["radius"].append(np.sqrt(np.maximum.reduceat(away, starts)))
        fields["first"].append(starts)
        fields["size"].append(np.diff(starts, append=n))
        if before is not None:
            lo = np.searchsorted(starts, before)
            fields["child"].append(base + lo)
            fields["children"].append(np.diff(lo, append=len(starts)))
        base, before = base + len(starts), starts
    fields["child"].append(np.zeros(n, np.int64))
    fields["children"].append(np.zeros(n, np.int64))
    return Tree(**{k: np.concatenate(v) for k, v in fields.items()}, order=order[walk])


def _nearest(points: np.ndarray, order: np.ndarray, above: int, now: int) -> np.ndarray:
    """For each of the first ``now`` centres the nearest of the first ``above``, which are their own."""
    parent, step = np.arange(now), max(1, PAIRS // above)
    for a in range(above, now, step):
        some = np.arange(a, min(now, a + step))
        away = squared(points, points, np.repeat(order[some], above), np.tile(order[:above], len(some)))
        parent[some] = away.reshape(len(some), above).argmin(axis=1)
    return parent


def nearest_centroids(points: np.ndarray, tree: Tree, centroids: np.ndarray, ctree: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (the smaller of equal ones) and squared distance of each point, and the pairs whose
    distance was taken. Centroids are distinct; of equal ones give the first, in ascending order of their numbers."""
    best = np.full(len(points), -1, np.int64)
    node, other, taken = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    while len(node):
        away = squared(points, centroids, tree.centre[node], ctree.centre[other])
        taken += len(node)
        d = np.sqrt(away)
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        count = np.diff(starts, append=len(node))
        most = np.minimum.reduceat(d, starts) + tree.radius[node[starts]]
        keep = d - tree.radius[node] - ctree.radius[other] <= np.repeat(most * (1 + 1e-9) + 1e-6, count)
        node, other, away = node[keep], other[keep], away[keep]
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        count = np.diff(starts, append=len(node))
        single = ctree.children[other] == 0
        ended = np.repeat(np.minimum.reduceat(single, starts) & ((count == 1) | (tree.size[node[starts]] == 1)), count)
        if ended.any():
            v, c, far = node[ended], ctree.centre[other[ended]], away[ended]
            sort = np.lexsort((c, far, v))
            v, c = v[sort], c[sort]
            head = np.diff(v, prepend=-1) != 0
            v, c = v[head], c[head]
            best[tree.order[ragged_arange(tree.first[v], tree.size[v])]] = np.repeat(c, tree.size[v])
        node, other = node[~ended], other[~ended]
        node, other = _opened(node, other, tree, ctree)
    return best, squared(points, centroids, np.arange(len(points)), best), taken


def _opened(node: np.ndarray, other: np.ndarray, tree: Tree, ctree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children of both, where a node has any; else of the node itself. By vector node."""
    kids = np.maximum(tree.children[node], 1)
    v = ragged_arange(np.where(tree.children[node] > 0, tree.child[node], node), kids)
    c = np.repeat(other, kids)
    more = np.maximum(ctree.children[c], 1)
    right = ragged_arange(np.where(ctree.children[c] > 0, ctree.child[c], c), more)
    left = np.repeat(v, more)
    sort = np.argsort(left, kind="stable")
    return left[sort], right[sort]


# ---- blocks ---------------------------------------------------------------------------------------------

_TREE = ("centre", "radius", "child", "children", "first", "size", "order")
BLOCKS = "ids binary, known binary, place binary, points binary, " + ", ".join(f"{k} binary" for k in _TREE)


def _integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector that takes part, and these vectors as integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array(column.value_lengths().fill_null(-1))
    whole = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(whole)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims) * scale
    fine = np.isfinite(x).all(axis=1)
    x = np.floor(x[fine])
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError("a component is too large: distances would not fit a long")
    return whole[fine], x.astype(np.int64)


def blocks(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """One row for each block of (id, vector): ids, the point of each row, distinct points, and the tree over them."""

    def packed(ids: list, known: list, rows: list) -> pa.RecordBatch:
        points, place = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        tree = cover_tree(points)
        parts = [np.concatenate(ids).astype("<i8"), np.concatenate(known).astype("u1"), place.reshape(-1).astype("<i4"), points.astype("<i4")]
        parts += [getattr(tree, k).astype("<f8" if k == "radius" else "<i4") for k in _TREE]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["ids", "known", "place", "points", *_TREE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        ids, known, rows, held = [], [], [], 0
        for batch in batches:
            taking, x = _integers(batch.column(1), dims, scale)
            name = batch.column(0).take(pa.array(taking))
            for a in range(0, len(x), BLOCK):
                ids.append(name[a : a + BLOCK].fill_null(0).to_numpy(zero_copy_only=False))
                known.append(name[a : a + BLOCK].is_valid().to_numpy(zero_copy_only=False))
                rows.append(x[a : a + BLOCK])
                held += len(rows[-1])
                if held >= BLOCK:
                    yield packed(ids, known, rows)
                    ids, known, rows, held = [], [], [], 0
        if held:
            yield packed(ids, known, rows)

    return in_arrow(vectors, run, BLOCKS)


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Tree]]:
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        ids, known, place, points = np.frombuffer(row[0], "<i8"), np.frombuffer(row[1], "u1"), np.frombuffer(row[2], "<i4"), np.frombuffer(row[3], "<i4")
        tree = Tree(*(np.frombuffer(x, "<f8" if k == "radius" else "<i4").astype(float if k == "radius" else np.int64) for k, x in zip(_TREE, row[4:], strict=True)))
        yield ids, known, place, points.reshape(-1, dims).astype(np.int64), tree


def _distinct(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the centroids that no smaller number equals, ascending, and these centroids."""
    first = np.sort(np.unique(centroids, axis=0, return_index=True)[1])
    return first, centroids[first]


def assigned(table: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of each vector of the blocks."""
    number, own = _distinct(centroids)
    ctree = cover_tree(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, place, points, tree in _read(batch, dims):
                best, away, _ = nearest_centroids(points, tree, own, ctree)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=known == 0), pa.array(number[best[place]], pa.int32()), pa.array(away[place], pa.int64())], ["vec_id", "cluster", "distance"])

    return in_arrow(table, run, "vec_id long, cluster int, distance long")


def sums(table: DataFrame, centroids: np.ndarray, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that has vectors: their number and the sums of their components. A task sends k rows at most."""
    number, own = _distinct(centroids)
    ctree = cover_tree(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = np.zeros((len(own), dims), np.int64), np.zeros(len(own), np.int64)
            for _, _, place, points, tree in _read(batch, dims):
                best = nearest_centroids(points, tree, own, ctree)[0]
                weight = np.bincount(place, minlength=len(points))
                np.add.at(total, best, points * weight[:, None])
                np.add.at(count, best, weight)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(number[some], pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = in_arrow(table, run, "cluster int, n long, total array<long>")
    long = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "total")).alias("i", "x"))
    found: dict[int, list[int]] = {}
    for r in long.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k x (dims + 1)
        found.setdefault(r.cluster, [0] * (dims + 1))[r.i] = int(r.x)
    return {c: (x[0], x[1:]) for c, x in found.items()}


def initial(vectors: DataFrame, k: int, dims: int, scale: int) -> np.ndarray:
    """The k vectors that take part whose ids, as text after ``2:``, have the least SHA-256; ties by their components."""
    x = F.transform("vector", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = vectors.where((F.size("vector") == dims) & finite & F.col("id").isNotNull())
    rows = usable.select(F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256).alias("h"), x.alias("x")).orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, dims)


def clustered(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector that takes part, written, and the final centroids. A round moves every
    centroid that has vectors to the floor of their mean; vectors are assigned once more after the last round."""
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    centroids = initial(vectors, k, dims, scale)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    table = written(blocks(vectors, dims, scale), "blocks")
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, total) in sums(table, centroids, dims).items():
            moved[c] = [x // n for x in total]
        centroids = moved
    return written(assigned(table, centroids, dims), "clusters"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignments with the sum of distances of the cluster and of all, and the SHA-256 of the cluster's centroid."""
    names = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    hashes = found.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    both = per.crossJoin(per.agg(F.sum("s").alias("all")))  # one row
    told = both.join(hashes, "cluster").select("cluster", F.col("s").cast("long").alias("cluster_inertia"), F.col("all").cast("long").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
