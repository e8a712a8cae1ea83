"""Approximate nearest neighbours with learned partitions.

1. A neighbour graph over a bounded sample (``SAMPLE`` vectors of least hash) is cut into parts of equal size: halves
   along main directions first, then moves of vertices to the part of most neighbours while parts stay within 5 %.
2. A small network learns, for a vector, how its neighbours spread over the parts (soft labels).
3. Every vector of the table is indexed under its most probable part. How many parts a query visits is set on the
   sample: the least number that holds ``WANTED`` of its true neighbours. A query whose parts hold fewer vectors than it
   asks for visits further ones, in the order of their probability, until they do.
4. The number of parts follows the table. Beyond ``MOST_PARTS`` there are two levels: each part is cut again, by steps 1
   and 2 on a bounded sample of it, in tasks of their own, and a query visits so many parts of each part it visits.
5. Vectors and queries of a part are packed into blocks of bounded size, and groups of ``GROUP`` blocks of a part are
   joined with its query blocks, so a part of many vectors is many tasks. Each pair of blocks returns the best of each
   query, ranked by the exact measure.

Nearness is the largest inner product in double precision, summed in the order of the components; ties go to the
smaller id. Results for odd input: vectors that are null, zero, of another length than the sample's most common one, or
that hold null or non-finite numbers take no part, nor do rows without an id; rows of one id are one vector, the least;
equal vectors of several ids are several candidates; a query with fewer candidates gets all of them; an empty table gives
no rows; vectors have no texts, and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import in_arrow
from cohortlens.storage import written

SAMPLE, PART, MOST_PARTS, NEIGHBOURS, WANTED = 12_000, 1000, 256, 10, 0.97
#: Small tables have up to so many parts, of so many vectors at least.
FEW_PARTS, LEAST_PART = 8, 128
BLOCK, QUERY_BLOCK, GROUP = 2048, 512, 8


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows of largest inner product with each row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    if k < 1:
        return out
    y = x.astype(np.float32)
    for a in range(0, len(x), 1024):
        s = y[a : a + 1024] @ y.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.05, seed: int = 3) -> np.ndarray:
    """A part for each vertex: few edges between parts, at most 1 + slack of the mean size in each."""
    part, rnd = np.zeros(len(x), np.int64), np.random.default_rng(seed)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        part[rows] = first
        if count > 1 and len(rows) > 1:
            centred = x[rows] - x[rows].mean(0)
            axis = rnd.normal(size=x.shape[1])
            for _ in range(8):  # power iteration: the direction of most variance
                axis = centred.T @ (centred @ axis)
                axis /= max(np.linalg.norm(axis), 1e-12)
            order, left = np.argsort(centred @ axis, kind="stable"), count // 2
            cut = len(rows) * left // count
            halve(rows[order[:cut]], first, left)
            halve(rows[order[cut:]], first + left, count - left)

    halve(np.arange(len(x)), 0, parts)
    if parts == 1 or not graph.shape[1]:
        return part
    room = int(np.ceil(len(x) / parts * (1 + slack)))
    source, target = np.repeat(np.arange(len(x)), graph.shape[1]), graph.reshape(-1)
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    for _ in range(rounds):
        votes = np.bincount(source * parts + part[target], minlength=len(x) * parts).reshape(-1, parts)
        to = votes.argmax(1)
        gain = votes[np.arange(len(x)), to] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[to[v]] < room:
                size[to[v]] += 1
                size[part[v]] -= 1
                part[v] = to[v]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer: vector -> probabilities of the parts; and how many of them to visit."""

    weights: dict[str, np.ndarray]
    scale: float
    visits: int = 1

    @property
    def parts(self) -> int:
        return len(self.weights["b"])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x / self.scale @ self.weights["A"] + self.weights["a"], 0)
        s = h @ self.weights["B"] + self.weights["b"]
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)

    def best(self, x: np.ndarray, count: int) -> np.ndarray:
        """The most probable parts of each vector, in order."""
        return np.argsort(-self.probabilities(x), axis=1, kind="stable")[:, :count]

    @classmethod
    def fit(cls, x: np.ndarray, soft: np.ndarray, hidden: int = 96, epochs: int = 14, batch: int = 128, rate: float = 3e-3, seed: int = 5) -> Router:
        rnd, parts = np.random.default_rng(seed), soft.shape[1]
        scale = float(np.sqrt((x**2).mean())) or 1.0
        p = {"A": rnd.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), "a": np.zeros(hidden), "B": rnd.normal(0, np.sqrt(1 / hidden), (hidden, parts)), "b": np.zeros(parts)}
        own = cls(p, scale)
        if parts == 1:
            return own
        m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
        step, x = 0, x / scale
        for epoch in range(epochs):
            now, order = rate * (1 - epoch / epochs), rnd.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                h = np.maximum(x[rows] @ p["A"] + p["a"], 0)
                s = h @ p["B"] + p["b"]
                s = np.exp(s - s.max(1, keepdims=True))
                d = (s / s.sum(1, keepdims=True) - soft[rows]) / len(rows)
                dh = (d @ p["B"].T) * (h > 0)
                step += 1
                for k, grad in {"A": x[rows].T @ dh, "a": dh.sum(0), "B": h.T @ d, "b": d.sum(0)}.items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return own


def wanted_parts(total: int) -> int:
    return max(1, -(-total // PART), min(FEW_PARTS, total // LEAST_PART))


def fit_router(x: np.ndarray, total: int, seed: int = 3, most_parts: int = MOST_PARTS, wanted: float = WANTED) -> Router:
    """Partitions a sample x of ``total`` vectors and learns to route."""
    parts = int(min(most_parts, wanted_parts(total), max(1, len(x) // 16)))
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts, seed=seed)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.arange(len(x)), part), 1)
    for j in range(graph.shape[1]):
        np.add.at(soft, (np.arange(len(x)), part[graph[:, j]]), 1)
    router = Router.fit(x, soft / soft.sum(1, keepdims=True), seed=seed)
    order = router.best(x, parts)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(x), 0), axis=1)
    if graph.shape[1]:
        need = place[np.repeat(np.arange(len(x)), graph.shape[1]), order[graph.reshape(-1), 0]]
        router.visits = int(min(parts, np.searchsorted(np.cumsum(np.bincount(need, minlength=parts)) / len(need), wanted) + 1))
    return router


@dataclass
class Tree:
    """A router, and one for each of its parts that is cut again; leaves have running numbers."""

    root: Router
    below: dict[int, Router]
    sizes: np.ndarray | None = None

    def __post_init__(self):
        parts = self.root.parts
        self.first = np.concatenate([[0], np.cumsum([self.below[p].parts if p in self.below else 1 for p in range(parts)])])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf that a vector is indexed under."""
        part = self.root.best(x, 1)[:, 0]
        out = self.first[part]
        for p in np.unique(part):
            if p in self.below:
                rows = np.flatnonzero(part == p)
                out[rows] += self.below[p].best(x[rows], 1)[:, 0]
        return out

    def visited(self, x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, leaf) of the leaves that a query visits: they hold ``least`` vectors, if all leaves do."""
        rows, leaves = [], []
        order = self.root.best(x, self.root.parts)
        held = np.zeros(len(x), np.int64)
        for turn in range(self.root.parts):
            open_ = np.flatnonzero((held < least) | (turn < self.root.visits))
            if not len(open_):
                break
            for p in np.unique(order[open_, turn]):
                here = open_[order[open_, turn] == p]
                child = self.below.get(int(p))
                inner = child.best(x[here], child.parts) if child else np.zeros((len(here), 1), np.int64)
                for k in range(inner.shape[1]):
                    more = np.flatnonzero((held[here] < least) | (k < (child.visits if child else 1)))
                    if not len(more):
                        break
                    found = self.first[p] + inner[more, k]
                    rows.append(here[more])
                    leaves.append(found)
                    held[here[more]] += self.sizes[found]
        return np.concatenate(rows), np.concatenate(leaves)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of doubles) of the vectors that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    return rows.where(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fitted(rows: DataFrame, x: np.ndarray, total: int, sample: int, most_parts: int) -> Tree:
    """Routers for the vectors (vec_id, v), of which x is a sample."""
    if wanted_parts(total) <= most_parts:
        return Tree(fit_router(x, total, most_parts=most_parts), {})
    wanted = WANTED**0.5  # at each of two levels
    top = fit_router(x, total, most_parts=most_parts, wanted=wanted)
    sent = rows.sparkSession.sparkContext.broadcast(top)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.best(_matrix(batch.column(1)), 1)[:, 0], pa.int32()), *batch.columns], ["part", "vec_id", "v"])

    placed = written(in_arrow(rows, assign, "part int, vec_id long, v array<double>"), "parts")
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # most_parts rows at most
    share = F.create_map(*(F.lit(v) for p, n in sizes.items() for v in (p, sample / n)))
    few = placed.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < share[F.col("part")] * (1 << 30))  # some ``sample`` of each part

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        own = fit_router(np.stack(frame.sort_values("vec_id")["v"].to_numpy()), sizes[part], most_parts=most_parts, wanted=wanted)
        return pd.DataFrame({"part": [part], "router": [pickle.dumps(own)]})

    below = few.groupBy("part").applyInPandas(fit, "part int, router binary").collect()
    return Tree(top, {r.part: pickle.loads(r.router) for r in below})


def nearest(df: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, most_parts: int = MOST_PARTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (the rows for which the SQL condition holds,
    over ``vec_id``), among all other rows."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(usable(df, id_col, vector_col), "vectors")
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not few:
        return empty
    sizes = np.bincount([len(r.v) for r in few])
    width = int(sizes.argmax())
    rows = rows.where(F.size("v") == width)
    x = np.array([r.v for r in few if len(r.v) == width])
    tree = fitted(rows, x, rows.count(), sample, most_parts)
    router = spark.sparkContext.broadcast(tree)
    shape = "part int, vec_id long, v binary"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(router.value.leaf(v), pa.int32()), batch.column(0), pa.array([r.tobytes() for r in v], pa.binary())], ["part", "vec_id", "v"])

    indexed = written(in_arrow(rows, assign, shape), "index")
    counts = indexed.groupBy("part").agg(F.count("*").alias("n")).collect()  # a number for each leaf
    tree.sizes = np.zeros(int(tree.first[-1]), np.int64)
    for r in counts:
        tree.sizes[r.part] = r.n
    sent = spark.sparkContext.broadcast(tree)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 256):
                batch = whole.slice(a, 256)
                v = _matrix(batch.column(1))
                again, parts = sent.value.visited(v, k + 1)
                again = pa.array(again)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch.column(0).take(again), pa.array([r.tobytes() for r in v], pa.binary()).take(again)], ["part", "vec_id", "v"])

    asked = _packed(in_arrow(rows.where(is_query), visit, shape), QUERY_BLOCK).select("part", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    groups = spark.createDataFrame([(r.part, -(-_blocks(r.n, BLOCK) // GROUP)) for r in counts], "part int, groups int")
    spread = asked.join(F.broadcast(groups), "part").withColumn("grp", F.explode(F.expr("sequence(0, groups - 1)")))  # a row for each leaf
    packed = _packed(indexed, BLOCK).withColumn("grp", (F.col("salt") / GROUP).cast("int"))
    pairs = packed.join(spread, ["part", "grp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, query_ids, queries in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                ids, query_ids = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
                c, q = np.frombuffer(vectors).reshape(len(ids), -1), np.frombuffer(queries).reshape(len(query_ids), -1)
                # two roundings of a product are at most so far apart, and so are those of the product it is compared with
                wide = 4 * c.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max(initial=0)
                found = [_top(ids, c, one, i, row, k, margin) for one, i, row, margin in zip(q, query_ids, q @ c.T, wide, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["query_id", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, scores = None, b"", b""
        for batch in batches:
            out = []
            for query, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if query != at:
                    if at is not None:
                        out.append(_ranked(at, ids, scores, k))
                    at, ids, scores = query, b"", b""
                ids, scores = ids + i, scores + s
            if out:
                yield pa.concat_batches(out)
        if at is not None:
            yield _ranked(at, ids, scores, k)

    partial = in_arrow(pairs.select("part", "ids", "vectors", "query_ids", "queries"), search, "query_id long, ids binary, scores binary")
    return in_arrow(partial.repartition("query_id").sortWithinPartitions("query_id"), merge, empty.schema)


def _blocks(n: int, block: int) -> int:
    return -(-n // block)


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """(part, salt, ids, vectors): the rows of a part in blocks of about ``block`` rows."""
    sizes = F.broadcast(rows.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))  # a row for each leaf
    salted = rows.join(sizes, "part").withColumn("salt", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).select("part", "salt", "vec_id", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary())], ["part", "salt", "ids", "vectors"])

        for batch in batches:
            for part, salt, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, salt) != at or len(ids) >= 2 * block:
                    if ids:
                        yield full()
                    at, ids, vectors = (part, salt), [], []
                ids.append(i)
                vectors.append(v)
        if ids:
            yield full()

    return in_arrow(salted.repartition("part", "salt").sortWithinPartitions("part", "salt", "vec_id"), pack, "part int, salt int, ids binary, vectors binary")


def _top(ids: np.ndarray, c: np.ndarray, query: np.ndarray, own: int, rough: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a block: rough products choose, with a margin for their rounding; sums in the order of the components
    rank."""
    rough = np.where(ids == own, -np.inf, rough)
    if len(rough) > k:
        least = np.partition(rough, len(rough) - k)[-k]
        near = np.flatnonzero(rough >= least - margin)
    else:
        near = np.arange(len(rough))
    near = near[ids[near] != own]
    score = exact(query, c[near])
    order = np.lexsort((ids[near], -score))[:k]
    return ids[near][order], score[order]


def exact(query: np.ndarray, c: np.ndarray) -> np.ndarray:
    score = np.zeros(len(c))
    for d in range(len(query)):
        score += query[d] * c[:, d]
    return score


def _ranked(query: int, ids: bytes, scores: bytes, k: int) -> pa.RecordBatch:
    ids, scores = np.frombuffer(ids, "<i8"), np.frombuffer(scores)
    order = np.lexsort((ids, -scores))[:k]
    n = len(order)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, query), pa.int64()), pa.array(np.arange(1, n + 1), pa.int32()), pa.array(ids[order], pa.int64()), pa.array(scores[order], pa.float64())], ["query_id", "rank", "vec_id", "score"])
