"""Jaccard join of word n-gram sets with token-combination prefixes.

A document is the set of its distinct word n-grams (tokens). All tokens are put in one order, rare ones first. If two
sets have an overlap of at least a, then their prefixes of size - a + k tokens share at least k tokens (k at most the
overlap). The larger of two linked sets has an overlap of at least t of its size, the smaller one of 2t / (1 + t).

1. *Extended prefixes, in hash order.* Each set sends the first tokens in hash order, extended by k = a twentieth of its
   size. A document can have a partner only if k of them occur elsewhere. Most documents end here.
2. *Equal sets* become one class; what follows sees one document of each class, and of those only the ones left by 1.
3. *Signatures, in order of frequency.* Tokens of up to ``RARE`` documents are indexed alone, more frequent ones by
   pairs (k = 2). So a document that shares two tokens of its prefix with a partner meets it: under a rare one, or under
   a pair of frequent ones. Sets of more than ``LONG`` tokens, and those that can link to such a set, index frequent
   tokens alone (k = 1) up to the shorter prefix, so that a very long text has no more signatures than tokens. Candidates
   are verified on the whole sets.

Links decide components only, so a large group of copies need not become all its pairs. Two early rounds take the first
few tokens of each prefix as signatures and verify the most central member of a signature against the others. Then
frequencies are counted anew as the number of *components* that hold a token: what occurs in one component only can't
link it to another, so a document with too few other tokens is done. The last round indexes every signature of the rest,
each with the most that can be shared from its place in the order on, and verifies every pair of different components that
this bound leaves. A linked pair always passes under its first common tokens, so no link between components is missed.

Results for odd input: null or empty text has no tokens and stays alone; fewer words than n are one token; a null id has
component null and links nothing; repeated rows are one class; rows of one id with different texts are judged apart; ids
may be numbers or texts; very long texts are whole sets; an empty table gives no rows; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import Windows, Words, in_arrow, release_caches, slices, splitmix, text_bytes, window_starts
from cohortlens.llm.exchange import CHUNK, ENTRIES, PACKED, REPEATS, ROWS, Keys, _batches, _runs, dealt, key_ranges, named, repeated, whole_number
from cohortlens.operators.components import connected_components
from cohortlens.storage import let_go, written

#: Components up to which a token is rare.
RARE = 48
#: Tokens of a set beyond which frequent tokens are indexed alone too, as their pairs would grow with its square.
LONG = 4096
#: Signatures of a document in an early round, and the number of such rounds.
FEW, EARLY = 8, 2
EXTEND = 20
#: Pairs that a worker holds before it sends them on.
HELD = 200_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, one text after the other; and how many each has."""
    found = Words(data, offsets, lower=True)
    start, n = window_starts(found.first, words)
    count = found.counts
    windows = Windows(found.hash)
    hashes, out = windows.at(start, words), []
    edge = np.concatenate([[0], np.cumsum(n)])
    for r in range(len(n)):
        if n[r] > 1:
            run = np.sort(hashes[edge[r] : edge[r + 1]])
            out.append(run[np.concatenate([[True], run[1:] != run[:-1]])])
        elif count[r]:
            out.append(windows.at(found.first[r : r + 1], min(count[r], words)))
        else:
            out.append(np.zeros(0, np.uint64))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array([len(x) for x in out], np.int64)


def _ceil(a, b):
    return -(-a // b)


def least_overlap(n, percent: int, small: bool = False):
    """What a set of n tokens shares at least with a linked one that isn't larger, or (``small``) isn't smaller."""
    return _ceil(2 * percent * n, 100 + percent) if small else _ceil(percent * n, 100)


def _row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _prints(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of each set."""
    return np.column_stack([_row_sums(splitmix(tokens + np.uint64(s)), counts) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]).view(np.int64)


def prefix_kernel(words: int, percent: int):
    """Keys: the extended prefix in hash order. Extra numbers: set size and two fingerprints."""

    def kernel(batch: pa.RecordBatch) -> Keys:
        tokens, n = shingle_sets(*text_bytes(batch.column("text")), words)
        size = np.minimum(n, n - least_overlap(n, percent) + _ceil(n, EXTEND))
        begin = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        position = np.arange(len(tokens)) - begin[row]
        keep = position < size[row]
        return Keys(splitmix(tokens[keep]), position[keep], size, size, np.column_stack([n, _prints(tokens, n)]))

    return kernel


def classes(info: DataFrame) -> DataFrame:
    """One row per class of equal sets: its size and prints, the row that stands for it (dk, rk), and its marks."""
    return info.groupBy("n", "fp1", "fp2").agg(F.min(F.struct("dk", "rk")).alias("rep"), F.max("hits").alias("hits")).select("n", "fp1", "fp2", "rep.dk", "rep.rk", "hits")


SETS = "rk long, dk long, n long, tokens binary"


def candidate_sets(df: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The whole sets of the wanted rows (dk, rk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                tokens, n = shingle_sets(*text_bytes(batch.column("text")), words)
                ends = np.cumsum(n)
                packed = [tokens[b - c : b].tobytes() for b, c in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rk"), batch.column("dk"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["rk", "dk", "n", "tokens"])

    rows = df.join(wanted.select("dk", "rk"), ["dk", "rk"]).groupBy("dk", "rk").agg(F.first("text").alias("text"))  # repeated rows, where the join has them
    return in_arrow(rows.select("rk", "dk", "text"), run, SETS)


def _entries(keys: np.ndarray, refs: list[np.ndarray], buckets: int, chunk: int) -> list[tuple]:
    """Packed rows of keys sorted ascending, one for each key range; ``refs`` follow one another in the second array."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(keys)]
    return [(int(bucket[a]), chunk, ENTRIES, keys[a:b].tobytes(), b"".join(r[a:b].tobytes() for r in refs)) for a, b in zip(edges, edges[1:], strict=False)]


def signatures(tokens: np.ndarray, spread: np.ndarray, percent: int, few: int | None, most_rare: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set; whether each is one of it as the smaller set; and the most that it can share with a set that
    has its first common tokens under that signature. ``spread``: components that hold a token."""
    n = len(tokens)
    shared = spread > 1
    m = int(shared.sum())
    large = min(m, m - least_overlap(n, percent) + 2)
    if m < least_overlap(n, percent):
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    small = m - least_overlap(n, percent, small=True) + 2 if m >= least_overlap(n, percent, small=True) else 0
    tokens, spread = tokens[shared], spread[shared]
    order = np.lexsort((tokens, spread))[:large]
    tokens, spread = tokens[order], spread[order]
    if few is not None:
        return splitmix(tokens[:few]), np.ones(min(few, large), bool), np.full(min(few, large), m)
    rare = int((spread <= most_rare).sum())
    keys, is_small, left = [splitmix(tokens[:rare])], [np.arange(rare) < small], [m - np.arange(rare)]
    if 100 * n > percent * LONG:
        one = min(m, m - least_overlap(n, percent) + 1)
        alone = np.arange(rare, max(rare, one))
        keys.append(splitmix(tokens[alone]))
        is_small.append(alone < small - 1)
        left.append(m - alone)
    if n <= LONG and large - rare > 1:
        i, j = np.triu_indices(large - rare, 1)
        rest = tokens[rare:]
        keys.append(splitmix(rest[i] * np.uint64(0x9E3779B97F4A7C15) + splitmix(rest[j])))
        is_small.append(j + rare < small)
        left.append(m + 1 - rare - j)
    return np.concatenate(keys), np.concatenate(is_small), np.concatenate(left)


def candidate_pairs(sets: DataFrame, percent: int, few: int | None, rare: int = RARE) -> DataFrame:
    """Pairs (a, b) of rows of sets (rk, root, n, tokens) of different roots that may link: of each signature all of
    them, or with ``few`` those of one member with the others, over the first signatures of a row."""
    buckets = max(1, key_ranges(sets) // 2)

    def send(parts: list[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
        rk, root, n = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("rk", "root", "n"))
        tokens = np.frombuffer(b"".join(x for p in parts for x in p.column("tokens").to_pylist()), "<u8")
        unique, inverse = np.unique(tokens, return_inverse=True)
        holder = np.repeat(root, n)
        order = np.lexsort((holder, inverse))
        index, holder = inverse[order], holder[order]
        new = np.ones(len(order), bool)
        new[1:] = (index[1:] != index[:-1]) | (holder[1:] != holder[:-1])
        index, holder = index[new], holder[new]
        out = [(chunk % buckets, chunk, ROWS, tokens.tobytes(), np.column_stack([rk, root, n]).astype("<i8").tobytes())]
        yield from _batches(out + _entries(unique[index], [index.astype("<u4"), holder.astype("<i8")], buckets, chunk))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        task, serial, held, parts = TaskContext.get().partitionId(), 0, 0, []
        for whole in batches:
            for batch in slices(whole, "tokens"):
                parts.append(batch)
                held += int(batch.column("n").to_numpy(zero_copy_only=False).sum())
                if held >= CHUNK // 2:
                    yield from send(parts, task << 24 | serial)
                    serial, held, parts = serial + 1, 0, []
        if parts:
            yield from send(parts, task << 24 | serial)

    def unpack(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(r[3]) // 8 for r in rows])
        keys = np.frombuffer(b"".join(r[3] for r in rows), "<u8")
        index = np.frombuffer(b"".join(r[4][: 4 * s] for r, s in zip(rows, sizes, strict=True)), "<u4")
        holder = np.frombuffer(b"".join(r[4][4 * s :] for r, s in zip(rows, sizes, strict=True)), "<i8")
        return sizes, keys, index, holder

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, "bucket"):
            out = [r for r in rows if r[2] != ENTRIES]
            rows = [r for r in rows if r[2] == ENTRIES]
            if rows:
                sizes, keys, index, holder = unpack(rows)
                order = np.lexsort((holder, keys))
                k, h = keys[order], holder[order]
                key_new, new = np.ones(len(k), bool), np.ones(len(k), bool)
                key_new[1:] = k[1:] != k[:-1]
                new[1:] = key_new[1:] | (h[1:] != h[:-1])
                group = np.cumsum(key_new) - 1
                count = np.zeros(len(k), np.uint32)
                count[order] = np.bincount(group, weights=new)[group]
                ends = np.cumsum(sizes)
                for r, a, b in zip(rows, ends - sizes, ends, strict=True):
                    if (more := count[a:b] > 1).any():
                        out.append((bucket, r[1], REPEATS, None, np.column_stack([index[a:b][more], count[a:b][more]]).astype("<u4").tobytes()))
            yield from _batches(out)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _runs(batches, "chunk"):
            own = next(r for r in rows if r[2] == ROWS)
            tokens, table = np.frombuffer(own[3], "<u8"), np.frombuffer(own[4], "<i8").reshape(-1, 3)
            told = np.frombuffer(b"".join(r[4] for r in rows if r[2] == REPEATS), "<u4").reshape(-1, 2)
            unique, inverse = np.unique(tokens, return_inverse=True)
            count = np.ones(len(unique), np.int64)
            count[told[:, 0]] = told[:, 1]
            count = count[inverse]
            ends, keys, small, left = np.cumsum(table[:, 2]), [], [], []
            for b, n in zip(ends, table[:, 2], strict=True):
                k, s, most = signatures(tokens[b - n : b], count[b - n : b], percent, few, rare)
                keys.append(k)
                small.append(s)
                left.append(most)
            row = np.repeat(np.arange(len(table)), [len(k) for k in keys])
            keys = np.concatenate(keys)
            rows = Rows(*(table[row, c] for c in range(3)), np.concatenate(left), np.concatenate(small))
            order = np.lexsort((rows.rk, rows.n - rows.left, keys))
            keys, rows = keys[order], rows.take(order)
            if few is not None and len(keys):  # one member leaves the chunk, the others are paired with it here
                first = np.ones(len(keys), bool)
                first[1:] = keys[1:] != keys[:-1]
                pairs = _star(first, rows, percent)
                if len(pairs):
                    yield from _batches([(chunk % buckets, chunk, REPEATS, None, pairs.tobytes())])
                keys, rows = keys[first], rows.take(first)
            yield from _batches(_entries(keys, [c.astype("<i8") for c in rows.columns()], buckets, chunk))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 2), np.int64)
        for _, rows in _runs(batches, "bucket"):
            found: Iterable[np.ndarray] = [np.frombuffer(r[4], "<i8").reshape(-1, 2) for r in rows if r[2] == REPEATS]
            rows = [r for r in rows if r[2] == ENTRIES]
            if rows:
                keys = np.frombuffer(b"".join(r[3] for r in rows), "<u8")
                table = Rows(*(np.concatenate([np.frombuffer(r[4], "<i8").reshape(5, -1)[c] for r in rows]) for c in range(5)))
                order = np.lexsort((table.rk, table.n, keys) if few is None else (table.rk, table.n - table.left, keys))
                keys, table = keys[order], table.take(order)
                first = np.ones(len(keys), bool)
                first[1:] = keys[1:] != keys[:-1]
                more = _all_pairs(np.flatnonzero(first), table, percent) if few is None else [_star(first, table, percent)]
                found = chain(found, more)
            # A pair meets under several signatures: pairs are made distinct here, and again where they are dealt to.
            for part in found:
                kept = _distinct(np.concatenate([kept, part]))
                if len(kept) > HELD:
                    yield from _dealt(kept, buckets)
                    kept = kept[:0]
        yield from _dealt(kept, buckets)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "bucket"):
            part = _distinct(np.frombuffer(b"".join(r[4] for r in rows), "<i8").reshape(-1, 2))
            for a in range(0, len(part), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(part[a : a + 100_000, c], pa.int64()) for c in (0, 1)], ["a", "b"])

    out = in_arrow(sets.select("rk", "root", "n", "tokens"), gather, PACKED)
    out = in_arrow(dealt(out, "bucket", buckets).sortWithinPartitions("bucket", "chunk", "kind"), spread, PACKED)
    out = in_arrow(out.repartition("chunk").sortWithinPartitions("chunk", "kind"), sign, PACKED)
    out = in_arrow(dealt(out, "bucket", buckets).sortWithinPartitions("bucket", "chunk", "kind"), pair, PACKED)
    return in_arrow(dealt(out, "bucket", buckets).sortWithinPartitions("bucket"), distinct, "a long, b long")


def _dealt(pairs: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs in packed rows by their hash."""
    home = (splitmix(np.ascontiguousarray(pairs[:, 0]).view(np.uint64) * np.uint64(3) + np.ascontiguousarray(pairs[:, 1]).view(np.uint64)) % np.uint64(max(1, buckets // 2))).astype(np.int64)
    order = np.argsort(home, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(home[order])) + 1), len(order)]
    yield from _batches([(int(home[order[a]]), 0, ENTRIES, None, pairs[order[a:b]].astype("<i8").tobytes()) for a, b in zip(edges, edges[1:], strict=False) if b > a])


@dataclass
class Rows:
    """Rows under a signature: name, component, set size, the most that the row can share from there on, and whether the
    signature is one of the row as the smaller set."""

    rk: np.ndarray
    root: np.ndarray
    n: np.ndarray
    left: np.ndarray
    small: np.ndarray

    def columns(self) -> list[np.ndarray]:
        return [self.rk, self.root, self.n, self.left, self.small]

    def take(self, where) -> Rows:
        return Rows(*(c[where] for c in self.columns()))

    def may_link(self, i, j, percent: int) -> np.ndarray:
        """Whether rows i and j are of different components and can reach the overlap that their sizes ask for."""
        n, m = self.n[i] + self.n[j], np.minimum(self.left[i], self.left[j])
        fit = 100 * np.minimum(self.n[i], self.n[j]) >= percent * np.maximum(self.n[i], self.n[j])
        return (self.root[i] != self.root[j]) & fit & ((100 + percent) * m >= percent * n)


def _star(first: np.ndarray, rows: Rows, percent: int) -> np.ndarray:
    """Pairs of the first row of each run with the others that it may link to. Runs begin with the row that has the
    fewest tokens of its own: the most central one of a group of copies."""
    head, own = np.flatnonzero(first)[np.cumsum(first) - 1], np.arange(len(first))
    keep = ~first & rows.may_link(head, own, percent)
    return _distinct(np.column_stack([rows.rk[head[keep]], rows.rk[keep]])).astype("<i8")


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """Distinct pairs, each with the lesser member first."""
    a, b = pairs.min(1, initial=np.iinfo(np.int64).max), pairs.max(1, initial=np.iinfo(np.int64).min)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.column_stack([a[new], b[new]])


def _all_pairs(starts: np.ndarray, rows: Rows, percent: int) -> Iterator[np.ndarray]:
    """Pairs inside each run (ascending by size) that may link: one as the smaller set, and one not smaller."""
    if not len(rows.rk):
        return
    ends = np.append(starts[1:], len(rows.rk))
    differ = np.minimum.reduceat(rows.root, starts) != np.maximum.reduceat(rows.root, starts)
    found, held = [], 0
    for a, b in zip(starts[differ], ends[differ], strict=True):
        n = rows.n[a:b]
        for i in np.flatnonzero(rows.small[a:b]):
            other = np.arange(np.searchsorted(n, n[i]), np.searchsorted(n, 100 * n[i] // percent, side="right"))
            other = other[(other > i) | (rows.small[a:b][other] == 0)] + a
            other = other[rows.may_link(np.full(len(other), a + i), other, percent)]
            if len(other):
                found.append(np.column_stack([np.full(len(other), rows.rk[a + i]), rows.rk[other]]))
                held += len(other)
            if held > HELD:
                yield np.concatenate(found)
                found, held = [], 0
    if found:
        yield np.concatenate(found)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link, with the sizes of intersection and union."""
    left = sets.select(F.col("rk").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("rk").alias("b"), F.col("tokens").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "left", 8 << 20):
                both = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    joint = np.sort(np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")]))
                    common = int((joint[1:] == joint[:-1]).sum())
                    both.append((common, len(joint) - common))
                shared, union = np.array(both, np.int64).reshape(-1, 2).T
                keep = pa.array(100 * shared >= percent * union)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(union)], ["a", "b", "shared", "total"]).filter(keep)

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return in_arrow(joined, run, "a long, b long, shared long, total long")


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85, rare: int = RARE, early: int = EARLY) -> DataFrame:
    """One row per input row: the id column, n_shingles (set size) and component_id (the least id reachable by links).

    Two rows link when 100 * intersection >= percent * union of their n-gram sets."""
    rows = named(df, id_col, text_col)
    out = _components(rows, words, percent, rare, early)
    kind = rows.schema["doc_id"].dataType
    if not whole_number(rows, "doc_id"):  # names are hashes: the least id is found among the ids themselves
        out = rows.where("doc_id is not null").select("dk", "rk", "doc_id").join(out.select("dk", "rk", "n", "component").distinct(), ["dk", "rk"])
        least = out.groupBy("component").agg(F.min("doc_id").alias("least"))
        alone = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
        whole = out.join(least, "component").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"))
        return whole.unionByName(_without_id(rows, id_col, words))
    whole = out.select(F.col("dk").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))
    return whole.unionByName(_without_id(rows, id_col, words))


def linked_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85, rare: int = RARE, early: int = EARLY) -> DataFrame:
    """(dk, rk, component): the name of each row with an id, and of its component, which two rows of one id share only if
    they are linked."""
    return _components(named(df, id_col, text_col), words, percent, rare, early).select("dk", "rk", "component")


def _components(rows: DataFrame, words: int, percent: int, rare: int, early: int) -> DataFrame:
    """dk, rk, n, component (the name of one of its rows) and component_id (its least id) of each row with an id."""
    if not 60 <= percent <= 100:
        raise ValueError("percent must be from 60 to 100")
    marks = repeated(rows.where("doc_id is not null"), prefix_kernel(words, percent), ("n", "fp1", "fp2"), key_bytes=4, all_rows=True)
    info = written(marks.select("dk", "rk", "n", "fp1", "fp2", F.expr("length(marks) div 4").alias("hits")), "sets")
    wanted = classes(info).where(f"n > 0 and hits >= ceil(n / {EXTEND})")
    sets = written(candidate_sets(rows, wanted, words), "tokens")
    let_go(rows.sparkSession)  # the marks and the joins of whole texts are in tables now
    links = None
    root = None
    for few in [*[FEW] * early, None]:
        labelled = sets.withColumn("root", F.col("rk")) if root is None else sets.join(root, sets.rk == root.node, "left").withColumn("root", F.coalesce("component", "rk"))
        pairs = written(candidate_pairs(labelled, percent, few, rare), "pairs")
        let_go(rows.sparkSession)  # what it took to find them goes before whole sets are moved to verify them
        found = written(verified(pairs, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        root = connected_components(links, "a", "b")
        let_go(rows.sparkSession)
    names = sets.select("rk", "dk").join(root, sets.rk == root.node).groupBy("component").agg(F.min("dk").alias("least"))
    of_class = classes(info).alias("c").join(root, F.col("c.rk") == root.node, "left").join(names, "component", "left")
    of_class = of_class.select("n", "fp1", "fp2", F.coalesce("least", "dk").alias("component_id"), F.coalesce("component", "rk").alias("component"))
    own = lambda of, alone: F.when(F.col("n") > 0, F.col(of)).otherwise(F.col(alone)).alias(of)
    return info.join(of_class, ["n", "fp1", "fp2"]).select("dk", "rk", "n", own("component", "rk"), own("component_id", "dk"))


def _without_id(rows: DataFrame, id_col: str, words: int) -> DataFrame:
    out = T.StructType([T.StructField(id_col, rows.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("component_id", rows.schema["doc_id"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = shingle_sets(*text_bytes(batch.column("text")), words)[1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("doc_id")], [f.name for f in out.fields])

    return in_arrow(rows.where("doc_id is null").select("doc_id", "text"), run, out)
