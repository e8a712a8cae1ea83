"""Cluster bootstrap of metrics, and summaries over several runs.

Groups are drawn once for all runs. Weights come as a (replicate, group_key, w) table, or packed as (group_key, at, w): the
replicates that draw a group and how often, as arrays, in one or more rows of a group. There are three kinds: the exact
multinomial as numpy draws it in one go (for up to MOST_GROUPS groups, in pieces); the exact multinomial for any number of
groups, by a tree of binomial splits whose nodes have generators of their own, so that each task draws its groups by itself;
and weights by a hash, which are no multinomial but can be followed in SQL. Counts are aggregated per group before they meet
the replicates, and so are scores: a group brings its weights of all replicates as one array, and no row is repeated for each
replicate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import md5
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.scalars import hashed
from cohortlens.operators import metrics
from cohortlens.operators.numbering import hash_ranked

#: Groups up to which the multinomial is drawn.
MOST_GROUPS = 200_000
#: Numbers that are drawn, and held, at a time.
PIECE = 4_000_000
#: Groups that are drawn together at the leaves of the tree of splits.
LEAF = 1024
#: Ranges of scores in which replicates of AUROC are summed up.
RANGES = 256
#: Rows whose pairs are compared at a time there.
BLOCK = 96


def _states(groups: int, replicates: int, seed: int) -> list[tuple[int, int, dict]]:
    """(first replicate, their number, state of the generator before them) of each piece of the draws."""
    if not groups:
        return []
    size = max(1, PIECE // groups)
    generator, even = np.random.default_rng(seed), np.full(groups, 1 / groups)
    out = []
    for first in range(0, replicates, size):
        out.append((first, min(size, replicates - first), generator.bit_generator.state))
        if first + size < replicates:
            generator.multinomial(groups, even, size=size)  # only moves the generator on
    return out


PACKED = "group_key string, at array<int>, w array<int>"


def _packed_rows(names: np.ndarray, drawn: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of draws (replicates x groups), of which the first replicate has the given number."""
    for low in range(0, len(names), 4096):
        part = drawn[:, low : low + 4096].T
        g, r = np.nonzero(part)
        ends = pa.array(np.searchsorted(g, np.arange(len(part) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (r + first, part[g, r])]
        yield pa.RecordBatch.from_arrays([pa.array(names[low : low + 4096], pa.string()), *lists], ["group_key", "at", "w"])


def packed(weights: DataFrame) -> DataFrame:
    if "at" in weights.columns:
        return weights
    lists = weights.groupBy("group_key").agg(F.collect_list(F.struct("replicate", "w")).alias("d"))
    return lists.select("group_key", F.col("d.replicate").cast("array<int>").alias("at"), F.col("d.w").cast("array<int>").alias("w"))


def multinomial_weights(df: DataFrame, replicates: int = 2000, seed: int = 20260927, pack: bool = False) -> DataFrame:
    """(replicate, group_key, w), w > 0: as many draws as groups, with replacement, over groups in the order of their keys.

    The driver goes through the draws piece by piece and keeps the generator's state before each; tasks draw the pieces
    again from there. So neither holds more than a piece, and what is sent is the group keys and the states. Rows without a
    group are left out."""
    groups = [r.group_key for r in df.select("group_key").where("group_key is not null").distinct().limit(MOST_GROUPS + 1).collect()]
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups; use tree_weights")
    groups.sort()
    states = _states(len(groups), replicates, seed)
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((np.array(groups, object), states))  # MOST_GROUPS keys, replicates states at most

    def rows(batches):
        names, pieces = sent.value
        even = np.full(len(names), 1 / len(names)) if len(names) else names
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                first, size, state = pieces[piece]
                generator = np.random.default_rng()
                generator.bit_generator.state = state
                drawn = generator.multinomial(len(names), even, size=size)
                if pack:
                    yield from _packed_rows(names, drawn, first)
                    continue
                for r, counts in enumerate(drawn, first):
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r), pa.int32()), pa.array(names[at], pa.string()), pa.array(counts[at], pa.int32())], ["replicate", "group_key", "w"])

    return spark.range(0, len(states), 1, max(1, len(states))).mapInArrow(rows, PACKED if pack else "replicate int, group_key string, w int")


def leaf_draws(groups: int, leaf: int, replicates: int, seed: int, size: int) -> np.ndarray:
    """How often each group of a leaf is drawn in each replicate (replicates x groups of the leaf), of ``groups`` draws over
    as many groups. The number of draws that fall to a range of leaves is split between its halves by a binomial; the
    splits, and the draws inside the leaf, come from generators keyed by seed and range. So leaves agree with each other
    wherever they are drawn, and sums over all of them are exact."""
    low, high = 0, -(-groups // size)
    draws = np.full(replicates, groups, np.int64)
    keyed = lambda a, b: np.random.Generator(np.random.Philox(key=np.array([seed % (1 << 64), a << 32 | b], np.uint64)))
    end = lambda x: min(groups, x * size)
    while high - low > 1:
        middle = (low + high) // 2
        first = keyed(low, high).binomial(draws, (end(middle) - low * size) / (end(high) - low * size))
        draws, low, high = (first, low, middle) if leaf < middle else (draws - first, middle, high)
    own = end(high) - low * size
    return keyed(leaf, 0).multinomial(draws, np.full(own, 1 / own))


def tree_weights(df: DataFrame, replicates: int = 2000, seed: int = 20260927, pack: bool = False) -> DataFrame:
    """(replicate, group_key, w), w > 0: as many draws as groups, with replacement, over any number of groups, which are put
    in the order of a hash. The driver sees their number. The first replicates are the same whatever their number."""
    size = LEAF
    groups = df.select("group_key").where("group_key is not null").distinct()
    total = groups.count()
    leaves = hash_ranked(groups, (), F.col("group_key")).select((F.col("rank") / size).cast("int").alias("leaf"), "rank", "group_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for leaf, members in groupby(rows, key=lambda r: r[0]):
            names = np.array([r[2] for r in members], object)
            drawn = leaf_draws(total, leaf, replicates, seed, size)
            if pack:
                yield from _packed_rows(names, drawn, 0)
                continue
            for first in range(0, replicates, 64):
                r, g = np.nonzero(drawn[first : first + 64])
                yield pa.RecordBatch.from_arrays([pa.array((r + first).astype(np.int32)), pa.array(names[g], pa.string()), pa.array(drawn[first + r, g].astype(np.int32))], ["replicate", "group_key", "w"])

    return leaves.repartition("leaf").sortWithinPartitions("leaf", "rank").mapInArrow(run, PACKED if pack else "replicate int, group_key string, w int")


def hash_weights(df: DataFrame, replicates: int, most: int = 3, pack: bool = False) -> DataFrame:
    """(replicate, group_key, w): w from 0 to ``most`` by a hash of group and replicate. Like a bootstrap, but no multinomial."""
    groups = df.select("group_key").distinct()
    if pack:
        # Keys are few bytes, which AQE would put into one task, but each brings all its replicates.
        dealt = groups.where("group_key is not null").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by the key it would be left out
        return dealt.mapInArrow(partial(_hash_draws, replicates=replicates, most=most), PACKED)
    every = F.sequence(F.lit(0), F.lit(replicates - 1))
    w = (hashed(F.concat("group_key", F.lit("-"), F.col("replicate").cast("string")), 4) % (most + 1)).cast("int")
    return groups.select("group_key", F.explode(every).alias("replicate")).withColumn("w", w).where("w > 0")


def _hash_draws(batches: Iterator[pa.RecordBatch], replicates: int, most: int) -> Iterator[pa.RecordBatch]:
    """The draws of each group, packed. A column of arrays instead would be hashed again for each use of it, one by one."""
    tails = [f"-{r}".encode() for r in range(replicates)]
    size = max(1, PIECE // 8 // max(1, replicates))
    for batch in batches:
        every = batch.column("group_key").to_pylist()
        for low in range(0, len(every), size):
            names = every[low : low + size]
            heads = (md5(name.encode() + tail).digest()[:2] for name in names for tail in tails)
            drawn = np.frombuffer(b"".join(heads), ">u2").reshape(len(names), replicates) % (most + 1)
            yield from _packed_rows(np.array(names, object), drawn.T, 0)


def _joined(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """Rows with what their groups have drawn. Spark can't know how large the draws are, and would take them for small ones
    and broadcast them; so both sides are shuffled."""
    return rows.join(drawn.hint("merge"), "group_key")


def replicate_counts(df: DataFrame, weights: DataFrame, classes: int, runs: tuple[str, ...] = ("run",)) -> DataFrame:
    """Weighted class counts of each (run, replicate): per group first, then by replicate."""
    per = metrics.class_counts(df, classes, (*runs, "group_key"))
    names = ["n", *(f"{x}_{k}" for k in range(classes) for x in "spt")]
    joined = _joined(per, packed(weights)).select(*runs, *names, "at", "w")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}  # by run: counts x replicates, the first of which is -1
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in runs]
            numbers: dict[tuple, int] = {}
            of = np.array([numbers.setdefault(k, len(numbers)) for k in zip(*(batch.column(c).to_pylist() for c in runs), strict=True)], np.int64)
            row = np.repeat(np.arange(len(of)), np.diff(batch.column("at").offsets.to_numpy()))
            at, w = (batch.column(c).flatten().to_numpy() for c in ("at", "w"))
            counts = [batch.column(c).to_numpy() for c in names]
            for key, number in numbers.items():
                own = np.flatnonzero(of[row] == number)
                if not len(own):
                    continue
                place = at[own] + 1
                part = np.array([np.bincount(place, weights=w[own] * c[row[own]]) for c in counts]).astype(np.int64)  # whole numbers below 2**53
                have = held.get(key)
                if have is None or have.shape[1] < part.shape[1]:
                    have, part = part, have
                if part is not None:
                    have[:, : part.shape[1]] += part
                held[key] = have
        for key, have in held.items():
            some = np.flatnonzero(have[0])
            fixed = [pa.array([v] * len(some), t) for v, t in zip(key, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array((some - 1).astype(np.int32)), *(pa.array(c[some]) for c in have)], [*runs, "replicate", *names])

    given = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in runs)
    parts = joined.mapInArrow(sums, f"{given}, replicate int, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy(*runs, "replicate").agg(*(F.sum(c).alias(c) for c in names))


def _planes(drawn: np.ndarray) -> list[bytes]:
    """Of each row its numbers below 2**16 as bits: a plane with the lowest bit of each, one with the next, and so on up to
    the highest that the row has."""
    most = drawn.max(axis=1, initial=0)
    if most.max(initial=0) > 65535:
        raise ValueError("a group is drawn more than 65535 times")
    need = [max(1, int(m).bit_length()) for m in most]
    planes = [np.packbits(drawn >> b & 1, axis=1) for b in range(max(need, default=0))]
    return [b"".join(planes[b][i].tobytes() for b in range(n)) for i, n in enumerate(need)]


#: The eight bits of each byte as bytes.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _numbers(rows: list[bytes], replicates: int) -> np.ndarray:
    """The numbers of rows of planes (rows x replicates), unsigned, of 8 bits, or 16 if any row needs them."""
    width = -(-replicates // 8)
    planes = np.array([len(r) // width for r in rows], np.int64)
    most = planes.max(initial=1)
    out = np.zeros((len(rows), 8 * width), np.uint8 if most <= 8 else np.uint16)
    for n in np.unique(planes):
        own = np.flatnonzero(planes == n)
        bits = np.frombuffer(b"".join([rows[i] for i in own]), np.uint8).reshape(len(own), n, width)
        for low in range(0, n, 8):
            found = _BITS[bits[:, low]]
            for b in range(low + 1, min(low + 8, n)):
                found |= _BITS[bits[:, b]] << np.uint64(b - low)
            out[own] |= found.view(np.uint8).astype(out.dtype) << low
    return out[:, :replicates]


def _dense(drawn: DataFrame, replicates: int) -> DataFrame:
    """(group_key, w): how often a group is drawn in each of the first replicates, as planes of bits. Rows go with every
    score of their group, and draws are small numbers: two or three bits in place of sixteen."""

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("at")
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at, w = (batch.column(c).flatten().to_numpy() for c in ("at", "w"))
            kept = at < replicates
            out = np.zeros((len(lists), replicates), np.uint32)
            out[row[kept], at[kept]] = w[kept]
            yield pa.RecordBatch.from_arrays([batch.column("group_key"), pa.array(_planes(out), pa.binary())], ["group_key", "w"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("w")
            offsets, rows = lists.offsets.to_numpy(), lists.flatten().to_pylist()
            if len(rows) > len(lists):  # groups whose draws have come in pieces
                rows = _planes(np.add.reduceat(_numbers(rows, replicates).astype(np.uint32), offsets[:-1] - offsets[0], axis=0))
            yield pa.RecordBatch.from_arrays([batch.column("group_key"), pa.array(rows, pa.binary())], ["group_key", "w"])

    parts = drawn.where(F.exists("at", lambda r: r < replicates)).select("group_key", "at", "w").mapInArrow(packs, "group_key string, w binary")
    return parts.groupBy("group_key").agg(F.collect_list("w").alias("w")).mapInArrow(sums, "group_key string, w binary")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, small ones put together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if sum(map(len, held)):
        yield pa.concat_batches(held)


def replicate_aurocs(df: DataFrame, weights: DataFrame, replicates: int) -> DataFrame:
    """(run, replicate, macro_auroc) over the first so many replicates; null where a class is absent or alone.

    Rows get the draws of their groups and are dealt by class and range of scores. A task sorts by the score alone, which
    needs no comparisons of rows, and ranks the ranges of its runs and classes side by side for all replicates at once, a
    batch at a time; what the ranges above a range hold is a table of ranges x replicates."""
    given = _joined(df.select(F.col("run").cast("string").alias("run"), "group_key", "target", "probs"), _dense(packed(weights), replicates))
    cells = metrics.by_class(given, ("run", "w"))
    place = F.when(F.isnan("score"), RANGES - 1).otherwise(F.least(F.greatest(F.floor(F.col("score") * RANGES), F.lit(0)), F.lit(RANGES - 1)))  # NaN is sorted first
    rows = cells.select("run", "class", place.cast("int").alias("range"), "score", "positive", "w")
    together = max(1, min(1 << 14, (1 << 22) // max(1, replicates)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run, class and range: weights of positives and negatives, and what pairs inside the range lose."""
        open_: dict[tuple, tuple] = {}  # by run and class: range, last score, sums of all, what is lost, sums of that score

        def told(key: tuple, state: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key[:1], pa.string()), pa.array(key[1:], pa.int32()), pa.array(state[:1], pa.int32())] + [pa.array([v.tolist()]) for v in state[2:5]], ["run", "class", "range", "pos", "neg", "lost"])

        for batch in _gathered(batches, together):
            runs = batch.column("run").dictionary_encode()
            names = runs.dictionary.to_pylist()
            run = runs.indices.to_numpy(zero_copy_only=False)
            of, span, score, positive = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("class", "range", "score", "positive"))
            drawn = _numbers(batch.column("w").to_pylist(), replicates)
            code = (run.astype(np.int64) << 32 | of) * RANGES + (RANGES - 1 - span)
            order = np.argsort(code, kind="stable")
            code = code[order]
            bounds = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for a, b in ((x, min(x + BLOCK, end)) for start, end in zip(bounds[:-1], bounds[1:], strict=True) for x in range(start, end, BLOCK)):
                own = order[a:b]
                s, hit = score[own], positive[own] == 1
                key, now = (names[run[own[0]]], int(of[own[0]])), int(span[own[0]])
                state = open_.get(key)
                if state is None or state[0] != now:
                    if state is not None:
                        yield told(key, state)
                    state = (now, s[0], *np.zeros((5, replicates)))
                _, tied, pos, neg, lost, p, n = state
                place = np.concatenate([[0], np.cumsum(~((s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1]))))])  # of each score, from the highest
                wp, wn = drawn[own[hit]].astype(float), drawn[own[~hit]].astype(float)
                above, at = place[~hit], place[hit, None]
                ps, ns = wp.sum(axis=0), wn.sum(axis=0)
                lost = lost + ps * neg + np.einsum("ij,ij->j", wp, ((above < at) + 0.5 * (above == at)) @ wn)
                again = tied == s[0] or (np.isnan(tied) and np.isnan(s[0]))
                if again:  # rows of the score that the block before ended with
                    lost += 0.5 * (p * wn[above == 0].sum(axis=0) - n * wp[at[:, 0] == 0].sum(axis=0))
                last = place[-1]
                tp, tn = wp[at[:, 0] == last].sum(axis=0), wn[above == last].sum(axis=0)
                if again and last == 0:
                    tp, tn = p + tp, n + tn
                open_[key] = (now, s[-1], pos + ps, neg + ns, lost, tp, tn)
        for key, state in open_.items():
            yield told(key, state)

    shape = "run string, class int, range int, pos array<double>, neg array<double>, lost array<double>"
    ranges = rows.repartition("class", "range").sortWithinPartitions(F.desc("score")).mapInArrow(sums, shape)
    long = ranges.select("run", "class", "range", F.posexplode(F.arrays_zip("pos", "neg", "lost")).alias("replicate", "v")).select("run", "class", "range", "replicate", "v.*")
    above = Window.partitionBy("run", "class", "replicate").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = long.withColumn("over", F.coalesce(F.sum("neg").over(above), F.lit(0.0)))
    each = whole.groupBy("run", "class", "replicate").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("lost") + F.col("pos") * F.col("over")).alias("lost"))
    found = each.select("run", "replicate", F.when(F.col("p") * F.col("n") > 0, 1 - F.col("lost") / (F.col("p") * F.col("n"))).alias("auroc"))
    return found.groupBy("run", "replicate").agg(F.when(F.count("auroc") == F.count("*"), F.avg("auroc")).alias("macro_auroc"))


def _metric_columns(classes: tuple[str, ...]) -> dict[str, Column]:
    c = len(classes)
    return {"accuracy": metrics.accuracy(c), "balanced_accuracy": metrics.balanced_accuracy(c), "macro_f1": metrics.macro_f1(c)} | {f"recall_{name}": metrics.recall(k) for k, name in enumerate(classes)}


def _mean_of_all(value: str) -> Column:
    """Mean over the runs, null if it is null for any."""
    return F.when(F.count(value) == F.count("*"), F.avg(value))


def _long(df: DataFrame, names: list[str], by: tuple[str, ...]) -> DataFrame:
    return metrics.long_metrics(df, names, by)


def bootstrap(df: DataFrame, weights: DataFrame, classes: tuple[str, ...], auroc_replicates: int = 500) -> DataFrame:
    """(metric, point, mean, ci_low, ci_high, n_valid) of the mean over runs.

    A replicate counts for a metric if it is defined for every run; the point is the mean over the runs where it is defined,
    for AUROC only if that is all of them. AUROC takes the first ``auroc_replicates``. ``df`` has run, group_key, target,
    probs, prediction."""
    columns = _metric_columns(classes)
    names = [*columns, "macro_auroc"]
    drawn = replicate_counts(df, weights, len(classes)).select("run", "replicate", *(c.alias(n) for n, c in columns.items()))
    reps = drawn.groupBy("replicate").agg(*(_mean_of_all(n).alias(n) for n in columns))
    aurocs = replicate_aurocs(df, weights, auroc_replicates).groupBy("replicate").agg(_mean_of_all("macro_auroc").alias("macro_auroc"))
    values = _long(reps, list(columns), ("replicate",)).unionByName(_long(aurocs, ["macro_auroc"], ("replicate",)))
    spread = values.groupBy("metric").agg(F.avg("value").alias("mean"), F.expr("percentile(value, array(0.025, 0.975))").alias("q"), F.count("value").alias("n_valid"))
    per_run = metrics.class_counts(df, len(classes), ("run",)).select("run", *(c.alias(n) for n, c in columns.items()))
    point = per_run.agg(*(F.avg(n).alias(n) for n in columns)).crossJoin(metrics.macro_auroc(df, ("run",)).agg(_mean_of_all("macro_auroc").alias("macro_auroc")))  # one row each
    points = _long(point, names, ()).withColumnRenamed("value", "point")
    return points.join(spread, "metric", "left").select("metric", "point", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


def paired_differences(df: DataFrame, weights: DataFrame, classes: tuple[str, ...], first: str, second: str) -> DataFrame:
    """(metric, point, ci_low, ci_high) of second - first over the same draws, for metrics of counts."""
    columns = _metric_columns(classes)
    ones = df.select("group_key").distinct().select("group_key", F.array(F.lit(-1)).alias("at"), F.array(F.lit(1)).alias("w"))
    drawn = replicate_counts(df.where(F.col("run").isin(first, second)), packed(weights).unionByName(ones), len(classes))
    rows = _long(drawn.select("run", "replicate", *(c.alias(n) for n, c in columns.items())), list(columns), ("run", "replicate"))
    side = lambda r: F.max(F.when(F.col("run") == r, F.col("value")))
    gaps = rows.groupBy("metric", "replicate").agg((side(second) - side(first)).alias("gap"))
    ci = F.expr("percentile(case when replicate >= 0 then gap end, array(0.025, 0.975))")
    return gaps.groupBy("metric").agg(F.max(F.when(F.col("replicate") < 0, F.col("gap"))).alias("point"), ci.alias("q")).select("metric", "point", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
