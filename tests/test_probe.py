import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import numbering, probe
from cohortlens.operators.probe import ONE, Boosting


@pytest.mark.parametrize("seed", range(40))
def test_dealing_equals_one_by_one(seed):
    rnd = random.Random(seed)
    folds = rnd.randrange(2, 7)
    sizes = [(s, rnd.randrange(1, 40)) for s in rnd.sample(range(1, 30), rnd.randrange(1, 8))]
    rows = {}
    for size, first, last, order in probe.dealing(sizes, folds):
        for i in range(first, last + 1):
            assert (size, i) not in rows
            rows[size, i] = order[(i - first) % len(order)]
    load = [0] * folds
    for size, n in sorted(sizes, reverse=True):
        for i in range(n):
            f = min(range(folds), key=lambda f: (load[f], f))
            assert rows.pop((size, i)) == f
            load[f] += size
    assert not rows


def test_hash_ranked(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", None, "b") for i in range(200)] + [("a", 5)], "k string, i int").repartition(5)
    got = defaultdict(list)
    for r in numbering.hash_ranked(df, ("k",), F.col("i")).collect():
        got[r.k].append((r["rank"], r.i))
    import hashlib

    for k, rows in got.items():
        assert sorted(p for p, _ in rows) == list(range(201 if k == "a" else 200))
        assert [i for _, i in sorted(rows)] == sorted((i for _, i in rows), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())


def test_group_folds(spark):
    rows = [("s", f"g{g}", i) for g in range(40) for i in range(1 + g % 7)] + [("t", "only", 1), ("t", None, 2), (None, "x", 3)]
    df = spark.createDataFrame(rows, "source string, g string, i int")
    got = probe.group_folds(df, "g", 5, ("source",)).collect()
    assert len({(r.source, r.g) for r in got}) == len(got) == 42
    size = Counter((s, g) for s, g, _ in rows)
    load = Counter()
    for r in got:
        if r.source == "s":
            load[r.fold] += size["s", r.g]
    assert set(load) == set(range(5)) and max(load.values()) - min(load.values()) <= 7


def slow(rows, folds_of, names, features, folds, how):
    """Row by row and cut by cut, with the same bins, whole gradients and order of cuts. rows: (group, label, values)."""
    x = np.array([v for _, _, v in rows], float)
    cuts = []
    for f in range(features):
        known = np.sort(x[~np.isnan(x[:, f]), f])
        cuts.append(np.quantile(known, [i / how.bins for i in range(1, how.bins)]))
    bins = [[how.bins - 1 if np.isnan(v) else sum(e < v for e in cuts[f]) for f, v in enumerate(r)] for r in x]
    y, fold = [names.index(t) for _, t, _ in rows], [folds_of[g] for g, _, _ in rows]
    out = Counter()
    for tested in range(folds):
        score, learn = np.zeros((len(rows), len(names))), [i for i in range(len(rows)) if fold[i] != tested]
        for _ in range(how.rounds):
            e = np.exp(score - score.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            step = np.zeros_like(score)
            for c in range(len(names)):
                g = [round((p[i, c] - (y[i] == c)) * ONE) for i in range(len(rows))]
                h = [round(p[i, c] * (1 - p[i, c]) * ONE) for i in range(len(rows))]
                worth = lambda s: (sum(g[i] for i in s) / ONE) ** 2 / (sum(h[i] for i in s) / ONE + how.penalty)  # noqa: B023, E731

                def grow(members, asked, depth):
                    best = None
                    for f in range(features) if depth < how.depth else ():
                        for at in sorted({bins[i][f] for i in members}):
                            a, b = [i for i in members if bins[i][f] <= at], [i for i in members if bins[i][f] > at]
                            if min(len(a), len(b)) >= how.least_rows and (gain := worth(a) + worth(b) - worth(members)) > 1e-9 and (best is None or gain > best[0]):  # noqa: B023
                                best = gain, f, at, a, b
                    if best is None:
                        for i in asked:
                            step[i, c] = -how.rate * (sum(g[j] for j in members) / ONE) / (sum(h[j] for j in members) / ONE + how.penalty)  # noqa: B023
                        return
                    _, f, at, a, b = best
                    grow(a, [i for i in asked if bins[i][f] <= at], depth + 1)
                    grow(b, [i for i in asked if bins[i][f] > at], depth + 1)

                grow(learn, list(range(len(rows))), 0)
            score += step
        for i in range(len(rows)):
            if fold[i] == tested:
                out[names[y[i]], names[int(score[i].argmax())]] += 1
    return out


def table(seed, n=160):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.randrange(12), rnd.random()
        label = "x" if a > 7 else "y" if b > 0.5 else "z"
        rows.append(("s", f"g{i % 23}", rnd.choice("xyz") if rnd.random() < 0.2 else label, None if rnd.random() < 0.05 else float(a), float("nan") if rnd.random() < 0.05 else b, 1.0))
    return rows


@pytest.mark.parametrize(("seed", "every"), [(1, 10), (2, 2)])
def test_boosting_equals_slow_version(spark, monkeypatch, seed, every):
    monkeypatch.setattr(probe, "WRITE_EVERY", every)
    how = Boosting(rounds=4, depth=2, bins=8, least_rows=5, rate=0.4)
    rows = table(seed)
    other = [("t", f"h{i % 9}", "xy"[i % 2], float(i % 2), 0.0, 1.0) for i in range(90)] + [("t", None, "x", 0.0, 0.0, 0.0), (None, "h1", "x", 0.0, 0.0, 0.0), ("t", "h1", None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + other, "source string, g string, label string, a double, b double, c double").repartition(3)
    told = {(r.source, r.label, r.prediction): r.rows for r in probe.boosted(df, ("a", "b", "c"), "label", "g", folds=3, how=how).collect()}
    folds_of = {r.g: r.fold for r in probe.group_folds(df.where("source = 's'"), "g", 3, ("source",)).collect()}
    want = slow([(g, t, (np.nan if a is None else a, b, c)) for _, g, t, a, b, c in rows], folds_of, ["x", "y", "z"], 3, 3, how)
    assert {k[1:]: n for k, n in told.items() if k[0] == "s"} == dict(want)
    assert {k: n for k, n in told.items() if k[0] == "t"} == {("t", "x", "x"): 45, ("t", "y", "y"): 45}  # told by a alone


def test_probe_scores(spark):
    rows = [("s", f"g{i % 20}", "pq"[i % 2], float(i % 2), float(i % 3)) for i in range(240)]
    df = spark.createDataFrame(rows, "source string, g string, label string, leak double, noise double")
    how = Boosting(rounds=2, depth=1, bins=4, least_rows=5)
    got = {r.features: r for r in probe.probed(df, {"leak": ("leak",), "noise": ("noise",)}, "label", "g", how=how).collect()}
    assert got["leak"].balanced_accuracy == 1 and got["noise"].balanced_accuracy < 0.7 and got["leak"].chance == 0.5 and got["leak"].rows == 240
    assert probe.probed(df.limit(0), {"leak": ("leak",)}, "label", "g", how=how).collect() == []


def test_blocks_are_filled_over_batches(spark, monkeypatch):
    """Batches of rows are smaller than blocks; blocks once ended with them, and most time went to small blocks."""
    monkeypatch.setattr(probe, "BLOCK", 300)
    rows = spark.range(0, 1400, 1, 1).select((F.col("id") % 2).cast("int").alias("s"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("fold"), F.array(F.col("id").cast("double")).alias("x"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = probe.blocks(rows, [np.array([[500.0, 900.0]])] * 2, 3, 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.s, r.n) for r in got) == [(0, 100), (0, 300), (0, 300), (1, 100), (1, 300), (1, 300)]
    bins, target = (b"".join(r[c] for r in sorted(got, key=lambda r: (r.s, -r.n))) for c in ("bins", "target"))
    assert sum(bins) == sum((i > 500) + (i > 900) for i in range(1400)) and len(target) == 4 * 1400
