import itertools
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import arrays, scalars
from cohortlens.operators import bootstrap, calibration, campaign, curves, metrics, slices
from cohortlens.plans import campaigns, views

SHAPE = "seq long, path string, source string, target int, probs array<double>, group_key string, eye_id string, cohort string, raw_label string"


def frame(spark, rows):
    """Rows of (target, probs[, group])."""
    full = [(i, f"p{i}", "s", r[0], [float(x) for x in r[1]], r[2] if len(r) > 2 else f"g{i}", None, None, "x") for i, r in enumerate(rows)]
    return metrics.with_prediction(spark.createDataFrame(full, SHAPE))


def one(df):
    (row,) = df.collect()
    return row.asDict()


def test_perfect_binary(spark):
    df = frame(spark, [(0, [0.9, 0.1]), (1, [0.2, 0.8]), (0, [0.7, 0.3]), (1, [0.1, 0.9])])
    assert one(metrics.point_metrics(df, 2)) == {"rows": 4, "accuracy": 1.0, "balanced_accuracy": 1.0, "macro_f1": 1.0}
    assert one(metrics.macro_auroc(df)) == {"macro_auroc": 1.0}
    assert sorted(tuple(r) for r in metrics.confusion(df, 2).collect()) == [(0, 0, 2), (0, 1, 0), (1, 0, 0), (1, 1, 2)]


def test_absent_class(spark):
    df = frame(spark, [(0, [0.9, 0.1]), (0, [0.4, 0.6])])
    assert one(metrics.macro_auroc(df))["macro_auroc"] is None
    got = one(metrics.point_metrics(df, 2))
    assert got["balanced_accuracy"] == 0.5  # class 1 isn't among the targets
    assert got["macro_f1"] == pytest.approx((2 / 3 + 0) / 2)  # but among the predictions


def test_ties_take_the_first_class(spark):
    df = frame(spark, [(0, [0.4, 0.4, 0.2]), (1, [0.2, 0.4, 0.4])])
    assert [r.prediction for r in df.orderBy("seq").collect()] == [0, 1]


def test_mean_of_eyes(spark):
    df = frame(spark, [(0, [0.9, 0.1], "a"), (0, [0.7, 0.3], "a"), (1, [0.1, 0.9], "b"), (1, [0.4, 0.6], "b")])
    eyes = metrics.grouped(df, "group_key", 2).orderBy("group_key").collect()
    assert [[round(x, 9) for x in r.probs] for r in eyes] == [[0.8, 0.2], [0.25, 0.75]]
    assert one(metrics.point_metrics(metrics.grouped(df, "group_key", 2), 2))["accuracy"] == 1
    with pytest.raises(Exception, match="several targets"):
        metrics.grouped(frame(spark, [(0, [0.9, 0.1], "a"), (1, [0.7, 0.3], "a")]), "group_key", 2).collect()
    with pytest.raises(Exception, match="no eye_id"):
        metrics.grouped(df, "eye_id", 2).collect()


def test_weighted_auroc_with_ties(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(2), [round(p, 1), round(1 - p, 1)]) for p in (rnd.random() for _ in range(60))]
    df = frame(spark, rows).withColumn("w", (1 + F.col("seq") % 3).cast("double"))
    weight = [1 + i % 3 for i in range(60)]
    wins = total = 0
    for (i, a), (j, b) in itertools.permutations(enumerate(rows), 2):
        if a[0] == 1 and b[0] == 0:
            w = weight[i] * weight[j]
            total += w
            wins += w * (1 if a[1][1] > b[1][1] else 0.5 if a[1][1] == b[1][1] else 0)
    got = {r["class"]: r.auroc for r in metrics.auroc_by_class(df, weight="w").collect()}
    assert got[1] == pytest.approx(wins / total) and got[0] == pytest.approx(wins / total)


@pytest.mark.parametrize(("p", "right", "ece", "bin_"), [(0.8, 8, 0.0, 12), (0.9, 5, 0.4, 13)])
def test_calibration_error(spark, p, right, ece, bin_):
    df = calibration.with_correct(frame(spark, [(0 if i < right else 1, [p, 1 - p]) for i in range(10)]))
    table = calibration.reliability(df)
    assert one(calibration.calibration_error(table))["ece"] == pytest.approx(ece)
    rows = {r.bin: r for r in table.collect()}
    assert len(rows) == 15 and rows[bin_]["count"] == 10 and rows[0]["mean_confidence"] is None


def test_last_bin_holds_one(spark):
    rows = spark.createDataFrame([(1.0,), (14.9985 / 15,)], "v double")
    assert [r[0] for r in rows.select(calibration.bin_index(F.col("v"), 15)).collect()] == [14, 14]


def test_operating_points(spark):
    scores = [(0, 0.1), (0, 0.2), (0, 0.6), (1, 0.3), (1, 0.7), (1, 0.8), (1, 0.9)]
    df = frame(spark, [(t, [1 - s, s]) for t, s in scores])
    got = {r.point: r for r in curves.operating_points(df).collect()}
    assert got["sensitivity_95"].threshold == pytest.approx(0.3)
    assert got["sensitivity_95"].sensitivity == 1 and got["sensitivity_95"].specificity == pytest.approx(2 / 3)
    assert got["argmax"].sensitivity == 0.75 and got["argmax"].threshold is None
    assert curves.operating_points(frame(spark, [(0, [0.9, 0.1])])).collect() == []


def test_curves_leave_out_degenerate_classes(spark):
    df = frame(spark, [(0, [0.8, 0.2, 0.0]), (1, [0.1, 0.9, 0.0]), (0, [0.7, 0.3, 0.0])])
    steps = curves.curve_steps(df)
    assert {r["class"] for r in steps.collect()} == {0, 1}
    assert all(r.average_precision == 1 for r in curves.average_precision(steps).collect())
    pr = curves.pr_points(steps).collect()
    assert min(r.recall for r in pr) > 0
    points = curves.roc_points(steps).where("class = 1").orderBy("fpr", "tpr").collect()
    assert [(r.fpr, r.tpr) for r in points] == [(0, 0), (0, 1), (1, 1)]


def test_downsampling(spark):
    points = spark.range(1000).selectExpr("1 as class", "id as x")
    kept = sorted(r.x for r in curves.downsampled(points, ("class",), "x", 200).collect())
    assert kept == sorted({round(i * 999 / 199) for i in range(200)})
    assert curves.downsampled(points.limit(50), ("class",), "x", 200).count() == 50


def test_error_concentration(spark):
    groups = spark.createDataFrame([(f"g{i}", n) for i, n in enumerate([6, 3, 1] + [0] * 17)], "group_key string, errors long")
    got = one(slices.error_concentration(groups))
    assert got == {"groups": 20, "groups_with_errors": 3, "total_errors": 10, "error_share_top_5pct_groups": 0.6, "error_share_top_10pct_groups": 0.9, "error_share_top_25pct_groups": 1.0}
    assert one(slices.error_concentration(groups.withColumn("errors", F.lit(0))))["error_share_top_5pct_groups"] is None


def test_slices_leave_out_null_columns(spark):
    df = frame(spark, [(0, [0.9, 0.1]), (1, [0.9, 0.1])]).withColumns({"in_duplicate_cluster": F.lit(False), "raw_label": F.when(F.col("seq") == 0, "x")})
    rows = {(r.slice_type, r.slice_value): r.images for r in slices.slice_metrics(df, ("a", "b")).collect()}
    assert rows == {("all", "all"): 2, ("raw_label", "x"): 1, ("raw_label", "None"): 1, ("in_duplicate_cluster", "False"): 2}


def test_bootstrap_of_one_group(spark):
    df = frame(spark, [(0, [0.9, 0.1], "g"), (0, [0.9, 0.1], "g"), (1, [0.1, 0.9], "g"), (1, [0.9, 0.1], "g")]).withColumn("run", F.lit("r"))
    rows = {r.metric: r for r in bootstrap.bootstrap(df, bootstrap.multinomial_weights(df, 20), ("a", "b"), 5).collect()}
    assert rows["accuracy"].point == 0.75 and rows["accuracy"].ci_low == rows["accuracy"].ci_high == 0.75
    assert rows["macro_auroc"].n_valid == 5 and rows["accuracy"].n_valid == 20


def test_perfect_and_inverted_runs(spark):
    right = frame(spark, [(t, [1 - t, t], f"g{t}{i}") for t in (0, 1) for i in (0, 1)])
    wrong = frame(spark, [(t, [t, 1 - t], f"g{t}{i}") for t in (0, 1) for i in (0, 1)])
    df = right.withColumn("run", F.lit("a")).unionByName(wrong.withColumn("run", F.lit("b")))
    weights = bootstrap.multinomial_weights(df, 50)
    rows = {r.metric: r for r in bootstrap.bootstrap(df, weights, ("a", "b")).collect()}
    assert rows["accuracy"].point == 0.5 and rows["accuracy"].mean == pytest.approx(0.5)
    gap = {r.metric: r for r in bootstrap.paired_differences(df, weights, ("a", "b"), "a", "b").collect()}
    assert gap["accuracy"].point == -1 and gap["accuracy"].ci_high == -1


def test_draws_are_numpys(spark):
    import numpy as np

    df = spark.createDataFrame([(g,) for g in "cab"], "group_key string")
    want = np.random.default_rng(7).multinomial(3, [1 / 3] * 3, size=4)
    got = {(r.replicate, r.group_key): r.w for r in bootstrap.multinomial_weights(df, 4, 7).collect()}
    assert got == {(i, g): int(want[i][j]) for i in range(4) for j, g in enumerate("abc") if want[i][j]}


def test_draws_in_pieces_are_the_same(spark, monkeypatch):
    import numpy as np

    df = spark.createDataFrame([(f"g{i:02d}",) for i in range(30)], "group_key string")
    want = np.random.default_rng(5).multinomial(30, [1 / 30] * 30, size=11)
    monkeypatch.setattr(bootstrap, "PIECE", 100)  # three replicates a piece, the last one smaller
    assert [(a, n) for a, n, _ in bootstrap._states(30, 11, 5)] == [(0, 3), (3, 3), (6, 3), (9, 2)]
    got = {(r.replicate, r.group_key): r.w for r in bootstrap.multinomial_weights(df, 11, 5).collect()}
    assert got == {(i, f"g{j:02d}"): int(want[i][j]) for i in range(11) for j in range(30) if want[i][j]}


def test_no_groups_give_no_draws(spark):
    assert bootstrap.multinomial_weights(spark.createDataFrame([], "group_key string"), 5).count() == 0


def test_tree_of_splits_draws_a_multinomial(spark, monkeypatch):
    """Sums are exact, shares are those of the multinomial, and neither leaves nor partitions matter to a leaf's draws."""
    import numpy as np

    monkeypatch.setattr(bootstrap, "LEAF", 8)
    df = spark.createDataFrame([(f"g{i}",) for i in range(61)] + [("g3",), (None,)], "group_key string")
    rows = bootstrap.tree_weights(df.repartition(5), 400, 3).collect()
    table = np.zeros((400, 61))
    for r in rows:
        table[r.replicate, int(r.group_key[1:])] += r.w
    assert len({(r.replicate, r.group_key) for r in rows}) == len(rows) and min(r.w for r in rows) == 1
    assert (table.sum(axis=1) == 61).all()
    assert abs(table.mean(axis=0) - 1).max() < 0.25 and abs(table.var() - 60 / 61) < 0.05
    pairs = np.cov(table.T)[np.triu_indices(61, 1)]
    assert abs(pairs.mean() + 1 / 61) < 0.01
    assert sorted(map(tuple, bootstrap.tree_weights(df.repartition(2), 400, 3).collect())) == sorted(map(tuple, rows))
    assert {tuple(r) for r in bootstrap.tree_weights(df, 10, 3).collect()} == {tuple(r) for r in rows if r.replicate < 10}
    assert {tuple(r) for r in bootstrap.tree_weights(df, 10, 4).collect()} != {tuple(r) for r in rows if r.replicate < 10}
    assert bootstrap.tree_weights(df.limit(0), 5).count() == 0


def test_packed_draws_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "PIECE", 60)
    monkeypatch.setattr(bootstrap, "LEAF", 4)
    df = spark.createDataFrame([(f"g{i:02}",) for i in range(30)], "group_key string")
    for draw in (bootstrap.multinomial_weights, bootstrap.tree_weights, bootstrap.hash_weights):
        wide = [(r.group_key, at, w) for r in draw(df, 11, pack=True).collect() for at, w in zip(r.at, r.w, strict=True)]
        assert sorted(wide) == sorted((r.group_key, r.replicate, r.w) for r in draw(df, 11).collect())


def test_draws_are_not_broadcast(spark):
    """Spark takes the draws for a few bytes, whatever their number."""
    df = spark.createDataFrame([("r", f"g{i}", i % 2, [i / 9, 1 - i / 9], i % 2) for i in range(9)], "run string, group_key string, target int, probs array<double>, prediction int")
    for weights in (bootstrap.multinomial_weights(df, 20), bootstrap.multinomial_weights(df, 20, pack=True)):
        for plan in (bootstrap.replicate_counts(df, weights, 2), bootstrap.replicate_aurocs(df, weights, 5)):
            assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_two_groups_follow_the_binomial():
    """Chances of each count against the exact ones, at a leaf of one group."""
    from math import comb

    import numpy as np

    drawn = bootstrap.leaf_draws(5, 2, 20_000, 1, 1)[:, 0]
    want = [comb(5, k) * 0.2**k * 0.8 ** (5 - k) for k in range(6)]
    assert np.abs(np.bincount(drawn, minlength=6) / 20_000 - want).max() < 0.012


def test_aurocs_of_replicates_equal_weighted_ones(spark):
    """Ties, groups that aren't drawn, several runs and scores outside 0 to 1, against the metric on weighted rows."""
    import random

    rnd = random.Random(2)
    rows = [(f"r{i % 2}", f"g{rnd.randrange(9)}", rnd.randrange(3), [rnd.choice([0.1, 0.25, 0.5, rnd.random(), 1.5, -0.5]) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "run string, group_key string, target int, probs array<double>")
    weights = bootstrap.multinomial_weights(df, 12, 1)
    weighted = df.join(weights.where("replicate < 7"), "group_key").withColumn("w", F.col("w").cast("double"))
    want = {(r.run, r.replicate): r.macro_auroc for r in metrics.macro_auroc(weighted, ("run", "replicate"), "w").collect()}
    got = {(r.run, r.replicate): r.macro_auroc for r in bootstrap.replicate_aurocs(df, weights, 7).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) if want[k] is not None else got[k] is None for k in want)


def test_aurocs_of_replicates_tie_across_blocks(spark, monkeypatch):
    """Scores that fill several blocks, and draws that come in pieces and need more than eight bits."""
    import random

    monkeypatch.setattr(bootstrap, "BLOCK", 2)
    rnd = random.Random(5)
    rows = [(f"r{i % 2}", f"g{rnd.randrange(9)}", rnd.randrange(3), [rnd.choice([0.1, 0.25, 0.2501, 0.5]) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "run string, group_key string, target int, probs array<double>").coalesce(1)
    drawn = [(f"g{g}", [r], [rnd.choice([1, 2, 3, 700])]) for g in range(9) for r in range(11) if rnd.random() < 0.7]
    packed = spark.createDataFrame(drawn, bootstrap.PACKED)
    weights = spark.createDataFrame([(at[0], g, w[0]) for g, at, w in drawn], "replicate int, group_key string, w int").where("replicate < 9")
    weighted = df.join(weights, "group_key").withColumn("w", F.col("w").cast("double"))
    want = {(r.run, r.replicate): r.macro_auroc for r in metrics.macro_auroc(weighted, ("run", "replicate"), "w").collect()}
    got = {(r.run, r.replicate): r.macro_auroc for r in bootstrap.replicate_aurocs(df, packed, 9).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) if want[k] is not None else got[k] is None for k in want)


def test_draws_as_planes_of_bits():
    import numpy as np

    rng = np.random.default_rng(3)
    for replicates in (1, 8, 9, 500):
        for most in (1, 3, 255, 256, 65535):
            drawn = rng.integers(0, most + 1, (20, replicates)).astype(np.uint32)
            drawn[::3] %= 3
            assert (bootstrap._numbers(bootstrap._planes(drawn), replicates) == drawn).all()
    with pytest.raises(ValueError, match="65535"):
        bootstrap._planes(np.array([[65536]], np.uint32))


def test_hash_draws_are_dealt_to_tasks(spark):
    """Group keys are few bytes, for which Spark ran a single task, that drew all replicates of all groups."""
    df = spark.createDataFrame([(f"g{i}",) for i in range(40)], "group_key string")
    tasks = bootstrap.hash_weights(df, 10, pack=True).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_without_a_group_are_not_drawn(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "group_key string")
    assert {r.group_key for r in bootstrap.multinomial_weights(df, 20).collect()} == {"a", "b"}


def test_bootstrap_query_equals_brute_force(spark, sf_dir):
    import numpy as np

    from cohortlens import catalog
    from cohortlens.plans import views

    rows = views.predictions(spark, sf_dir).select("group_key", "target", "probs").collect()
    names = sorted({r.group_key for r in rows})
    draws = np.random.default_rng(20260927).multinomial(len(names), np.full(len(names), 1 / len(names)), size=2000)
    place = {g: i for i, g in enumerate(names)}
    group = np.array([place[r.group_key] for r in rows])
    target, probs = np.array([r.target for r in rows]), np.array([r.probs for r in rows])
    right = probs.argmax(1) == target
    accuracy, auroc = [], []
    for k, draw in enumerate(draws):
        w = draw[group].astype(float)
        accuracy.append(w[right].sum() / w.sum())
        if k < 500:
            each = []
            for c in range(3):
                score, inverse = np.unique(probs[:, c], return_inverse=True)
                pos = np.bincount(inverse, w * (target == c), len(score))
                neg = np.bincount(inverse, w * (target != c), len(score))
                each.append((pos * (neg.cumsum() - neg / 2)).sum() / (pos.sum() * neg.sum()) if pos.sum() * neg.sum() else None)
            if None not in each:  # a draw without a class has no macro AUROC
                auroc.append(np.mean(each))
    got = {r.metric: r for r in catalog.QUERIES["q83_bootstrap"](spark, sf_dir).collect()}
    for name, values in (("accuracy", accuracy), ("macro_auroc", auroc)):
        assert got[name].n_valid == len(values) and got[name].mean == pytest.approx(np.mean(values), abs=1e-8)
        assert (got[name].ci_low, got[name].ci_high) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])), abs=1e-8)


def test_campaign_query_draws_all_replicates(spark, sf_dir):
    """2,000 draws of all groups, 500 of them for AUROC, of which the table had 20 and 3; against a brute-force version."""
    from hashlib import md5

    import numpy as np

    from cohortlens import catalog

    rows = campaigns.runs(spark, sf_dir).select("run", "group_key", "target", "probs").collect()
    names = sorted({r.group_key for r in rows})
    draws = np.array([[int(md5(f"{g}-{k}".encode()).hexdigest()[:4], 16) % 4 for g in names] for k in range(2000)])
    place = {g: i for i, g in enumerate(names)}
    accuracy, auroc = [], []
    for run in campaigns.RUNS:
        own = [r for r in rows if r.run == run]
        group = np.array([place[r.group_key] for r in own])
        target, probs = np.array([r.target for r in own]), np.array([r.probs for r in own])
        weights = draws[:, group].astype(float)
        accuracy.append(weights[:, probs.argmax(1) == target].sum(1) / weights.sum(1))
        each = []
        for c in range(3):
            score, inverse = np.unique(probs[:, c], return_inverse=True)
            sides = [np.array([np.bincount(inverse, w * side, len(score)) for w in weights[:500]]) for side in (target == c, target != c)]
            whole = sides[0].sum(1) * sides[1].sum(1)
            each.append((sides[0] * (sides[1].cumsum(1) - sides[1] / 2)).sum(1) / np.where(whole > 0, whole, np.nan))
        auroc.append(np.mean(each, axis=0))
    got = {r.metric: r for r in catalog.QUERIES["q38_campaign_table"](spark, sf_dir).collect()}
    for name, values in (("accuracy", np.mean(accuracy, axis=0)), ("macro_auroc", np.mean(auroc, axis=0))):
        known = values[np.isfinite(values)]  # a draw without a class has no macro AUROC
        assert (got[name].ci_low, got[name].ci_high) == pytest.approx(tuple(np.quantile(known, [0.025, 0.975])), abs=1e-8)


def test_modes_and_spread(spark):
    rows = spark.createDataFrame([("a", "r1", "x"), ("a", "r2", "x"), ("b", "r1", "x"), ("b", "r2", "y"), ("c", "r1", "x"), ("c", "r1", "z"), ("c", "r2", "x"), ("d", "r1", "x")], "set string, run string, path string")
    assert {r.set: r["mode"] for r in campaign.mode(rows).collect()} == {"a": "shared", "b": "pooled", "c": "overlapping", "d": "shared"}
    runs = spark.createDataFrame([("r1", 1.0, None), ("r2", 3.0, 2.0)], "run string, accuracy double, ece double")
    got = {r.metric: (r["mean"], r.sd) for r in campaign.spread(runs, names=("accuracy", "ece")).collect()}
    assert got == {"accuracy": (2.0, pytest.approx(2**0.5)), "ece": (2.0, None)}


def test_reference_check(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None), ("z", 2.0), ("v", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("x", 1.0 + 1e-10), ("y", None), ("z", None), ("v", 1.1)], "metric string, value double")
    assert {r.metric: r.matches for r in metrics.compare_metrics(a, b).collect()} == {"x": True, "y": True, "z": False, "v": False}


def test_vectors(spark):
    df = spark.createDataFrame([([0.5, 0.2, 0.3], 2, [1.0, 2.0, 3.0], [True, False, True])], "probs array<double>, target int, logits array<double>, mask array<boolean>")
    row = df.select(arrays.restricted("probs", [0, 2]).alias("p"), arrays.restricted_target("target", [0, 2]).alias("t"), arrays.masked_softmax("logits", "mask").alias("s"), arrays.masked_cross_entropy("logits", "mask", "target").alias("l")).first()
    assert row.p == pytest.approx([0.625, 0.375]) and row.t == 1 and row.s[1] == 0
    assert row.s[2] == pytest.approx(0.880797) and row.l == pytest.approx(0.126928, abs=1e-6)
    with pytest.raises(Exception, match="isn't available"):
        df.withColumn("target", F.lit(1)).select(arrays.masked_cross_entropy("logits", "mask", "target")).collect()
    with pytest.raises(Exception, match="outside the kept"):
        df.select(arrays.restricted_target("target", [0, 1], strict=True)).collect()


def test_scalars(spark):
    df = spark.createDataFrame([(400, 200, 0.9126, 0.8504, 0.9645, float("nan"))], "w int, h int, p double, lo double, hi double, n double")
    row = df.select(scalars.letterbox("w", "h", 64).alias("b"), scalars.interval_text("p", "lo", "hi").alias("t"), scalars.finite_or_null(F.col("n")).alias("n")).first()
    assert tuple(row.b) == (0, 16, 64, 32) and row.t == "91.26 [85.04, 96.45]" and row.n is None


def test_class_weights_and_balance(spark):
    df = spark.createDataFrame([("a", 0)] * 3 + [("a", 1)] + [("b", 1)] * 2, "source string, target int")
    from cohortlens.operators import splits

    assert {r.target: r.weight for r in metrics.class_weights(df, 2).collect()} == {0: 1.0, 1: 1.0}
    got = {(r.source, r.target): r.weight for r in splits.balanced_weights(df).collect()}
    assert got == {("a", 0): pytest.approx(1 / 12), ("a", 1): pytest.approx(1 / 4), ("b", 1): pytest.approx(1 / 4)}


def test_rank_correlation(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 200) / 5, rng.integers(0, 9, 200) / 4 - 1
    y[:120] = x[:120]
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("a", None, 1.0), ("c", 1.0, 0.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r for r in metrics.rank_correlation(df, "x", "y", ("k",)).collect()}
    assert got["a"].rows == 200 and got["a"].spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and got["c"].spearman is None


@pytest.mark.parametrize("n", [1, 2, 199, 200, 201, 399, 1000, 5003])
def test_downsampled_places(spark, n):
    import numpy as np

    df = spark.range(n).selectExpr("'k' as k", "case when id > 0 then id / 997.0D - 0.3D end as v", "id as i").repartition(3)
    got = sorted(r.i for r in curves.downsampled(df, ("k",), "v").collect())
    assert got == (list(range(n)) if n <= 200 else sorted(set(np.round(np.linspace(0, n - 1, 200)).astype(int).tolist())))


def test_galleries_and_controls_are_cut_before_they_are_moved(spark, sf_dir):
    """The rows of a class meet in one task only after each part of the table has been cut to as many as are asked for."""
    from cohortlens.operators import gallery
    from cohortlens.plans import views

    plan = gallery.control_sample(views.predictions(spark, sf_dir), views.CLASSES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3


def test_filters_do_not_hash_predictions_again(spark, sf_dir):
    """Tests of a probability for null, also those that Spark adds by itself, once stood below the hashes of the view."""
    rows = views.predictions(spark, sf_dir).select("cohort", "target", "probs", F.element_at("probs", 1).alias("x"), F.element_at("probs", 2).alias("y"))
    for plan in (metrics.rank_correlation(rows, "x", "y", ("cohort",)), metrics.macro_auroc(rows)):
        lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert any("md5" in line for line in lines) and not any("md5" in line for line in lines if "Filter" in line)


def test_hash_draws_are_made_once_a_group(spark):
    """As a column of arrays they were hashed again for each use, in as few tasks as the groups fill."""
    df = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "group_key string")
    drawn = bootstrap.hash_weights(df, 40, pack=True)
    assert "transform" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert {r.group_key for r in drawn.collect()} == {"a", "b"}
    assert bootstrap.hash_weights(df.limit(0), 40, pack=True).collect() == []


def test_runs_are_hashed_once(spark, sf_dir):
    plan = campaigns.runs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
