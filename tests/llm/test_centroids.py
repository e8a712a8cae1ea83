import hashlib
import math
import random

import numpy as np
import pytest

from cohortlens.llm import centroids

KIND = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k, rounds, dims, scale):
    """Plain Lloyd rounds over Python integers; rows are (id, vector)."""
    kept = [(i, tuple(math.floor(x * scale) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    means = [v for _, v in seeds]
    if not means:
        return [], []
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((away(v, m), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        means = [tuple(sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)) if c in groups else m for c, m in enumerate(means)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], means


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def check(spark, rows, k=5, rounds=4, dims=3, scale=16, parts=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], KIND).repartition(parts)
    found, means = centroids.clustered(df, k, rounds, dims, scale)
    want, own = brute(rows, k, rounds, dims, scale)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert [tuple(m) for m in means.tolist()] == own
    return found, means


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(centroids, "BLOCK", 40)
    rnd = random.Random(seed)
    at = [[rnd.uniform(-9, 9) for _ in range(3)] for _ in range(6)]
    rows = [(i, [c + rnd.gauss(0, rnd.choice([0.1, 2])) for c in rnd.choice(at)]) for i in range(240)]
    check(spark, rows)


def test_odd_input(spark):
    rnd = random.Random(4)
    rows = [(i, [float(rnd.randrange(3)) for _ in range(3)]) for i in range(80)]  # ties and equal vectors
    rows += [(7, rows[7][1])] * 30 + [(7, [2.0, 2.0, 1.0])] + [(None, [1.0, 0.5, 0.0])] * 3
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [1.0, math.nan, 2.0]), (205, [1.0, math.inf, 2.0]), (206, [0.0] * 4), (207, [-0.01, 0.01, -1e-300])]
    check(spark, rows, k=12)
    check(spark, rows[:3], k=12)
    check(spark, [(None, [1.0, 2.0, 3.0]), (1, None)])
    check(spark, [])


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="too large|OVERFLOW"):
        check(spark, [(1, [1e30, 0.0, 0.0])])


def test_inertia_and_hash(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(50)]
    found, means = check(spark, rows)
    out = centroids.with_inertia(found, means).collect()
    per = {}
    for r in out:
        per[r.cluster] = per.get(r.cluster, 0) + r.distance
    assert len(out) == 50 and all(r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values()) for r in out)
    assert {r.centroid_sha256 for r in out} <= {hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means.tolist()}


def test_cover_tree():
    rng = np.random.default_rng(5)
    points = np.unique(rng.integers(-50, 50, (300, 4)), axis=0)
    tree = centroids.cover_tree(points)
    assert sorted(tree.order) == list(range(len(points))) and tree.size[0] == len(points)
    for node in range(len(tree.centre)):
        inside = tree.order[tree.first[node] : tree.first[node] + tree.size[node]]
        assert tree.centre[node] in inside
        gap = np.sqrt(((points[inside] - points[tree.centre[node]]) ** 2).sum(axis=1))
        assert gap.max() == tree.radius[node]
        kids = range(tree.child[node], tree.child[node] + tree.children[node])
        assert not kids or sum(tree.size[c] for c in kids) == tree.size[node]


def test_pairs_are_pruned():
    rng = np.random.default_rng(6)
    middle = rng.integers(-5000, 5000, (20, 8))
    points = np.unique(np.concatenate([m + rng.integers(-20, 20, (50, 8)) for m in middle]), axis=0)
    best, away, taken = centroids.nearest_centroids(points, centroids.cover_tree(points), middle, centroids.cover_tree(middle))
    every = ((points[:, None] - middle[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (away == every.min(axis=1)).all()
    assert taken < 0.2 * every.size  # groups go to their centroid whole
