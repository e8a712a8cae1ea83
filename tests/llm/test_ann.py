import math

import numpy as np

from cohortlens.llm import ann, queries


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def brute(rows, k, is_query):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i] = min(fine.get(i, v), v)
    out = {}
    for q in filter(is_query, fine):
        score = [(-dot(fine[q], v), i) for i, v in fine.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


def as_map(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_one_part_is_exact(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [math.nan] + [1.0] * 5), (304, [math.inf] + [1.0] * 5), (None, [1.0] * 6), (3, rows[3][1]), (305, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    assert as_map(ann.nearest(df)) == brute(rows, 20, lambda i: i % 20 == 0)


def test_products_that_cancel_are_ranked_exactly(spark):
    """Large components, almost orthogonal: products are small beside the rounding of their terms."""
    rnd = np.random.default_rng(11)
    q = rnd.normal(size=16) * 1e6
    rows = [(0, q.tolist())]
    for i in range(1, 80):
        v = rnd.normal(size=16) * 1e6
        v -= q * (v @ q) / (q @ q)
        rows.append((i, v.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert as_map(ann.nearest(df)) == brute(rows, 20, lambda i: i % 20 == 0)


def test_fewer_candidates_and_none(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert as_map(ann.nearest(df)) == {20: [(1, 1.5)]}
    assert ann.nearest(df.limit(0)).collect() == []
    assert ann.nearest(df.where("vec_id = 20")).collect() == []


def test_parts_are_balanced():
    rnd = np.random.default_rng(2)
    x = np.concatenate([rnd.normal(c, 0.3, (150, 8)) for c in rnd.normal(0, 2, (6, 8))])
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 10), 6)
    assert np.bincount(part, minlength=6).max() <= math.ceil(150 * 1.05)


def recall(rows, got, some):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = []
    for q in np.flatnonzero(ids % 20 == 0)[:some]:
        s = ann.exact(x[q], x)
        order = [int(i) for i in ids[np.lexsort((ids, -s))] if i != ids[q]][:20]
        found = got[int(ids[q])]
        assert len(found) == 20 and all(v == s[np.flatnonzero(ids == i)[0]] for i, v in found)
        hits.append(len(set(order) & {i for i, _ in found}) / 20)
    return np.mean(hits)


def test_recall_with_many_parts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert ann.wanted_parts(len(rows)) > 4
    assert recall(rows, as_map(ann.nearest(df)), 100) >= 0.9


def grouped(n, groups, seed):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(groups, 24))
    x = centre[rnd.integers(0, groups, n)] + 0.35 * rnd.normal(size=(n, 24))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vectors_in_groups_need_few_parts():
    x = grouped(12_000, 150, 3)
    router = ann.fit_router(x, 40_000)
    assert router.parts == 40 and router.visits < 40 / 3


def test_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 150)
    rows = list(enumerate(grouped(3000, 60, 4).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert ann.wanted_parts(3000) == 20
    assert recall(rows, as_map(ann.nearest(df, most_parts=6)), 60) >= 0.9


def test_parts_that_hold_too_few(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(600)] + [(1000 + i, rnd.normal(size=4).tolist()) for i in range(500)]
    got = as_map(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=400))
    assert all(len(v) == 400 for v in got.values())


def test_query(spark, sf_dir):
    got = as_map(queries.op8_nearest(spark, sf_dir))
    assert all(len(v) == 20 for v in got.values())
