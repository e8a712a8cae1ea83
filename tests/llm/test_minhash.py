import numpy as np
import pytest

from cohortlens.llm import minhash
from cohortlens.llm.common import splitmix
from tests.llm.test_ngram_join import brute, corpus, key


def wanted(rows, words, percent):
    return sorted(((k, n, c, k is None or k == c) for k, n, c in brute(rows, words, percent)), key=key)


@pytest.mark.parametrize(("seed", "words", "percent", "early"), [(1, 4, 80, 2), (2, 4, 80, 0), (3, 5, 80, 1), (4, 2, 65, 2)])
def test_same_as_brute_force(spark, seed, words, percent, early):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "n", "k") for r in rows], "doc_id long, text string, n_shingles string, keys string").repartition(3)
    got = [tuple(r) for r in minhash.linked(df, words=words, percent=percent, early=early).collect()]
    assert sorted(got, key=key) == wanted(rows, words, percent)


def test_empty_table(spark):
    assert minhash.linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_text_ids_and_a_long_text(spark):
    rows = [*corpus(3, 40), (2000, " ".join(f"x{i}" for i in range(60_000))), (2001, " ".join(f"x{i}" for i in range(200, 60_000)))]
    df = spark.createDataFrame([(None if k is None else f"id-{k:05d}", t) for k, t in rows], "doc_id string, text string")
    got = sorted((tuple(r) for r in minhash.linked(df).collect()), key=str)
    name = lambda k: None if k is None else f"id-{k:05d}"
    assert got == sorted(((name(k), n, name(c), kept) for k, n, c, kept in wanted(rows, 4, 80)), key=str)


def test_collisions_follow_the_similarity():
    """Coordinates of a pair collide independently: mean and variance are those of a binomial."""
    found = []
    for r in range(400):
        tokens = splitmix(np.arange(r * 1000, r * 1000 + 110, dtype=np.uint64))
        a, b = minhash.signature_keys(np.concatenate([tokens[:100], tokens[10:]]), np.array([100, 100]), 64)
        found.append(int((a == b).sum()))
    share = 90 / 110
    assert abs(np.mean(found) - 64 * share) < 0.7 and 0.7 < np.var(found) / (64 * share * (1 - share)) < 1.4


def test_threshold():
    t = minhash.least_collisions(80, 64, 1e-9)
    assert 20 < t < 35 and minhash.least_collisions(100, 64, 1e-9) == 64 and minhash.least_collisions(1, 64, 1e-9) == 1


def test_prefixes_lose_no_pair(spark):
    """Every pair of different components with enough common keys is found, whatever the postings hold."""
    rng = np.random.default_rng(7)
    rows = [(r, 10, int(rng.integers(6)), int(rng.integers(5)), sorted(rng.choice(20, 8, replace=False).tolist())) for r in range(60)]
    df = spark.createDataFrame(rows, "rk long, n long, root long, hits long, keys array<long>")
    ranked = minhash.contested(df.selectExpr("explode(keys) as key", "rk", "n", "root", "hits"), 5)
    found = {(r.a, r.b) for r in minhash.prefix_pairs(ranked, df.selectExpr("rk", "10L as m", "array_repeat(0L, 8) as odd"), 80, 5).collect()}
    assert len({frozenset(p) for p in found}) == len(found)
    want = {frozenset((x[0], y[0])) for x in rows for y in rows if x[0] < y[0] and x[2] != y[2] and len(set(x[4]) & set(y[4])) >= 5}
    assert want <= {frozenset(p) for p in found}


def test_star_names_are_of_one_component(spark):
    links = [(1, 9), (2, 9), (9, 3), (3, 4), (4, 5), (20, 21), (30, 31), (30, 32), (31, 33), (31, 34), (31, 35), (33, 36)]
    got = {r.node: r.component for r in minhash.star_names(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 9, 2: 9, 9: 9, 3: 9, 4: 4, 5: 4, 20: 21, 21: 21, **dict.fromkeys([30, 31, 32, 33, 34, 35, 36], 31)}


def test_shared_tokens(spark):
    sets = {1: [5, 6, 7], 2: [6, 7, 8], 3: [7, 9], 4: [1, 2]}
    roots = {1: 1, 2: 1, 3: 3}
    df = spark.createDataFrame([(k, len(v), bytearray(np.array(v, "<i8").tobytes())) for k, v in sets.items()], "rk long, n long, tokens binary")
    got = {r.rk: r.m for r in minhash.shared_tokens(df, spark.createDataFrame(list(roots.items()), "rk long, root long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_odd_sketches_differ_in_no_more_bits_than_the_sets(spark):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(12)]
    df = spark.createDataFrame([(i, len(s), bytearray(splitmix(s).tobytes())) for i, s in enumerate(sets)], "rk long, n long, tokens binary")
    odd = {r.rk: r.odd for r in minhash.odd_sketches(df).collect()}
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            apart = sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(odd[i], odd[j], strict=True))
            differ = len(np.setxor1d(s, t))
            assert apart <= differ and (differ - apart) % 2 == 0


def test_a_group_of_copies_alike_but_not_linked(spark):
    """Copies of one text, each with its own words: none is linked, and none is compared in the end."""
    text = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if (k + 3 * i) % 30 else f"x{i}-{k}" for k, w in enumerate(text))) for i in range(60)]
    got = [tuple(r) for r in minhash.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=key) == wanted(rows, 4, 80)
