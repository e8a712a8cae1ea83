import random

import numpy as np
import pytest

from cohortlens.llm import ngram_join


def grams(text, words):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + words]) for i in range(max(len(ws) - words + 1, 1))} if ws else set()


def brute(rows, words, percent):
    sets = [grams(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(k, len(sets[i]), None if k is None else least[root(i)]) for i, (k, _) in enumerate(rows)]


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(300)}"
    base = [[word() for _ in range(rnd.choice([3, 5, 9, 40, 80, 200]))] for _ in range(12)]
    page = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        ws = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            at = rnd.randrange(len(ws))
            ws[at : at + rnd.randrange(2)] = [word()] * rnd.randrange(2)
        if rnd.random() < 0.2:
            ws = page + [word() for _ in range(rnd.randrange(8, 14))]
        rows.append((1000 - i, rnd.choice([" ", "\n"]).join(ws)))
    return [*rows, (1, None), (2, ""), (3, " \t "), (None, rows[0][1]), (4, "One"), (5, "ONE"), (6, "one two three"), rows[5], (7, rows[5][1].upper())]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 2, 70), (5, 4, 100)])
def test_same_as_brute_force(spark, seed, words, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_shingles string").repartition(3)
    got = [tuple(r) for r in ngram_join.linked(df, words=words, percent=percent).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, words, percent), key=key)


@pytest.mark.parametrize("early", [0, 2])
def test_pairs_of_frequent_tokens(spark, early):
    rows = corpus(9, 60)
    got = [tuple(r) for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), rare=2, early=early).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 4, 85), key=key)


def test_empty_table(spark):
    assert ngram_join.linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_text_ids(spark):
    rows = corpus(3, 60)
    df = spark.createDataFrame([(None if k is None else f"id-{k:05d}", t) for k, t in rows], "doc_id string, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(df).collect()), key=str)
    name = lambda k: None if k is None else f"id-{k:05d}"
    assert got == sorted(((name(k), n, name(c)) for k, n, c in brute(rows, 4, 85)), key=str)


@pytest.mark.parametrize("long", [30, 60, 150])
def test_long_sets_index_frequent_tokens_alone(spark, monkeypatch, long):
    monkeypatch.setattr(ngram_join, "LONG", long)
    rows = corpus(10, 90)
    got = [tuple(r) for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), rare=2, early=0).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 4, 85), key=key)


def test_signatures_of_a_very_long_text():
    n = 200_000
    tokens = np.arange(n, dtype=np.uint64)
    keys, small, left = ngram_join.signatures(tokens, np.full(n, 1000), 85, None)
    assert len(keys) == len(small) == len(left) <= n
