import hashlib
import random
from collections import Counter

import pytest

from cohortlens.llm import substring


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[s : s + window]) for _, w in words for s in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    shared = [text(n) for n in (34, 35, 36, 50, 120)]
    rows = []
    for i in range(60):
        words = text(rnd.randrange(0, 150))
        for s in rnd.sample(shared, rnd.randrange(0, 3)):
            at = rnd.randrange(len(words) + 1)
            words[at:at] = s
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(words)))
    rows += [(60, None), (61, ""), (None, "x y"), (62, rows[3][1]), (3, rows[3][1]), (63, "a " * 90), (64, "  \n "), (65, " ".join(shared[4] * 3)), (66, "é\x85ü " * 40 + " ".join(shared[1]))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in substring.remove_repeats(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 35), key=key)


def test_smaller_window(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, marks string, n_words int")
    got = [tuple(r) for r in substring.remove_repeats(df, window=10, period=7, cover=(0, 1, 3)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 10), key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(df).collect() == []


def test_no_cover():
    with pytest.raises(ValueError):
        substring.anchor_kernel(cover=(0, 1, 2))


def test_query(spark, sf_dir):
    from cohortlens.llm import queries

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substring_dedup(spark, sf_dir).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 35)}


def test_text_ids_and_a_very_long_text(spark):
    rnd = random.Random(12)
    long = [f"w{rnd.randrange(5000)}" for _ in range(120_000)]
    rows = [("a", " ".join(long)), ("b", " ".join(long[70_000:70_060])), (None, "x y")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id string, text string, dk string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()}
    assert got == {"a": (120_000, 60), "b": (60, 60), None: (2, 0)}
    assert substring.remove_repeats(df.limit(0)).collect() == []
