import random
import re

from cohortlens.llm import decontaminate, queries


def brute_tiles(item, doc, least):
    found, a, b = [], [False] * len(item), [False] * len(doc)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and not a[i + n] and not b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return found
        found.append(best)
        a[best[0] : best[0] + best[2]] = [True] * best[2]
        b[best[1] : best[1] + best[2]] = [True] * best[2]


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    out = []
    for d, text in docs:
        for i, item in items:
            w = words(item)
            if len(w) >= 5:
                part = sum(n for _, _, n in brute_tiles(w, words(text), 5)) / len(w)
                if part >= 0.8:
                    out.append((d, i, round(part, 9)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: [rnd.choice("abcdefghijklmnop") + rnd.choice(["", "é", "x", "Y"]) for _ in range(n)]
    items = [(i, " ".join(text(rnd.choice([4, 5, 14, 25, 40])))) for i in range(12)] + [(12, None), (13, ""), (None, "A b c d e f g"), (1, "same id, another text of some length")]
    docs = []
    for d in range(50):
        ws = text(rnd.randrange(60))
        for _, item in rnd.sample(items[:12], rnd.randrange(3)):
            part = item.split()
            how = rnd.randrange(4)
            if how == 1:
                cut = len(part) // 2
                part = [*part[cut:], "zz", *part[:cut]]
            elif how == 2:
                part[rnd.randrange(len(part))] = "changed"
            elif how == 3:
                part = [w.upper() + "," for w in part]
            at = rnd.randrange(len(ws) + 1)
            ws[at:at] = part
        docs.append((d, " ".join(ws)))
    return [*docs, (50, None), (51, ""), (None, "a b c d e f g"), docs[3]], items


def test_same_as_brute_force(spark):
    docs, items = corpus(3)
    df, bench = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, round(r.coverage, 9)) for r in decontaminate.contaminated(df, bench).collect()]
    want = brute(docs, items)
    assert len(want) > 20
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns
    dirty = {d for d, _, _ in want}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in dirty), key=str)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = corpus(4)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    got = [(r.doc_id, r.item_id, round(r.coverage, 9)) for r in decontaminate.contaminated(df, bench).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items), key=str)


def test_tiles_in_any_order():
    import numpy as np

    rnd = random.Random(8)
    for _ in range(60):
        a, b = ([rnd.randrange(3) for _ in range(rnd.randrange(1, 30))] for _ in range(2))
        got = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert got == brute_tiles(a, b, 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(none, bench).collect() == []
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.contaminated(one, bench.limit(0)).collect() == []
    assert decontaminate.decontaminated(one, bench.limit(0)).count() == 1


def test_items_without_ids(spark):
    bench = spark.createDataFrame([(None, "a b c d e f")], "item_id long, text string")
    rows = decontaminate.contaminated(spark.createDataFrame([(1, "x a b c d e f")], "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.item_id, r.coverage) for r in rows] == [(1, None, 1.0)]


def test_items_in_several_blocks(spark, monkeypatch):
    rows, items = corpus(5)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).select("doc_id", "item_id").collect()), key=str)
    kept = sorted(map(tuple, decontaminate.decontaminated(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", sum(len(words(t)) for _, t in items) // 3)
    parts = list(decontaminate.blocks(bench, "item_id", "text"))
    assert len(parts) > 2 and sum(map(len, parts)) == sum(t is not None for _, t in items)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).select("doc_id", "item_id").collect()), key=str) == whole
    assert sorted(map(tuple, decontaminate.decontaminated(docs, bench).collect()), key=str) == kept


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in queries.op3_decontamination(spark, sf_dir).collect())
    assert got and got == sorted(brute(docs, items))
