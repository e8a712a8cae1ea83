import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import phrases

KIND = "doc_id long, text string, lang string, chunk string, kind int"


def brute(rows, least, most):
    """Counts of all runs of 1 to 4 words in dictionaries; rows are (text, lang)."""
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    out = []
    for lang in n:
        found = []
        for (of, p), a in f.items():
            if of != lang or len(p) < 2:
                continue
            longer = [c for (o, q), c in f.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * c >= 80 * a for c in longer):
                continue
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, docs=120):
    rnd = random.Random(seed)
    fixed = [["New", "York", "city"], ["a", "b", "a", "b"], ["é", "Ü", "x"], ["zz", "zz", "zz", "zz", "zz"]]
    rows = []
    for _ in range(docs):
        words = []
        for _ in range(rnd.randrange(40)):
            words += rnd.choice(fixed) if rnd.random() < 0.3 else [rnd.choice("abcdefgh") + rnd.choice(["", "", "1"])]
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; ", "\xa0 "]) for w in words)
        rows.append((text, rnd.choice(["en", "en", "de", None])))
    return [*rows, (None, "en"), ("", None), (" .. ,\n", "fr"), rows[0], rows[0], ("one", "und"), ("a b", "")]


def run(spark, rows, least, most, parts=5):
    df = spark.createDataFrame([(i, t, x, "y", 1) for i, (t, x) in enumerate(rows)], KIND).repartition(parts)
    return sorted(map(tuple, phrases.collocations(df, least=least, most=most).collect()))


@pytest.mark.parametrize(("seed", "least", "most"), [(1, 3, 2000), (2, 5, 7)])
def test_same_as_brute_force(spark, seed, least, most):
    rows = corpus(seed)
    assert run(spark, rows, least, most) == brute(rows, least, most)


def test_small_shards_and_groups(spark, monkeypatch):
    """Shards end inside long texts, and phrases are extended a few at a time."""
    monkeypatch.setattr(phrases, "SHARD", 50)
    monkeypatch.setattr(phrases, "GROUP", 3)
    rows = corpus(3, 20) + [(" ".join(t or "" for t, _ in corpus(4, 30)), "en")]
    made = list(phrases._pieces(pa.RecordBatch.from_pydict({"text": [rows[-1][0]], "lang": ["en"]}), {}, 50))
    assert len(made) > 3 and all(p.opens[0] for p in made)
    assert run(spark, rows, 3, 100, parts=2) == brute(rows, 3, 100)


def test_empty_table(spark):
    assert run(spark, [], 3, 10) == []
    assert run(spark, [(None, None), ("", "en")], 3, 10) == []


def test_bitmaps():
    at = np.array([-1, 0, 1, 0, 1, 0, -1, *[0] * 130])
    held = phrases.phrases_at(np.zeros(2, np.uint64), at)
    maps = held.maps
    assert maps.counts(2).tolist() == [int((at == 0).sum()), 2] and maps.first().tolist() == [1, 2]
    moved, inside, last = maps.shifted()
    places = lambda m, o: sorted(int(b) * 64 + i for w, b, x in zip(m.owner, m.block, m.bits, strict=True) if w == o for i in range(64) if int(x) >> i & 1)
    for owner in (0, 1):
        assert places(moved, owner) == [p + 1 for p in np.flatnonzero(at == owner)]
    for p in np.flatnonzero(at >= 0):
        now = (inside if (p + 1) % 64 else last)[held.entry[p]]
        assert moved.owner[now] == at[p] and moved.block[now] == (p + 1) // 64


def test_planes():
    ids = np.array([-1, 0, 5, 254, 255, 256, 70_000, -1])
    assert phrases._from_planes(phrases._planes(ids)).tolist() == ids.tolist() and len(phrases._from_planes(phrases._planes(ids[:0]))) == 0


def test_what_shards_send():
    """Keys and counts leave a shard in less than 8 bytes each, leading bits and counts in less than 5."""
    rnd = np.random.default_rng(9)
    key, count = rnd.integers(0, 1 << 64, 300_000, np.uint64), np.minimum(rnd.zipf(2.2, 300_000), 9000)
    size = lambda rows: sum(len(r[3]) + len(r[4]) for r in rows) / len(key)
    assert size(phrases._sent(key, count, 5, 0)) < 8
    assert size(phrases._sent(key, count, 5, 0, phrases.LEADING, 30)) < 5


def test_packed_numbers():
    rnd = np.random.default_rng(10)
    for bits in (1, 7, 8, 9, 40, 63, 64):
        for n in (1, 2, 1000):
            numbers = np.sort(rnd.integers(0, (1 << bits) - 1, n, np.uint64, endpoint=True))
            assert (phrases._from_ascending(phrases._ascending(numbers)) == numbers).all()
            counts = rnd.choice([1, 1, 1, 2, 300, 70_000], n)
            assert (phrases._from_mostly_ones(phrases._mostly_ones(counts), n) == counts).all()


@pytest.mark.parametrize("bits", [1, 9])
def test_phrases_that_share_leading_bits(spark, monkeypatch, bits):
    """Rare phrases with the bits of frequent ones neither count nor keep these from being spelled."""
    monkeypatch.setattr(phrases, "LEADING", bits)
    monkeypatch.setattr(phrases, "SHARD", 60)
    rows = corpus(5, 60)
    assert run(spark, rows, 3, 2000) == brute(rows, 3, 2000)
