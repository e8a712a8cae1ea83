import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import quality


def test_gradients():
    rnd = np.random.default_rng(0)
    x, n, y = rnd.normal(size=(9, 5)), np.array([1, 3, 5]), np.array([1.0, 0.0, 1.0])
    p = {k: v + 0.1 for k, v in quality.GatedAttention.start(5, 1, 4, 3).items()}

    def loss(q):
        s = quality.GatedAttention.forward(q, x, n)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, grad in quality.GatedAttention.backward(p, x, n, y).items():
        flat = p[k].reshape(-1)
        for i in range(min(len(flat), 6)):
            was = flat[i]
            flat[i] = was + 1e-6
            up = loss(p)
            flat[i] = was - 1e-6
            down = loss(p)
            flat[i] = was
            assert grad.reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_passages_cover_whole_texts():
    text = " ".join(f"w{i}" for i in range(200))
    x, n = quality.passages(pa.array([text, None, "", "one", "a b " * 64]))
    assert n.tolist() == [4, 1, 1, 1, 2]
    assert np.isfinite(x).all()
    assert np.expm1(x[:4, 0]).round().tolist() == [64, 64, 64, 8]
    alone, _ = quality.passages(pa.array([" ".join(text.split()[64:128])]))
    assert np.allclose(alone[0, :8], x[1, :8])


def test_attention_finds_the_passage():
    rnd = np.random.default_rng(3)
    n = rnd.integers(2, 8, 300)
    x = rnd.normal(size=(n.sum(), 6))
    y = (np.arange(300) % 2).astype(float)
    spot = np.cumsum(n) - 1
    x[spot, 0] = np.where(y == 1, 4.0, -4.0)
    x[spot, 1] = 5.0
    model = quality.GatedAttention.fit(x, n, y, epochs=40)
    assert ((model.score(x, n) >= 0.5) == y).mean() > 0.95
    assert model.attention(x, n)[spot].mean() > 1.5 / n.mean()


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.scored(docs.selectExpr("*", "1 as score"), quality.fitted(docs, labels)).collect()
    assert sorted(round(r.score, 6) for r in out) == [0.5, 0.5, 0.5]
    assert quality.scored(docs.limit(0), quality.fitted(docs, labels)).collect() == []


def test_query(spark, sf_dir):
    from cohortlens.llm import queries

    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    out = queries.op2_quality(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(out) == docs.count()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [(r.predicted, label[r.doc_id]) for r in out if r.held_out and r.doc_id in label]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([a == b for a, b in held if b == 0]) > 0.9
