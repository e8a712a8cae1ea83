import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from cohortlens.llm import bpe, quality, queries, secrets
from tests.llm import test_decontaminate, test_ngram_join


def test_same_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text", "source").collect())
    known = [r for r in rows if r[0] in labels and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    x, n = quality.passages(pa.array([t for _, t, _ in known]))
    model = quality.GatedAttention.fit(x.astype(float), n, np.array([float(labels[r[0]]) for r in known]))
    score = model.score(*quality.passages(pa.array([t for _, t, _ in rows])))
    rows = [r for r, s in zip(rows, score, strict=True) if s >= 0.5]
    groups = test_ngram_join.brute([r[:2] for r in rows], 5, 80)
    rows = [r for r, (k, _, least) in zip(rows, groups, strict=True) if k == least]
    dirty = {d for d, _, _ in test_decontaminate.brute([r[:2] for r in rows], items)}
    rows = [r for r in rows if r[0] not in dirty]
    judged = secrets._judged(secrets.trained(), [t for _, t, _ in rows], [s for _, _, s in rows])
    own, want = bpe.encoder(queries.vocabulary("byte_bpe_50k.json")), {}
    for (k, text, _), spots in zip(rows, judged, strict=True):
        for a, b, kind, s in reversed(spots):
            text = f"{text[:a]}[SECRET:{kind}]{text[b:]}" if s >= 0.5 else text
        want[k] = own.encode_le(text)
    assert len(want) > 100
    assert {r.doc_id: bytes(r.ids_le) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (7_000_000, "", "", "", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.count() > 10
    ids = [r.doc_id for r in docs.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))


def test_rows_of_one_id_are_judged_apart(spark, sf_dir):
    long = lambda k: " ".join(f"{k}{i}" for i in range(60))
    a, b, c = long("a"), long("b"), long("c")
    rows = [(3, a), (7, f"{a} more"), (7, b), (8, c), (8, f"{c} more"), (8, f"{c} more"), (9, ""), (9, ""), (9, None), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, docs, sf_dir).collect()]
    of_8 = [t for k, t in got if k == 8]
    assert len(of_8) == 1 and of_8[0] in (c, f"{c} more")
    assert sorted((r for r in got if r[0] != 8), key=str) == sorted([(3, a), (7, b), (9, ""), (9, None), (None, a), (None, a)], key=str)


def test_columns_with_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    names = ["score", "lower_text", "path", "dk", "rk", "component", "n", "__text", "__path", "__score", "block"]
    extra = docs.selectExpr("*", *(f"concat('{n}', doc_id) AS {n}" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, sf_dir), stage(spark, extra, sf_dir)
        assert out.columns == extra.columns
        rows = out.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
        assert sorted(r[:5] for r in map(tuple, rows)) == sorted(map(tuple, plain.collect()))
