import hashlib
import random

import numpy as np
import pytest

from cohortlens.llm import bpe, queries

VOCABULARY = queries.vocabulary("byte_bpe_50k.json")
ALPHABET = " \n\t  ab'sdZéñ1٣२\x1c\x85\xa0 　.,|x😀ß中́"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def texts():
    rnd = random.Random(5)
    out = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    return [*out, "a<|endoftext|> b<|endoftext|><|endoftext|>", "ab" * 4000 + "x" * 900, "word " * 500, " lead", "trail ", "a  b", "a \n b"]


def test_same_ids_as_the_library(library):
    own = bpe.BytePairEncoder(VOCABULARY)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_any_ids_decode_as_in_the_library(library):
    own, rnd = bpe.BytePairEncoder(VOCABULARY), random.Random(6)
    for _ in range(200):
        ids = [rnd.randrange(50_257) for _ in range(rnd.randrange(30))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_heap_and_scan_agree(monkeypatch):
    own, rnd = bpe.BytePairEncoder(VOCABULARY), random.Random(7)
    for _ in range(200):
        word = bytes(rnd.choice(b"abcdeth \xc3\xa9") for _ in range(rnd.randrange(1, 120)))
        by_scan = own.merge(word)
        monkeypatch.setattr(bpe, "LONG", 0)
        assert own.merge(word) == by_scan
        monkeypatch.undo()


def test_dataframes(spark):
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "x" * 50_000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_tokens int")
    coded = bpe.encode_documents(df, VOCABULARY)
    back = [(r.doc_id, r.decoded) for r in bpe.decode_documents(coded, VOCABULARY).collect()]
    assert sorted(back, key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    assert all(len(r.ids_le) == 4 * r.n_tokens for r in coded.collect())
    assert bpe.encode_documents(df.limit(0), VOCABULARY).collect() == []


def test_query(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
