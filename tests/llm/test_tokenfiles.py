import random
import zlib

import numpy as np
import pytest

from cohortlens.llm import files, mixcoder, queries, tokenfiles
from cohortlens.storage import new_path

VOCABULARY = queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_coder_round_trip():
    rnd = np.random.default_rng(4)
    cases = [np.zeros(0, int), np.array([5]), np.full(5000, 7), rnd.integers(0, 49_408, 7000), rnd.zipf(1.3, 20_000) % 49_408, np.arange(4097), np.tile(rnd.integers(0, 9, 50), 100), np.array([2**19, 0] * 60)]
    for ids in cases:
        coded = mixcoder.encode(ids.astype(np.int32))
        assert (mixcoder.decode(coded) == ids).all()


@pytest.mark.parametrize(("known", "group"), [(3, 4096), (1 << 14, 3), ((1 << 14) + 1, 3), (70_000, 4096)])
def test_coder_in_groups_of_blocks_and_with_many_ids(monkeypatch, known, group):
    monkeypatch.setattr(mixcoder, "GROUP", group)
    rnd = np.random.default_rng(9)
    ids = np.concatenate([rnd.permutation(known), rnd.zipf(1.3, 9000) % known]).astype(np.int32) * 14
    assert (mixcoder.decode(mixcoder.encode(ids)) == ids).all()


def test_blocks_learn_many_ids_at_once(monkeypatch):
    calls, learn = [], mixcoder._Model._learn
    monkeypatch.setattr(mixcoder._Model, "_learn", lambda self: (calls.append(self.steps), learn(self)))
    mixcoder.encode(np.arange(3 * mixcoder.BLOCK, dtype=np.int32) % 50)
    assert len(calls) <= mixcoder.BLOCK // mixcoder.LEARN + len(mixcoder._EARLY)


def test_repeats_cost_little():
    rnd = np.random.default_rng(5)
    assert len(mixcoder.encode(np.tile(rnd.integers(0, 40_000, 64), 64).astype(np.int32))) < 4096 * 2 / 4


def test_changes_are_found():
    rnd = random.Random(6)
    coded = tokenfiles.section([3, None], [1000, 2000], np.array([rnd.randrange(300) for _ in range(3000)], np.int32))
    assert tokenfiles.opened(coded)[0] == [3, None]
    for _ in range(30):
        at = rnd.randrange(len(coded) - 2000, len(coded))
        with pytest.raises(mixcoder.Corrupt):
            tokenfiles.opened(coded[:at] + bytes([coded[at] ^ 1]) + coded[at + 1 :])


def test_words_as_the_library(library):
    own, rnd = tokenfiles.WordEncoder(VOCABULARY, 2), random.Random(7)
    alphabet = " \n\t  ab'sSdZéÉñ1٣\x1c\x85\xa0 　.,|x😀ßΣς中́ắ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 16))) for _ in range(4000)]
    texts += ["a<|endoftext|> b<|startoftext|>c", "don't we'LL I'D", "x" * 5000]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_stops_make_no_new_words(library):
    own = tokenfiles.WordEncoder(VOCABULARY, 2)
    text = "abcq xyzq vwxq abcq, xyzq, vwxq, abcq. xyzq. vwxq. don't, é, 5. ..,"
    assert np.frombuffer(own.encode([text.encode()])[0], "<i4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert own.count == len({"end", "abcq", "xyzq", "vwxq", ",", ".", "don't", "é,", "5.", "..,"})


def test_texts_and_words_encoded_apart_stay_in_their_places(library):
    own = tokenfiles.WordEncoder(VOCABULARY, 2)
    texts = ["", "<|endoftext|>", "", "b, " + "x" * 40 + ". " + "x" * 40 + " c.", "<|startoftext|>a, b", "d", " \n ", "e. <|endoftext|>", ""]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text
    assert own.encode([b"", b" "]) == [np.array([2], "<i4").tobytes()] * 2


def test_the_table_of_words_stays_within_bounds(monkeypatch, library):
    monkeypatch.setattr(tokenfiles, "CACHE", 1 << 18)
    own, often = tokenfiles.WordEncoder(VOCABULARY, 2), "often used words"
    for k in range(4):
        words = [f"{i:x}k" for i in range(k * 100_000, (k + 1) * 100_000)]
        ids = own.encode([" ".join(words[a : a + 1000]).encode() for a in range(0, len(words), 1000)] + [often.encode()])
        assert np.frombuffer(ids[-1], "<i4").tolist() == [*library.encode(often, add_special_tokens=False).ids, 2]
        assert np.frombuffer(ids[0], "<i4").tolist() == [*library.encode(" ".join(words[:1000]), add_special_tokens=False).ids, 2]
        assert len(own.size) == 1 << 18
    assert np.frombuffer(own.encode([" ".join(f"{i:x}q" for i in range(300_000)).encode()])[0], "<i4")[-1] == 2


def check(rows, got, library):
    start = 0
    want = []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_files(spark, library):
    rnd = random.Random(8)
    rows = [(rnd.randrange(50), " ".join(rnd.choice(["one", "Two,", "three3"]) for _ in range(rnd.randrange(30)))) for _ in range(120)] + [(None, "null id"), (7, None), (8, ""), (9, "w " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    folder = new_path(spark, "tokens")
    manifest = tokenfiles.write(df, VOCABULARY, folder, file_tokens=400)
    assert len(manifest) > 4
    check(rows, [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids_le)) for r in tokenfiles.read(spark, folder).collect()], library)
    empty = new_path(spark, "tokens")
    assert tokenfiles.write(df.limit(0), VOCABULARY, empty) == []
    assert tokenfiles.read(spark, empty).collect() == []
    assert files.get(empty, "manifest.tsv") == b""


def test_query(spark, sf_dir, library):
    got = [tuple(r) for r in queries.op7_token_files(spark, sf_dir).collect()]
    check([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()], got, library)


@pytest.mark.parametrize(("docs", "tokens"), [(3, [300]), (4, [400]), (5, [500]), (9, [400, 500]), (10, [400, 400, 200]), (13, [400, 400, 500])])
def test_little_that_is_left_goes_with_the_file_before(spark, library, docs, tokens):
    rows = [(7, f"{chr(97 + i)} " * 99) for i in range(docs)]
    folder = new_path(spark, "tokens")
    manifest = tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, folder, file_tokens=400)
    assert [n for _, _, n in manifest] == tokens
    check(rows, [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids_le)) for r in tokenfiles.read(spark, folder).collect()], library)


def test_a_long_document_stays_alone(spark, library):
    rows = [(7, "a " * 999), (7, "b " * 49)]
    folder = new_path(spark, "tokens")
    assert [n for _, _, n in tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, folder, file_tokens=400)] == [1000, 50]
    check(rows, [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids_le)) for r in tokenfiles.read(spark, folder).collect()], library)
