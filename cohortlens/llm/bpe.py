"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is held as one array of part ids and one of the ranks of adjacent pairs. The least rank is found by scanning,
its boundary is deleted, and the ranks on both sides are refreshed. Words with more than ``LONG`` parts keep the same
order of merges (rank, then position) in a heap over a linked list, as scanning would be quadratic in them.

Results for odd input: null text is empty text; empty text has no ids and decodes to the empty string; invalid id
sequences decode with U+FFFD as ``bytes.decode(errors="replace")`` does; repeated rows are encoded row by row; extra
input columns are ignored, so their names can't clash; very long texts are encoded whole; of equal ranks the first pair is
merged; an empty table gives no rows; a null id is kept.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import CACHES, in_arrow, slices

NONE = 1 << 62
#: Parts from which the heap is used.
LONG = 192
#: Entries of a worker's cache of words; it is emptied when full.
CACHE = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next free code point from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class BytePairEncoder:
    """Encodes and decodes as the vocabulary file at ``path`` (a byte-level BPE in JSON) says."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        vocab, alphabet = model["vocab"], byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: (left id, right id) as one number -> (rank, merged id)
        self.pairs = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.ranks = {k: v[0] for k, v in self.pairs.items()}
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        self.token = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in vocab.items():
            self.token[i] = bytes(back[c] for c in text)
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self._split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self._back = back
        self._pieces: dict[bytes, bytes] = {}
        self._first, self._spaced = _Cache(self, ""), _Cache(self, " ")

    # -- one word

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > LONG:
            return self._merge_long(ids)
        known, pairs = self.ranks.get, self.pairs
        ranks = [known(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = pairs[ids[i] << 32 | ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = known(ids[i] << 32 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = known(ids[i - 1] << 32 | ids[i], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (hit := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of its parts has gone or grown since
            ids[i], ids[j] = get(a << 32 | b)[1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (hit := get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (hit[0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def _piece(self, word: bytes) -> bytes:
        found = self._pieces.get(word)
        if found is None:
            if len(self._pieces) >= CACHE:
                self._pieces.clear()
            found = self._pieces[word] = np.array(self.merge(word), "<u4").tobytes()
        return found

    def _chunk(self, text: str) -> bytes:
        """Ids of a text that no pre-token crosses at either end."""
        if text.isascii() and (text[1:] if text[:1] == " " else text).isalpha():
            return self._piece(text.encode())
        back = self._back
        return b"".join(self._piece(bytes(map(back.__getitem__, piece))) for piece, _ in self._split(text))

    # -- texts

    def encode_le(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        out, rest = [], [text]
        for mark, i in self.special.items():
            if mark in text:
                cut = []
                for part in rest:
                    if isinstance(part, str):
                        for k, x in enumerate(part.split(mark)):
                            cut += [i, x] if k else [x]
                    else:
                        cut.append(part)
                rest = cut
        for part in rest:
            out.append(int(part).to_bytes(4, "little") if isinstance(part, int) else self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        # A single space before a visible character starts a pre-token, so words between single spaces are independent.
        # Where white space touches white space that no longer holds, and the text is cut as a whole.
        if "  " in text or text[-1].isspace():
            return self._chunk(text)
        head, *words = text.split(" ")
        try:
            return (self._first[head] if head else b"") + b"".join(map(self._spaced.__getitem__, words))
        except _Adjacent:
            return self._chunk(text)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_le(text), "<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids if i < len(token)])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Adjacent(Exception):
    """A word between spaces begins or ends with other white space."""


class _Cache(dict):
    """Word -> its ids, with ``lead`` before the word."""

    def __init__(self, encoder: BytePairEncoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, word: str) -> bytes:
        if word[0].isspace() or word[-1].isspace():
            raise _Adjacent
        found = self.encoder._chunk(self.lead + word)
        if len(word) < 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """One encoder a Python process and file."""
    return BytePairEncoder(path)


CACHES.append(encoder.cache_clear)


ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType())])


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row per input row: the id column, n_tokens, ids_le (ids as little-endian unsigned 32-bit numbers) and, with
    ``decode``, ``decoded``: the text that the ids stand for. No shuffle; each row is encoded where it is read."""
    given = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([given.schema[id_col], *ENCODED.fields, *([T.StructField("decoded", T.StringType())] if decode else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                coded = [own.encode_le(t) for t in batch.column(1).to_pylist()]
                arrays = [batch.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(coded, pa.binary())]
                if decode:
                    arrays.append(pa.array([own.decode(np.frombuffer(x, "<u4").tolist()) for x in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in out.fields])

    return in_arrow(given, run, out)


def decode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids_le") -> DataFrame:
    """One row per input row: the id column and ``decoded``. Null ids decode to the empty string."""
    given = df.select(F.col(id_col), F.col(ids_col).alias("ids_le"))
    out = T.StructType([given.schema[id_col], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, "ids_le", 4 << 20):
                texts = [own.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [f.name for f in out.fields])

    return in_arrow(given, run, out)
