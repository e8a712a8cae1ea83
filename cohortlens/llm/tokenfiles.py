"""Token-id files: texts encoded with a public vocabulary, in ascending order of id, as sections of coded ids.

A file holds up to ``FILE_TOKENS`` ids (whole documents; one longer document alone), the last one of a task up to a quarter
more where little is left: a file of few ids takes nearly as long to code as a larger one. They are held as a section of ``mixcoder`` with
independently reset, checksummed blocks, and a directory of its documents: ids and token counts, with a checksum.
Documents are dealt to files by ranges of their id. A file appears under its name when it is complete, and a repeated
task writes the same file again. The manifest has a row for each file; its order is the order of the documents.

Words between ASCII white space are encoded apart and remembered: the vocabulary's normaliser and splitter never join
characters over white space. A comma or full stop that ends a word, behind a letter from a to z, is a word of its own where the
splitter cuts there anyway. Results for odd input: a null text is empty and has the end id only; null ids come first;
equal ids follow in the order of their texts, and repeated rows are all written; very long texts are whole documents of
one file; an empty table gives no file; other columns, whatever their names, are not read; ids must be whole numbers.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import files, mixcoder
from cohortlens.llm.bpe import byte_alphabet
from cohortlens.llm.common import CACHES, SPACE_BYTES, in_arrow, ragged_arange, release_caches, slices, text_bytes, word_spans

FILE_TOKENS = 6_000_000
#: Bytes of texts that are encoded at once: words that they share are looked up once.
SLICE = 1 << 23
#: Words of the table beyond which those not used lately go, and the 8-byte parts of a word in it.
CACHE, LANES = 1 << 21, 4
MAGIC = b"TOKFILE1"
_PRINTED = re.compile(rb"[!-~\n]+")
_SOLID = ~np.isin(np.arange(256), SPACE_BYTES)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordEncoder:
    """Ids of texts by a library tokenizer that drops white space, word by word.

    Arrow finds the distinct words of a run of texts, and puts their ids in the place of each word. Distinct ones of up to
    ``LANES`` times 8 bytes are looked up many at a time in a hash table of arrays, by all their bytes. New ones go to the library, many at a time: its normaliser and its own pattern cut them into pieces for its merge model,
    which marks the ends of pieces. Longer words, texts that may hold special tokens, and words of other kinds of
    vocabularies are encoded one by one. When the table is full, the words used
    last stay, half of it at most. Case is folded
    first where the vocabulary does so anyway."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        def opened(text: str) -> Tokenizer:
            found = Tokenizer.from_str(text)
            found.no_truncation()
            found.no_padding()
            if hasattr(found.model, "_resize_cache"):
                found.model._resize_cache(0)  # words are remembered here
            return found

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.library = opened(json.dumps(spec))
        self.marks = [(t.content.encode(), i) for i, t in self.library.get_added_tokens_decoder().items()]
        self.folds = self._whole("Ab") == self._whole("ab")
        self.ends, self.stops = np.zeros(0, bool), False
        self.pieces, self.merges = self._piece_model(spec, opened)
        self.mark_start = re.compile(b"|".join({re.escape(m[:2]) for m, _ in self.marks})) if self.marks else None
        self._clear(1 << 18)
        self.now = self.distinct = 0  # what is marked as used now, and the words that must have room at once
        end = np.array([] if end_id is None else [end_id], np.int32)
        self.end = self._add(np.zeros((1, LANES), np.uint64), np.zeros(1, np.int64), np.array([len(end)]), end, listed=False)[0]

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _piece_model(self, spec: dict, opened):
        """What cuts ASCII words into pieces, and the library's merge model over pieces between spaces; nothing where the
        vocabulary doesn't mark the ends of pieces."""
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        cut = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split" and s.get("invert") and s.get("behavior") == "Removed"]
        if not suffix or len(cut) != 1 or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not self.folds:
            return None, None
        self.stops = cut[0].endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and cut[0].count(",") + cut[0].count(".") == 0
        import regex

        merges = opened(json.dumps({**spec, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        #: Bytes as the merge model names them; spaces between pieces and line ends between words stay.
        self.alphabet = byte_alphabet() | {10: "", 32: " "}
        self.pieces_ascii = re.compile(cut[0].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9") + "|\n").findall
        return regex.compile(cut[0] + "|\n").findall, merges

    # -- the table

    def _clear(self, room: int) -> None:
        self.count, self.lanes, self.size = 0, np.zeros((room, LANES), np.uint64), np.zeros(room, np.uint8)
        self.at, self.ids, self.used = np.zeros(room, np.int64), np.zeros(room, np.int32), np.zeros(room, np.int64)
        self.pool, self.filled = np.zeros(8 * room, np.int32), 0
        self.slots = np.full(4 * room, -1, np.int32)

    def _slot(self, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of a word of so many bytes, where the table looks first."""
        h = lanes[:, 0] * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
        for k in range(1, LANES):
            more = np.flatnonzero(size > 8 * k)
            h[more] = (h[more] ^ h[more] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + lanes[more, k]
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries of words; -1 for unknown ones."""
        slot = self._slot(lanes, size)
        entry = self.slots.take(slot)
        left = np.flatnonzero((entry >= 0) & ~self._same(entry, lanes, size))
        while len(left):
            slot[left] = slot[left] + 1 & len(self.slots) - 1
            now = self.slots.take(slot[left])
            entry[left] = now
            left = left[(now >= 0) & ~self._same(now, lanes[left], size[left])]
        return entry

    def _same(self, entry: np.ndarray, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        same = (self.lanes[:, 0].take(entry) == lanes[:, 0]) & (self.size.take(entry) == size)
        long = np.flatnonzero(same & (size > 8))
        same[long] = (self.lanes[entry[long], 1:] == lanes[long, 1:]).all(1)
        return same

    def _place(self, entries: np.ndarray) -> None:
        slot = self._slot(self.lanes[entries], self.size[entries].astype(np.int64))
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], slot[left] + 1 & len(self.slots) - 1

    def _add(self, lanes: np.ndarray, size: np.ndarray, counts: np.ndarray, ids: np.ndarray, listed: bool = True) -> np.ndarray:
        """Entries of new words with their ids; the table grows to ``CACHE`` words, of which then half at most stay."""
        while self.count + len(size) > len(self.size):
            self._resize()
        entries = np.arange(self.count, self.count + len(size))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.lanes[entries], self.size[entries], self.ids[entries] = lanes, size, counts
        self.at[entries] = self.filled + np.cumsum(counts) - counts
        self.count, self.filled = self.count + len(size), self.filled + len(ids)
        if listed:
            self._place(entries)
        return entries

    def _resize(self) -> None:
        n, room = self.count, 2 * len(self.size)
        keep = np.arange(n)
        if room > CACHE and self.distinct < len(self.size):
            late = self.used[:n] > np.partition(self.used[:n], n // 2)[n // 2]
            keep, room = np.flatnonzero(late | (keep == 0)), len(self.size)
        lanes, size, ids, used = self.lanes[keep], self.size[keep], self.ids[keep], self.used[keep]
        found = self.pool[ragged_arange(self.at[keep], ids.astype(np.int64))]
        self._clear(room)
        self._add(lanes[:1], size[:1], ids[:1], found[: ids[0]], listed=False)
        self._add(lanes[1:], size[1:], ids[1:], found[ids[0] :])
        self.used[: len(keep)] = used

    # -- new words

    def _coded(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of the text bytes in some order, with the numbers of their ids, and all their ids. ``plain`` ones are
        ASCII."""
        order, counts, found = [], [], []
        for ascii_ in (True, False):
            some = np.flatnonzero(plain == ascii_)
            for a in range(0, len(some), 500):
                part = some[a : a + 500]
                edge = np.cumsum(size[part] + 1)
                text = data[ragged_arange(start[part], size[part] + 1)]
                text[edge - 1] = 10
                coded = self._by_pieces(text[:-1].tobytes(), len(part), ascii_) if self.merges is not None else None
                if coded is None:
                    each = [np.array(self._whole(w.decode()), np.int32) for w in text[:-1].tobytes().split(b"\n")]
                    coded = np.array([len(x) for x in each], np.int32), np.concatenate(each)
                order.append(part)
                counts.append(coded[0])
                found.append(coded[1])
        return np.concatenate(order), np.concatenate(counts), np.concatenate(found)

    def _by_pieces(self, raw: bytes, words: int, plain: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words through the merge model; None if control characters or the normaliser make other words of them."""
        if plain and not _PRINTED.fullmatch(raw):
            return None
        text = raw.decode()
        if not plain:  # the normaliser makes every white space a space
            text = self.library.normalizer.normalize_str(text.replace("\n", " "))
            if text.count(" ") != words - 1:
                return None
            text = text.replace(" ", "\n")
        pieces = (self.pieces_ascii if plain else self.pieces)(text)
        joined = " ".join(pieces)
        if not plain:
            joined = joined.encode().decode("latin-1").translate(self.alphabet)
        ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        edges = np.array([i for i, x in enumerate(pieces) if x == "\n"], np.int64)
        edges = np.concatenate([[0], edges - np.arange(len(edges)), [len(pieces) - len(edges)]])
        return np.diff(np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[edges]).astype(np.int32), ids

    def _entries(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Table entries of distinct words of the text bytes (with 8 * LANES bytes more at the end), known or new."""
        views = np.lib.stride_tricks.sliding_window_view(data, 8)
        lanes = np.zeros((len(start), LANES), np.uint64)
        for k in range(LANES):
            some = np.flatnonzero(size > 8 * k) if k else slice(None)
            lanes[some, k] = views[start[some] + 8 * k].view("<u8").ravel() & _MASKS.take(np.minimum(size[some] - 8 * k, 8))
        entry = self._find(lanes, size)
        miss, self.distinct = np.flatnonzero(entry < 0), len(start)
        self.now += 1
        self.used[entry[entry >= 0]] = self.now
        if len(miss):
            plain = ((lanes[miss] & np.uint64(0x8080808080808080)) == 0).all(1)
            shuffled, counts, ids = self._coded(data, start[miss], size[miss], plain)
            before = len(self.size), self.count
            added = self._add(lanes[miss[shuffled]], size[miss[shuffled]], counts, ids)
            if before != (len(self.size), self.count - len(miss)):  # the table was made anew: entries have moved
                return self._entries(data, start, size)
            entry[miss[shuffled]] = added
        self.used[entry] = self.now
        return entry

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text, with the end id, as little-endian 32-bit numbers."""
        ids, n = self.encode_bytes(*text_bytes(pa.array(texts, pa.binary())))
        return [x.astype("<i4").tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, given as bytes and offsets, each with the end id; and how many each has."""
        raw = data.tobytes()
        n, apart = len(offsets) - 1, {}
        if self.mark_start:
            hits = np.array([m.start() for m in self.mark_start.finditer(raw)], np.int64)
            for r in np.unique(np.searchsorted(offsets, hits, side="right") - 1).tolist():
                apart[r] = np.array(self._whole(raw[offsets[r] : offsets[r + 1]].decode()), np.int32)
        data = np.frombuffer(raw.lower() if self.folds else raw, np.uint8)
        if apart:
            data = data.copy()
            for r in apart:
                data[offsets[r] : offsets[r + 1]] = SPACE_BYTES[0]
        start, end, first = word_spans(data, offsets)
        edge, letters = np.cumsum(end - start), data[_SOLID[data]]
        if self.stops:  # those behind a letter are words of their own: there are fewer new words so
            last, before = data.take(end - 1), data.take(end - 2, mode="clip")
            stop = ((last == 0x2C) | (last == 0x2E)) & (before - np.uint8(0x61) < 26) & (end - start > 1)
            apart_to = np.concatenate([[0], np.cumsum(stop)])
            edge = np.repeat(edge, 1 + stop)
            edge[np.flatnonzero(stop) + apart_to[:-1][stop]] -= 1
            first = first + apart_to.take(first)
        words = _binary(np.concatenate([[0], edge]), letters).dictionary_encode()
        known, edge, letters = (np.frombuffer(x, t) if x else np.zeros(1, t) for x, t in zip((words.indices.buffers()[1], *words.dictionary.buffers()[1:]), (np.int32, np.int64, np.uint8), strict=True))
        known, edge = known[: len(words)], edge[: len(words.dictionary) + 1]
        size = np.diff(edge)
        long = size > 8 * LANES
        extra = [self._whole(letters[edge[i] : edge[i + 1]].tobytes().decode()) for i in np.flatnonzero(long)] + list(apart.values())
        short = np.flatnonzero(~long)
        entry = self._entries(np.concatenate([letters[: edge[-1]], np.zeros(8 * LANES, np.uint8)]), edge[short], size[short])
        # Ids of the end, of short words, of long ones and of the texts encoded apart; then of all there is, in its order.
        listed = _binary(4 * np.append(self.at[: self.count], self.filled), self.pool).take(pa.array(np.append(self.end, entry)))
        listed = pa.concat_arrays([listed, pa.array([np.array(x, np.int32).tobytes() for x in extra], pa.large_binary())])
        place = np.empty(len(size), np.int64)
        place[short], place[long] = np.arange(1, len(short) + 1), len(short) + 1 + np.arange(len(size) - len(short))
        rows = np.sort(np.concatenate([np.arange(n) * 2 + 1, np.fromiter(apart, np.int64, len(apart)) * 2]))  # ends and, before them, texts apart
        more = np.zeros(len(rows), np.int64)
        more[rows % 2 == 0] = len(listed) - len(apart) + np.arange(len(apart))
        found = listed.take(pa.array(np.insert(place.take(known), first[1:].take(rows // 2), more)))
        ids, bounds = (np.frombuffer(found.buffers()[k], t) if found.buffers()[k] else np.zeros(n + 1, t) for k, t in ((2, np.int32), (1, np.int64)))
        upto = bounds.take(first[1:] + np.searchsorted(rows, np.arange(n) * 2 + 1) + 1) // 4
        return ids[: bounds[len(found)] // 4], np.diff(upto, prepend=0)


def _binary(edges: np.ndarray, data: np.ndarray) -> pa.Array:
    """Values that stand one after the other, between edges counted in bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64, copy=False)), pa.py_buffer(np.ascontiguousarray(data))])


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None) -> WordEncoder:
    return WordEncoder(path, end_id)


CACHES.append(encoder.cache_clear)


def section(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One file: directory of documents, then coded ids."""
    rows = np.array([(d or 0, d is None, n) for d, n in zip(doc_ids, counts, strict=True)], "<i8")
    directory = zlib.compress(np.ascontiguousarray(rows.T).tobytes(), 6)
    return b"".join([MAGIC, struct.pack("<QII", len(rows), len(directory), zlib.crc32(directory)), directory, mixcoder.encode(ids)])


def opened(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and ids of a file; ``mixcoder.Corrupt`` if a checksum doesn't hold."""
    n, length, check = struct.unpack_from("<QII", data, 8)
    directory = data[24 : 24 + length]
    if data[:8] != MAGIC or zlib.crc32(directory) != check:
        raise mixcoder.Corrupt("the directory was changed")
    doc, null, counts = np.frombuffer(zlib.decompress(directory), "<i8").reshape(3, n)
    return [None if e else d for d, e in zip(doc.tolist(), null.tolist(), strict=True)], counts, mixcoder.decode(data[24 + length :])


def write(df: DataFrame, vocabulary: str, folder: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> list[tuple[str, int, int]]:
    """Writes the files and returns the manifest: (file, documents, tokens) in the order of the documents."""
    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    ordered = given.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(vocabulary, end_id), TaskContext.get().partitionId()
        docs, counts, coded, held, done, full = [], [], [], 0, [], []

        def put(docs: list, counts: list, coded: list, held: int) -> None:
            name = f"part-{task:06d}-{len(done):05d}.tok"
            files.put(folder, name, section(docs, counts, np.concatenate(coded)))
            done.append((name, len(docs), held))

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, n = own.encode_bytes(*text_bytes(batch.column(1)))
                at, names = 0, batch.column(0).to_pylist()
                sums = np.cumsum(n)
                while at < len(names):  # as many documents as the file still has room for, one at least in an empty one
                    done_ids = int(sums[at - 1]) if at else 0
                    to = max(int(np.searchsorted(sums, done_ids + file_tokens - held, side="right")), at if held else at + 1)
                    if to > at:
                        docs += names[at:to]
                        counts += n[at:to].tolist()
                        coded.append(ids[done_ids : sums[to - 1]])
                        held += len(coded[-1])
                        at = to
                    if full and held > file_tokens // 4:
                        put(*full.pop())
                    if at < len(names):
                        if full:
                            put(*full.pop())
                        full.append((docs, counts, coded, held))
                        docs, counts, coded, held = [], [], [], 0
        if docs and full and full[0][3] + held <= file_tokens + file_tokens // 4:  # little is left: it goes with the file before
            docs, counts, coded, held = (x + y for x, y in zip(full.pop(), (docs, counts, coded, held), strict=True))
        for last in (*full, (docs, counts, coded, held)):
            if last[0]:
                put(*last)
        if done:
            names, n, tokens = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())], ["file", "docs", "tokens"])

    rows = in_arrow(ordered, run, "file string, docs long, tokens long").collect()
    manifest = sorted(tuple(r) for r in rows)
    files.put(folder, "manifest.tsv", "".join(f"{a}\t{b}\t{c}\n" for a, b, c in manifest).encode())
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_le (unsigned 32-bit numbers) of each document
    in the files that the manifest of the folder names."""
    listed, start = [], 0
    for line in files.get(folder, "manifest.tsv").decode().splitlines():
        name, _, tokens = line.split("\t")
        listed.append((name, start))
        start += int(tokens)
    result = "doc_id long, start long, n_tokens long, ids_le binary"
    if not listed:
        return spark.createDataFrame([], result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, counts, ids = opened(files.get(folder, name))
                ends = np.cumsum(counts)
                raw, begin = ids.astype("<u4", copy=False), first + ends - counts
                for a in range(0, len(docs), 500):
                    some = range(a, min(a + 500, len(docs)))
                    yield pa.RecordBatch.from_arrays([pa.array(docs[a : a + 500], pa.int64()), pa.array(begin[a : a + 500]), pa.array(counts[a : a + 500]), pa.array([raw[ends[i] - counts[i] : ends[i]].tobytes() for i in some], pa.binary())], ["doc_id", "start", "n_tokens", "ids_le"])

    return in_arrow(spark.createDataFrame(listed, "file string, first long").repartition(len(listed)), run, result)
