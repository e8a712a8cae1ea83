"""Phrase collocations from position bitmaps.

Texts are cut into pieces and words; a shard holds about a million positions, with an empty one between pieces, so that
nothing that moves by one position crosses a piece. In a shard a word, and later a phrase, is a compressed bitmap of the
positions where it ends: blocks of 64 bits, only those with a bit set. A phrase grows by a word when its bitmap, shifted by
one, is cut (AND) with the bitmap of that word; the popcount is the number of times it stands in the shard. ANDs that would
be empty aren't formed: the shard's order of words tells which blocks can meet.

Popcounts are summed over shards by key ranges (packed arrays through ordinary shuffles), and each shard learns which of its
phrases may reach the threshold. That happens three times: for words; for pairs, which only frequent words form; and for
phrases of three and four words, which a shard makes depth-first, group by group of pairs, where pairs one after the other may
be frequent. Words are summed by their whole keys, and one of the shards that hold a frequent one is asked to spell it. Most
pairs and longer phrases are rare: the leading bits of their keys, as sorted numbers of some three bytes, tell which can't
reach the threshold, as phrases that share these bits only add to a sum. The others are summed by whole keys, which gives
exact numbers. One shard for each of those leading bits spells its phrase; where that was another phrase with the same bits,
a shard is asked for the right one. All that follows are joins of phrases by their text: the parts of
each cut, the score, longer phrases that hold a shorter one.

Results for odd input: a null text is empty and a null language ``und``; texts without words give nothing; long texts are
cut into several shards between pieces; repeated rows count each time; ties are ranked by the phrase; an empty table gives
no rows; other columns are not read. Languages may be of any number. Keys of phrases are 64-bit hashes of language and words
while they are counted; what follows compares texts.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm.common import _LOWER, Words, in_arrow, release_caches, shuffle_width, slices, splitmix, text_bytes
from cohortlens.llm.exchange import ENTRIES, ROWS, _runs, dealt, key_ranges
from cohortlens.storage import erase, let_go, stored, written

#: Positions of a shard, about.
SHARD = 1 << 20
#: Pairs whose extensions are held at a time.
GROUP = 1 << 16
#: Leading bits of a phrase's key by which phrases that can't be frequent are found.
LEADING = 40
TEXTS, LANGS, TOLD, NAMED, PLACES, SUMS, MARKS = 3, 4, 5, 6, 7, 8, 9
FIELDS = "bucket long, chunk long, kind int, keys binary, refs binary, lang string, phrase string, k int, f long"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary()), ("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())])
#: Bytes that end a piece, and those that end a word.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
_BREAKS = _ENDS.copy()
_BREAKS[[0x20, 0x09]] = True


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 2048):
        part = [(*r, *(None,) * (len(_SCHEMA) - len(r))) for r in rows[a : a + 2048]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _planes(ids: np.ndarray) -> bytes:
    """Numbers from -1 on as their lowest bytes, then the next ones, and so on: small numbers then take little when packed."""
    return np.ascontiguousarray((ids + 1).astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64) - 1


def _ascending(numbers: np.ndarray) -> bytes:
    """Ascending numbers (equal ones may follow each other): the lowest bits of each, and a bitmap with a bit for each number at
    its place plus its highest bits."""
    n, first = len(numbers), int(numbers[0])
    numbers = numbers - numbers[0]
    low = max(0, (int(numbers[-1]) // n).bit_length() - 1)
    high = np.zeros((int(numbers[-1]) >> low) + n, bool)
    high[(numbers >> np.uint64(low)).astype(np.int64) + np.arange(n)] = True
    whole, rest = divmod(low, 8)
    planes = [(numbers >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(whole)]
    left = np.unpackbits((numbers >> np.uint64(8 * whole)).astype(np.uint8)[:, None], axis=1, count=rest, bitorder="little")
    return b"".join([struct.pack("<QIIB", first, n, len(high), low), *planes, np.packbits(left).tobytes(), np.packbits(high).tobytes()])


def _from_ascending(data: bytes) -> np.ndarray:
    first, n, places, low = struct.unpack_from("<QIIB", data)
    whole, rest = divmod(low, 8)
    raw = np.frombuffer(data, np.uint8, offset=17)
    at = whole * n + -(-n * rest // 8)
    high = np.flatnonzero(np.unpackbits(raw[at:], count=places)) - np.arange(n)
    left = np.packbits(np.unpackbits(raw[whole * n : at], count=n * rest).reshape(n, rest), axis=1, bitorder="little") if rest else np.zeros((n, 1), np.uint8)
    out = (high.astype(np.uint64) << np.uint64(low)) + (left[:, 0].astype(np.uint64) << np.uint64(8 * whole))
    for i in range(whole):
        out += raw[i * n : (i + 1) * n].astype(np.uint64) << np.uint64(8 * i)
    return out + np.uint64(first)


def _mostly_ones(counts: np.ndarray) -> bytes:
    """Counts, most of which are 1: a bitmap of the others, and these."""
    more = counts != 1
    return np.packbits(more).tobytes() + counts[more].astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def _from_mostly_ones(data: bytes, n: int) -> np.ndarray:
    out, at = np.ones(n, np.int64), -(-n // 8)
    more = np.unpackbits(np.frombuffer(data, np.uint8, at), count=n).astype(bool)
    out[more] = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=at).reshape(4, -1).T).view("<u4").reshape(-1)
    return out


# ---- shards ---------------------------------------------------------------------------------------------


@dataclass
class Piece:
    """Words of some texts: hash of language and word, number of the language, first byte and end of each in ``data``, and
    whether a piece starts with it."""

    key: np.ndarray
    lang: np.ndarray
    start: np.ndarray
    end: np.ndarray
    opens: np.ndarray
    data: np.ndarray


def _pieces(batch: pa.RecordBatch, langs: dict[str, int], size: int) -> Iterator[Piece]:
    """The words of a batch, cut between pieces after about so many words."""
    data, offsets = text_bytes(batch.column("text"))
    words = Words(data, offsets, lower=True, breaks=_BREAKS)
    names = [langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()]
    lang = np.repeat(np.array(names, np.int64), words.counts)
    opens = np.ones(len(words.start), bool)
    ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
    opens[1:] = ends[words.start[1:]] > ends[words.end[:-1]]
    opens[words.first[:-1][words.counts > 0]] = True
    salt = splitmix(np.array([hash_of(x) for x in langs], np.uint64))
    key = splitmix(words.hash ^ salt[lang])
    low = _LOWER.astype(np.uint8)[data]
    at = np.flatnonzero(opens)
    cuts = [0, *(int(at[i]) for i in np.searchsorted(at, np.arange(size, len(key), size)) if i < len(at)), len(key)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield Piece(key[a:b], lang[a:b], words.start[a:b], words.end[a:b], opens[a:b], low)


def hash_of(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(Words(raw, np.array([0, len(raw)]), breaks=np.zeros(256, bool)).hash[0]) if len(raw) else 1


def shards(df: DataFrame) -> DataFrame:
    """Rows of each shard of (text, lang): the hashes of its vocabulary and the word of each position; the words themselves;
    and the languages with their numbers of words."""

    def packed(parts: list[Piece], langs: dict[str, int], chunk: int) -> Iterator[pa.RecordBatch]:
        key, opens = np.concatenate([p.key for p in parts]), np.concatenate([p.opens for p in parts])
        opens[np.cumsum([0, *(len(p.key) for p in parts[:-1])])] = True
        lang = np.concatenate([p.lang for p in parts])
        vocabulary, first, word, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        vocabulary, first, word = vocabulary[order], first[order], number[word]
        place = np.arange(len(key)) + np.cumsum(opens)
        ids = np.full(len(key) + int(opens.sum()) + 1, -1, np.int64)
        ids[place] = word
        base = np.cumsum([0, *(len(p.key) for p in parts)])
        of = np.searchsorted(base, first, side="right") - 1
        spelled = [parts[p].data[parts[p].start[i] : parts[p].end[i]].tobytes() for p, i in zip(of.tolist(), (first - base[of]).tolist(), strict=True)]
        count = np.bincount(lang, minlength=len(langs)).astype("<i8")
        yield from _rows([(chunk, chunk, ROWS, vocabulary.tobytes(), _planes(ids)), (chunk, chunk, TEXTS, b"\n".join(spelled), lang[first].astype("<u4").tobytes()), (chunk, chunk, LANGS, json.dumps(list(langs)).encode(), count.tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        task, serial, held, parts, langs = TaskContext.get().partitionId(), 0, 0, [], {}
        for whole in batches:
            for batch in slices(whole, "text"):
                for part in _pieces(batch, langs, SHARD):
                    parts.append(part)
                    held += len(part.key)
                    if held >= SHARD:
                        yield from packed(parts, langs, task << 24 | serial)
                        serial, held, parts = serial + 1, 0, []
        if parts:
            yield from packed(parts, langs, task << 24 | serial)

    return in_arrow(df, run, FIELDS)


class Shard:
    """A shard's rows, and what it was told."""

    def __init__(self, rows: list[tuple]):
        by = {r[2]: r for r in rows if r[2] in (ROWS, TEXTS, LANGS, PLACES)}
        self.keys, self.ids = np.frombuffer(by[ROWS][3], "<u8"), _from_planes(by[ROWS][4])
        self.spelled, self.lang = by[TEXTS][3].decode().split("\n"), np.frombuffer(by[TEXTS][4], "<u4")
        self.langs = json.loads(by[LANGS][3])
        self.places = by.get(PLACES)
        self.marks = {r[0]: (r[3], r[4]) for r in rows if r[2] == MARKS}
        told = [r for r in rows if r[2] == TOLD]
        self.told = np.frombuffer(b"".join(r[3] for r in told), "<u8")
        self.total = np.frombuffer(b"".join(r[4] for r in told), "<i8")
        order = np.argsort(self.told)
        self.told, self.total = self.told[order], self.total[order]

    def named(self, key: np.ndarray, last: np.ndarray, k: int) -> list[tuple]:
        """Rows that spell those of the phrases (keys, last positions) that this shard was asked to."""
        at = np.searchsorted(self.told, key)
        ask = np.flatnonzero(at < len(self.told))
        ask = ask[(self.told[at[ask]] == key[ask]) & (self.total[at[ask]] > 0)]
        return self.spelled_as(last[ask], k, self.total[at[ask]])

    def spelled_as(self, last: np.ndarray, k: int, total: np.ndarray) -> list[tuple]:
        """Rows that spell the phrases at these last positions, with their sums."""
        out = []
        for end, f in zip(last.tolist(), total.tolist(), strict=True):
            words = self.ids[end - k + 1 : end + 1].tolist()
            out.append((0, 0, NAMED, None, None, self.langs[self.lang[words[0]]], " ".join(self.spelled[w] for w in words), k, f))
        return out

    def marked(self, key: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The order of the keys by leading bits, as they were sent; in this order, which of them may be frequent and which
        are to be spelled; and the sums that came with the latter."""
        order, edges = _ranges(key, buckets, bits)
        keep, spells, sums = np.zeros(len(key), bool), np.zeros(len(key), bool), [b""]
        for bucket, a, b in edges:
            if bucket in self.marks:
                bits_kept, rest = self.marks[bucket]
                keep[a:b] = np.unpackbits(np.frombuffer(bits_kept, np.uint8), count=b - a)
                spells[a:b] = np.unpackbits(np.frombuffer(rest, np.uint8, -(-(b - a) // 8)), count=b - a)
                sums.append(rest[-(-(b - a) // 8) :])
        return order, keep, spells, np.frombuffer(b"".join(sums), "<i8")

    def sums(self, key: np.ndarray, last: np.ndarray, count: np.ndarray, k: np.ndarray, spells: np.ndarray, buckets: int, chunk: int) -> list[tuple]:
        """For each key range the phrases (keys, last positions, counts, lengths) that may be frequent, some of them spelled."""
        order, edges = _ranges(key, buckets)
        key, last, count, k, spells = key[order], last[order], count[order], k[order], spells[order]
        out = []
        for bucket, a, b in edges:
            at = a + np.flatnonzero(spells[a:b])
            names = [" ".join([self.spelled[w] for w in self.ids[e - n + 1 : e + 1].tolist()]) for e, n in zip(last[at].tolist(), k[at].tolist(), strict=True)]
            lang, counts = self.lang[self.ids[last[at]]].astype("<u4").tobytes(), _mostly_ones(count[a:b])
            refs = struct.pack("<I", len(counts)) + counts + np.packbits(spells[a:b]).tobytes() + lang
            out.append((bucket, chunk, SUMS, _ascending(key[a:b]), refs, json.dumps(self.langs), "\n".join(names)))
        return out


# ---- bitmaps --------------------------------------------------------------------------------------------


@dataclass
class Bitmaps:
    """Blocks of 64 positions of each owner (a word or phrase), ascending by owner and block."""

    owner: np.ndarray
    block: np.ndarray
    bits: np.ndarray

    def counts(self, owners: int) -> np.ndarray:
        return np.bincount(self.owner, weights=np.bitwise_count(self.bits), minlength=owners).astype(np.int64)

    def first(self) -> np.ndarray:
        """The first position of each owner; every owner has one."""
        head = np.diff(self.owner, prepend=-1) != 0
        bits = self.bits[head]
        return self.block[head] * 64 + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))

    def shifted(self) -> tuple[Bitmaps, np.ndarray, np.ndarray]:
        """Every position moved on by one; and of each block where its positions are now: those that stay inside, and the
        last one, which goes over into the next block."""
        over = self.bits >> np.uint64(63)
        into = np.flatnonzero(over)
        moved, place = merged(np.concatenate([self.owner, self.owner[into]]), np.concatenate([self.block, self.block[into] + 1]), np.concatenate([self.bits << np.uint64(1), over[into]]))
        last = np.full(len(self.bits), -1, np.int64)
        last[into] = place[len(self.bits) :]
        return moved, place[: len(self.bits)], last


def merged(owner: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[Bitmaps, np.ndarray]:
    """The bitmaps of blocks that may be there several times or empty, and the place of each block given (-1: empty)."""
    some = np.flatnonzero(bits)
    code = owner[some] << 32 | block[some]
    order = np.argsort(code, kind="stable")
    code, part = code[order], bits[some[order]]
    new = np.diff(code, prepend=-1) != 0
    head = np.flatnonzero(new)
    place = np.full(len(bits), -1, np.int64)
    place[some[order]] = np.cumsum(new) - 1
    return Bitmaps(code[head] >> 32, code[head] & 0xFFFFFFFF, np.bitwise_or.reduceat(part, head) if len(head) else part), place


@dataclass
class Phrases:
    """Phrases of one length in a shard: key, bitmap of last positions, the phrase that ends at each position (-1: none), and
    its block."""

    key: np.ndarray
    maps: Bitmaps
    at: np.ndarray
    entry: np.ndarray


def phrases_at(key: np.ndarray, at: np.ndarray) -> Phrases:
    place = np.flatnonzero(at >= 0)
    maps, of = merged(at[place], place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    entry = np.full(len(at), -1, np.int64)
    entry[place] = of
    return Phrases(key, maps, at, entry)


def extended(prefix: Phrases, words: Phrases) -> Phrases:
    """All phrases that are one of the prefixes and one of the words after it."""
    moved, inside, last = prefix.maps.shifted()
    place = np.flatnonzero((prefix.at[:-1] >= 0) & (words.at[1:] >= 0)) + 1
    before = prefix.entry[place - 1]
    left, right = np.where(place & 63, inside[before], last[before]), words.entry[place]
    met, back = np.unique(left * np.int64(max(1, len(words.maps.owner))) + right, return_inverse=True)
    left, right = np.divmod(met, max(1, len(words.maps.owner)))
    bits = moved.bits[left] & words.maps.bits[right]
    code, phrase = np.unique(moved.owner[left] * np.int64(max(1, len(words.key))) + words.maps.owner[right], return_inverse=True)
    first, word = np.divmod(code, max(1, len(words.key)))
    key = _longer(prefix.key[first], words.key[word])
    maps, of = merged(phrase, moved.block[left], bits)
    at, entry = np.full(len(prefix.at), -1, np.int64), np.full(len(prefix.at), -1, np.int64)
    at[place], entry[place] = phrase[back], of[back]
    return Phrases(key, maps, at, entry)


def some_of(phrases: Phrases, keep: np.ndarray) -> Phrases:
    """The phrases that ``keep`` marks."""
    number, stay = np.cumsum(keep) - 1, keep[phrases.maps.owner]
    maps = Bitmaps(number[phrases.maps.owner[stay]], phrases.maps.block[stay], phrases.maps.bits[stay])
    place = np.flatnonzero(phrases.at >= 0)
    place = place[keep[phrases.at[place]]]
    at, entry = np.full(len(phrases.at), -1, np.int64), np.full(len(phrases.at), -1, np.int64)
    at[place], entry[place] = number[phrases.at[place]], (np.cumsum(stay) - 1)[phrases.entry[place]]
    return Phrases(phrases.key[keep], maps, at, entry)


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of phrases with one word more."""
    return splitmix(key * np.uint64(0xD6E8FEB86659FD93) + splitmix(word))


def words_and_pairs(shard: Shard) -> tuple[Phrases, Phrases]:
    words = phrases_at(shard.keys, shard.ids)
    return words, extended(words, words)


# ---- levels ---------------------------------------------------------------------------------------------


def _ranges(key: np.ndarray, buckets: int, bits: int = 64) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the keys by their leading bits, and of each key range where it begins and ends in this order."""
    key = key >> np.uint64(64 - bits) << np.uint64(64 - bits)
    order = np.argsort(key, kind="stable")
    bucket = (key[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
    return order, [(int(bucket[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _sent(key: np.ndarray, count: np.ndarray, buckets: int, chunk: int, bits: int = 64, most: int = (1 << 32) - 1) -> list[tuple]:
    """Leading bits of the keys, and their counts, which say no more than ``most``."""
    order, edges = _ranges(key, buckets, bits)
    key, count = key[order] >> np.uint64(64 - bits), np.minimum(count[order], most)
    return [(bucket, chunk, ENTRIES, _ascending(key[a:b]), _mostly_ones(count[a:b])) for bucket, a, b in edges]


def _groups(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, where each begins in it, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    return order, head, np.add.reduceat(count[order], head)


def told(entries: DataFrame, buckets: int, least: int, sums: bool) -> DataFrame:
    """To each shard a bit for each of the keys it sent: whether the sum over all shards is at least ``least``; and a bit where
    it is to spell the phrase, with that sum if ``sums``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, "bucket"):
            keys = [_from_ascending(r[3]) for r in rows]
            key, count = np.concatenate(keys), np.concatenate([_from_mostly_ones(r[4], len(k)) for r, k in zip(rows, keys, strict=True)])
            order, head, total = _groups(key, count)
            keep, spells, sum_of = np.zeros(len(key), bool), np.zeros(len(key), bool), np.zeros(len(key), np.int64)
            keep[order] = np.repeat(total >= least, np.diff(head, append=len(key)))
            sum_of[order[head]], spells[order[head]] = total, total >= least
            ends, out = np.cumsum([0, *(len(k) for k in keys)]), []
            for r, a, b in zip(rows, ends, ends[1:], strict=False):
                if keep[a:b].any():
                    out.append((bucket, r[1], MARKS, np.packbits(keep[a:b]).tobytes(), np.packbits(spells[a:b]).tobytes() + (sum_of[a:b][spells[a:b]].astype("<i8").tobytes() if sums else b"")))
            yield from _rows(out)

    narrow = entries.where(F.col("kind") == ENTRIES).select("bucket", "chunk", "kind", "keys", "refs")
    return in_arrow(dealt(narrow, "bucket", buckets).sortWithinPartitions("bucket", "chunk"), run, FIELDS)


def summed(sums: DataFrame, buckets: int, least: int) -> DataFrame:
    """Rows that name the phrases that stand at least so many times in all shards together; those that no shard has spelled are
    told to a shard that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, "bucket"):
            keys, counts, spells, langs = [_from_ascending(r[3]) for r in rows], [], [], []
            for r, k in zip(rows, keys, strict=True):
                to = 4 + struct.unpack_from("<I", r[4])[0]
                counts.append(_from_mostly_ones(r[4][4:to], len(k)))
                spells.append(np.unpackbits(np.frombuffer(r[4], np.uint8, -(-len(k) // 8), to), count=len(k)).astype(bool))
                langs.append(np.frombuffer(r[4], "<u4", offset=to + -(-len(k) // 8)))
            key, spelled, ends = np.concatenate(keys), np.concatenate(spells), np.cumsum([0, *(len(k) for k in keys)])
            order, head, total = _groups(key, np.concatenate(counts))
            by = np.maximum.reduceat(np.where(spelled[order], order, -1), head)
            number, out = np.cumsum(spelled) - 1, []
            base = np.cumsum([0, *(len(x) for x in langs)])
            for some in (np.flatnonzero((total >= least) & (by >= 0)), np.flatnonzero((total >= least) & (by < 0))):
                at = np.where(by[some] < 0, order[head[some]], by[some])
                of = np.searchsorted(ends, at, side="right") - 1
                for i in np.unique(of).tolist():
                    own, f = at[of == i], total[some[of == i]]
                    if by[some[0]] < 0:
                        out.append((bucket, rows[i][1], TOLD, key[own].tobytes(), f.astype("<i8").tobytes()))
                        continue
                    names, known, place = rows[i][6].split("\n"), json.loads(rows[i][5]), number[own] - base[i]
                    out += [(0, 0, NAMED, None, None, known[lang], names[j], names[j].count(" ") + 1, n) for lang, j, n in zip(langs[i][place].tolist(), place.tolist(), f.tolist(), strict=True)]
            yield from _rows(out)

    narrow = sums.where(F.col("kind") == SUMS).select("bucket", "chunk", "kind", "keys", "refs", "lang", "phrase")
    return in_arrow(dealt(narrow, "bucket", buckets).sortWithinPartitions("bucket", "chunk"), run, FIELDS)


def _by_shard(table: DataFrame, answers: DataFrame, step) -> DataFrame:
    """``step`` on each shard with its answers; it gives rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for chunk, rows in _runs(batches, "chunk"):
            if any(r[2] == ROWS for r in rows):
                yield from _rows(step(Shard(rows), chunk))

    both = table.unionByName(answers).select("bucket", "chunk", "kind", "keys", "refs")
    return in_arrow(both.repartition("chunk").sortWithinPartitions("chunk", "kind"), run, FIELDS)


_DATA = f"kind in ({ROWS}, {TEXTS}, {LANGS}, {PLACES})"


def frequent(df: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to 4 words that stand at least so many times inside pieces of df (text,
    lang), and (lang, n) of all words."""
    spark, buckets, bits = df.sparkSession, key_ranges(df), LEADING
    base, base_path = stored(shards(df), "shards")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _runs(batches, "chunk"):
            keys, ids = np.frombuffer(rows[0][3], "<u8"), _from_planes(rows[0][4])
            yield from _rows(_sent(keys, np.bincount(ids[ids >= 0], minlength=len(keys)), buckets, chunk))

    def count_langs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, n) for k, v in zip(batch.column("keys").to_pylist(), batch.column("refs").to_pylist(), strict=True) for x, n in zip(json.loads(k), np.frombuffer(v, "<i8").tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["lang", "n"])

    def pairs_of(shard: Shard, chunk: int) -> list[tuple]:
        ends = np.zeros(len(shard.keys), np.int64)
        here = np.flatnonzero(shard.ids >= 0)
        ends[shard.ids[here]] = here
        order, some, spells, total = shard.marked(shard.keys, buckets, 64)
        keep = np.zeros(len(shard.keys), bool)
        keep[order] = some
        out = shard.spelled_as(ends[order[spells]], 1, total)
        number = np.cumsum(keep) - 1
        ids = np.where((shard.ids >= 0) & keep[np.maximum(shard.ids, 0)], number[np.maximum(shard.ids, 0)], -1)
        at, spelled = np.flatnonzero(keep), shard.spelled
        shard.keys, shard.ids = shard.keys[keep], ids
        pairs = words_and_pairs(shard)[1]
        out += _sent(pairs.key, pairs.maps.counts(len(pairs.key)), buckets, chunk, bits, least)
        out.append((chunk, chunk, ROWS, shard.keys.tobytes(), _planes(ids)))
        out.append((chunk, chunk, TEXTS, b"\n".join(spelled[i].encode() for i in at.tolist()), shard.lang[keep].tobytes()))
        return [*out, (chunk, chunk, LANGS, json.dumps(shard.langs).encode(), None)]

    def longer_of(shard: Shard, chunk: int) -> list[tuple]:
        words, pairs = words_and_pairs(shard)
        order, some, spells, _ = shard.marked(pairs.key, buckets, bits)
        keep, tells = np.zeros((2, len(pairs.key)), bool)
        keep[order], tells[order] = some, spells
        pairs, tells = some_of(pairs, keep), tells[keep]
        if not len(pairs.key):
            return []
        out = shard.sums(pairs.key, pairs.maps.first(), pairs.maps.counts(len(pairs.key)), np.full(len(pairs.key), 2), tells, buckets, chunk)
        follows = np.where(pairs.at >= 0, words.at, -1)  # a word that ends a pair that may be frequent
        words = phrases_at(words.key, follows)
        keys, counts, ends, sizes = [], [], [], []
        for a in range(0, len(pairs.key), GROUP):
            number = np.arange(len(pairs.key))
            longer = some_of(pairs, (number >= a) & (number < a + GROUP))
            for k in (3, 4):
                longer = extended(longer, words)
                keys.append(longer.key)
                counts.append(longer.maps.counts(len(longer.key)))
                ends.append(longer.maps.first())
                sizes.append(np.full(len(longer.key), k))
        key, count = np.concatenate(keys), np.concatenate(counts)
        out += _sent(key, count, buckets, chunk, bits, least)
        order = _ranges(key, buckets, bits)[0]
        place = (np.concatenate(ends) * 2 + np.concatenate(sizes) - 3)[order]
        return [*out, (chunk, chunk, PLACES, _planes(place), _mostly_ones(count[order]))]

    def placed(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, last positions and lengths of the longer phrases of a shard, in the order of what it sent."""
        place = _from_planes(shard.places[3])
        last, k = place // 2, 3 + place % 2
        key = np.zeros(len(place), np.uint64)
        for size in (3, 4):
            some = np.flatnonzero(k == size)
            words = [shard.keys[shard.ids[last[some] - size + 1 + i]] for i in range(size)]
            key[some] = words[0]
            for word in words[1:]:
                key[some] = _longer(key[some], word)
        return key, last, k

    def sums_of(shard: Shard, chunk: int) -> list[tuple]:
        if shard.places is None or not shard.marks:
            return []
        key, last, k = placed(shard)
        count = _from_mostly_ones(shard.places[4], len(key))
        order, keep, spells, _ = shard.marked(key, buckets, bits)
        order, spells = order[keep], spells[keep]
        return shard.sums(key[order], last[order], count[order], k[order], spells, buckets, chunk)

    def asked(shard: Shard, chunk: int) -> list[tuple]:
        pairs = words_and_pairs(shard)[1]
        out = shard.named(pairs.key, pairs.maps.first(), 2)
        if shard.places is not None:
            key, last, k = placed(shard)
            out += [r for size in (3, 4) for r in shard.named(key[k == size], last[k == size], size)]
        return out

    first = in_arrow(base.where(F.col("kind") == ROWS).select("bucket", "chunk", "kind", "keys", "refs"), count_words, FIELDS)
    n = written(in_arrow(base.where(F.col("kind") == LANGS).select("keys", "refs"), count_langs, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    two, two_path = stored(_by_shard(base.where(_DATA), told(first, buckets, least, True), pairs_of), "pairs")
    erase(spark, base_path)
    let_go(spark)
    three, three_path = stored(_by_shard(two.where(_DATA), told(two, buckets, least, False), longer_of), "longer")
    let_go(spark)
    four = _by_shard(two.where(_DATA).unionByName(three.where(_DATA)), told(three, buckets, least, False), sums_of)
    total, total_path = stored(summed(three.unionByName(four), buckets, least), "sums")
    ask = total.where(F.col("kind") == TOLD)
    named = two.unionByName(total).where(F.col("kind") == NAMED)
    if ask.head(1):
        let_go(spark)
        those = two.where(_DATA).unionByName(three.where(_DATA)).join(ask.select("chunk").distinct(), "chunk", "left_semi")
        named = named.unionByName(_by_shard(those, ask, asked))
    named = written(named.select("lang", "phrase", "k", "f"), "phrases")
    erase(spark, total_path)
    erase(spark, two_path)
    erase(spark, three_path)
    let_go(spark)
    return named, n


# ---- scores ---------------------------------------------------------------------------------------------


def scored(named: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of phrases of two words or more, by their lowest-scoring cut (ties: the earliest)."""
    words = F.split("phrase", " ", -1)
    cuts = named.where("k >= 2").withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.select("lang", "phrase", "k", F.col("f").alias("a"), "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k")), " ").alias("tail"))
    side = lambda part, f: named.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    score = F.expr(f"(cast(a as decimal(20,0)) * {scale}) div (cast(l as decimal(20,0)) + r)")
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "k", "a", "c.l", "c.r", "c.score")


def absorbed(named: DataFrame, percent: int = 80) -> DataFrame:
    """(lang, phrase) of those that lie inside a longer phrase which stands at least so many percent as often."""
    words = F.split("phrase", " ", -1)
    inner = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(w, i, s), ' '))))")
    longer = named.where("k >= 3").withColumn("w", words).select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    both = named.join(most, ["lang", "phrase"])
    return both.where(f"100 * cast(most as decimal(38,0)) >= {percent} * cast(f as decimal(38,0))").select("lang", "phrase")


def first_of_each(df: DataFrame, most: int) -> DataFrame:
    """The first rows of each language, with their rank: of parts first, then of parts of what is left of these, so that a
    language isn't sorted in one task."""
    width = shuffle_width(df.sparkSession)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in (width, isqrt(width)):
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        df = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the phrases of 2 to 4 words that hold together best."""
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    named, n = frequent(rows, least)
    kept = scored(named).join(absorbed(named), ["lang", "phrase"], "left_anti")
    out = first_of_each(kept, most).join(n, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
