"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage becomes a vector of surface measures (word lengths,
byte classes, repetition, layout), is encoded by a small network, and gets a gated attention weight
softmax(w . (tanh(V h) * sigmoid(U h))). The weighted mean of the encoded passages is scored by a logistic unit. Only
document labels are known in training; which passages matter is learnt through the attention.

The model is fitted on the driver from a bounded sample: at most ``SAMPLE`` labelled documents, the ones of least hash,
as passage vectors. Scoring reads every whole text where it lies, with no shuffle. Labels, language, source and id are
never inputs of a score.

Results for odd input: null or empty text is one passage without words and gets a score too; an id without a label is
scored only; repeated labels of an id are averaged (a tie counts as good); null labels are ignored; without labels of
both kinds in the sample every score is the share of good labels in it (0.5 if there is none). Very long texts are scored
over all their passages; of labels with equal hashes the lesser id counts first; repeated rows are scored row by row; an empty
table gives no rows; other columns are kept, but for one that has the name of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import Words, in_arrow, slices, text_bytes

PASSAGE, SAMPLE, HASHED = 64, 6000, 16
LOWER, UPPER, DIGIT, WIDE, STOP, MARK, SPACE, OTHER = range(8)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = LOWER, UPPER, DIGIT, WIDE
    kind[list(b".,;:!?'\"()-")] = STOP
    kind[list(b"|#$%&*<>{}[]=@^~_\\/+")] = MARK
    kind[list(b" \t\n\r\x0b\x0c")] = SPACE
    return kind


_CLASS = _byte_classes()


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of measures for each passage, and the number of passages of each text (one at least)."""
    data, offsets = text_bytes(texts)
    words = Words(data, offsets)
    count = words.counts
    n = np.maximum(-(-count // PASSAGE), 1)
    begin = np.repeat(words.first[:-1], n) + PASSAGE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    end = np.minimum(begin + PASSAGE, np.repeat(words.first[1:], n))
    size = np.maximum(end - begin, 0)

    def per(values: np.ndarray) -> np.ndarray:
        """Sums of a number of each word over the passages."""
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[begin + size] - sums[begin]

    length = (words.end - words.start).astype(np.float64)
    safe = np.maximum(size, 1)
    mean = per(length) / safe
    out = [np.log1p(size), mean, np.sqrt(np.maximum(per(length**2) / safe - mean**2, 0))]
    out += [per(length <= 1) / safe, per(length <= 3) / safe, per(length > 12) / safe, per(length > 24) / safe]
    kinds = _CLASS[data]
    total = np.maximum(per(length), 1)
    last, first = (kinds[words.end - 1], kinds[words.start]) if len(words.start) else (kinds[:0], kinds[:0])
    for k in (LOWER, UPPER, DIGIT, WIDE, STOP, MARK, OTHER):
        sums = np.concatenate([[0], np.cumsum(kinds == k)])
        held = (sums[words.end] - sums[words.start]).astype(np.float64)
        out += [per(held) / total, per(held == length) / safe]
    out += [per(first == UPPER) / safe, per(last == STOP) / safe, per(last == MARK) / safe, per(last == DIGIT) / safe]
    same = np.zeros(len(length))
    same[1:] = words.hash[1:] == words.hash[:-1]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    gap = np.zeros(len(length))
    gap[1:] = lines[words.start[1:]] - lines[words.end[:-1]]
    out += [per(same) / safe, per(gap) / safe, per(gap > 1) / safe]
    # distinct words and pairs of words inside a passage
    owner = np.repeat(np.arange(len(begin)), size)
    for values in (words.hash, words.hash * np.uint64(3) + np.roll(words.hash, 1)):
        order = np.lexsort((values, owner))
        new = np.ones(len(order))
        new[1:] = (values[order][1:] != values[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        out.append(np.bincount(owner[order], weights=new, minlength=len(begin)) / safe)
    bag = np.bincount(owner * HASHED + (words.hash >> np.uint64(40)).astype(np.int64) % HASHED, weights=length <= 4, minlength=len(begin) * HASHED)
    return np.column_stack([*out, bag.reshape(-1, HASHED) / safe[:, None]]).astype(np.float32), n


@dataclass
class GatedAttention:
    """Encoder, gated attention and scoring weights, and the scale of the inputs."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    @staticmethod
    def start(inputs: int, seed: int, hidden: int = 32, gate: int = 16) -> dict[str, np.ndarray]:
        rnd = np.random.default_rng(seed)
        shape = {"E": (inputs, hidden), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,)}
        out = {k: rnd.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
        return out | {"e": np.zeros(hidden), "v": np.zeros(gate), "u": np.zeros(gate), "b": np.zeros(1)}

    @staticmethod
    def forward(p: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        begin, owner = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"] + p["v"]), 1 / (1 + np.exp(-(h @ p["U"] + p["u"])))
        s = (t * g) @ p["w"]
        a = np.exp(s - np.maximum.reduceat(s, begin)[owner])
        a /= np.add.reduceat(a, begin)[owner]
        z = np.add.reduceat(a[:, None] * h, begin, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"owner": owner, "begin": begin, "h": h, "t": t, "g": g, "a": a, "z": z, "score": score}

    @classmethod
    def backward(cls, p, x, n, y) -> dict[str, np.ndarray]:
        f = cls.forward(p, x, n)
        owner, h, t, g, a = (f[k] for k in ("owner", "h", "t", "g", "a"))
        d = (f["score"] - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[owner] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, f["begin"])[owner])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h * h)
        return {"E": x.T @ dx, "e": dx.sum(0), "V": h.T @ dt, "v": dt.sum(0), "U": h.T @ dg, "u": dg.sum(0), "w": ((t * g) * ds[:, None]).sum(0), "c": f["z"].T @ d, "b": np.array([d.sum()])}

    @classmethod
    def fit(cls, x: np.ndarray, n: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4) -> GatedAttention:
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        p = cls.start(x.shape[1], seed)
        if len(np.unique(y)) < 2:
            share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
            p["c"][:] = 0
            p["b"][:] = np.log(share / (1 - share))
            return cls(p, mean, scale)
        x = np.clip((x - mean) / scale, -6, 6)
        rnd, begin = np.random.default_rng(seed), np.cumsum(n) - n
        m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rnd.permutation(len(y))
            now = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for a in range(0, len(order), batch):
                docs = order[a : a + batch]
                rows = np.concatenate([np.arange(begin[i], begin[i] + n[i]) for i in docs])
                step += 1
                for k, grad in cls.backward(p, x[rows], n[docs], y[docs]).items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] -= now * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * p[k])
        return cls(p, mean, scale)

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(n):
            return np.zeros(0)
        return self.forward(self.weights, np.clip((x - self.mean) / self.scale, -6, 6), n)["score"]

    def attention(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The weight of each passage in its document."""
        return self.forward(self.weights, np.clip((x - self.mean) / self.scale, -6, 6), n)["a"]


def in_fold(id_col: str) -> Column:
    """Whether an id is held out: crc32 of it as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> GatedAttention:
    """A model of the labels of documents that aren't held out, from at most ``sample`` of them."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~in_fold(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("good"))
    few = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x, n = passages(batch.column("text"))
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("good"), pa.array([x[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())], ["id", "good", "x"])

    found = in_arrow(rows, run, T.StructType([rows.schema["id"], T.StructField("good", T.DoubleType()), T.StructField("x", T.BinaryType())])).collect()
    found.sort(key=lambda r: (r.id, bytes(r.x)))
    width = passages(pa.array(["a"]))[0].shape[1]
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, width) for r in found]
    x = np.concatenate(parts) if parts else np.zeros((1, width), np.float32)
    return GatedAttention.fit(x.astype(np.float64), np.array([len(p) for p in parts], np.int64), np.array([r.good for r in found]))


def scored(df: DataFrame, model: GatedAttention, text_col: str = "text", name: str = "score") -> DataFrame:
    """df with the model's score of its texts as one more column; a column of that name is replaced."""
    given = df.drop(name)
    sent = given.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*given.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                score = sent.value.score(*passages(batch.column(text_col)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return in_arrow(given, run, out)
