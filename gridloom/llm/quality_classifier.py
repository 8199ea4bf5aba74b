"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words, hashed to ``BUCKETS`` buckets and weighted by 1 + log(count)
with unit length together; statistics of its structure; and its number of characters. The machine
scores w0 + sum(w x) + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2), i.e. all pairwise interactions in time linear
in the number of features, and a logistic function makes it a probability.

It is fitted by mini-batch Adam on a bounded sample of labelled documents (``TRAIN_DOCS``, a parameter),
with a fixed seed; every document is scored. The sample's features are made in tasks; a document gives at most one number a bucket to the driver. Labels, language, source and doc_id are never inputs.

Defined results: null and empty texts have no words and structure statistics of 0, and get a score like any other;
without training documents, or with one class only, every score is the share of label 1, within 0.0001 (0.5 if none); a
column named score is replaced, others of any name pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, map_rows, packed, training_texts, unpacked, utf8_texts

TRAIN_DOCS = 6000
BUCKETS = 1 << 16
FACTORS = 8
EPOCHS = 12
BATCH = 128
STEP = 0.02
DECAY = 1e-4
SEED = 20240901
THRESHOLD = 0.5
#: Texts scored together; their words are held as arrays.
_TOGETHER = 256
_STATS = 16
_SYMBOLS = b"#*$%&|<>{}[]\\^~_=+"


def structure(text: bytes, counts: Counter, words: int) -> list[float]:
    """Statistics of the text's structure and its length, each roughly between 0 and 2."""
    n = max(1, len(text))
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    data = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit = data[65:91].sum(), data[97:123].sum(), data[48:58].sum()
    symbols = sum(int(data[c]) for c in _SYMBOLS)
    most = counts.most_common(1)[0][1] if counts else 0
    return [
        np.log1p(n) / 10,
        np.log1p(words) / 10,
        n / max(1, words) / 10,
        upper / n * 2,
        upper / max(1, upper + lower),
        digit / n * 4,
        symbols / n * 8,
        data[33] / n * 20,
        data[124] / n * 20,
        (data[46] + data[44]) / n * 10,
        len(counts) / max(1, words),
        most / max(1, words) * 2,
        len(filled) / max(1, words) * 10,
        1 - len(set(filled)) / max(1, len(filled)),
        data[128:].sum() / n,
        1.0 if words < 20 else 0.0,
    ]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, values and row starts of the texts' features; structure statistics come after the buckets."""
    index, value, starts = [], [], [0]
    for text in texts:
        words = text.split()
        counts = Counter(words)
        hashed = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) & (BUCKETS - 1)
        weight = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        weight /= max(1e-9, np.sqrt((weight**2).sum()))
        # words that share a bucket are one feature
        hashed, inverse = np.unique(hashed, return_inverse=True)
        index += [hashed, BUCKETS + np.arange(_STATS)]
        value += [np.bincount(inverse, weight, len(hashed)), np.array(structure(text, counts, len(words)), np.float64)]
        starts.append(starts[-1] + len(hashed) + _STATS)
    return np.concatenate(index or [np.zeros(0, np.int64)]), np.concatenate(value or [np.zeros(0)]), np.array(starts, np.int64)


class Machine:
    def __init__(self, bias: float = 0.0):
        rng = np.random.default_rng(SEED)
        self.bias = bias
        self.linear = np.zeros(BUCKETS + _STATS)
        self.factors = rng.normal(0, 0.01, (BUCKETS + _STATS, FACTORS))

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros(0)
        v = self.factors[index] * value[:, None]
        total = np.add.reduceat(v, starts[:-1], axis=0)
        squares = np.add.reduceat(v * v, starts[:-1], axis=0)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts[:-1]) + 0.5 * (total**2 - squares).sum(axis=1)


def fit(index: np.ndarray, value: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> Machine:
    """A machine fitted to rows of features, as features() gives them."""
    share = float(labels.mean()) if len(labels) else 0.5
    machine = Machine(_logit(share))
    if not len(labels) or not 0 < share < 1:
        machine.factors[:] = 0
        return machine
    rng = np.random.default_rng(SEED)
    first = [np.zeros_like(machine.linear), np.zeros_like(machine.factors)]
    second = [np.zeros_like(machine.linear), np.zeros_like(machine.factors)]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        rate = STEP * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            spans = [np.arange(starts[r], starts[r + 1]) for r in rows]
            take = np.concatenate(spans)
            i, x = index[take], value[take]
            own = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            error = 1 / (1 + np.exp(-np.clip(machine.margins(i, x, own), -30, 30))) - labels[rows]
            row = np.repeat(np.arange(len(rows)), np.diff(own))
            v = machine.factors[i]
            total = np.add.reduceat(v * x[:, None], own[:-1], axis=0)
            slope = (error / len(rows))[row] * x
            gradients = [slope, slope[:, None] * (total[row] - v * x[:, None])]
            machine.bias -= rate * float(error.mean())
            where, inverse = np.unique(i, return_inverse=True)
            for p, (target, g) in enumerate(zip((machine.linear, machine.factors), gradients, strict=True)):
                mean = np.zeros((len(where), *target.shape[1:]))
                np.add.at(mean, inverse, g)
                mean += DECAY * target[where]
                first[p][where] = 0.9 * first[p][where] + 0.1 * mean
                second[p][where] = 0.999 * second[p][where] + 0.001 * mean**2
                target[where] -= rate * first[p][where] / (np.sqrt(second[p][where]) * 3 + 1e-8)
    return machine


def _logit(share: float) -> float:
    share = min(max(share, 1e-4), 1 - 1e-4)
    return float(np.log(share / (1 - share)))


def train_model(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Machine:
    """labels: (doc_id, quality); only training rows are used, at most ``bound`` of them."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, label in zip(batch.column(0).to_pylist(), utf8_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                index, value, _ = features([text])
                rows.append((doc_id, label, index.astype(np.int32), value.astype(np.float32)))
            yield batch_of(schema, list(zip(*rows, strict=True)) or [[]] * 4)

    rows = training_texts(docs, labels, "quality", bound).select(F.col("doc_id").cast("long"), "text", "label")
    found = rows.mapInArrow(run, "doc_id long, label int, index array<int>, value array<float>").toArrow().sort_by("doc_id").combine_chunks()
    starts = np.concatenate([[0], np.cumsum(found["index"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]) if len(found) else np.zeros(1)
    flat = [np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in found[name].chunks)]) for name in ("index", "value")]
    return fit(flat[0].astype(np.int64), flat[1], starts.astype(np.int64), found["label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text, if ``keep_text`` is off) with the column score (double, the probability of label 1) appended."""
    held = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)))

    def make():
        own = Machine.__new__(Machine)
        own.bias, own.linear, own.factors = held.value

        def act(column: pa.Array) -> list[pa.Array]:
            texts, scores = utf8_texts(column), [np.zeros(0)]
            for at in range(0, len(texts), _TOGETHER):
                margin = own.margins(*features(texts[at : at + _TOGETHER]))
                scores.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            return [pa.array(np.concatenate(scores), pa.float64())]

        return act

    scored = map_rows(packed(docs, "text"), make, "score double", keep_text=keep_text)
    return unpacked(scored, [c for c in docs.columns if keep_text or c != "text"], ["text"], "score")
