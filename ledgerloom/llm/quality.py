"""Quality classifier: a factorisation machine over words, structure and metadata.

Features are the text's distinct words, hashed to 2^WORD_BITS buckets with unit length together, one bin for each
structure statistic (shares of capitals, digits, symbols, blanks, line ends and characters beyond ASCII, word and line lengths,
distinct words, repeated words, size) and one bin for the metadata column n_chars. Every feature has a weight and FACTORS
factors; pairs of features interact by the product of their factors. The sum over all pairs is taken in linear time as half of the difference of the
squared sum and the sum of squares. Fitting is AdaGrad on the logistic loss, on at most about SAMPLE labelled texts chosen by a hash of the id;
scoring takes every whole text.

Defined results: null text is empty; an empty text has the lowest bins and no words; a null or wrong n_chars has a bin of its own; without any
labels every score is 0.5; without two kinds of labels it is near the kind there is; rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import runs, share_below, texts_of
from ledgerloom.llm.words import find_words

WORD_BITS, FACTORS, SAMPLE, EPOCHS, RATE, DECAY, BATCH, BINS = 13, 6, 6000, 16, 0.1, 1e-4, 128, 12
ACCEPTED = 0.7

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 capital, 2 digit, 3 symbol, 4 blank, 5 line end, 6 beyond ASCII
_CLASS[33:127] = 3
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 2, 1, 0, 6
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 4, 5
for _mark in b".,;:'\"()-?":
    _CLASS[_mark] = 7  # marks of ordinary prose
STATISTICS = 14


def features(texts: list[bytes], sizes: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets of all texts in order, where each text's begin, and a row of statistics per text."""
    words = find_words(texts)
    counts, n = words.counts(), len(texts)
    buckets = (words.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    keys, often = np.unique(words.text_of * (1 << WORD_BITS) + buckets, return_counts=True)
    owner, bucket = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(owner, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, owner, often)
    classes = _CLASS[np.frombuffer(words.data, dtype=np.uint8)]
    bytes_ = np.maximum(1, np.diff(words.offsets) - 1)
    per = []
    for kind in range(1, 8):
        total = np.concatenate([[0], np.cumsum(classes == kind)])
        found = total[words.offsets[1:] - 1] - total[words.offsets[:-1]]
        per.append(found)
    lengths = np.bincount(words.text_of, weights=words.ends - words.starts, minlength=n)
    some = np.maximum(1, counts)
    chars = np.array([len(t) - sum_ for t, sum_ in zip(texts, _continuations(texts), strict=True)])
    claimed = np.array([-1 if s is None else s for s in sizes])
    right = np.where(claimed < 0, 0, np.where(claimed == chars, 2 + np.log2(1 + chars) / 32, 1))
    stats = np.stack([
        np.log1p(counts), lengths / some, distinct / some, most / some, *(p / bytes_ for p in per[:4]),
        np.log1p(counts / (1 + per[4])), per[5] / bytes_, per[6] / bytes_, per[2] / some, np.log1p(chars), right], axis=1)
    return bucket, np.concatenate([[0], np.cumsum(distinct)]), stats


def _continuations(texts: list[bytes]) -> list[int]:
    """Bytes of each text that continue a character."""
    return [int(np.count_nonzero((np.frombuffer(t, dtype=np.uint8) & 0xC0) == 0x80)) for t in texts]


class Machine:
    """The fitted machine: bin edges, weights, factors. Its size follows from the constants above."""

    def __init__(self, texts: list[bytes], sizes: list[int | None], labels: np.ndarray) -> None:
        parts = [features(texts[a:b], sizes[a:b]) for a, b in runs(texts)]
        stats = np.concatenate([p[2] for p in parts]) if parts else np.zeros((0, STATISTICS))
        inner = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = np.quantile(stats, inner, axis=0).T if len(stats) else np.zeros((STATISTICS, BINS - 1))
        size = (1 << WORD_BITS) + STATISTICS * BINS
        self.bias, self.weight = 0.0, np.zeros(size)
        self.factor = np.random.default_rng(7).normal(0, 0.05, (size, FACTORS))
        if len(texts):
            self._fit([self._vectors(*p) for p in parts], labels)

    def _vectors(self, bucket: np.ndarray, begin: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all texts in order, and where each text's begin."""
        n = len(stats)
        bins = np.stack([np.searchsorted(e, s, side="left") for e, s in zip(self.edges, stats.T, strict=True)], axis=1)
        bins += (1 << WORD_BITS) + np.arange(STATISTICS) * BINS
        sizes = np.diff(begin)
        ends = begin + np.arange(n + 1) * STATISTICS
        index, value = np.empty(ends[-1], dtype=np.int64), np.empty(ends[-1])
        at = np.arange(len(bucket)) + np.repeat(np.arange(n), sizes) * STATISTICS
        index[at], value[at] = bucket, np.repeat(1 / np.sqrt(np.maximum(1, sizes)), sizes)
        own = (ends[1:, None] - STATISTICS + np.arange(STATISTICS)).ravel()
        index[own], value[own] = bins.ravel(), 1 / np.sqrt(STATISTICS)
        return index, value, ends

    def _margin(self, index: np.ndarray, value: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scaled = self.factor[index] * value[:, None]
        sums = np.add.reduceat(scaled, ends[:-1], axis=0)
        squares = np.add.reduceat((scaled * scaled).sum(axis=1), ends[:-1])
        linear = np.add.reduceat(self.weight[index] * value, ends[:-1])
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums, scaled

    def _fit(self, parts: list, labels: np.ndarray) -> None:
        rows = [(i[e[k]:e[k + 1]], v[e[k]:e[k + 1]]) for i, v, e in parts for k in range(len(e) - 1)]
        rng, size = np.random.default_rng(11), len(self.weight)
        step_w, step_v, step_b = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
        share = labels.mean()
        self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                some = order[at:at + BATCH]
                index, value = (np.concatenate([rows[k][j] for k in some]) for j in (0, 1))
                sizes = np.array([len(rows[k][0]) for k in some])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                margin, sums, scaled = self._margin(index, value, ends)
                error = (1 / (1 + np.exp(-margin)) - labels[some]) / len(some)
                each = np.repeat(error, sizes)
                slope = value[:, None] * (np.repeat(sums, sizes, axis=0) - scaled) * each[:, None]
                used = np.unique(index)
                g = np.bincount(index, weights=each * value, minlength=size)[used] + DECAY * self.weight[used]
                step_w[used] += g * g
                self.weight[used] -= RATE * g / np.sqrt(step_w[used])
                for f in range(FACTORS):
                    g = np.bincount(index, weights=slope[:, f], minlength=size)[used] + DECAY * self.factor[used, f]
                    step_v[used, f] += g * g
                    self.factor[used, f] -= RATE * g / np.sqrt(step_v[used, f])
                step_b += error.sum() ** 2
                self.bias -= RATE * error.sum() / np.sqrt(step_b)

    def scores(self, texts: list[bytes], sizes: list[int | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in runs(texts):
            margin, _, _ = self._margin(*self._vectors(*features(texts[a:b], sizes[a:b])))
            out[a:b] = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars",
        label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine learned from about `sample` labelled documents at most."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("label is not null and doc_id is not null")
    total = known.count()
    picked = known.where(share_below("doc_id", min(1.0, sample / max(1, total))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(n_chars).cast("long").alias("size"))
    # The sample's size is bounded by the parameter, so its ids may be broadcast.
    found = rows.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "text").toArrow()
    return Machine(texts_of(found.column("text").combine_chunks()), found.column("size").to_pylist(),
                   np.array(found.column("label").to_pylist(), dtype=float))


def with_score(docs: DataFrame, machine: Machine, out: str, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with a further column, the probability of the good label."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at, size = docs.columns.index(text), docs.columns.index(n_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                scores.append(shared.value.scores(texts_of(part.column(at)), part.column(size).to_pylist()))
            yield batch.append_column(out, pa.array(np.concatenate(scores)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
