"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams, of lengths 1 to MOST, that both
hold, divided by the root of the product of their own numbers. N-grams are hashed to 2^HASH_BITS buckets; case and characters that are
not letters do not count. LANDMARKS labelled texts span the space (Nyström): a text's features are its kernel values with them, and a
one-versus-rest kernel ridge regression gives each language a weight per landmark. Scoring is the
kernel block of many texts times these weights, a batched matrix product.

Learning takes about SAMPLE texts of each language, chosen by a hash of the id; prediction takes every whole text.

Defined results: a null text and a text without a letter are `und` with score 0; ties go to the first language in
alphabetical order; without any labelled text everything is `und`; rows are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import share_below

MOST, HASH_BITS, LANDMARKS, SAMPLE, RIDGE, SHARPNESS = 3, 18, 96, 300, 1e-2, 6.0
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")  # and numbers that are no digits
NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


class Grams:
    """Distinct n-grams of a text as buckets, without sorting: of all places with one bucket the last one counts."""

    def __init__(self, most: int = MOST, bits: int = HASH_BITS) -> None:
        self.most, self.bits = most, bits
        self.last = np.zeros(1 << bits, dtype=np.int64)

    def __call__(self, text: str) -> np.ndarray:
        plain = " " + NOT_LETTERS.sub(" ", text.lower()).strip() + " "
        codes = np.frombuffer(plain.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        parts, rolled = [], codes
        for n in range(1, min(self.most, len(codes)) + 1):
            if n > 1:
                rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[n - 1:]
            parts.append((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits))
        buckets = np.concatenate(parts).astype(np.int64)
        places = np.arange(len(buckets))
        self.last[buckets] = places
        return buckets[self.last[buckets] == places]


class Classifier:
    """Landmarks and weights. A picklable value that goes to the tasks; its size follows from its parameters."""

    def __init__(self, texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        self.languages = sorted(set(languages))
        grams, y = Grams(), np.array([self.languages.index(x) for x in languages], dtype=int)
        own = [grams(t) for t in texts]
        chosen = self._spread(y, landmarks)
        held = np.unique(np.concatenate([own[i] for i in chosen])) if len(chosen) else np.zeros(0, int)
        self.row = np.full(1 << grams.bits, -1, dtype=np.int32)
        self.row[held] = np.arange(len(held))
        self.holds = np.zeros((len(held), len(chosen)), dtype=np.float32)
        for j, i in enumerate(chosen):
            self.holds[self.row[own[i]], j] = 1
        self.norms = np.sqrt(np.array([len(own[i]) for i in chosen], dtype=np.float64))
        self.weights = np.zeros((len(chosen), len(self.languages)))
        if len(chosen):
            block = self.kernel(own)
            between = block[chosen]
            values, vectors = np.linalg.eigh((between + between.T) / 2)
            good = values > 1e-8 * values[-1]
            root = vectors[:, good] / np.sqrt(values[good])
            features = block @ root
            target = np.where(y[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
            # Each language counts alike, whatever its part of the sample.
            share = 1 / np.bincount(y, minlength=len(self.languages))[y]
            gram = features.T @ (features * share[:, None]) + ridge * np.eye(features.shape[1])
            self.weights = root @ np.linalg.solve(gram, features.T @ (target * share[:, None]))

    def _spread(self, y: np.ndarray, landmarks: int) -> np.ndarray:
        each = max(1, landmarks // max(1, len(self.languages)))
        return np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(self.languages))]) if len(y) else np.zeros(0, int)

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (as buckets) with all landmarks."""
        block = np.zeros((len(texts), len(self.norms)))
        for i, buckets in enumerate(texts):
            rows = self.row[buckets]
            block[i] = self.holds[rows[rows >= 0]].sum(axis=0) / max(1.0, np.sqrt(len(buckets)))
        return block / np.maximum(self.norms, 1.0)

    def predict(self, texts: list[str | None], grams: Grams) -> tuple[list[str], list[float]]:
        able = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for begin in range(0, len(able), 512):
            part = able[begin:begin + 512]
            margins = self.kernel([grams(texts[i]) for i in part]) @ self.weights
            odds = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
            odds /= odds.sum(axis=1, keepdims=True)
            for i, best, score in zip(part, odds.argmax(axis=1), odds.max(axis=1), strict=True):
                names[i], scores[i] = self.languages[best], float(score)
        return names, scores


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang", sample: int = SAMPLE) -> Classifier:
    """A classifier learned from about `sample` rows of each language."""
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(language).alias("language")).where(
        F.col("language").isNotNull() & F.col("text").isNotNull())
    share: Column = F.lit(0.0)
    for row in rows.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per language
        share = F.when(F.col("language") == row["language"], F.lit(min(1.0, sample / row["n"]))).otherwise(share)
    picked = rows.where(share_below("doc_id", share)).orderBy(F.xxhash64("doc_id"), "doc_id", "language", "text").collect()
    able = [r for r in picked if has_letter(r["text"])]
    return Classifier([r["text"] for r in able], [r["language"] for r in able])


def identify(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            names, scores = [], []
            for at in range(0, batch.num_rows, 512):
                more = shared.value.predict(batch.column(1).slice(at, 512).to_pylist(), grams)
                names += more[0]
                scores += more[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, lang_pred string, score double")
