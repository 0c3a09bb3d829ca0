"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_udf, frugal, lists, sampled, steps, strings

#: log2 of the weights that hashes fall on.
BITS = 20
#: Labelled rows that training takes at most, and features of these in all: with the first row beyond it, it has enough.
TRAIN_ROWS, TRAIN_FEATURES = 12_000, 20_000_000
#: Rows that training looks at in all, so that few rows are seen often; epochs at least and at most.
PASSES, EPOCHS = 36_000, (3, 40)
#: Texts that a feature must come in to be learned; rates and penalties.
LEAST_TEXTS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
#: First letters of a word that make its stem.
STEMS = (4, 5)

_WORD = re.compile(r"[^\W_]+")
_MIX = 0x9E3779B97F4A7C15
#: Words that a worker remembers, and their characters in all.
_MEMO_WORDS, _MEMO_CHARS = 100_000, 1 << 20


def _mix(k: int) -> np.uint64:
    return np.uint64(k * _MIX & 0xFFFFFFFFFFFFFFFF)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Turns texts into hashed features: words, their stems, pairs of neighbours, and pairs with one word between."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros((1024, 1 + len(STEMS)), np.uint64)

    def _codes(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.memo) > _MEMO_WORDS or self.chars > _MEMO_CHARS:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if (need := len(self.memo) + len(new)) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((need, self.table.shape[1]), np.uint64)])
        self.chars += sum(map(len, new))
        for w in new:
            k = self.memo[w] = len(self.memo)
            self.table[k] = [xxhash.xxh64_intdigest(w)] + [xxhash.xxh64_intdigest(w[:n], n) for n in STEMS]
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature), one for each occurrence; documents count from 0 in the given order."""
        found = [_WORD.findall(t.lower()) for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        codes = self._codes([w for x in found for w in x])
        word = self.table[codes]
        docs, keys = [doc] * word.shape[1], [_scramble(word[:, k] + _mix(k)) for k in range(word.shape[1])]
        for gap in (1, 2):
            same = doc[gap:] == doc[:-gap]
            pair = word[:-gap, 0][same] * np.uint64(2 * gap + 1) + (word[gap:, 0][same] >> np.uint64(gap)) + _mix(gap + 7)
            docs.append(doc[gap:][same])
            keys.append(_scramble(pair))
        return np.concatenate(docs), (np.concatenate(keys) >> self.shift).astype(np.int64)


class FTRL:
    """Per-coordinate FTRL-proximal: the weight of a coordinate comes from its gradient sum z and squared sum n."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, label: int) -> float:
        """One row of distinct coordinates i, each of value 1."""
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g
        return p


@dataclass(frozen=True)
class Model:
    """Weights that are not 0, by feature; feature 2**bits is the bias."""

    bits: int
    index: np.ndarray
    weight: np.ndarray


def fit(labelled: DataFrame, bits: int = BITS, train_rows: int = TRAIN_ROWS, passes: int = PASSES) -> Model:
    """Learns from (key long, text string, label int): of the rows with a label 0 or 1, the train_rows whose keys hash lowest.
    Executors hash the texts; one task, which the bounds on rows and features keep small, learns row by row in the order of the hashes and
    returns the weights that L1 has not set to 0. No rows: a model that gives all texts 0."""
    known = labelled.select("key", "text", "label").where(F.col("label").isin(0, 1))
    sample = sampled(known, "key", train_rows)

    @arrow_udf("array<int>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher(bits)
        for batch in frugal(batches):
            out = []
            for texts in steps(strings(batch)):
                doc, feature = hasher.features(texts)
                pairs = np.unique(doc * (1 << bits) + feature)
                cuts = np.searchsorted(pairs, np.arange(1, len(texts)) * (1 << bits))
                out += [x.astype(np.int32) for x in np.split(pairs & ((1 << bits) - 1), cuts)]
            yield lists(out)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for b in frugal(batches):
            for f, y in zip(b["f"], b["label"], strict=True):
                if held <= TRAIN_FEATURES:
                    rows.append((np.array(f, np.int32), y))
                    held += len(f)
        texts = np.zeros(1 << bits, np.int32)
        for i, _ in rows:
            texts[i] += 1
        for k, (i, y) in enumerate(rows):
            rows[k] = np.append(i[texts[i] >= LEAST_TEXTS], np.int32(1 << bits)), y
        model = FTRL((1 << bits) + 1)
        epochs = min(max(-(-passes // max(len(rows), 1)), EPOCHS[0]), EPOCHS[1])
        for _ in range(epochs):
            for i, y in rows:
                model.learn(i, y)
        w = model.weights()
        kept = np.flatnonzero(w)
        yield pd.DataFrame({"i": kept, "w": w[kept]})

    one = sample.select(F.xxhash64(F.lit(17), "key").alias("h"), "key", "label", hashed("text").alias("f")).repartition(1).sortWithinPartitions("h", "key", "label", F.hash("f"))
    found = one.select("label", "f").mapInPandas(learn, "i long, w double").toPandas().sort_values("i")
    return Model(bits, found["i"].to_numpy(np.int64), found["w"].to_numpy(np.float64))


def score(text: Column, model: Model) -> Column:
    """Column of double, 0 to 1. Null and empty texts get what the bias gives, as all texts without known features do.
    A feature counts once a text, however often it comes, so repeated lines and long texts weigh no more."""

    @arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        size = 1 << model.bits
        hasher, weight, bias = Hasher(model.bits), np.zeros(size), 0.0
        for i, w in zip(model.index, model.weight, strict=True):
            if i == size:
                bias = w
            else:
                weight[i] = w
        for batch in frugal(batches):
            out = []
            for texts in steps(strings(batch)):
                doc, feature = hasher.features(texts)
                heavy = weight[feature] != 0
                pairs = np.unique(doc[heavy] * size + feature[heavy])
                total = bias + np.bincount(pairs >> model.bits, weight[pairs & (size - 1)], minlength=len(texts))
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return scores(text)
