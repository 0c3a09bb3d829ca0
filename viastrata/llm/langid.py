"""Language by string kernels: presence of n-grams of mixed lengths, Nyström landmarks, one-versus-rest ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_udf, checkpoint, frugal, lists, sampled, steps, strings, structs

#: n-gram lengths of the blended spectrum, and log2 of the places that they are hashed to.
SPECTRUM = (1, 2, 3, 4)
BITS = 15
#: Labelled rows that training takes at most; those of them that become landmarks; the ridge.
TRAIN_ROWS, LANDMARKS, RIDGE = 6_000, 192, 1e-2
UNDETERMINED = "und"

_STEP_ROWS, _STEP_CODES = 64, 1 << 18


def presence(texts: list[str], bits: int = BITS) -> np.ndarray:
    """A row of 0 and 1 for each text: the hashed n-grams of its lower-cased letters, with runs of anything else as one
    space, and a space at the end."""
    size = 1 << bits
    out = np.zeros((len(texts), size), np.float32)
    data = np.frombuffer("\n".join(["", *(t.lower() for t in texts), ""]).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), lengths)
    code = data[1:] if len(data) else data
    letter = _letters(code)
    code = np.where(letter, code, np.uint32(32))
    keep = letter | np.concatenate([[True], letter[:-1]])
    end = np.cumsum(lengths) - 1
    keep[end[end < len(keep)]] = True
    code, row = code[keep].astype(np.uint64), row[keep]
    for start in range(0, len(code), _STEP_CODES):
        part, at = (x[start : start + _STEP_CODES + max(SPECTRUM) - 1] for x in (code, row))
        key = np.zeros(len(part), np.uint64)
        for n in range(1, min(max(SPECTRUM), len(part)) + 1):
            key = key[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            if n in SPECTRUM:
                same = at[: len(key)] == at[n - 1 :]
                place = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
                out[at[: len(key)][same], place[same]] = 1
    return out


_LETTER: np.ndarray | None = None


def _letters(code: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER[code]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, so that the product of two counts common n-grams over the geometric mean of their numbers."""
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def kernel(seen: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Common n-grams over the geometric mean of their numbers, of rows of presence and of landmarks, eight places a byte. These
    are unpacked a few at a time: whole, a worker would keep 25 MB of them, and their pickle."""
    common, sizes = np.zeros((len(seen), len(marks)), np.float32), np.zeros(len(marks), np.float32)
    for at in range(0, marks.shape[1], 512):
        part = np.unpackbits(marks[:, at : at + 512], axis=1).astype(np.float32)
        sizes += part.sum(axis=1)
        common += seen[:, 8 * at : 8 * (at + 512)] @ part.T
    return common / np.sqrt(np.maximum(sizes, 1)) / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))


@dataclass(frozen=True)
class Model:
    """weights: for each hashed n-gram and language; landmarks and their coefficients are multiplied out, as the kernel is linear."""

    bits: int
    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray


def fit(labelled: DataFrame, bits: int = BITS, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learns from (key long, text string, label string), of rows with a label and a text, and of those chosen the ones with a letter. Each language gives
    an equal share of the sample, as far as it has rows; landmarks are the first of each. The driver gets the landmarks'
    n-grams and, from each of a bounded number of tasks, a matrix of landmarks x landmarks. No rows: a model without languages."""
    known = labelled.select("key", "text", "label").where(F.col("label").isNotNull() & F.col("text").isNotNull())
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}
    if not counts:
        return Model(bits, (), np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32))
    languages = tuple(counts)
    share = max(1, train_rows // len(languages))
    wanted = F.lit(0.0)
    for name, n in counts.items():
        wanted = F.when(F.col("label") == name, min(1.0, share / n)).otherwise(wanted)
    level = F.pmod(F.xxhash64(F.lit(29), "key"), F.lit(1 << 30)) / float(1 << 30)
    sample = checkpoint(sampled(known.where(level < wanted), "key", train_rows).where(F.col("text").rlike(r"\p{L}")))
    few = max(1, landmarks // len(languages))
    order = F.xxhash64(F.lit(17), "key")
    lowest = sample.groupBy("label").agg(F.sort_array(F.collect_list(order)).alias("h")).select("label", F.get("h", F.least(F.size("h"), F.lit(few)) - 1).alias("limit"))
    chosen = sample.join(F.broadcast(lowest), "label").where(order <= F.col("limit"))

    @arrow_udf("array<int>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in frugal(batches):
            yield lists([np.flatnonzero(presence([t], bits)[0]) for t in strings(batch)])

    base = np.zeros((0, 1 << bits), np.float32)
    for r in chosen.orderBy("label", order, "key").select(places("text").alias("p")).collect():
        base = np.vstack([base, np.zeros((1, 1 << bits), np.float32)])
        base[-1, r["p"]] = 1
    if not len(base):
        return Model(bits, (), np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32))
    base = np.unique(base, axis=0)
    marks, base = np.packbits(base.astype(bool), axis=1), unit(base)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    large = values > 1e-6 * values[-1]
    root = vectors[:, large] / np.sqrt(values[large])
    m, k, names = root.shape[1], len(languages), {x: j for j, x in enumerate(languages)}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = np.zeros((m + 1, m + 1)), np.zeros((m + 1, k))
        for batch in frugal(batches):
            at = 0
            for texts in _blocks(batch["text"]):
                phi = kernel(presence(texts, bits), marks) @ root
                phi = np.hstack([phi, np.ones((len(texts), 1))])
                y = -np.ones((len(texts), k))
                y[np.arange(len(texts)), [names[x] for x in batch["label"].iloc[at : at + len(texts)]]] = 1
                left += phi.T @ phi
                right += phi.T @ y
                at += len(texts)
        yield pd.DataFrame({"left": [left.tobytes()], "right": [right.tobytes()]})

    left, right = np.zeros((m + 1, m + 1)), np.zeros((m + 1, k))
    for r in sample.select("text", "label").repartition(8).mapInPandas(sums, "left binary, right binary").collect():
        left += np.frombuffer(r["left"]).reshape(left.shape)
        right += np.frombuffer(r["right"]).reshape(right.shape)
    n = max(left[m, m], 1)
    penalty = ridge * n * np.eye(m + 1) / m
    penalty[m, m] = 1e-9
    solved = np.linalg.solve(left + penalty, right)
    weights = base.T.astype(np.float64) @ (root @ solved[:m])
    return Model(bits, languages, weights.astype(np.float32), solved[m].astype(np.float32))


def _blocks(texts) -> Iterator[list[str]]:
    for run in steps(texts):
        for at in range(0, len(run), _STEP_ROWS):
            yield run[at : at + _STEP_ROWS]


def predict(text: Column, model: Model) -> Column:
    """Column of struct<lang_pred string, score double>: the language of highest value, the first by name of equals, and that
    value moved from -1..1 to 0..1. Null texts, texts without a letter, and all texts under an empty model: `und`, 0."""

    @arrow_udf("lang_pred string, score double")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in frugal(batches):
            names, scores = [], []
            for texts in _blocks(strings(batch)):
                if not model.languages:
                    names += [UNDETERMINED] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                values = unit(presence(texts, model.bits)) @ model.weights + model.bias
                best = values.argmax(axis=1)
                top = np.clip((values[np.arange(len(texts)), best] + 1) / 2, 0, 1)
                for t, j, s in zip(texts, best, top, strict=True):
                    sure = has_letter(t)
                    names.append(model.languages[j] if sure else UNDETERMINED)
                    scores.append(float(s) if sure else 0.0)
            yield structs(lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()))

    return told(text)
