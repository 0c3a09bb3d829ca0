"""Quality: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_udf, frugal, lists, sampled, steps, strings

#: Labelled rows that training takes at most; Fourier features; width of the kernel in standard deviations; ridge; seed.
TRAIN_ROWS, FEATURES, WIDTH, RIDGE, SEED = 20_000, 256, 4.0, 1e-3, 7
#: Scores are counted in so many bins for calibration.
BINS = 2048
STATISTICS = (
    "log_chars", "log_words", "mean_word", "letters", "upper", "digits", "spaces", "marks", "symbols", "bangs", "bars",
    "distinct_words", "repeats_next", "top_word", "upper_words", "odd_ends", "dup_lines", "mean_line",
)

_CLASS: np.ndarray | None = None
#: Characters that count as symbols.
_SYMBOLS = "#*$%&|<>"


def _classes() -> np.ndarray:
    """Of each code point (from 0x33480 on there are no letters, digits or marks): 0 other, 1 lower-case or caseless letter, 2 upper-case letter, 3 digit, 4 space, 5 mark, 6 symbol."""
    global _CLASS
    if _CLASS is None:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x33480):
            x = chr(c)
            table[c] = 2 if x.isupper() else 1 if x.isalpha() else 3 if x.isdigit() else 4 if x.isspace() else 6 if x in _SYMBOLS else 5 if x.isprintable() and not x.isalnum() else 0
        _CLASS = table
    return _CLASS


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for an empty one. Words of 50 characters and more on average count as 50."""
    out = np.zeros((len(texts), len(STATISTICS)))
    table = _classes()
    for k, text in enumerate(texts):
        if not text:
            continue
        n = len(text)
        count = np.bincount(table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=7) / n
        words = text.split()
        w = max(len(words), 1)
        seen: dict[str, int] = {}
        for x in words:
            seen[x] = seen.get(x, 0) + 1
        lines = text.split("\n")
        out[k] = (
            np.log1p(n), np.log1p(len(words)), min((n - len(words)) / w, 50), count[1] + count[2], count[2], count[3], count[4], count[5],
            count[6], text.count("!") / n, text.count("|") / n, len(seen) / w, sum(map(eq, words, words[1:])) / w, max(seen.values(), default=0) / w,
            sum(map(str.isupper, words)) / w, sum(not (x[-1].isalnum() or x[-1] in ".,;:?)\"'") for x in words) / w,
            1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    direction: np.ndarray
    phase: np.ndarray
    solved: np.ndarray
    #: Calibration: scores and the shares of label 1 there, both rising.
    at: np.ndarray
    share: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.mapped(stats) @ self.solved

    def mapped(self, stats: np.ndarray) -> np.ndarray:
        """Fourier features and a 1; a statistic over 8 deviations off counts as 8."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.direction + self.phase) * np.sqrt(2 / self.direction.shape[1])
        return np.hstack([waves, np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.share), 0, 1)


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rising means of blocks of neighbours (pool adjacent violators); weight: rows of each bin, total: their labels' sum."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total, strict=True):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / w) for w, t, n in blocks]) if blocks else np.zeros(0)


def _summed(rows: DataFrame, make, shapes: list[tuple[int, ...]], tasks: int = 8) -> list[np.ndarray]:
    """Sums over all rows of the arrays that make(statistics, labels) gives; each of a bounded number of tasks sends one set."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(s) for s in shapes]
        for batch in batches:
            if len(batch):
                for a, b in zip(held, make(np.stack(batch["stats"].to_numpy()), batch["label"].to_numpy(float)), strict=True):
                    a += b
        yield pd.DataFrame({"sums": [np.concatenate([a.ravel() for a in held]).tobytes()]})

    whole = sum((np.frombuffer(r["sums"]) for r in rows.coalesce(tasks).mapInPandas(part, "sums binary").collect()), np.zeros(sum(int(np.prod(s)) for s in shapes)))
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return [x.reshape(s) for x, s in zip(np.split(whole, cuts), shapes, strict=True)]


def stats_column(text: Column) -> Column:
    """Column of array<double>: STATISTICS of each whole text; null and empty: all 0."""

    @arrow_udf("array<double>")
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in frugal(batches):
            yield lists([x for run in steps(strings(batch)) for x in statistics(run)], np.float64)

    return stats(text)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Learns from (key long, text string, label int): of the rows with a label 0 or 1, the train_rows whose keys hash lowest.
    Their statistics are written once; means, normal equations and calibration counts are sums that tasks send. No rows, or
    one label only: a model that gives all texts that label's share (0.5 if there is none)."""
    from .common import checkpoint

    known = labelled.select("key", "text", "label").where(F.col("label").isin(0, 1))
    rows = checkpoint(sampled(known, "key", train_rows).select(stats_column(F.col("text")).alias("stats"), "label"))
    d = len(STATISTICS)
    n, total, square, ones = _summed(rows, lambda x, y: ([len(x)], x.sum(axis=0), (x * x).sum(axis=0), [y.sum()]), [(1,), (d,), (d,), (1,)])
    count = max(float(n[0]), 1.0)
    mean = total / count
    scale = np.sqrt(np.maximum(square / count - mean**2, 0))
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(seed)
    direction, phase = rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features)
    empty = Model(mean, scale, direction, phase, np.zeros(features + 1), np.zeros(1), np.array([ones[0] / count if n[0] else 0.5]))
    if not 0 < ones[0] < n[0]:
        return empty
    # Both labels weigh as much.
    weigh = lambda y: np.where(y > 0, 0.5 / ones[0], 0.5 / (n[0] - ones[0])) * n[0]

    def normal(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        phi = empty.mapped(x)
        heavy = phi * weigh(y)[:, None]
        return heavy.T @ phi, heavy.T @ y

    left, right = _summed(rows, normal, [(features + 1, features + 1), (features + 1,)])
    solved = np.linalg.solve(left + ridge * n[0] / features * np.eye(features + 1), right)
    ridged = Model(mean, scale, direction, phase, solved, np.zeros(1), np.zeros(1))
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.clip(np.searchsorted(edges, ridged.raw(x)) - 1, 0, BINS - 1)
        return np.bincount(place, minlength=BINS), np.bincount(place, y, minlength=BINS)

    weight, hits = _summed(rows, counts, [(BINS,), (BINS,)])
    some = weight > 0
    return Model(mean, scale, direction, phase, solved, ((edges[1:] + edges[:-1]) / 2)[some], isotonic(weight[some], hits[some]))


def score(text: Column, model: Model) -> Column:
    """Column of double, 0 to 1: the calibrated score of each whole text; null and empty texts are scored by statistics of 0."""

    @arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in frugal(batches):
            yield pa.array(np.concatenate([np.zeros(0), *(model.score(statistics(run)) for run in steps(strings(batch)))]))

    return scores(text)
