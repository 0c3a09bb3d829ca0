"""What the operators share: checkpoints, bounded samples of labelled rows, batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import checkpoint

__all__ = ["STEP_CHARS", "arrow_udf", "checkpoint", "fold", "frugal", "keeps", "lists", "release", "sampled", "small_batches", "steps", "strings", "structs", "table"]

#: Characters of text that one NumPy step works on; a longer text makes a step of its own.
STEP_CHARS = 1 << 18
#: Bytes of an Arrow batch; a longer row makes a batch of its own.
BATCH_BYTES = 2 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def small_batches() -> None:
    """Bounds the Arrow batches of the running session by bytes, as rows may be whole books. Spark's own bound is 64 MB, of which
    the JVM and each worker would hold copies; a session that asks for less keeps its bound."""
    spark = SparkSession.getActiveSession()
    if spark is not None and not 0 < _bytes(spark.conf.get(_BATCHES)) <= BATCH_BYTES:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def _bytes(size: str) -> int:
    digits = size.rstrip("abgkmpt").strip() or "0"
    return int(digits) << 10 * " kmgtp".index((size[len(digits) :].strip() or " ")[0].replace("b", " "))


def arrow_udf(kind: str):
    """F.arrow_udf under bounded batches."""
    small_batches()
    return F.arrow_udf(kind)


def _last(hashes: DataFrame, bound: int) -> tuple[int, int, int] | None:
    """Where `bound` rows of (h) by rising h end: that hash, how many of its rows still fit, and how many there are; None if all
    rows fit. The first pass counts rows; the second brings counts of hashes to the driver, about as many as the bound."""
    n = hashes.count()
    if n <= bound:
        return None
    # Hashes in the lowest `share` of their range hold the bound, unless few hashes hold most rows: then it is doubled.
    share = min(1.0, (bound + 6 * bound**0.5 + 20) / n)
    while True:
        top = (1 << 63) - 1 if share >= 1 else int(share * (1 << 64)) - (1 << 63)
        near = hashes.where(F.col("h") <= top).groupBy("h").agg(F.count("*").alias("n")).collect()
        if share >= 1 or sum(r["n"] for r in near) >= bound:
            break
        share = min(1.0, 2 * share)
    held = 0
    for r in sorted(near, key=lambda r: r["h"]):
        if held + r["n"] >= bound:
            return r["h"], bound - held, r["n"]
        held += r["n"]
    raise AssertionError("fewer rows than were counted")


def sampled(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """The rows whose key hashes lowest, `bound` at most. Of the rows of the last key, where not all fit, those whose columns
    hash lowest stay, and of equal rows as many as fit. Light passes over the keys find the limits."""
    mixed = F.xxhash64(F.lit(17), F.col(key))
    if (end := _last(rows.select(mixed.alias("h")), bound)) is None:
        return rows
    last, room, there = end
    if room == there:
        return rows.where(mixed <= F.lit(last))
    tied, whole = rows.where(mixed == F.lit(last)), F.xxhash64(F.lit(31), *(F.col(f"`{c}`") for c in sorted(rows.columns)))
    last2, room2, there2 = _last(tied.select(whole.alias("h")), room)
    equal = tied.where(whole == F.lit(last2))
    return rows.where(mixed < F.lit(last)).unionByName(tied.where(whole < F.lit(last2))).unionByName(equal if room2 == there2 else equal.limit(room2))


def strings(texts: pa.Array, rows: int = 128) -> Iterator[str]:
    """The texts of an Arrow batch (null: empty), a few rows at a time as Python strings, so that a batch is not held twice."""
    for at in range(0, len(texts), rows):
        for text in texts.slice(at, rows).to_pylist():
            yield text or ""


_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Says how to drop what an operator keeps in a worker from one task of its own to the next."""
    _KEPT[owner] = forget


def frugal(batches: Iterator, owner: str = "") -> Iterator:
    """The batches of a task. What other operators keep in the worker is dropped. Before and after them the worker, which Spark keeps for later tasks, gives memory that nothing
    uses back to the system. Arrow takes its memory from the system's own pool, which does give it back."""
    pa.set_memory_pool(pa.system_memory_pool())
    for name, forget in _KEPT.items():
        if name != owner:
            forget()
    release()
    yield from batches
    release()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def lists(arrays: list[np.ndarray], kind: type = np.int32) -> pa.Array:
    """An Arrow array of lists."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *arrays]).astype(kind, copy=False)))


def structs(**columns) -> pa.Array:
    """An Arrow array of structs."""
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def steps(texts: Iterable[str | None], size: int = STEP_CHARS) -> Iterator[list[str]]:
    """Runs of texts (null: empty) of about `size` characters."""
    run: list[str] = []
    held = 0
    for text in texts:
        run.append(text or "")
        held += len(run[-1])
        if held >= size or len(run) >= 4096:
            yield run
            run, held = [], 0
    if run:
        yield run
