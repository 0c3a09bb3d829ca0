"""Repeated lines: levelled sorted runs of line hashes, to which batches of documents are added.

A run holds (key, docs, last): a line's 128-bit hash, how many documents hold it and the largest doc_id of these, dealt by key
and sorted. All runs are dealt alike, so a batch is merge-anti-joined with one run after the other where they lie, without an
exchange: keys that no run has make a run of their own at level 0, keys met before make a run of repeats. FANOUT runs of a level are merged into one of the next. No key is in two first runs, so only the
keys in repeats, mostly few, are ever summed up again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_udf, checkpoint, frugal, strings, structs

#: Code points of the shortest line that counts; documents that make it repeated; batches of a table; runs that are merged.
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
#: Lines that make one more part of the runs, and parts at least.
PART_LINES, LEAST_PARTS = 1 << 20, 8
#: Most keys that are broadcast because very many documents hold them.
HOT_KEYS = 20_000
#: The white space that is stripped off a line.
_BLANK = " \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Of each line its key's hash, None if the key is too short. Only A-Z are lower-cased, as bytes.lower() does."""
    import xxhash

    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        bare = line.strip(_BLANK)
        out.append(xxhash.xxh3_128_digest(bare.encode("utf-8", "replace").lower()) if len(bare) >= min_chars else None)
    return out


def keys_column(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Column of array<binary>: the distinct keys of each text."""

    @arrow_udf("array<binary>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in frugal(batches):
            yield pa.array([list({k for k in line_keys(t, min_chars) if k is not None}) for t in strings(batch)], pa.list_(pa.binary()))

    return keys(text)


@contextmanager
def fixed_plans(spark: SparkSession, parts: int) -> Iterator[None]:
    """Plans that do not change as they run, whose checkpoints know how their rows are dealt and sorted."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class LineRuns:
    """The runs of all batches added so far, each dealt to `parts` tasks. Its frames are checkpoints: they outlive lost executors."""

    def __init__(self, fanout: int = FANOUT, parts: int = LEAST_PARTS):
        self.fanout, self.parts = fanout, parts
        self.first: list[list[DataFrame]] = []
        self.repeats: list[list[DataFrame]] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        """A run of rows that an aggregation or a merge join has dealt by key."""
        with fixed_plans(rows.sparkSession, self.parts):
            return checkpoint(rows.sortWithinPartitions("key"))

    def _push(self, levels: list[list[DataFrame]], run: DataFrame) -> None:
        level = 0
        while True:
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < self.fanout:
                return
            run = self._run(summed(reduce(DataFrame.unionByName, levels[level])))
            levels[level] = []
            level += 1

    def add(self, lines: DataFrame) -> None:
        """lines: (key, doc_id), a row for each key of each document of the batch."""
        own = self._run(lines.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")))
        new = own
        for run in (run for level in self.first for run in level):
            new = new.join(run.select("key").hint("merge"), "key", "left_anti")
        if new is own:
            self._push(self.first, own)
            return
        new = self._run(new)
        self._push(self.first, new)
        self._push(self.repeats, self._run(own.join(new.select("key").hint("merge"), "key", "left_anti")))

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame | None:
        """(key, docs, last) of the keys in at least min_docs documents; None before the first batch."""
        first = [run for level in self.first for run in level]
        again = [run for level in self.repeats for run in level]
        if not first:
            return None
        whole = reduce(DataFrame.unionByName, first)
        if not again:
            return whole.where(F.col("docs") >= min_docs)
        more = summed(reduce(DataFrame.unionByName, again)).select("key", F.col("docs").alias("docs2"), F.col("last").alias("last2"))
        total = whole.join(more, "key", "left").select("key", (F.col("docs") + F.coalesce("docs2", F.lit(0))).alias("docs"), F.greatest("last", "last2").alias("last"))
        return total.where(F.col("docs") >= min_docs)


def summed(runs: DataFrame) -> DataFrame:
    return runs.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))


def _meet(lines: DataFrame, n_lines: int, repeated: DataFrame, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(key, doc_id, last) of the lines, n_lines at most, with repeated keys. Keys in so many documents that no more than hot_keys can be are
    broadcast, as their lines would crowd one task; the rest are merge-joined."""
    least = max(256, -(-n_lines // hot_keys))
    hot = F.broadcast(repeated.where(F.col("docs") >= least).select("key", "last"))
    cold = repeated.where(F.col("docs") < least).select("key", "last")
    return lines.join(hot, "key").unionByName(lines.join(hot, "key", "left_anti").join(cold, "key"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The rows with `text` less its repeated lines, and n_lines (before), n_dropped. A line's key (white space stripped off,
    A-Z lower-cased) is repeated if at least min_chars long and in at least min_docs documents, told apart by doc_id; then
    only the largest of these doc_ids keeps its lines. Null and empty texts are one empty line and come out empty. Rows of one
    doc_id are one document; rows with a null doc_id neither count nor lose lines. Columns n_lines and n_dropped are replaced."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    held = checkpoint(
        docs.where("doc_id is not null").select("doc_id", keys_column(F.col("text"), min_chars).alias("keys")).where(F.size("keys") > 0)
    )
    n_lines = held.agg(F.sum(F.size("keys")).alias("n")).first()["n"] or 0
    lines = held.select("doc_id", F.explode("keys").alias("key"))
    if not held.groupBy("doc_id").count().where("count > 1").isEmpty():
        # Else a document's keys are distinct as they are, and need not be dealt by key and document.
        lines = lines.distinct()
    runs = LineRuns(fanout, max(LEAST_PARTS, n_lines // PART_LINES))
    for k in range(batches):
        runs.add(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    repeated = checkpoint(runs.repeated(min_docs))
    drops = _meet(lines, n_lines, repeated).where("doc_id < last").groupBy("doc_id").agg(F.collect_set("key").alias("drop_keys"))

    @arrow_udf("text string, n_lines long, n_dropped long")
    def cut(batches_: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in frugal(batches_):
            rows = []
            for text, keys in zip(strings(texts), gone, strict=True):
                if not keys.is_valid:
                    rows.append((text, text.count("\n") + 1, 0))
                    continue
                dead = set(keys.as_py())
                every = text.split("\n")
                kept = [line for line, key in zip(every, line_keys(text, min_chars), strict=True) if key not in dead]
                rows.append(("\n".join(kept), len(every), len(every) - len(kept)))
            kept_texts, n, lost = ([r[k] for r in rows] for k in range(3))
            yield structs(text=pa.array(kept_texts, pa.string()), n_lines=pa.array(n, pa.int64()), n_dropped=pa.array(lost, pa.int64()))

    # Rows go as one column, so that no name of theirs meets one of ours.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    joined = whole.join(drops, F.col("row")["doc_id"] == F.col("doc_id"), "left")
    done = joined.select("row", cut(F.col("row")["text"], F.col("drop_keys")).alias("cut"))
    return done.select(*((F.col("cut") if c == "text" else F.col("row"))[c].alias(c) for c in names), "cut.n_lines", "cut.n_dropped")
