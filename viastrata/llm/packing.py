"""Packing of token sequences: length combinations that fill a window, their counts by non-negative least squares.

Documents give whole windows and a rest. The histogram of rests is as long as the window, whatever the corpus; the driver
enumerates shallow combinations of lengths that fill a window, fits how often to use each, rounds, tops up, and packs the
residuals greedily, largest first. Each rest's rank among those of its length says which combination takes it; ranks are counted
in salted groups, as many as the rows ask for, so one length may hold most rests. Residuals that fill no window together are laid
end to end in sequences, cut where these end; the last of them is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_chars, read_ranks
from .common import arrow_udf, checkpoint, frugal, keeps, steps, strings

#: Tokens of a sequence; id that ends a document; groups that ranks and sums of one length are counted in, at least, and the rows
#: that ask for one group more.
WINDOW, END_ID, SALTS, SALT_ROWS = 2048, 1, 64, 1 << 24
#: Most rows of group starts that are broadcast, of 40 bytes each.
BROADCAST_ROWS = 1 << 18
#: Most frequent lengths that serve as the second part of three; rounds of the fit.
MIDDLES, SWEEPS = 12, 8


def combinations(counts: np.ndarray, middles: int = MIDDLES) -> list[tuple[tuple[int, int], ...]]:
    """Ways to fill the window, as ((length, times), ...): two lengths, one length many times and a remainder, three lengths.
    counts: rests of each length from 0 up to the window, which is left out; only lengths that occur are used."""
    window = len(counts)
    there = counts > 0
    out: dict[tuple[tuple[int, int], ...], None] = {}

    def add(*parts: int) -> None:
        if all(there[p] for p in parts):
            unique, times = np.unique(parts, return_counts=True)
            out[tuple(zip(unique.tolist()[::-1], times.tolist()[::-1], strict=True))] = None

    for a in range(1, window // 2 + 1):
        add(a, window - a)
    for a in range(1, window // 3 + 1):
        rest = window % a
        if there[a] and (not rest or there[rest]):
            out[((a, window // a), (rest, 1)) if rest else ((a, window // a),)] = None
    common = [int(b) for b in np.argsort(-counts, kind="stable")[:middles] if there[b]]
    for b in common:
        for a in range(1, (window - b) // 2 + 1):
            add(a, b, window - a - b)
    return list(out)


def fit_counts(counts: np.ndarray, ways: list[tuple[tuple[int, int], ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares by coordinate descent: repeats x >= 0 of each way, nearest to using up the counts."""
    left = counts.astype(float).tolist()
    x = [0.0] * len(ways)
    for _ in range(sweeps):
        for k, way in enumerate(ways):
            step = sum(t * left[a] for a, t in way) / sum(t * t for _, t in way)
            new = x[k] + step
            if new < 0:
                new = 0.0
            if step := new - x[k]:
                x[k] = new
                for a, t in way:
                    left[a] -= t * step
    return np.array(x)


def plan(counts: np.ndarray, middles: int = MIDDLES, sweeps: int = SWEEPS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(way, repeats): the fit, rounded so that no length is used more often than it occurs, then topped up in the ways' order;
    then ways of the residuals, packed greedily."""
    ways = combinations(counts, middles)
    x = fit_counts(counts, ways, sweeps)
    free = counts.astype(np.int64).copy()
    used = np.zeros(len(ways), np.int64)
    for goal in (np.floor(x + 0.5), np.full(len(ways), np.inf)):
        for k in np.argsort(-x, kind="stable").tolist():
            n = int(min(goal[k], *(free[a] // t for a, t in ways[k])))
            if n > 0:
                used[k] += n
                for a, t in ways[k]:
                    free[a] -= n * t
    return [(way, int(n)) for way, n in zip(ways, used, strict=True) if n] + greedy(free)


def greedy(free: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(way, repeats) of whole windows filled with the largest length that is left, then always the largest that still fits. A
    length whose windows do not come out even is passed over. Takes what it uses out of `free`."""
    window, out = len(free), []
    for top in np.flatnonzero(free)[::-1].tolist():
        while free[top]:
            left, room, at, way = free, window, top, {}
            while room and at:
                if times := min(room // at, int(left[at])):
                    way[at] = times
                    room -= at * times
                # The largest length up to both what is left of the window and the one before this.
                below = np.flatnonzero(left[1 : min(room, at - 1) + 1])
                at = int(below[-1]) + 1 if len(below) else 0
            if room:
                break
            n = min(int(free[a]) // t for a, t in way.items())
            for a, t in way.items():
                free[a] -= n * t
            out.append((tuple(way.items()), n))
    return out


class Slots:
    """Where the rest of rank k among those of its length goes."""

    def __init__(self, chosen: list[tuple[tuple[tuple[int, int], ...], int]], first: int):
        rows, taken, sequence = [], {}, first
        for way, n in chosen:
            offset = 0
            for length, times in way:
                for _ in range(times):
                    low = taken.get(length, 0)
                    rows.append((length, low, sequence, offset))
                    taken[length] = low + n
                    offset += length
            sequence += n
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.key = (table[:, 0] << 44) + table[:, 1]
        self.low, self.sequence, self.offset = table[:, 1], table[:, 2], table[:, 3]
        self.taken = taken
        self.after = sequence


def pieces_of(n: int, window: int, full_first: int, slot: tuple[int, int] | None, place: int, whole: int, ends: list[int], rest_first: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of a document of n tokens. slot: (sequence, offset) of its rest; else the rest lies
    at `place` of the residual row, whose first `whole` tokens fill sequences, and whose tail is cut at `ends`."""
    out = [(k * window, window, full_first + k, 0) for k in range(n // window)]
    start = n // window * window
    if start == n:
        return out
    if slot:
        return [*out, (start, n - start, *slot)]
    at, end = place, place + n - start
    while at < end:
        if at < whole:
            sequence, begin = rest_first + at // window, at // window * window
            stop = min(end, begin + window)
        else:
            j = next(j for j, e in enumerate(ends) if at < e)
            sequence, begin = rest_first + whole // window + j, ends[j - 1] if j else whole
            stop = min(end, ends[j])
        out.append((start, stop - at, sequence, at - begin))
        start += stop - at
        at = stop
    return out


def tail_ends(whole: int, tail: int) -> list[int]:
    """Ends of the tail's sequences, whose lengths are falling powers of two."""
    ends, at = [], whole
    for bit in reversed(range(tail.bit_length())):
        if tail >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def pack(tokens: DataFrame, width: int = 4, window: int = WINDOW, salts: int | None = None, middles: int = MIDDLES, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of each piece, from (doc_id long, ids binary: little-endian
    unsigned numbers of `width` bytes, 2 or 4); the pieces' ids have 4 bytes. Each id lies in one piece; the pieces of a sequence lie end to end from 0; a sequence has
    `window` tokens or a power of two. Rows without ids give no pieces; null and repeated doc_ids are packed row by row. A
    sequence_id is unique, not dense in row order."""
    spark = tokens.sparkSession
    held = checkpoint(tokens.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("ids").alias("packed")))
    rows = held.where("length(packed) > 0").select("uid", "doc_id", F.expr(f"length(packed) div {width}").alias("n"), "packed")
    # Dealt anew, so that such light rows make few files.
    sizes = checkpoint(rows.select("uid", F.expr(f"n div {window}").alias("full"), (F.col("n") % window).alias("rest")).repartition(F.col("uid")))
    # A group has a hot length's share of 2**24 rows at most, whatever the corpus.
    salts = salts or max(SALTS, sizes.count() // SALT_ROWS)
    light = sizes.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    groups = light.groupBy("rest", "salt").agg(F.count("*").alias("k"), F.sum("full").alias("fulls")).toArrow().to_pandas()
    groups = groups.sort_values(["rest", "salt"]).reset_index(drop=True)
    counts = np.zeros(window, np.int64)
    np.add.at(counts, groups["rest"].to_numpy(np.int64), groups["k"].to_numpy(np.int64))
    counts[0] = 0
    n_full = int(groups["fulls"].sum()) if len(groups) else 0
    slots = Slots(plan(counts, middles, sweeps), n_full)
    # Of each group of one rest and salt: its first rank, first whole window, and first place among the residuals.
    if len(groups):
        groups["rank0"] = groups.groupby("rest")["k"].cumsum() - groups["k"]
        groups["full0"] = groups["fulls"].cumsum() - groups["fulls"]
        taken = groups["rest"].map(slots.taken).fillna(0).astype(np.int64)
        over = np.clip(groups["rank0"] + groups["k"] - np.maximum(taken, groups["rank0"]), 0, None) * groups["rest"]
        groups["place0"] = over.cumsum() - over
        total = int(over.sum())
    else:
        groups = groups.assign(rank0=0, full0=0, place0=0)
        total = 0
    whole = total // window * window
    ends = tail_ends(whole, total - whole)
    # At most window x salts rows: 131,072 up to 10**9 documents.
    starts = spark.createDataFrame(
        [tuple(map(int, r)) for r in groups[["rest", "salt", "rank0", "full0", "place0"]].itertuples(index=False)],
        "rest long, salt int, rank0 long, full0 long, place0 long",
    )
    by = Window.partitionBy("rest", "salt").orderBy("uid")
    ranked = light.select("uid", "full", "rest", "salt", (F.row_number().over(by) - 1).cast("long").alias("k"), (F.sum("full").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("before"))
    placed = ranked.join(F.broadcast(starts) if len(groups) <= BROADCAST_ROWS else starts, ["rest", "salt"]).select(
        F.col("uid").alias("plan_uid"), (F.col("rank0") + F.col("k")).alias("rank"), "rank0", (F.col("full0") + F.col("before")).alias("full_first"), "place0"
    )
    joined = rows.join(placed, rows["uid"] == placed["plan_uid"]).select("doc_id", "n", "packed", "rank", "rank0", "full_first", "place0")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rest = batch["n"].to_numpy() % window
            rank = batch["rank"].to_numpy()
            taken = np.array([slots.taken.get(r, 0) for r in rest.tolist()], np.int64)
            at = np.searchsorted(slots.key, (rest << 44) + rank, side="right") - 1
            # A residual's place: those of its group before it are the ranks from the first free one on.
            place = batch["place0"].to_numpy() + (rank - np.maximum(batch["rank0"].to_numpy(), taken)) * rest
            out: list[tuple] = []
            size = 0
            for doc, n, packed, k, t, j, first, p in zip(batch["doc_id"], batch["n"].tolist(), batch["packed"], rank.tolist(), taken.tolist(), at.tolist(), batch["full_first"].tolist(), place.tolist(), strict=True):
                ids = np.frombuffer(packed, f"<u{width}").astype("<u4", copy=False)
                slot = (int(slots.sequence[j] + k - slots.low[j]), int(slots.offset[j])) if k < t else None
                for start, length, sequence, offset in pieces_of(n, window, first, slot, p, whole, ends, slots.after):
                    out.append((doc, start, length, ids[start : start + length].tobytes(), n, sequence, offset))
                size += n
                if size > 1 << 21:
                    yield _frame(out)
                    out, size = [], 0
            yield _frame(out)

    return joined.mapInPandas(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    return frame.astype({"doc_id": "Int64"})


@lru_cache(maxsize=2)
def _encoder(path: str, ranks_path: str | None, pattern: str | None):
    if ranks_path is None:
        tokenizer = _tokenizer(path)
        return lambda texts: [np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    added = {t.content: i for i, t in _tokenizer(path).get_added_tokens_decoder().items()}
    same = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens=added)
    return lambda texts: [same.encode_to_numpy(t, allowed_special="all") for t in texts]


keeps("packing", _encoder.cache_clear)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def check_ranks(path: str, ranks_path: str) -> None:
    """An error unless a rank file and a tokenizer file are the same byte-level BPE: the vocabularies are equal, merges make tokens
    of rising rank, nothing is normalized or added, and added tokens are cut out as they stand."""
    char, tokenizer = byte_chars(), _tokenizer(path)
    ranks = {"".join(char[b] for b in token): rank for token, rank in read_ranks(ranks_path).items()}
    if ranks != tokenizer.get_vocab(with_added_tokens=False):
        raise ValueError(f"{ranks_path} is not the vocabulary of {path}")
    whole = json.loads(tokenizer.to_str())
    made = [ranks["".join(m if isinstance(m, list) else m.split(" "))] for m in whole["model"]["merges"]]
    step = whole["pre_tokenizer"] or {}
    plain = whole["normalizer"] is None and whole["post_processor"] is None and step.get("type") == "ByteLevel" and step["use_regex"] and not step["add_prefix_space"]
    bare = not any(t[k] for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (plain and bare and made == sorted(set(made))):
        raise ValueError(f"{path} does more than merge bytes by rank")


def token_column(text: Column, path: str, end_id: int = END_ID, width: int = 4, ranks_path: str | None = None, pattern: str | None = None) -> Column:
    """Column of binary: ids, little-endian of `width` bytes, of each whole text (null: empty) by a tokenizer file, and end_id. Added
    tokens that a text spells out, as <|endoftext|>, get their own ids, as the tokenizers library gives them. With a rank file of the
    same BPE (it is compared) and its pattern, the same ids are found by the faster tiktoken library. An id that does not fit the
    width is an error."""
    if ranks_path is not None:
        check_ranks(path, ranks_path)

    @arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoder(path, ranks_path, pattern)
        end = np.array([end_id], f"<u{width}").tobytes()

        def packed(x: np.ndarray) -> bytes:
            if len(x) and x.max() >= 1 << 8 * width:
                raise ValueError(f"an id does not fit {width} bytes")
            return x.astype(f"<u{width}").tobytes() + end

        for batch in frugal(batches, "packing"):
            yield pa.array([packed(x) for run in steps(strings(batch)) for x in encode(run)], pa.binary())

    # So that no plan asks for it twice.
    return ids.asNondeterministic()(text)
