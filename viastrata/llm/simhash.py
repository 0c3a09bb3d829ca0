"""SimHash near-duplicates: fingerprints of word shingles, BK-trees over shards of them, components of the links.

Fingerprints that differ in at most r bits agree in two at least of r + 2 blocks of bits, so shards are the fingerprints that agree
in a pair of blocks: for r = 3 ten copies of each, whatever the corpus, dealt by 25 or 26 bits. Each task gets whole shards, grows a BK-tree of each (children keyed by their Hamming distance to the parent) and
looks up the members, following only edges within r of the distance to the node. Of the links found in a task it sends on a
spanning forest, so a dense shard gives no more links than members. Shards above a bound are cut into pieces, and each pair
of pieces makes a task's group: one piece is the tree, the other looks up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components_by_rounds
from .common import arrow_udf, checkpoint, frugal, strings

#: Words of a shingle; bits that linked fingerprints differ in at most; members of a shard's piece.
WORDS, RADIUS, PIECE = 3, 3, 2048

_STEP = 1 << 16


def fingerprint_bits(words: list[bytes], n: int = WORDS) -> int:
    """Bits that are set in over half of the XXH64 (seed 42) hashes of the n-word shingles; 0 without words."""
    import xxhash

    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else iter([b" ".join(words)])
    total = max(len(words) - n + 1, 1)
    votes = np.zeros(64, np.int64)
    hashes = np.frombuffer(b"".join(map(_digest(xxhash), grams)), np.uint8).reshape(-1, 8)
    for at in range(0, len(hashes), _STEP):
        votes += np.unpackbits(hashes[at : at + _STEP], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def _digest(xxhash):
    digest = xxhash.xxh64_digest
    return lambda gram: digest(gram, 42)


def fingerprint(text: Column, n: int = WORDS) -> Column:
    """Column of long: the fingerprint of each whole text as a signed number. A-Z count as a-z; words are runs of other
    characters than space and \\t to \\r. Null, empty and blank texts: 0."""

    @arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in frugal(batches):
            # bytes.split() cuts at just these six characters, bytes.lower() changes just A-Z.
            found = [fingerprint_bits(t.encode("utf-8", "replace").lower().split(), n) for t in strings(batch)]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return prints(text)


class BKForest:
    """BK-trees of many shards at once, grown level by level. shard, code: of each member; members of a shard adjoin."""

    def __init__(self, shard: np.ndarray, code: np.ndarray):
        self.code = code
        n = len(code)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.root_of = dict(zip(shard[first].tolist(), np.flatnonzero(first).tolist(), strict=True))
        node = np.flatnonzero(first)[np.cumsum(first) - 1]
        left = np.flatnonzero(~first)
        node = node[left]
        while len(left):
            d = np.bitwise_count(code[left] ^ code[node]).astype(np.int64)
            slot = node * 65 + d
            order = np.argsort(slot, kind="stable")
            left, slot, node, d = left[order], slot[order], node[order], d[order]
            new = np.r_[True, slot[1:] != slot[:-1]]
            self.parent[left[new]], self.edge[left[new]] = node[new], d[new]
            node = left[new][np.cumsum(new) - 1][~new]
            left = left[~new]
        children = np.flatnonzero(self.parent >= 0)
        slot = self.parent[children] * 65 + self.edge[children]
        order = np.argsort(slot)
        self.children, self.slots = children[order], slot[order]

    def search(self, roots: np.ndarray, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(lookup, member) of each pair within the radius. roots: where each lookup starts."""
        for at in range(0, len(codes), 1024):
            who, node = np.arange(at, min(at + 1024, len(codes))), roots[at : at + 1024]
            while len(who):
                d = np.bitwise_count(codes[who] ^ self.code[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield who[near], node[near]
                low = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), side="right")
                fan = high - low
                who = np.repeat(who, fan)
                node = self.children[np.repeat(low - np.r_[0, np.cumsum(fan)[:-1]], fan) + np.arange(fan.sum())]


def forest_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) for all members of the components of the links a - b, without the least themselves."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (x, y):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (before == root).all():
            break
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 blocks of bits."""
    cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
    return [(a, b - a) for a, b in pairwise(cuts)]


def links(codes: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """(code, other) of distinct fingerprints `code` (long): links within the radius, enough of them to join what they join."""
    masks = [((1 << w) - 1) << a for a, w in _blocks(radius)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    parts = [F.col("code").bitwiseAND(F.lit(signed(a | b))) for a, b in combinations(masks, 2)]
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), part.alias("part")) for k, part in enumerate(parts)))
    dealt = codes.select("code", F.explode(blocks).alias("s")).select("code", "s.block", "s.part")
    sizes = dealt.groupBy("block", "part").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sized = dealt.join(sizes.withColumn("k", F.ceil(F.col("n") / piece)), ["block", "part"])
    own = F.pmod(F.xxhash64("code"), F.col("k"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), own.alias("own")))
    grouped = sized.select("code", "block", "part", F.explode(pairs).alias("g")).select("code", "block", "part", "g.i", "g.j", "g.own")
    keys = ["block", "part", "i", "j"]
    found = grouped.repartition(*keys).sortWithinPartitions(*keys, "code").mapInPandas(_shard_links(radius), "code long, other long")
    return found.distinct()


def _shard_links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if len(batch) == 0:
                continue
            # All but the batch's last shard is whole.
            last = batch.iloc[-1][["block", "part", "i", "j"]].tolist()
            open_ = (batch[["block", "part", "i", "j"]] == last).all(axis=1).to_numpy()
            cut = len(batch) - int(open_[::-1].argmin()) if not open_.all() else 0
            held.append(batch.iloc[:cut])
            size += cut
            if cut and size >= _STEP:
                yield from _linked(pd.concat(held), radius)
                held, size = [], 0
            held.append(batch.iloc[cut:])
        if held:
            yield from _linked(pd.concat(held), radius)

    return run


def _linked(rows: pd.DataFrame, radius: int) -> Iterator[pd.DataFrame]:
    if len(rows) < 2:
        return
    code = rows["code"].to_numpy(np.int64)
    key = rows[["block", "part", "i", "j"]].to_numpy()
    shard = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
    # The tree holds piece i; where two pieces meet, only piece j looks up.
    tree = rows["own"].to_numpy() == key[:, 2]
    asks = (rows["own"].to_numpy() == key[:, 3]) & np.isin(shard, shard[tree])
    forest = BKForest(shard[tree], code[tree].view(np.uint64))
    asked = code[asks].view(np.uint64)
    roots = np.array([forest.root_of[s] for s in shard[asks].tolist()], np.int64)
    a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for who, node in forest.search(roots, asked, radius):
        x, y = asked[who], forest.code[node]
        other = x != y
        waiting.append((x[other], y[other]))
        size += int(other.sum())
        if size > 1 << 20:
            a, b = forest_links(np.concatenate([a, *(w[0] for w in waiting)]), np.concatenate([b, *(w[1] for w in waiting)]))
            waiting, size = [], 0
    if waiting:
        a, b = forest_links(np.concatenate([a, *(w[0] for w in waiting)]), np.concatenate([b, *(w[1] for w in waiting)]))
    if len(a):
        yield pd.DataFrame({"code": a.view(np.int64), "other": b.view(np.int64)})


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each node's component, for the nodes of the links."""
    links_ = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    loops = links_.select(F.explode(F.array("u", "v")).alias("u")).distinct().select("u", F.col("u").alias("v"))
    found = components_by_rounds(checkpoint(links_.unionByName(loops)), [])
    return found.select(F.col("node_id").alias("node"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """(doc_id, code, component_id) for each row of (doc_id, text): the fingerprint, and the least doc_id among the documents
    that links of at most `radius` differing bits reach. Equal fingerprints count once, so copies are never paired. Rows
    without words share fingerprint 0 and link as others do. A null doc_id gives a row, and its component the least id that is not
    null, or null; repeated rows give rows of their own."""
    rows = checkpoint(docs.select("doc_id", fingerprint(F.col("text"), words).alias("code")))
    codes = checkpoint(rows.groupBy("code").agg(F.min("doc_id").alias("least")))
    tied = components(links(codes.select("code"), radius, piece), "code", "other")
    rooted = checkpoint(codes.join(tied.withColumnRenamed("node", "code"), "code", "left").select("code", F.coalesce("root", "code").alias("root"), "least"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select("code", "component_id")
    return rows.join(named, "code").select("doc_id", "code", "component_id")
