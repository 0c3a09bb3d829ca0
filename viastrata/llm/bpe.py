"""Byte-level BPE: the tokenizers library over Arrow batches, with spans. Each byte has a character that stands for it; the
tokens' strings are such characters. Decoding reverses the table, for each token once, character by character, and joins the ids'
bytes; those of a character that is split between ids meet again there."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .common import arrow_udf, frugal, keeps, lists, steps, strings, structs

#: Pieces whose ids a worker remembers, their bytes in all (ids, characters, and what Python adds), and the longest such piece.
MEMO_PIECES, MEMO_BYTES, MEMO_CHARS = 600_000, 128 << 20, 64
#: New pieces that go to the library in one call.
CALL_PIECES = 100_000


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: Of each character of the table its byte; the others are no token's.
BYTE_OF = np.zeros(512, np.uint8)
BYTE_OF[[ord(c) for c in byte_chars()]] = range(256)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def build_tokenizer(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A tokenizer that merges as a rank table says: of all adjacent pairs whose joined bytes are a token, the one of
    lowest rank first. So each way to halve a token is a merge of its rank; a piece that is a token needs none."""
    char = byte_chars()
    name = {token: "".join(char[b] for b in token) for token in ranks}
    merges = [
        (name[token[:i]], name[token[i:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


class ByteBPE:
    """Encodes and decodes. A text is cut before each lone space between other characters, where no match of the pattern
    runs on; the pieces a worker has not met yet go to the library together, and the ids of short ones are remembered. A text
    without such spaces, as Chinese or base64 may be, is one long piece, which is not."""

    def __init__(self, path: str, pattern: str, memo_pieces: int = MEMO_PIECES, memo_bytes: int = MEMO_BYTES):
        ranks = read_ranks(path)
        self.tokenizer = build_tokenizer(ranks, pattern)
        self.token_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in self.tokenizer.get_vocab().items():
            self.token_bytes[rank] = BYTE_OF[[ord(c) for c in token]].tobytes()
        self.token_sizes = np.array([len(t) for t in self.token_bytes], np.int64)
        self.memo: dict[str, bytes] = {}
        self.held = 0
        self.memo_pieces, self.memo_bytes = memo_pieces, memo_bytes

    @staticmethod
    def pieces(text: str) -> list[str]:
        if "\0" in text or re.search(r"\s | \s", text):
            return re.split(r"(?<=\S)(?= \S)", text)
        return text.replace(" ", "\0 ").split("\0")

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.pieces(text) for text in texts]
        if len(self.memo) > self.memo_pieces or self.held > self.memo_bytes:
            self.memo = {piece: self.memo[piece] for pieces in cut for piece in pieces if piece in self.memo}
            self.held = sum(map(_size, self.memo, self.memo.values()))
        memo = self.memo
        new = list({piece for pieces in cut for piece in pieces if piece not in memo})
        long: list[str] = []
        for start in range(0, len(new), CALL_PIECES):
            part = new[start : start + CALL_PIECES]
            for piece, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = memo[piece] = np.array(got.ids, dtype="<u4").tobytes()
                if len(piece) > MEMO_CHARS:
                    long.append(piece)
                else:
                    self.held += _size(piece, ids)
        done = [np.frombuffer(b"".join(map(memo.__getitem__, pieces)), dtype="<u4") for pieces in cut]
        for piece in long:
            del memo[piece]
        return done

    def offsets(self, data: bytes, ids: np.ndarray) -> np.ndarray:
        """(start, end) of each token of a text's UTF-8, as characters of the text; tokens that share a character share its place."""
        sizes = self.token_sizes[ids]
        ends = np.cumsum(sizes)
        if data.isascii():
            return np.stack([ends - sizes, ends], axis=1)
        # How many characters have begun by each byte; all bytes but the 10xxxxxx ones begin one.
        begun = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int32)
        return np.stack([begun[ends - sizes] - 1, begun[ends - 1]], axis=1)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token."""
        ids = self.encode_batch([text])[0]
        return [(i, a, b) for i, (a, b) in zip(ids.tolist(), self.offsets(text.encode(), ids).tolist(), strict=True)]

    def decode_bytes(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """A character cut at either end of the ids becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids: Iterator[int]) -> Iterator[str]:
        """What each id adds to the text; bytes of a split character wait for the rest."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.decode_bytes([i]))
        yield decoder.decode(b"", final=True)


def _size(piece: str, ids: bytes) -> int:
    return 200 + 4 * len(piece) + len(ids)


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> ByteBPE:
    # Spark runs a worker for each core; threads of the library's own would only wait for these.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBPE(path, pattern)


keeps("bpe", coder.cache_clear)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Column of array<int>: the ids of each whole text, without special tokens. Null and empty texts: no ids."""

    @arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        for batch in frugal(batches, "bpe"):
            yield lists([x for texts in steps(strings(batch)) for x in bpe.encode_batch(texts)])

    return ids(text)


def encode_spans(text: Column, path: str, pattern: str) -> Column:
    """Column of array<struct<id,start,end>>: tokens with the characters that they cover. Null and empty texts: none."""

    kind = pa.list_(pa.struct([(name, pa.int32()) for name in ("id", "start", "end")]))

    @arrow_udf("array<struct<id:int,start:int,end:int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        for batch in frugal(batches, "bpe"):
            yield pa.array([[{"id": i, "start": a, "end": b} for i, a, b in bpe.spans(t)] for t in strings(batch)], kind)

    return spans(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Column of binary: the bytes that the ids stand for. Null: none. An id outside the table raises IndexError."""

    @arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        for batch in frugal(batches, "bpe"):
            yield pa.array([bpe.decode_bytes(x.as_py() or []) for x in batch], pa.binary())

    return text(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Column of struct<n_tokens,ids_sha256,decoded_sha256,offsets_crc32>: digests of the ids, encoded from the text, of the bytes
    decoded from these ids, and of the tokens' offsets (CRC-32 of starts and ends in turn, unsigned little-endian 32-bit), without
    moving the ids between Python and the JVM. Null and empty texts: of no ids."""

    @arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_crc32 long")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        for batch in frugal(batches, "bpe"):
            rows = []
            for texts in steps(strings(batch)):
                for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
                    listed = ids.tolist()
                    spelt = ",".join(map(str, listed)).encode()
                    at = zlib.crc32(bpe.offsets(text.encode("utf-8", "replace"), ids).astype("<u4").tobytes())
                    rows.append((len(listed), hashlib.sha256(spelt).hexdigest(), hashlib.sha256(bpe.decode_bytes(listed)).hexdigest(), at))
            n, spelt_digests, decoded_digests, places = ([r[k] for r in rows] for k in range(4))
            yield structs(
                n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(spelt_digests, pa.string()), decoded_sha256=pa.array(decoded_digests, pa.string()), offsets_crc32=pa.array(places, pa.int64())
            )

    return digests(text)
