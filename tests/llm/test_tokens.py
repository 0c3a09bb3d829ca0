"""Encoding, packing and media files: exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from viastrata.llm import bpe, ogg, packing, queries

from .conftest import ODD

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("exact", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_decoding_reverses_the_table_of_bytes():
    assert bpe.BYTE_OF[[ord(c) for c in bpe.byte_chars()]].tolist() == list(range(256))
    coder, ranks = bpe.coder(PATH, PATTERN), bpe.read_ranks(PATH)
    assert all(coder.decode_bytes([rank]) == token for token, rank in ranks.items())


def test_odd_texts_as_tiktoken(spark, docs, exact):
    rows = docs(list(enumerate(ODD)) + [(0, "again")])
    got = rows.select("doc_id", "text", bpe.round_trip(F.col("text"), PATH, PATTERN).alias("d")).collect()
    library = bpe.coder(PATH, PATTERN).tokenizer
    for r in got:
        places = np.array(library.encode(r["text"] or "", add_special_tokens=False).offsets, "<u4")
        assert r["d"]["offsets_crc32"] == zlib.crc32(places.tobytes())
        ids = exact.encode_ordinary(r["text"] or "")
        assert r["d"]["n_tokens"] == len(ids)
        assert r["d"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["d"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert len(got) == len(ODD) + 1
    assert rows.limit(0).select(bpe.round_trip(F.col("text"), PATH, PATTERN).alias("d")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aé.0  \x1c\x85\x00s"), st.characters(exclude_categories=["Cs"]))))
def test_any_text_as_tiktoken(text):
    coder = bpe.coder(PATH, PATTERN)
    exact = tiktoken.Encoding("exact2", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}) if not hasattr(coder, "exact") else coder.exact
    coder.exact = exact
    ids = coder.encode_batch([text])[0]
    assert ids.tolist() == exact.encode_ordinary(text)
    assert coder.decode(ids) == text


def test_every_character_as_tiktoken(exact):
    coder = bpe.coder(PATH, PATTERN)
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}b 1{c} {c}{c}'s  {c}\n" for c in every]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        assert all(a.tolist() == b for a, b in zip(coder.encode_batch(part), exact.encode_ordinary_batch(part), strict=True))


def test_texts_without_blanks_are_not_remembered(exact):
    coder = bpe.ByteBPE(PATH, PATTERN)
    rng = np.random.default_rng(3)
    for text in ("".join(map(chr, rng.integers(0x4E00, 0x9FA0, 150_000))), "".join(map(chr, rng.integers(33, 127, 1_000_000)))):
        ids = coder.encode_batch([text])[0]
        assert ids.tolist() == exact.encode_ordinary(text) and coder.decode(ids) == text
        assert not coder.memo and coder.held == 0
    small = bpe.ByteBPE(PATH, PATTERN, memo_bytes=20_000)
    for k in range(30):
        small.encode_batch([" ".join(f"w{k}x{j}" for j in range(40))])
        assert small.held <= 20_000 + 41 * 300


def test_memo_is_bounded(exact):
    coder = bpe.ByteBPE(PATH, PATTERN, memo_pieces=50)
    for k in range(20):
        text = " ".join(f"w{k}x{j}" for j in range(40))
        assert coder.encode_batch([text])[0].tolist() == exact.encode_ordinary(text)
        assert len(coder.memo) <= 130


def test_spans_cover_the_text_and_split_characters_decode(spark):
    coder = bpe.coder(PATH, PATTERN)
    text = "Höhe 日本 😀 done"
    spans = coder.spans(text)
    for t in (text, "", "x", "\U00010348 a", "日本語の文 " * 9):
        got = coder.tokenizer.encode(t, add_special_tokens=False)
        assert coder.spans(t) == [(i, *s) for i, s in zip(got.ids, got.offsets, strict=True)]
    assert [s[0] for s in spans] == coder.encode_batch([text])[0].tolist()
    assert spans[0][1] == 0 and spans[-1][2] == len(text) and all(a[1] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    ids = [s[0] for s in spans]
    assert "".join(coder.decode_stream(iter(ids))) == text
    split = coder.encode_batch(["\U00010348"])[0]
    assert len(split) > 1 and "�" in coder.decode(split[:1]) and coder.decode(split) == "\U00010348"
    frame = spark.createDataFrame([(text,), (None,)], "text string")
    back = frame.select(bpe.decode(bpe.encode(F.col("text"), PATH, PATTERN), PATH, PATTERN).alias("b"), bpe.encode_spans(F.col("text"), PATH, PATTERN).alias("s")).collect()
    assert bytes(back[0]["b"]).decode() == text and [x["id"] for x in back[0]["s"]] == ids and (bytes(back[1]["b"]), back[1]["s"]) == (b"", [])


def whole(pieces, window):
    """Checks pieces against the rules of packing; returns tokens of each sequence."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window and (at == window or at & (at - 1) == 0)
    return by_doc, by_sequence


@pytest.mark.parametrize(("window", "width"), [(64, 4), (64, 2), (2048, 2)])
def test_packing_is_exact(spark, window, width):
    rng = np.random.default_rng(window)
    lengths = [*rng.integers(1, 3 * window, 150).tolist(), *[window // 3] * 120, window, 2 * window, 1, 1]
    rows = [(k, rng.integers(0, 50_000, n).astype(f"<u{width}").tobytes()) for k, n in enumerate(lengths)]
    frame = spark.createDataFrame([*rows, (900, None), (901, b"")], "doc_id long, ids binary")
    pieces = packing.pack(frame, width=width, window=window, salts=4).collect()
    by_doc, _ = whole(pieces, window)
    assert len(by_doc) == len(lengths)
    for (doc, n), ps in by_doc.items():
        ps.sort(key=lambda p: p["start"])
        assert n == lengths[doc]
        assert b"".join(bytes(p["ids"]) for p in ps) == np.frombuffer(rows[doc][1], f"<u{width}").astype("<u4").tobytes()


def test_packing_of_nothing_repeats_and_nulls(spark):
    schema = "doc_id long, ids binary"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    ids = np.arange(5, dtype="<u4").tobytes()
    pieces = packing.pack(spark.createDataFrame([(1, ids), (1, ids), (None, ids)], schema), window=64).collect()
    assert sum(p["length"] for p in pieces) == 15
    assert sorted(str(p["doc_id"]) for p in pieces if p["start"] == 0) == ["1", "1", "None"]


def test_counts_are_never_overdrawn():
    rng = np.random.default_rng(1)
    for _ in range(5):
        counts = rng.poisson(3, 128) * (rng.random(128) < 0.7)
        counts[0] = 0
        used = np.zeros(128, int)
        for way, n in packing.plan(counts):
            assert sum(a * t for a, t in way) == 128 and n > 0
            for a, t in way:
                used[a] += n * t
        assert (used <= counts).all()


def test_residuals_are_packed_greedily():
    free = np.zeros(64, np.int64)
    free[[40, 15, 9, 7]] = [3, 5, 3, 2]
    # The largest first: 40 + 15 + 9, three times; 15 and 7 come out uneven.
    assert packing.greedy(free) == [(((40, 1), (15, 1), (9, 1)), 3)]
    assert free[[40, 15, 9, 7]].tolist() == [0, 2, 0, 2]
    free[[2, 4]] = [9, 20]
    got = packing.greedy(free)
    assert all(sum(a * t for a, t in way) == 64 for way, _ in got) and got and (free >= 0).all()


def test_least_squares_finds_an_exact_solution():
    counts = np.zeros(64, int)
    counts[[10, 54, 20, 24]] = [7, 7, 10, 5]
    ways = [((54, 1), (10, 1)), ((24, 1), (20, 2))]
    assert np.allclose(packing.fit_counts(counts, ways), [7, 5])


def test_packed_documents(spark, docs):
    rows = docs([*enumerate(ODD), (3, "a")])
    pieces = queries.packed(rows).collect()
    whole(pieces, 2048)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(ODD)}
    assert 50256 in ids[ODD.index("<|endoftext|>")]
    for p in pieces:
        cut = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert (zlib.crc32(cut.tobytes()), len(ids[p["doc_id"]])) == (p["ids_crc32"], p["doc_tokens"])
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values())) + len(ids[3])


def test_same_ids_by_either_library():
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    library, fast = Tokenizer.from_file(path), packing._encoder(path, ranks, PATTERN)
    slow = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    texts = [t or "" for t in ODD] + ["a<|endoftext|>b", "  <|endoftext|> \n<|endoftext|><|endoftext", "it<|endoftext|>'s"]
    texts += [f"a{chr(c)}b 1{chr(c)} {chr(c)}'s  {chr(c)}" for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF]
    assert all(np.array_equal(a, b) for a, b in zip(slow(texts), fast(texts), strict=True))
    with pytest.raises(ValueError, match="not the vocabulary"):
        packing.check_ranks(path, PATH)
    packing.check_ranks(path, ranks)


def slow_crc(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_page_checksum():
    for data in (b"", b"\0", b"OggS and more", bytes(range(256))):
        assert ogg.page_crc(data) == slow_crc(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=6))
def test_packets_of_any_size(sizes):
    packets = [(bytes([k % 251]) * n, k) for k, n in enumerate(sizes)]
    pages = ogg.write_pages([(b"head", 0), *packets], 7)
    (stream,) = ogg.demultiplex(b"".join(pages)).values()
    assert stream.packets == [b"head", *(p for p, _ in packets)] and stream.first and stream.last


def test_streams_are_told_apart():
    a, b = ogg.write_pages([(b"a", 0), (b"x" * 90_000, 800), (b"y", 900)], 1), ogg.write_pages([(b"b", 0), (b"z" * 70_000, 16_000)], 2)
    mixed = b"".join(p for pair in zip(a, b, strict=False) for p in pair) + b"".join(a[len(b) :]) + b"".join(b[len(a) :])
    streams = ogg.demultiplex(mixed)
    assert list(streams) == [1, 2] and streams[1].packets[1] == b"x" * 90_000 and streams[2].packets[1] == b"z" * 70_000
    assert streams[2].timestamps(8000)[-1] == 2.0


def test_levels_are_a_stream_of_their_own():
    rng = np.random.default_rng(4)
    for n in (0, 1, 576, ogg.LEVEL_SAMPLES, 3 * ogg.LEVEL_SAMPLES + 5, 400_000):
        data = rng.integers(3, 200, n, dtype=np.uint8).tobytes()
        media = ogg.mux_samples(data, 0xFFFFFFFF)
        streams = ogg.demultiplex(media)
        assert list(streams) == [0xFFFFFFFF, 0] and streams[0].first and streams[0].last
        parts = [data[k : k + ogg.LEVEL_SAMPLES] for k in range(0, n, ogg.LEVEL_SAMPLES)]
        assert [ogg.LEVEL.unpack(x) for x in streams[0].packets[1:]] == [(min(p), max(p), sum(p)) for p in parts]
        samples, about = ogg.read_samples(media)
        assert samples == data and about["streams"] == 2 and (about["least"], about["most"]) == (min(data, default=None), max(data, default=None))
        if n > ogg.LEVEL_SAMPLES:
            # Pages of both streams take turns.
            order = [p.serial for p in ogg.read_pages(media)]
            assert order != sorted(order) and order != sorted(order, reverse=True)
    wrong = ogg.write_pages([(ogg.HEAD.pack(ogg.LEVELS, 8000, 1, 8, ogg.LEVEL.size), 0), (ogg.LEVEL.pack(1, 2, 3), 5)], 9)
    with pytest.raises(ogg.OggError, match="levels"):
        ogg.read_samples(b"".join(ogg.write_pages([(ogg.HEAD.pack(ogg.NAME, 8000, 1, 8, 576), 0), (b"abcde", 5)], 1) + wrong))


def test_damage_is_found():
    media = ogg.mux_samples(bytes(range(256)) * 300, 3)
    samples, about = ogg.read_samples(media)
    assert samples == bytes(range(256)) * 300 and about["seconds"] == len(samples) / 8000 and about["packets"] == -(-len(samples) // 576)
    for at in (30, 500, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read_samples(bytes(bad))
    for cut in (media[:-10], media[5:], b"Ogg", media + b"x"):
        with pytest.raises(ogg.OggError):
            ogg.read_samples(cut)


def test_media_columns(spark, docs):
    frame = spark.createDataFrame([(b"abc" * 500,), (b"",), (None,)], "p binary").withColumn("m", ogg.media(F.col("p")))
    told = frame.select("p", ogg.describe(F.col("m")).alias("d")).collect()
    assert bytes(told[0]["d"]["samples"]) == b"abc" * 500 and told[0]["d"]["error"] is None
    broken = spark.createDataFrame([(b"nothing",), (None,)], "m binary").select(ogg.describe(F.col("m")).alias("d")).collect()
    assert broken[0]["d"]["samples"] is None and broken[0]["d"]["error"] and broken[1]["d"]["samples"] is None
    got = docs([*enumerate(ODD), (0, "a")]).select("doc_id", "text", ogg.stored(F.col("text")).alias("m")).select("doc_id", "text", "m.*").collect()
    for r in got:
        data = (r["text"] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_bytes"] > len(payload)
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["text"] == "a"}) == 1
