"""Line and near-duplicate removal against brute force, and the pipeline's stages."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from viastrata.llm import line_dedup, queries, simhash

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def slow_print(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{doc_id: least doc_id in reach} of (doc_id, fingerprint)."""
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in prints}


def test_simhash_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], slow_print(r["text"])) for r in docs]
    want = slow_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", want[d]) for d, p in prints}
    assert len(set(want.values())) < len(want)


def test_simhash_of_odd_rows(spark, docs):
    rows = [*enumerate(ODD), (100, "a"), (100, "a"), (None, "only here with a null id"), (None, "a")]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    blank = {r["component_id"] for r in got if r["code"] == 0}
    assert blank == {0}
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 100)} == {3}
    assert [r["component_id"] for r in got if r["doc_id"] is None and r["code"] == np.uint64(slow_print(rows[-2][1])).astype(np.int64)] == [None]
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < len(ODD):
            assert int(r["code"]) & (1 << 64) - 1 == slow_print(ODD[r["doc_id"]])
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("piece", [4, 10_000])
def test_links_of_dense_codes(spark, piece):
    rng = np.random.default_rng(piece)
    centre = int(rng.integers(0, 1 << 62))
    codes = {centre}
    for _ in range(150):
        c = centre
        for b in rng.integers(0, 64, rng.integers(1, 7)):
            c ^= 1 << int(b)
        codes.add(c)
    codes |= {int(x) for x in rng.integers(0, 1 << 62, 100)}
    signed = [int(np.uint64(c).astype(np.int64)) for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "code long")
    links = simhash.links(frame, piece=piece)
    assert links.where(F.bit_count(F.col("code").bitwiseXOR(F.col("other"))) > 6 * 64).count() == 0
    tied = {r["node"]: r["root"] for r in simhash.components(links, "code", "other").collect()}
    unsigned = lambda c: c & (1 << 64) - 1
    want = slow_components([(c, unsigned(c)) for c in signed])
    groups = lambda of: {frozenset(c for c in signed if of(c) == r) for r in map(of, signed)}
    assert groups(lambda c: tied.get(c, c)) == groups(lambda c: want[c])


def test_forest_follows_only_near_edges():
    rng = np.random.default_rng(0)
    code = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    forest = simhash.BKForest(np.zeros(len(code), int), code)
    children = np.flatnonzero(forest.parent >= 0)
    assert (np.bitwise_count(code[children] ^ code[forest.parent[children]]) == forest.edge[children]).all()
    assert len({(p, e) for p, e in zip(forest.parent[children].tolist(), forest.edge[children].tolist(), strict=True)}) == len(children)


def slow_lines(rows, least=20, docs_=3):
    """{row: (n_lines, n_dropped, kept)}."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held.get(key(x), ())) < docs_ or d == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_lines_against_brute_force(spark, docs, batches, fanout):
    rng = np.random.default_rng(9)
    pool = [f"Shared line number {k} of the collection" for k in range(12)] + ["short", "", "ÄÖÜ twenty characters é", "ÄÖÜ TWENTY characters é"]
    rows = [(k, "\n".join("\t " * int(rng.integers(0, 2)) + str(x).upper() * 1 if rng.random() < 0.3 else str(x) for x in rng.choice(pool, rng.integers(1, 9)))) for k in range(60)]
    rows += [(k + 1000, t) for k, t in enumerate(ODD)] + [(None, pool[0]), (5, rows[5][1]), (59, pool[1])]
    frame = docs(rows).withColumn("n_lines", F.lit("clash"))
    done = line_dedup.drop_repeated_lines(frame, batches=batches, fanout=fanout)
    assert done.columns == [*docs([]).columns, "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in done.collect()), key=str) == slow_lines(rows)


def test_no_lines(spark, docs):
    assert line_dedup.drop_repeated_lines(docs([])).count() == 0
    assert [tuple(r)[-2:] for r in line_dedup.drop_repeated_lines(docs([(1, None)])).collect()] == [(1, 0)]


def test_hot_and_cold_keys_meet_alike(spark):
    lines = spark.createDataFrame([(bytes([k % 7]), k) for k in range(3000)], "key binary, doc_id long")
    repeated = lines.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")).where(F.col("key") != b"\x03")
    for hot in (1, 10**6):
        assert line_dedup._meet(lines, 3000, repeated, hot).count() == lines.where(F.col("key") != b"\x03").count()


def test_runs_hold_each_key_once(spark):
    runs = line_dedup.LineRuns(fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(bytes([j]), 10 * k + j) for j in range(k, k + 3)], "key binary, doc_id long"))
    first = [r["key"] for level in runs.first for run in level for r in run.collect()]
    assert len(first) == len(set(first)) == 7 and max(map(len, runs.first)) < 2
    got = {bytes(r["key"])[0]: (r["docs"], r["last"]) for r in runs.repeated(1).collect()}
    assert got == {j: (sum(k <= j < k + 3 for k in range(5)), max(10 * k + j for k in range(5) if k <= j < k + 3)) for j in range(7)}


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "line dedup", "SimHash near-dedup", "packing"]
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    state = whole
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = state.count()
        state = spark.createDataFrame(stage(spark, state, SF).collect(), whole.schema)
        assert state.columns == whole.columns and 0 < state.count() <= before, name
    packed = corpus_pipeline.STAGES[-1][1](spark, state, SF)
    assert packed.select("doc_id").distinct().count() == state.count()
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length").alias("n")).first()["n"] == packed.agg(F.sum("length").alias("n")).first()["n"]


def test_pipeline_stages_on_odd_rows(spark, docs):
    import corpus_pipeline

    rows = docs([*enumerate(ODD), (3, "a"), (None, "some words that are here"), (None, None)])
    kept = docs([])
    for frame in (rows, kept):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == rows.columns and out.count() <= frame.count(), name
    one = corpus_pipeline.keep_one_of_near_duplicates(spark, docs([(5, "the same text here"), (2, "the same text here"), (9, "another one altogether")]), SF)
    assert sorted(r["doc_id"] for r in one.collect()) == [2, 9]
    cut = corpus_pipeline.drop_repeated_lines(spark, docs([(k, "a line that is in all of them\nown " + str(k)) for k in range(4)]), SF).orderBy("doc_id").collect()
    assert [r["n_chars"] for r in cut] == [len(r["text"]) for r in cut] == [5, 5, 5, 35]


def test_near_duplicates_go_by_rows(spark, docs):
    import corpus_pipeline

    one, other = "the same text here, which is long enough", "a wholly different text that nobody else has got"
    rows = [(1, one), (5, one), (5, other), (None, one), (None, "no id, and no other row says this at all"), (1, one)]
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs(rows), SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


def test_kept_digest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in slow_lines([(r["doc_id"], r["text"]) for r in docs])}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op10_line_dedup(spark, SF).collect()} == want


def test_names_that_clash(spark, docs):
    import corpus_pipeline

    line = "a line that is in all of them"
    odd = [c for c in "_drop_keys _drop_doc _cut row cut drop_keys _toxic toxic _lang told _lost _own own code key text_ n_dropped_".split() if c not in docs([]).columns]
    frame = docs([(k, f"{line}\nown words of number {k}") for k in range(5)]).withColumns({c: F.lit(c) for c in odd})
    done = line_dedup.drop_repeated_lines(frame).collect()
    assert len(done) == 5 and sorted(r["n_dropped"] for r in done) == [0, 1, 1, 1, 1] and all(r[c] == c for r in done for c in odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns
        assert all(r[c] == c for r in out.collect() for c in odd)


def test_batches_meet_runs_without_an_exchange(spark):
    runs = line_dedup.LineRuns(fanout=9)
    for k in range(2):
        runs.add(spark.createDataFrame([(bytes([j]), 10 * k + j) for j in range(50)], "key binary, doc_id long"))
    one, two = runs.first[0]
    plan = two.join(one.select("key").hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_copies_of_a_fingerprint_are_as_many_at_any_size(spark):
    rng = np.random.default_rng(5)
    for n in (1_000, 20_000):
        codes = spark.createDataFrame([(int(c),) for c in rng.integers(-(1 << 63), 1 << 63, n, np.int64)], "code long")
        assert simhash.links(codes).count() == 0
    assert len(list(simhash._blocks(3))) == 5


def test_pipeline_against_plain_python(spark):
    """Line removal, near-duplicates and packing of what the classifiers keep, in plain Python."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"] for r in queries.op7_toxicity(spark, SF).collect() if r["predicted"]}
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    rows = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_known_languages(spark, kept, SF).collect()]
    texts = {d: t for d, _, _, t in slow_lines(rows)}
    root = slow_components([(d, slow_print(t)) for d, t in texts.items()])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items() if root[d] == d}
    pieces = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda p: (p["doc_id"], p["start"]))
    assert {p["doc_id"] for p in pieces} == set(want)
    at = dict.fromkeys(want, 0)
    ends = {}
    for p in pieces:
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(want[p["doc_id"]]) and p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at[p["doc_id"]] += p["length"]
        ends.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert all(at[d] == len(ids) for d, ids in want.items())
    for parts in ends.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
