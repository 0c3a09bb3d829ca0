"""One query for each operator, over whole tables with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, langid, line_dedup, ogg, packing, quality, rules, simhash, toxicity
from .common import checkpoint, fold, sampled, table

#: Fixed values of the contract: least scores of predictions.
QUALITY_FROM, TOXIC_FROM = 0.3, 0.7


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str, label: str, learn, bound: int) -> DataFrame:
    """(key, text, label) of documents with a label 0 or 1 that the condition `learn` on doc_id lets in, for as many as `bound`
    doc_ids, those that hash lowest. Ids alone are joined to choose them; the chosen, so few, are broadcast to the texts."""
    known = table(spark, sf_dir, "labels", "doc_id", label).where(F.col(label).isin(0, 1))
    known = known.select(F.col("doc_id").alias("key"), F.col(label).alias("label")).where(learn(F.col("key")))
    there = docs.select("doc_id").where(learn(F.col("doc_id")))
    chosen = checkpoint(sampled(known.join(there, F.col("key") == F.col("doc_id"), "left_semi"), "key", bound))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("key")).select("key", "text", "label")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    digests = bpe.round_trip(F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", digests.alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256", "d.offsets_crc32")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(labelled(spark, docs, sf_dir, "quality", lambda d: fold(d, 5) != 0, quality.TRAIN_ROWS))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_FROM).cast("int"))


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, ids) of documents for packing."""
    ids = packing.token_column(
        F.col("text"), public_tokenizers.path("byte_bpe_50k.json"), width=2, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN
    )
    return docs.select("doc_id", ids.alias("ids"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(encoded(docs), width=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    model = html_extract.fit(pages)
    return pages.select("page_id", "url", html_extract.main_text(F.col("html"), model).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held).select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")))
    told = docs.select("doc_id", held.alias("held_out"), langid.predict(F.col("text"), model).alias("p"))
    return told.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", ogg.stored(F.col("text")).alias("m")).select("doc_id", "m.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(labelled(spark, docs, sf_dir, "toxic", lambda d: fold(d, 3) != 1, toxicity.TRAIN_ROWS))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").select("doc_id", F.col("quality").alias("label"))
    found = rules.judged(docs, labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, i, line, coalesce(doc_id < last, false) AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe, op2_quality, op3_packing, op4_html, op5_langid, op6_ogg, op7_toxicity, op8_rules, op9_simhash, op10_line_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": LINE_DEDUP_SQL}
