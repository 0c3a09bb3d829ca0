"""A corpus from raw documents to packed sequences: each stage works on all that the one before it kept.

Documents go if they are toxic, or in no known language; lines that documents share go but for one; of near-duplicates the
document of the least doc_id stays; what is left is packed. Null and empty texts are in no language. Rows that repeat a doc_id
go through all stages as rows of their own, and of near-duplicates all rows of the least doc_id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viastrata.llm import langid, line_dedup, queries, simhash, toxicity
from viastrata.llm.common import fold

#: Language scores below this (0.5 is the decision line of a language) count as no known language.
LEAST_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(queries.labelled(spark, docs, sf_dir, "toxic", lambda d: fold(d, 3) != 1, toxicity.TRAIN_ROWS))
    # Rows go as one column, here and below, so that no name of theirs meets one of ours.
    told = docs.select(F.struct("*").alias("row"), toxicity.score(F.col("text"), model).alias("toxic"))
    return told.where(F.col("toxic") < queries.TOXIC_FROM).select("row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = docs.where(fold(F.col("doc_id"), 4) != 2).select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label"))
    told = docs.select(F.struct("*").alias("row"), langid.predict(F.col("text"), langid.fit(learn)).alias("told"))
    return told.where((F.col("told.lang_pred") != langid.UNDETERMINED) & (F.col("told.score") >= LEAST_SCORE)).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row stays if no document of a smaller doc_id is in the component of its own text; a null doc_id is above all others."""
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    # Rows of one doc_id and one fingerprint share a component, so these two name a row's verdict.
    later = F.col("component_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("component_id") < F.col("doc_id")))
    lost = found.where(later).select("doc_id", "code")
    told = docs.select(F.struct("*").alias("row"), simhash.fingerprint(F.col("text"), simhash.WORDS).alias("own"))
    return told.join(lost, F.col("row")["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("code")), "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("packing", pack),
]

#: No SQL: the scores of the first two stages, and the tokens of the last, are not SQL's to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each result written before the next stage."""
    from viastrata.llm.common import checkpoint

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
