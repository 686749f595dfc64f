"""Corpus pipeline: raw documents in, a mixed and tokenised training set out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, langid
from ledgerloom.llm.common import ship, stage, table
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.jaccard import jaccard_join
from ledgerloom.llm.mixing import mix


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: ``und`` texts (null or without a letter) go, ambiguous ones stay.

    Labels are learned from the rows outside the held-out fold; without any, every text with a letter stays.
    Repeated rows are all judged alike.
    """
    ship(spark)
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.keep_recognised(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each group of identical texts; null counts as empty.

    Of rows repeated with the same id and text one stays.
    """
    ship(spark)
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha_own") == F.col("_sha"))
    again = Window.partitionBy("doc_id", "_sha_own").orderBy("source", "lang", "n_chars")
    return (
        docs.withColumn("_sha_own", sha).join(kept, same, "left_semi")
        .withColumn("_again", F.row_number().over(again)).filter("_again = 1").select(*docs.columns)
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by similar word shingles."""
    ship(spark)
    gone = jaccard_join(docs).filter("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order: each as many times as the mix takes at least half of it.

    Documents that the mix does not reach, empty texts among them, go. Rows that share an id but not
    a text all take the positions of the first of them.
    """
    ship(spark)
    placed = mix(docs).filter("size(positions) > 0").groupBy("doc_id").agg(F.min("positions").alias("_at"))
    return (
        docs.join(placed, docs["doc_id"].eqNullSafe(placed["doc_id"]))
        .select(*[docs[c] for c in docs.columns], F.explode("_at").alias("_at"))
        .orderBy("_at", docs["doc_id"]).select(*docs.columns)
    )


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document, decoded again as a check."""
    ship(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digest(bpe.bpe_round_trip(docs, path, pattern))


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", tokenize),
]

#: Classifier, min-hash tries and byte-pair merges cannot be stated in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
